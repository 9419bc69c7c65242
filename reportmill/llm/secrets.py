"""Secret scans with built-in functions only: fixed patterns, and a battery of randomness tests for what they don't know.

Spans are code points, end exclusive. Kinds of the base: assign, access, hex. The battery looks at further runs of
credential characters: it infers an encoding (its alphabet), tests the run against uniform random symbols by chi-squared
counts, runs about the alphabet's middle and lag-1 serial correlation, and combines the three chances (Fisher); the lower
the result, the more random the run.

What is reported is held to a share of false discoveries. Each run has a decoy: as many characters of the same text's own
words, written without blanks in the run's alphabet and tested alike. Decoys show how often ordinary words of that
encoding and length look as random, so that in each stratum of encoding and length the cut is the highest at which the
runs expected to be words are at most ``FALSE_DISCOVERIES`` of those reported; short runs, which tell little, are then
reported only where their stratum holds enough random ones. Tables with few decoys lean on a prior (``PRIOR_DECOYS``). As the decoys go through the same three tests, it does not
matter that these are not independent. Results are binned, and the strata's counts (a bounded table) are all that the
control needs. No cut is beyond ``MOST_BIN``, where one random run in a thousand would be lost if the tests were exact.

Null texts are empty ones. Empty texts and tables give no spans. Very long texts are scanned whole. Repeated rows are
scanned each. Other columns are kept by ``redacted``, whatever their names, and not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of at least the least length are found at once: a shorter run can hide no longer one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The least run that is tested.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Encodings from narrow to wide: name, pattern of the whole run, alphabet.
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("digits", "[0-9]+", _DIGITS),
    ("hex_upper", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]*[2-7][A-Z2-7]*=*", _UP + "234567"),
    ("letters", "[a-z]+|[A-Z][a-z]*|[A-Z]+", _LOW),
    ("base36", "[a-z0-9]+|[A-Z0-9]+", _LOW + _DIGITS),
    ("letters_mixed", "[A-Za-z]+", _LOW + _UP),
    ("base62", "[A-Za-z0-9]+", _LOW + _UP + _DIGITS),
    ("base64", "[A-Za-z0-9+/]+=*", _LOW + _UP + _DIGITS + "+/"),
    ("base64_url", "[A-Za-z0-9_-]+=*", _LOW + _UP + _DIGITS + "-_"),
    ("mixed", ".*", _LOW + _UP + _DIGITS + "+/-_"),
)
#: Encodings of one case: both are read as small letters.
_FOLDED = [i for i, e in enumerate(ENCODINGS) if e[0] in ("letters", "base36")]
_WIDEST = ENCODINGS[-1][2]
FALSE_DISCOVERIES = 0.05
#: What is taken for known before any decoy is seen: so many decoys, of which 2 ** (-length / LOOKS_RANDOM) look random.
PRIOR_DECOYS, LOOKS_RANDOM = 20, 6
_BINS_A_DIGIT, _MOST_BINS, MOST_BIN = 4, 200, 12
_NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once, however often then names it."""
    return F.transform(F.array(value), then)[0]


def _spans(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end>> of the pattern's matches: lengths of what lies between them and of them, summed up."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(found, lambda x: F.struct(F.length(x).alias("f"), (F.length(F.regexp_extract(x, pattern, value_group)) if value_group else F.length(x)).alias("v")))
    both = F.filter(F.arrays_zip(between.alias("b"), parts.alias("m")), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NO_SPANS).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["b"], acc["at"] + x["b"] + x["m"]["f"]
        own = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["m"]["v"] >= least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(both, start, one, lambda acc: acc["out"])).otherwise(F.array().cast(_NO_SPANS))


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by the approximation 7.1.26 of Abramowitz and Stegun."""

    def tail(v: Column) -> Column:
        t = v["t"]
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.greatest(poly * F.exp(-v["x"] * v["x"]), F.lit(1e-50))

    return _let(F.abs(z) / F.sqrt(F.lit(2.0)), lambda x: _let(F.struct(x.alias("x"), (1 / (1 + 0.3275911 * x)).alias("t")), tail))


def _chi_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x), by Wilson and Hilferty's cube root."""
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    halves = lambda z: _let(_normal_tail(z) / 2, lambda h: F.when(z > 0, h).otherwise(1 - h))
    return _let(z, halves)


def encoding_of(run: Column) -> Column:
    """The place in ``ENCODINGS`` of the narrowest alphabet that a run fits."""
    return F.coalesce(*[F.when(run.rlike(f"^(?:{p})$"), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)], F.lit(len(ENCODINGS) - 1))


def against_random(run: Column, encoding: Column) -> Column:
    """-log10 of the combined chance that random symbols of the encoding would give such a run."""
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), encoding + 1)
    symbols = F.rtrim(F.translate(run, "=", " "))
    folded = F.when(encoding.isin(_FOLDED), F.lower(symbols)).otherwise(symbols)

    def coded(x: Column) -> Column:
        # Symbols of a decoy that the alphabet does not hold fold into it.
        own = lambda c: _let(F.position(c, x["alphabet"]), lambda p: F.when(p > 0, p - 1).otherwise(F.pmod(F.position(c, F.lit(_WIDEST)), F.length(x["alphabet"]))))
        codes = F.transform(F.filter(F.split(x["s"], ""), lambda c: c != ""), own)
        return F.struct(F.length(x["alphabet"]).cast("double").alias("a"), codes.alias("codes"))

    named = _let(F.struct(alphabet.alias("alphabet"), folded.alias("s")), coded)
    return _let(_let(_let(named, _counted), _moments), _combined)


def _counted(x: Column) -> Column:
    codes, a = x["codes"], x["a"]
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(codes, lambda y: y == c)).cast("double"), F.lit(2.0)))
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    total = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c)
    return F.struct(
        a.alias("a"),
        codes.alias("codes"),
        pairs.alias("pairs"),
        squares.alias("squares"),
        F.size(codes).cast("double").alias("n"),
        (total / F.size(codes)).alias("centre"),
        F.size(F.filter(codes, lambda c: c >= a / 2)).cast("double").alias("high"),
    )


def _moments(x: Column) -> Column:
    n, a, centre = x["n"], x["a"], x["centre"]
    runs = 1 + F.size(F.filter(x["pairs"], lambda r: (r["p"] >= a / 2) != (r["q"] >= a / 2))).cast("double")
    variance = F.aggregate(x["codes"], F.lit(0.0), lambda s, c: s + (c - centre) * (c - centre))
    lag = F.aggregate(x["pairs"], F.lit(0.0), lambda s, r: s + (r["p"] - centre) * (r["q"] - centre))
    return F.struct(
        n.alias("n"),
        a.alias("a"),
        F.greatest(a / n * x["squares"] - n, F.lit(0.0)).alias("chi"),
        runs.alias("runs"),
        (2 * x["high"] * (n - x["high"]) / n + 1).alias("mean"),
        variance.alias("variance"),
        lag.alias("lag"),
    )


def _combined(x: Column) -> Column:
    spread = (x["mean"] - 1) * (x["mean"] - 2) / F.greatest(x["n"] - 1, F.lit(1.0))
    run = _let(spread, lambda v: F.when(v > 0, _normal_tail((x["runs"] - x["mean"]) / F.sqrt(v))).otherwise(F.lit(1e-6)))
    serial = F.when(x["variance"] > 0, _normal_tail(x["lag"] / x["variance"] * F.sqrt(x["n"]))).otherwise(F.lit(1e-6))
    chi = F.greatest(_chi_tail(x["chi"], x["a"] - 1), F.lit(1e-50))
    fisher = -2 * (F.log(chi) + F.log(run) + F.log(serial))
    return -F.log10(F.greatest(_chi_tail(fisher, F.lit(6.0)), F.lit(1e-50)))


def _matched(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_row (the columns to keep), _base and _found: further runs with a decoy each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(_spans(text, ASSIGN, "assign", 2, 12), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))
    runs = F.arrays_zip(_spans(text, RUN, "random").alias("s"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("t"))
    words = F.regexp_replace(F.regexp_replace(text, RUN, " "), "[^A-Za-z0-9]+", "")

    def with_decoys(own: Column) -> Column:
        def one(r: Column) -> Column:
            room = F.length(own) - F.length(r["t"])
            decoy = F.when(room >= 0, F.substring(own, F.pmod(r["s"]["start"], F.greatest(room, F.lit(0)) + 1) + 1, F.length(r["t"])))
            return F.struct(r["s"]["start"].alias("start"), r["s"]["kind"].alias("kind"), r["s"]["end"].alias("end"), r["t"].alias("run"), decoy.alias("decoy"))

        return F.transform(runs, one)

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,run:string,decoy:string>>")
    found = F.when(text.rlike(RUN), _let(words, with_decoys)).otherwise(empty)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), base.alias("_base"), found.alias("_found"))


def _tested(matched: DataFrame) -> DataFrame:
    """_row, _base and _runs: the runs beside the base's spans with their encoding, length band and bins."""
    free = F.filter("_found", lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    binned = lambda s, e: F.least(F.floor(against_random(s, e) * _BINS_A_DIGIT), F.lit(_MOST_BINS)).cast("int")

    def tested(r: Column) -> Column:
        def shaped(e: Column) -> Column:
            return F.struct(
                r["start"].alias("start"),
                r["kind"].alias("kind"),
                r["end"].alias("end"),
                e.alias("encoding"),
                F.least(F.floor(2 * F.log2(F.length(r["run"]))), F.lit(20)).cast("int").alias("band"),
                binned(r["run"], e).alias("bin"),
                F.when(r["decoy"].isNotNull(), binned(r["decoy"], e)).alias("decoy_bin"),
            )

        return _let(encoding_of(r["run"]), shaped)

    return matched.select("_row", "_base", F.transform(free, tested).alias("_runs"))


def thresholds(tested: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[tuple[int, int], int]:
    """By encoding and length band, the highest bin that is reported; a bounded table reaches the driver."""
    seen = lambda c, own: F.struct(F.col(c).alias("bin"), F.lit(own).alias("own"), F.lit(1 - own).alias("decoy"))
    each = tested.select(F.explode("_runs").alias("r")).select("r.encoding", "r.band", F.explode(F.array(seen("r.bin", 1), seen("r.decoy_bin", 0))).alias("x"))
    counts = each.filter("x.bin is not null").groupBy("encoding", "band", "x.bin").agg(F.sum("x.own").alias("own"), F.sum("x.decoy").alias("decoys"))
    stratum = Window.partitionBy("encoding", "band")
    upto = stratum.orderBy("bin")
    prior = PRIOR_DECOYS * F.pow(F.lit(2.0), -F.pow(F.lit(2.0), F.col("band") / 2) / LOOKS_RANDOM)
    words = F.sum("own").over(stratum) * (F.sum("decoys").over(upto) + prior) / (F.sum("decoys").over(stratum) + PRIOR_DECOYS)
    ranked = counts.select("encoding", "band", "bin", (words <= q * F.sum("own").over(upto)).alias("fine"))
    rows = ranked.filter(F.col("fine") & (F.col("bin") <= MOST_BIN)).groupBy("encoding", "band").agg(F.max("bin").alias("bin")).collect()
    return {(r["encoding"], r["band"]): r["bin"] for r in rows}


def _with_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """_row, _base, _spans: array<struct<start, kind, end>>, by start, then kind as listed. Texts are scanned once."""
    tested = stored(_tested(stored(_matched(docs, keep), "secret-matches")), "secret-tests")
    known = thresholds(tested)
    if known:
        limits = F.create_map(*[F.lit(x) for (e, b), v in sorted(known.items()) for x in (e * 100 + b, v)])
    else:
        limits = F.lit(None).cast("map<int,int>")
    random = F.filter("_runs", lambda r: r["bin"] <= F.coalesce(limits[r["encoding"] * 100 + r["band"]], F.lit(-1)))
    added = F.transform(random, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    return tested.select("_row", "_base", F.array_sort(F.concat("_base", added)).alias("_spans"))


def with_spans(docs: DataFrame) -> DataFrame:
    """The documents with base and spans (in place of columns of these names)."""
    found = _with_spans(docs, docs.columns)
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("base", "spans")]
    return found.select(*own, F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents' own columns; every found span of text gives way to the mark, and n_chars follows where it is a column."""
    found = _with_spans(docs, docs.columns)
    own = F.col("_row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(own, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("_spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))))
    out = found.select("_row", F.when(F.size("_spans") > 0, whole).otherwise(own).alias("_text"), (F.size("_spans") > 0).alias("_cut"))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_cut"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[c.alias(name) for name, c in columns.items()])


def op6_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(F.col("_row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"))
