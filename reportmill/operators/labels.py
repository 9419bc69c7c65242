"""Label sets: long form, precedence, adjudication, agreement, validation, training rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import BINS, u

CHECKS = ("summary_what", "summary_where", "summary_when", "steps", "expected", "actual", "build_version")
BATCH = 20


def to_long(wide: DataFrame, value: str = "gold") -> DataFrame:
    """(id, check, value) of seven columns."""
    return wide.unpivot("id", list(CHECKS), "check", value)


def latest_labels(files: list[DataFrame]) -> DataFrame:
    """One row an id, from the last file that has it."""
    ranked = reduce(DataFrame.unionByName, [f.withColumn("_file", F.lit(i)) for i, f in enumerate(files)])
    row = F.struct(*[c for c in files[0].columns if c != "id"])
    return ranked.groupBy("id").agg(F.max_by(row, "_file").alias("r")).select("id", "r.*")


def adjudicated(primary: DataFrame, rulings: DataFrame) -> DataFrame:
    """(id, check, gold), a ruling first."""
    return primary.join(rulings.select("id", "check", F.col("gold").alias("ruled")), ["id", "check"], "left").select("id", "check", F.coalesce("ruled", "gold").alias("gold"), F.col("ruled").isNotNull().alias("was_ruled"))


def id_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of one set only, and which lacks them."""
    left, right = (x.select("id").distinct().withColumn(f"in_{s}", F.lit(True)) for x, s in ((a, "a"), (b, "b")))
    return left.join(right, "id", "full_outer").filter("in_a is null or in_b is null").select("id", F.when(F.col("in_a").isNull(), "extra").otherwise("missing").alias("problem"))


def without_label(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """J2."""
    return reports.select("id").join(labels.select("id"), "id", "left_anti")


def agreement(reference: DataFrame, labels: DataFrame, least: float = 0.85) -> DataFrame:
    """A10: by check; the minority class is the reference's rarer one, no on a tie."""
    both = reference.select("id", "check", F.col("gold").alias("r")).join(labels.select("id", "check", F.col("gold").alias("l")), ["id", "check"])
    counts = both.groupBy("check").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("r") == F.col("l")).alias("agree"),
        F.count_if("r").alias("yes"),
        F.count_if(F.col("r") & F.col("l")).alias("yes_agree"),
        F.count_if(~F.col("r")).alias("no"),
        F.count_if(~F.col("r") & ~F.col("l")).alias("no_agree"),
    )
    rarer_yes = F.col("yes") < F.col("no")
    return counts.select("check", "n", "agree", F.when(rarer_yes, "yes").otherwise("no").alias("minority"), F.when(rarer_yes, F.col("yes")).otherwise(F.col("no")).alias("minority_n"), F.when(rarer_yes, F.col("yes_agree")).otherwise(F.col("no_agree")).alias("minority_agree"), (F.col("agree") >= least * F.col("n")).alias("passes"))


def balance(labels: DataFrame) -> DataFrame:
    """Share of yes by set and check."""
    return labels.groupBy("set", "check").agg(F.avg(F.col("gold").cast("int")).alias("share_yes"), F.count("*").alias("n"))


def answer_problems(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """Every problem of a label file at once. answers(line, answer: JSON text), ids(id) as asked for."""
    typed = F.from_json("answer", ", ".join(f"{c} boolean" for c in CHECKS))
    parsed = answers.withColumns({"m": F.from_json("answer", "map<string,string>"), "typed": typed})
    broken = parsed.filter("m is null").select(F.lit("broken").alias("rule"), F.concat(F.lit("line "), F.col("line")).alias("key"))
    good = parsed.filter("m is not null").withColumn("id", F.coalesce(F.col("m")["id"], F.lit("")))
    wanted = F.array(*map(F.lit, CHECKS))
    have = F.filter(F.map_keys("m"), lambda k: k != "id")

    def each(rule: str, keys: Column) -> DataFrame:
        return good.select(F.lit(rule).alias("rule"), F.explode(F.transform(keys, lambda k: F.concat_ws(":", F.col("id"), k))).alias("key"))

    # A JSON string, number or null is no boolean: read as one it gives null.
    boolean = F.map_from_arrays(wanted, F.array(*[F.col(f"typed.{c}") for c in CHECKS]))
    not_boolean = F.filter(F.array_intersect(have, wanted), lambda k: F.element_at(boolean, k).isNull())
    given = good.select("id")
    out = [
        broken,
        each("missing key", F.array_except(wanted, have)),
        each("extra key", F.array_except(have, wanted)),
        each("not boolean", not_boolean),
        ids.join(given, "id", "left_anti").select(F.lit("missing id").alias("rule"), F.col("id").alias("key")),
        given.join(ids, "id", "left_anti").distinct().select(F.lit("foreign id").alias("rule"), F.col("id").alias("key")),
        given.groupBy("id").count().filter("count > 1").select(F.lit("duplicate id").alias("rule"), F.col("id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, out)


def thin_codes(specs: DataFrame, codes: tuple[str, ...], least: int = 8) -> DataFrame:
    """The listed codes that fewer than least specs(codes array) have, those in none included."""
    spark = specs.sparkSession
    every = spark.createDataFrame([(c,) for c in codes], "code string")
    counts = specs.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return every.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def record_problems(specs: DataFrame, records: DataFrame, allowed: tuple[str, ...], codes: tuple[str, ...]) -> DataFrame:
    """(rule, id, found) of generated records(id, summary, description) against specs(id), all at once."""
    from ..sources.issues import foreign_hosts

    none = F.lit(None).cast("string").alias("found")
    rule = lambda name: F.lit(name).alias("rule")
    given, asked = records.select("id").distinct(), specs.select("id").distinct()
    blank = [records.filter(F.coalesce(F.trim(c), F.lit("")) == "").select(rule("blank"), "id", F.lit(c).alias("found")) for c in ("summary", "description")]
    twice = records.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    text = records.select("id", F.concat_ws("\n", "summary", "description").alias("text"))
    out = [
        asked.join(given, "id", "left_anti").select(rule("missing id"), "id", none),
        given.join(asked, "id", "left_anti").select(rule("foreign id"), "id", none),
        twice.select(rule("duplicate id"), "id", F.col("n").cast("string").alias("found")),
        *blank,
        foreign_hosts(text, allowed, codes).select("rule", "id", "found"),
    ]
    return reduce(DataFrame.unionByName, out)


#: What each check asks of a report; the wording is our own, as a model is trained on the rows that hold it.
QUESTIONS = {
    "summary_what": "Is the fault itself named in the title?",
    "summary_where": "Is the place of the fault (a screen, function or part) named in the title?",
    "summary_when": "Is the action or condition that brings the fault about named in the title?",
    "steps": "Can a reader repeat the fault from what the description says?",
    "expected": "Does the description say what ought to happen?",
    "actual": "Does the description say what happens instead?",
    "build_version": "Is the build in which the fault was seen named exactly?",
}
CRITERIA = {"true": "present", "false": "missing"}


def questions() -> Column:
    """the question map as a column: check -> struct<type, text, criteria>."""
    criteria = F.create_map(*[F.lit(x) for kv in CRITERIA.items() for x in kv])
    each = [x for c in CHECKS for x in (F.lit(c), F.struct(F.lit("noul").alias("type"), F.lit(QUESTIONS[c]).alias("text"), criteria.alias("criteria")))]
    return F.create_map(*each)


#: The fields of an assembled row.
FIELDS = ("set", "id", "source", "tracker", "project", "summary", "description")


def unexpected_fields(sets: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(rule, key, detail) of columns that an assembled row should not have, with the rows that hold a value there."""
    extra = [c for c in sets.columns if c not in fields]
    if not extra:
        return sets.sparkSession.createDataFrame([], "rule string, key string, detail string")
    held = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in extra]))
    return sets.select(F.lit("unexpected field").alias("rule"), F.col("id").alias("key"), F.explode(held).alias("detail"))


#: JSON without single quotes or NaN, and with strings of any length: by default, those of over 20,000,000 characters are refused.
STRICT_JSON = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def raw_rows(lines: DataFrame) -> DataFrame:
    """lines(set, raw: a JSON object) with ``row`` (MAP of field to text, null where the line is no object or has a field twice) and the fields of FIELDS."""
    read = F.array(F.from_json("raw", "map<string,string>", STRICT_JSON))  # named twice below, read once
    once = lambda r: F.when(F.size(F.array_distinct(F.map_keys(r))) == F.size(F.map_keys(r)), r)
    parsed = lines.withColumn("row", F.transform(read, once)[0])
    return parsed.select("set", "raw", "row", *[F.col("row")[c].alias(c) for c in FIELDS if c != "set"])


def raw_set_problems(lines: DataFrame, sizes: dict[tuple[str, str], int], optional: tuple[str, ...] = ("core",)) -> DataFrame:
    """A14 over raw JSON lines(set, raw): (rule, key, detail) of every problem at once.

    Beside the rules of ``set_problems``: lines that are no object, fields that a row should not have, whatever their type, and
    fields that it lacks. A row is named by its id, one without by the line itself.
    """
    rows = raw_rows(lines)
    name = F.coalesce("id", F.substring("raw", 1, 80)).alias("key")
    broken = rows.filter("row is null").select(F.lit("broken").alias("rule"), F.substring("raw", 1, 80).alias("key"), F.lit(None).cast("string").alias("detail"))
    good = rows.filter("row is not null")
    wanted = [c for c in FIELDS if c != "set"]
    extra = good.select(name, F.explode(F.map_keys("row")).alias("field")).filter(~F.col("field").isin(*wanted, *optional)).select(F.lit("unexpected field").alias("rule"), "key", F.col("field").alias("detail"))
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in wanted if c not in ("summary", "description")]))
    lacks = good.select(F.lit("missing field").alias("rule"), name, F.explode(absent).alias("detail"))
    return reduce(DataFrame.unionByName, [broken, extra, lacks, set_problems(good.select(*FIELDS), sizes)])


def set_problems(sets: DataFrame, sizes: dict[tuple[str, str], int]) -> DataFrame:
    """(rule, key, detail) of assembled sets (set, id, source, tracker, project, summary, description).

    Columns beyond these are looked at by ``unexpected_fields``.
    """
    spark = sets.sparkSession
    wanted = spark.createDataFrame([(s, f, n) for (s, f), n in sizes.items()], "set string, source string, wanted long")
    counts = sets.groupBy("set", "source").agg(F.count("*").alias("n")).join(F.broadcast(wanted), ["set", "source"], "full_outer")
    wrong = counts.filter(F.coalesce("n", F.lit(0)) != F.coalesce("wanted", F.lit(0))).select(F.lit("count").alias("rule"), F.concat_ws("/", "set", "source").alias("key"), F.coalesce("n", F.lit(0)).cast("string").alias("detail"))
    blank = reduce(DataFrame.unionByName, [sets.filter(F.coalesce(F.trim(c), F.lit("")) == "").select(F.lit("blank").alias("rule"), F.col("id").alias("key"), F.lit(c).alias("detail")) for c in ("summary", "description")])
    twice = sets.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("rule"), F.col("id").alias("key"), F.col("n").cast("string").alias("detail"))
    shared = sets.groupBy("tracker", "project").agg(F.countDistinct("set").alias("n")).filter("n > 1").select(F.lit("shared project").alias("rule"), F.concat_ws("/", "tracker", "project").alias("key"), F.col("n").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [wrong, blank, twice, shared])


def assembled(public: DataFrame, generated: DataFrame) -> DataFrame:
    """U4: one table of sets by the ids' prefixes; generated style rows are a set of their own."""
    style = F.col("id").startswith("syn-style-")
    return public.unionByName(generated.withColumn("set", F.when(style, "style").otherwise("train")))


def training_rows(reports: DataFrame, labels: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """Id, state, questions (F4), gold map of check to (false, true, label) with smoothed targets. labels in long form."""
    target = F.when(F.col("gold"), 1 - smoothing / 2).otherwise(smoothing / 2)
    entry = F.struct("check", F.struct((1 - target).alias("p_false"), target.alias("p_true"), F.col("gold").alias("label")))
    gold = labels.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("gold"))
    return reports.select("id", F.struct("summary", "description").alias("state"), questions().alias("questions")).join(gold, "id")


def batches(reports: DataFrame, size: int = BATCH, seed: str = "batches") -> DataFrame:
    """(batch, lines, n): batches of size reports as JSON lines, holding only id and text, in the order of chance.

    Numbers come from two passes: rows are counted by fixed ranges of chance and the counts are summed up; a row's number is what
    the ranges before hold and its place within its own. So the batches are the same under any partitioning, and no task sees more
    than a range of rows, the counts or a batch. ids are unique.
    """
    chance = u(seed, F.col("id"))
    rows = reports.select("id", chance.alias("u"), F.floor(chance * BINS).alias("bin"), F.to_json(F.struct("id", "summary", "description")).alias("line"))
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"))
    before = counts.select("bin", (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("before"))  # BINS rows at most
    nth = F.row_number().over(Window.partitionBy("bin").orderBy("u", "id"))
    numbered = rows.withColumn("nth", nth).join(before, "bin").withColumn("batch", F.floor((F.col("before") + F.col("nth") - 1) / size))
    ordered = F.sort_array(F.collect_list(F.struct("u", "id", "line")))
    return numbered.groupBy("batch").agg(ordered.alias("l")).select("batch", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"), F.size("l").alias("n"))
