"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are counts of hashed byte 1- to 4-grams of the text's lower-cased letters, square-rooted and scaled to length 1; one
pass over a text's bytes gives them. Machines are fitted by dual coordinate descent on a bounded sample: up to
``SAMPLE`` documents of each language, those with the smallest hash of their id, so reruns and partitionings agree. Each
pair's machine is fitted in a task of its own; families are told apart the same way, one versus one.

A null text, or one without a letter, is ``und`` with score 0. Without any learnable row all are ``und``. Null langs are
never learned; repeated rows count once each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod4, stored, table

DIMENSIONS = 4096
#: Documents of a language to fit on, at most.
SAMPLE = 600
#: Samples of a language that a bound on the hash lets pass, about.
SPARE = 4
#: Ids of the sample are broadcast up to so many, by its bound.
BROADCAST_ROWS = 100_000
#: Families of ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "dravidian": "kn ml ta te",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "iranian": "fa ku ps tg",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(texts: list[str | None], d: int = DIMENSIONS) -> np.ndarray:
    """A row a text: roots of hashed n-gram counts, of length 1 (0 without any)."""
    raws = [np.frombuffer(b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b" ", np.uint8) for t in texts]
    out = np.zeros((len(raws), d), np.float32)
    for i, raw in enumerate(raws):
        # Letters stay, all else becomes one blank; bytes from 128 on belong to letters of other alphabets.
        b = np.where((raw >= 97) & (raw <= 122) | (raw >= 128), raw, 32).astype(np.uint32)
        b = b[(b != 32) | (np.concatenate([[0], b[:-1]]) != 32)]
        code, total = b.copy(), np.zeros(d, np.int64)
        for n in range(4):
            if n:
                code = code[: len(b) - n] * np.uint32(0x01000193) ^ b[n:]
            total += np.bincount(((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - d.bit_length() + 1)).astype(np.int64), minlength=d)
        row = np.sqrt(total.astype(np.float32))
        out[i] = row / max(float(np.sqrt((row * row).sum())), 1e-9)
    return out


def fit(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear support vector machine (the last one is the bias); y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """Machines by pair of classes: families, and languages of one family."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str, str], np.ndarray]):
        self.langs = sorted(langs)
        self.families = sorted({family(x) for x in langs})
        self.machines = machines
        self.keys = sorted(machines)
        self.weights = np.array([machines[k] for k in self.keys]) if machines else np.zeros((0, DIMENSIONS + 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        x = features(texts)
        margin = dict(zip(self.keys, (x @ self.weights[:, :-1].T + self.weights[:, -1]).T, strict=True))
        fam, sure = self._vote("family", self.families, margin, len(x))
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for i, f in enumerate(self.families):
            at = np.flatnonzero(fam == i)
            own = [x for x in self.langs if family(x) == f]
            lang, s = self._vote("lang", own, {k: m[at] for k, m in margin.items()}, len(at))
            out[at], score[at] = np.array(own, object)[lang], sure[at] * s
        return list(out), score

    def _vote(self, level: str, classes: list[str], margin: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The class that wins most pairs, ties by the sum of margins; its least chance against another as its score."""
        votes, sums, least = (np.full((n, len(classes)), v) for v in (0.0, 0.0, 1.0))
        for (i, a), (j, b) in combinations(enumerate(classes), 2):
            m = margin[level, a, b]
            chance = 1 / (1 + np.exp(-3 * m))
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
            least[:, i], least[:, j] = np.minimum(least[:, i], chance), np.minimum(least[:, j], 1 - chance)
        best = (votes + 1e-3 * np.tanh(sums)).argmax(1) if len(classes) else np.zeros(n, int)
        return best, least[np.arange(n), best]


def _least(seen: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """Rows of seen(doc_id, lang, _hash) that surely hold each language's ``sample`` least hashes, most other rows left out.

    A bound on the hash lets about SPARE samples of a language pass. It holds only for languages of which enough rows do
    pass (repeated ids share a hash); the others keep all their rows.
    """
    bounds = {x: int((SPARE * sample / n - 0.5) * 2.0**64) for x, n in counts.items() if n > 2 * SPARE * sample}
    if not bounds:
        return seen

    def passing(bounds: dict[str, int]) -> DataFrame:
        bound = F.create_map(*[F.lit(x) for item in bounds.items() for x in item])[F.col("lang")]
        return seen.filter(bound.isNull() | (F.col("_hash") < bound))

    passed = passing(bounds).groupBy("lang").count().filter(F.col("count") >= sample).collect()
    sure = {r["lang"]: bounds[r["lang"]] for r in passed if r["lang"] in bounds}
    return passing(sure) if sure else seen


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents(doc_id, text, lang); the sample's features, not its texts, are dealt to the pairs' tasks."""
    spark = docs.sparkSession
    seen = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull()).withColumn("_hash", F.xxhash64(F.lit(3), "doc_id"))
    counts = {r["lang"]: r["count"] for r in seen.groupBy("lang").count().collect()}
    langs = sorted(counts)
    first = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    few = _least(seen, counts, sample)
    chosen = few.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= sample).select("doc_id", "lang").distinct()
    if sample * len(langs) <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    picked = docs.filter(F.col("lang").isNotNull()).join(chosen, ["doc_id", "lang"]).select("lang", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                few = pdf.iloc[i : i + 64]
                yield pd.DataFrame({"lang": few["lang"].tolist(), "x": [r.tobytes() for r in features(few["text"].tolist())]})

    rows = stored(picked.mapInPandas(vectors, "lang string, x binary"), "language-sample")
    families = sorted({family(x) for x in langs})
    pairs = [("family", a, b) for a, b in combinations(families, 2)] + [("lang", a, b) for a, b in combinations(langs, 2) if family(a) == family(b)]
    sides = [(k, lang, y) for k, (level, a, b) in enumerate(pairs) for lang in langs for y, name in ((1, a), (-1, b)) if (family(lang) if level == "family" else lang) == name]
    if not pairs:
        return Model(langs, {})
    dealt = rows.join(F.broadcast(spark.createDataFrame(sides, "pair int, lang string, y int")), "lang")

    def machine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "x"])
        w = fit(np.stack([np.frombuffer(x, np.float32) for x in pdf["x"]]), pdf["y"].to_numpy(float))
        return pd.DataFrame({"pair": pdf["pair"].iloc[:1], "w": [w.tobytes()]})

    fitted = dealt.groupBy("pair").applyInPandas(machine, "pair int, w binary").collect()
    return Model(langs, {pairs[r["pair"]]: np.frombuffer(r["w"]) for r in fitted})


def predicted(model: Model, text: Column) -> Column:
    """struct<lang_pred, score> of a text column; other columns don't pass through Python."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(texts), 64):
            few = texts.iloc[i : i + 64].tolist()
            lang, score = model.predict(few)
            none = np.array([not any(c.isalpha() for c in t or "") for t in few], bool) | (not model.langs)
            out.append(pd.DataFrame({"lang_pred": np.where(none, "und", np.array(lang, object)), "score": np.where(none, 0.0, score)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": []})

    return predict.asNondeterministic()(text)  # else a filter on the prediction works it out a second time


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred and score (in place of columns of these names)."""
    found = docs.withColumn("_found", predicted(model, F.col("text")))
    return found.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod4("doc_id") == 2
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
