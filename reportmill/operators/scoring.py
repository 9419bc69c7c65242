"""Model states as a predictor sees them: JSON, tokens with offsets, overlapping windows; and a store of recorded answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import giving_back, small_batches
from .decide import state_key
from .labels import CHECKS

#: Tokens of a state that a predictor reads at once, and how many of them the next window sees again.
ROOM, OVERLAP = 767, 128
#: Texts that a tokenizer gets at once.
AT_ONCE = 256

#: Gives each text's tokens as (begin, end) in characters.
Tokenizer = Callable[[list[str]], list[list[tuple[int, int]]]]


def state_json(summary: str = "summary", description: str = "description") -> Column:
    """The JSON of a cleaned state; null is empty."""
    return F.to_json(F.struct(F.coalesce(summary, F.lit("")).alias("summary"), F.coalesce(description, F.lit("")).alias("description")))


def by_blanks() -> Tokenizer:
    """Tokens that ASCII blanks part."""
    word = re.compile(r"[^ \t\n\r\f\v]+")
    return lambda texts: [[m.span() for m in word.finditer(t)] for t in texts]


def by_file(path: str) -> Callable[[], Tokenizer]:
    """Makes the tokenizer of a file (of the tokenizers library), without special tokens; made once a task."""

    def make() -> Tokenizer:
        from tokenizers import Tokenizer as Library

        own = Library.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [e.offsets for e in own.encode_batch(texts, add_special_tokens=False)]

    return make


def windows_of(tokens: int, room: int = ROOM, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, last + 1) of overlapping windows of a text's tokens: one at least, each with room tokens but the last."""
    step = room - overlap
    return [(begin, min(begin + room, tokens)) for begin in range(0, max(1, tokens - overlap), step)]


def window_count(tokens: Column, room: int = ROOM, overlap: int = OVERLAP) -> Column:
    """How many windows so many tokens have."""
    return F.ceil(F.greatest(tokens - overlap, F.lit(1)) / (room - overlap)).cast("int")


def blank_tokens(text: Column) -> Column:
    """F2 by blanks, without a helper: as many tokens as ``by_blanks`` finds."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+"))


def tokenized(text: Column, make_tokenizer: Callable[[], Tokenizer] = by_blanks, room: int = ROOM, overlap: int = OVERLAP) -> Column:
    """struct<tokens, windows array<struct<begin, end>>> of a text column; windows are given in characters.

    The tokenizer is made once a task. A null text has no tokens and one empty window.
    """
    if not 0 <= overlap < room:
        raise ValueError("windows overlap by less than their room")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = make_tokenizer()
        for texts in batches:
            tokens, windows = [], []
            for i in range(0, len(texts), AT_ONCE):
                for spans in tokenizer([t or "" for t in texts.iloc[i : i + AT_ONCE]]):
                    tokens.append(len(spans))
                    windows.append([{"begin": spans[a][0] if spans else 0, "end": spans[b - 1][1] if spans else 0} for a, b in windows_of(len(spans), room, overlap)])
            yield pd.DataFrame({"tokens": pd.array(tokens, "int32"), "windows": windows})

    return F.pandas_udf(giving_back(run), "tokens int, windows array<struct<begin:int,end:int>>")(text)


def state_windows(states: DataFrame, make_tokenizer: Callable[[], Tokenizer] = by_blanks, room: int = ROOM, overlap: int = OVERLAP) -> DataFrame:
    """(state, window, windows, text): a row a window of each distinct cleaned state's JSON; state is its key."""
    small_batches(states.sparkSession)
    once = states.select(state_key().alias("state"), state_json().alias("json")).dropDuplicates(["state"])
    cut = once.withColumn("t", tokenized(F.col("json"), make_tokenizer, room, overlap))
    each = cut.select("state", "json", F.size("t.windows").alias("windows"), F.posexplode("t.windows").alias("window", "w"))
    return each.select("state", "window", "windows", F.substring(F.col("json"), F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin")).alias("text"))


def answered(windows: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(state, p_<check> ..., windows): each check's largest chance over a state's windows.

    score maps rows with a text to the same rows with p_<check> ...: column expressions, or a predictor by ``F1``.
    """
    return score(windows).groupBy("state").agg(*[F.max(f"p_{c}").alias(f"p_{c}") for c in CHECKS], F.first("windows").cast("int").alias("windows"))


class AnswerStore:
    """Recorded answers of one model and its settings, by state; only states without an answer are ever scored.

    A folder of versions: each ``update`` appends the answers of the states that it had to score, and the first writes down whose
    answers these are. A store of another model or of other settings is refused, so that answers are never mixed.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, settings: dict | None = None):
        self.spark, self.path = spark, path
        self.key = json.dumps({"model": model, "settings": settings or {}}, sort_keys=True)
        known = self._known()
        if known not in (None, self.key):
            raise ValueError(f"{path} holds the answers of {known}, not of {self.key}")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was written yet
            return None

    def _known(self) -> str | None:
        owner = self._read("owner")
        found = [r.key for r in owner.distinct().collect()] if owner is not None else []
        if len(found) > 1:
            raise ValueError(f"{self.path} holds answers of several models: {found}")
        return found[0] if found else None

    def answers(self) -> DataFrame | None:
        """(state, p_<check> ..., windows), a row a state; None as long as nothing is recorded."""
        rows = self._read("answers")
        return None if rows is None else rows.groupBy("state").agg(F.max_by(F.struct(*[f"p_{c}" for c in CHECKS], "windows"), "version").alias("a")).select("state", "a.*")

    def unseen(self, states: DataFrame) -> DataFrame:
        """states(summary, description, ...) that have no answer yet."""
        known = self._read("answers")
        return states if known is None else states.withColumn("_state", state_key()).join(known.select(F.col("state").alias("_state")).distinct(), "_state", "left_anti").drop("_state")

    def update(self, states: DataFrame, score: Callable[[DataFrame], DataFrame], make_tokenizer: Callable[[], Tokenizer] = by_blanks, room: int = ROOM, overlap: int = OVERLAP) -> int:
        """Scores the states without an answer and records them as a version; how many these were."""
        if self._known() is None:
            self.spark.createDataFrame([(self.key,)], "key string").write.mode("overwrite").parquet(f"{self.path}/owner")
        known = self._read("answers")
        version = 1 if known is None else (known.agg(F.max("version")).first()[0] or 0) + 1
        made = answered(state_windows(self.unseen(states), make_tokenizer, room, overlap), score)
        made.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{self.path}/answers")
        return self._read("answers").filter(F.col("version") == version).count()

    def missing(self, states: DataFrame) -> DataFrame:
        """(state, summary) of distinct states that no answer is recorded for; empty: the set can be replayed."""
        return self.unseen(states).select(state_key().alias("state"), "summary").dropDuplicates(["state"])

    def replay(self, states: DataFrame) -> DataFrame:
        """states with p_<check> ... and windows, each answered; a set with unanswered states is refused, naming the first ten."""
        lacking = self.missing(states)
        first = lacking.orderBy("state").limit(11).collect()
        if first:
            names = ", ".join(f"{r.state[:12]} ({r.summary})" for r in first[:10])
            raise ValueError(f"no recorded answer for {names}{', and more' if len(first) > 10 else ''}")
        return states.withColumn("_state", state_key()).join(self.answers().withColumnRenamed("state", "_state"), "_state").drop("_state")


def predictions(make_predictor: Callable) -> Callable[[DataFrame], DataFrame]:
    """F1: a score for ``answered`` and AnswerStore by any predictor: made once a task, over batches sorted by length.

    It maps a pandas frame with a text to one with p_<check> ... for the same index.
    """

    def score(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", p_{c} double" for c in CHECKS)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = make_predictor()
            for pdf in batches:
                pdf = pdf.iloc[pdf["text"].str.len().argsort(kind="stable")]
                given = predict(pdf)
                yield pdf.assign(**{f"p_{c}": given[f"p_{c}"] for c in CHECKS})

        small_batches(rows.sparkSession)
        return rows.mapInPandas(giving_back(run), schema)

    return score
