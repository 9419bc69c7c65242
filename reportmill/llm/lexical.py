"""Ranked lexical search over a two-level quantised index.

A document's row of the index holds the terms that the queries use, with two levels a posting. Level one is a byte: the
term's saturated frequency, scaled to 255 and rounded up, so that weight times byte bounds what the posting adds from
above, and weight times (byte - 1) from below. Level two is the frequency itself. A search sums bytes for every document
and item; the k-th largest lower bound of an item is the cut, and every document whose upper bound reaches it is scored
again in exact integers. So no document is dropped by a bound alone that could rank among the first k.

A task keeps k lower bounds an item and lets go what cannot reach them; ties stay, however many. Items come in blocks whose
terms and items are bounded; each block reads the documents once, and only a block's terms and their weights reach the
driver. Rows of documents are found again by the number that they get when the index is written.

Edges: null and empty texts have no terms and count nowhere; very long texts are counted whole; rows repeated in doc_id are
documents of their own; rows of one item_id are one item, a null item_id too; documents without a doc_id rank after equal
scores with one; an item without terms or matches, an empty table and an empty query set give no rows; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import giving_back, stored, table

TOP = 20
#: (item, term) entries of a block of items, and its items, about.
BLOCK_TERMS, BLOCK_ITEMS = 100_000, 512
#: Terms that are summed as a dense matrix, those that most items use; all others entry by entry.
DENSE = 256
#: A saturated frequency is below SCALE; LEVELS bytes cover it.
SCALE, LEVELS = 1_000_000, 255
#: All bytes that stand in no term become blanks; A-Z become a-z.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: bytes | None) -> list[bytes]:
    """A text's terms as UTF-8, A-Z lower-cased; what parts terms is ASCII, so bytes part as code points do."""
    return (text or b"").translate(_TABLE).split()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _counted(numbers: dict[bytes, int]):
    """(doc_id, text as bytes) -> doc_id, n, and the numbers and frequencies of the terms that queries use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, of, tf, sizes = [], [], [], []
            for text in batch.column("text"):
                own = terms(text.as_py())
                found, times = np.unique(np.array([numbers[t] for t in own if t in numbers], np.int32), return_counts=True)
                n.append(len(own))
                of.append(found)
                tf.append(times.astype(np.int64))
                sizes.append(len(found))
            flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((of, np.int32), (tf, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *[_lists(x, np.array(sizes)) for x in flat]], ["doc_id", "n", "terms", "tf"])

    return giving_back(run)


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """row, doc_id, n, terms, tf of every document with a term."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = own.mapInArrow(_counted(numbers), "doc_id long, n long, terms array<int>, tf array<long>").filter("n > 0")
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "*"), "terms")


def saturated(tf: Column, m: Column) -> Column:
    """(10**9 tf) div (1000 tf + 12 m), in integers."""
    return F.call_function("div", tf * 1_000_000_000, tf * 1000 + m * 12)


def index(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """counted() rows with m, the length's part, and a byte a posting, rounded up."""
    m = F.lit(75).cast("long") + F.call_function("div", F.col("n") * F.lit(25 * n_docs), F.lit(max(1, n_terms)).cast("long"))
    byte = lambda tf: F.call_function("div", saturated(tf, F.col("m")) * LEVELS + (SCALE - 1), F.lit(SCALE).cast("long"))
    levels = found.withColumn("m", m).withColumn("impact", F.transform("tf", lambda tf: byte(tf).cast("short")))
    return stored(levels.select("row", "doc_id", "m", "terms", "impact", "tf"), "impacts")


@dataclass(frozen=True)
class Queries:
    """Items of a block: their ids, and for each of their terms (items, weight times repeats)."""

    ids: list
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term in the dense matrix (-1: none), and the matrix (place, item)."""
        uses = np.diff(self.starts)
        heads = np.sort(np.argsort(-uses, kind="stable")[:DENSE])
        place = np.full(len(uses), -1, np.int64)
        place[heads] = np.arange(len(heads))
        matrix = np.zeros((len(heads), len(self.ids)))
        for k, t in enumerate(heads):
            matrix[k, self.items[self.starts[t] : self.starts[t + 1]]] = self.weights[self.starts[t] : self.starts[t + 1]]
        return place, matrix


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of the batch, value) of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _bounded(queries, top: int):
    """row, terms, impact -> (item's number, row, low, high) of what may be among an item's first; of this task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        q: Queries = queries.value
        place, matrix = q.dense()
        count = len(q.ids)
        best = np.zeros((0, count))
        for batch in batches:
            (doc, term), (_, byte) = _flat(batch.column("terms")), _flat(batch.column("impact"))
            high, sure = np.zeros((batch.num_rows, count)), np.zeros((batch.num_rows, count))
            head = place[term] >= 0
            for out, value in ((high, byte.astype(np.float64)), (sure, np.ones(len(byte)))):
                cells = np.zeros((batch.num_rows, len(matrix)))
                cells[doc[head], place[term[head]]] = value[head]
                out += cells @ matrix  # whole numbers below 2**53
            rest_doc, rest_term, rest_byte = doc[~head], term[~head], byte[~head]
            uses = np.diff(q.starts)[rest_term]
            entry = np.repeat(q.starts[rest_term] - np.concatenate([[0], np.cumsum(uses)[:-1]]), uses) + np.arange(uses.sum()) if len(uses) else np.zeros(0, np.int64)
            cell = np.repeat(rest_doc, uses) * count + q.items[entry]
            for out, value in ((high, q.weights[entry] * np.repeat(rest_byte, uses)), (sure, q.weights[entry])):
                out += np.bincount(cell, value.astype(np.float64), out.size).reshape(out.shape)
            low = high - sure
            every = np.concatenate([best, low])
            best = every if len(every) <= top else -np.partition(-every, top - 1, axis=0)[:top]
            cut = best.min(axis=0) if len(best) == top else np.zeros(count)
            at, item = np.nonzero((high >= cut) & (high > 0))
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(rows[at]), pa.array(low[at, item].astype(np.int64)), pa.array(high[at, item].astype(np.int64))], ["item", "row", "low", "high"])

    return giving_back(run)


def _exact(queries):
    """items, doc_id, m, terms, tf -> (item's number, doc_id, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q: Queries = queries.value
        for pdf in batches:
            items, ids, scores = [], [], []
            for wanted, doc_id, m, own, tf in zip(pdf["items"], pdf["doc_id"].astype("Int64"), pdf["m"], pdf["terms"], pdf["tf"], strict=True):
                tf = np.asarray(tf, np.int64)
                value = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
                total = np.zeros(len(q.ids), np.int64)
                for t, v in zip(own, value, strict=True):
                    span = slice(q.starts[t], q.starts[t + 1])
                    total[q.items[span]] += q.weights[span] * v
                items.extend(wanted)
                ids.extend([doc_id] * len(wanted))
                scores.extend(total[np.asarray(wanted)])
            yield pd.DataFrame({"item": items, "doc_id": pd.array(ids, "Int64"), "score": scores}).astype({"item": "int32", "score": "int64"})

    return giving_back(run)


def _first(df: DataFrame, top: int, *order) -> DataFrame:
    """The first rows of each item; tasks send no more than so many each."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def _search(docs: DataFrame, own: list, top: int) -> DataFrame:
    """own: rows (item_id, term, times) of a block of items."""
    spark = docs.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in own}))}
    found = counted(docs, numbers)
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[r.t] = r["count"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    ids = sorted({r.item_id for r in own}, key=lambda x: (x is None, x))
    place = {x: i for i, x in enumerate(ids)}
    entries = sorted((numbers[bytes(r.term)], place[r.item_id], r.times) for r in own)
    term, item, times = (np.array(x, np.int64) for x in zip(*entries, strict=True))
    queries = spark.sparkContext.broadcast(Queries(ids, np.searchsorted(term, np.arange(len(numbers) + 1)), item, weight[term] * times))
    levels = index(found, n_docs, n_terms)
    bounds = levels.select("row", "terms", "impact").mapInArrow(_bounded(queries, top), "item int, row long, low long, high long")
    bounds = stored(bounds, "bounds")
    cuts = _first(bounds, top, F.desc("low")).groupBy("item").agg(F.when(F.count("*") == top, F.min("low")).otherwise(0).alias("cut"))
    left = bounds.join(F.broadcast(cuts), "item").filter("high >= cut")  # a row an item of the block
    wanted = left.groupBy("row").agg(F.collect_set("item").alias("items"))  # a document's items, a block's at most
    exact = levels.select("row", "doc_id", "m", "terms", "tf").join(wanted, "row").mapInPandas(_exact(queries), "item int, doc_id long, score long")
    ranked = _first(exact.filter("score > 0"), top, F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents; items(item_id, text), documents(doc_id, text)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    own = stored(each.groupBy("item_id", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times")), "query-terms")
    entries, several = own.agg(F.count("*"), F.count_distinct(F.coalesce("item_id", F.lit(-1)))).first()
    blocks = max(-(-entries // block_terms), -(-several // block_items))
    if not blocks:
        return own.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    dealt = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = [rows for b in range(blocks) if (rows := dealt.filter(F.col("block") == b).drop("block").collect())]
    return reduce(DataFrame.unionByName, (_search(docs, rows, top) for rows in parts))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
ORACLE = f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, {_TERM})) AS term FROM documents),
  q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, {_TERM})) AS term FROM benchmark) GROUP BY ALL),
  p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
  s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n), m AS (SELECT doc_id, 75 + (25 * n * docs) // l AS m FROM n, s),
  w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
  r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20"""
