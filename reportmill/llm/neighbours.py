"""Approximate nearest neighbours by cross-polytope hashing, with multiprobe and exact reranking.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns unit vectors, and the nearest signed
axis is the hash. A table's hash is several of these, each with a rotation of its own, so many that a bucket holds about
``BUCKET`` vectors however large the table grows (``widths``); the last one uses as few axes as that takes. A query's cost of a bucket
is how far its axes fall behind the query's nearest ones, and the query looks into every bucket up to a bound of cost: a
sample of queries is compared with all rows, and the bound is what ``RECALL`` of the sample's neighbours need. Where vectors
differ in length, one more coordinate makes all of a range of lengths equally long, so that the largest inner product stays
the nearest direction. Queries with fewer than k candidates are compared with all rows, in blocks.

Vectors are dealt by the first hashes, those that give groups of ``GROUP`` vectors, and a task compares a query only with
the group's buckets that it looks into. Hot groups are cut in blocks of bounded size, candidates and queries both, by the
groups' counts, and are many tasks' work; a task gives each query's k best there. Products are summed in double precision
the same way everywhere, so equal vectors tie exactly; ties go to the smaller id. Vectors null, zero, of another length
than most, or with null or non-finite components take no part, nor do rows without an id. Of rows with one id the best
counts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TABLES = 8
#: Vectors of a bucket, and of a group of buckets that one task looks into, about.
BUCKET, GROUP = 64, 8192
#: Buckets are probed until this share of the neighbours of so many queries is met.
RECALL, SAMPLE = 0.95, 128
#: Groups up to which their counts are broadcast.
BROADCAST_GROUPS = 200_000
#: Ranges of lengths: the longest of one is 2 ** (1 / RANGES) times its shortest.
RANGES = 4
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform along the last axis, a power of two, scaled to keep lengths."""
    d, h = x.shape[-1], 1
    while h < d:
        y = x.reshape(*x.shape[:-1], d // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, number: int, level: int, seed: int) -> np.ndarray:
    """The vectors under the rotation of a table's hash, in a power of two of dimensions."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, number, level]).choice([-1.0, 1.0], (3, d))
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def widths(n: int, dimensions: int, members: int) -> list[int]:
    """Axes of each hash of a table, so that n vectors have buckets of about so many members."""
    d, out, buckets = 1 << max(1, (dimensions - 1).bit_length()), [], 1
    while not out or n / buckets > members:
        need = max(1, math.ceil(n / buckets / members / 2))
        out.append(min(d, 1 << (need - 1).bit_length()) if out else d)
        buckets *= 2 * out[-1]
    return out


def codes(x: np.ndarray, number: int, seed: int, axes: list[int]) -> list[np.ndarray]:
    """The nearest signed axis of each unit vector, for each hash of a table."""
    out = []
    for level, w in enumerate(axes):
        y = rotated(x, number, level, seed)[:, :w]
        best = np.abs(y).argmax(1)
        out.append(best + w * (y[np.arange(len(y)), best] < 0))
    return out


def costs(y: np.ndarray, number: int, seed: int, axes: list[int]) -> list[np.ndarray]:
    """For each hash of a table, how far each signed axis falls behind the nearest one, squared."""
    out = []
    for level, w in enumerate(axes):
        z = rotated(y, number, level, seed)[:, :w]
        z = np.hstack([z, -z])
        out.append(np.square(z.max(1)[:, None] - z))
    return out


def joined_codes(levels: list[np.ndarray], axes: list[int], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for code, w in zip(levels, axes, strict=True):
        out = out * 2 * w + code
    return out


def probed_buckets(levels: list[np.ndarray], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, bucket) of every bucket whose hashes cost a query no more than the bound."""
    query, code, cost = np.arange(len(levels[0])), np.zeros(len(levels[0]), np.int64), np.zeros(len(levels[0]))
    for level in levels:
        every = cost[:, None] + level[query]
        at, axis = np.nonzero(every <= bound)
        query, code, cost = query[at], code[at] * level.shape[1] + axis, every[at, axis]
    return query, code


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id long, query, v binary (doubles), norm of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), "query").filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    size = fine.agg(F.mode(F.size("v"), True)).first()[0]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "query": pdf["query"], "v": [np.asarray(x, np.float64).tobytes() for x in pdf["v"]], "norm": [float(np.sqrt(np.square(np.asarray(x, np.float64)).sum())) for x in pdf["v"]]})

    return fine.filter(F.size("v") == F.lit(size)).mapInPandas(packed, "id long, query boolean, v binary, norm double")


def _directions(x: np.ndarray, norm: np.ndarray, longest: float | None, as_query: bool) -> np.ndarray:
    """Unit vectors to hash: candidates against the longest of their range of lengths, queries with 0 there."""
    if longest is None:
        return x / norm[:, None]
    if as_query:
        return np.pad(x / norm[:, None], ((0, 0), (0, 1)))
    top = longest * np.exp2(-np.floor(np.log2(longest / norm) * RANGES) / RANGES)
    return np.hstack([x / top[:, None], np.sqrt(np.maximum(0, 1 - np.square(norm / top)))[:, None]])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def needed_cost(every: DataFrame, k: int, longest: float | None, n_tables: int, seed: int, axes: list[int]) -> float:
    """The cost that meets RECALL of the neighbours of SAMPLE queries, which are found by comparing with all rows."""
    few = every.filter("query").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(few):
        return 0.0
    q, q_ids = _matrix(few["v"]), few["id"].to_numpy()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ids, scores = pdf["id"].to_numpy(), q @ _matrix(pdf["v"]).T
            for i in range(len(q)):
                other = np.flatnonzero(ids != q_ids[i])
                best = other[_best(ids[other], scores[i, other], k)]
                yield pd.DataFrame({"q": i, "id": ids[best], "v": pdf["v"].to_numpy()[best], "norm": pdf["norm"].to_numpy()[best], "score": scores[i, best]})

    near = every.mapInPandas(nearest, "q int, id long, v binary, norm double, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    pairs = near.withColumn("rank", rank).filter(F.col("rank") <= k).toPandas()
    if not len(pairs):
        return 0.0
    x, y = _directions(_matrix(pairs["v"]), pairs["norm"].to_numpy(), longest, False), _directions(q, few["norm"].to_numpy(), longest, True)
    least, of = np.full(len(pairs), np.inf), pairs["q"].to_numpy()
    for t in range(n_tables):
        both = zip(costs(y, t, seed, axes), codes(x, t, seed, axes), strict=True)
        least = np.minimum(least, sum(cost[of, code] for cost, code in both))
    return float(np.sort(least)[int(np.ceil(RECALL * len(least))) - 1]) + 1e-9


def search(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector: str = "embedding", n_tables: int = TABLES, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that the condition names, itself left out."""
    every = stored(usable(vectors.withColumn("query", F.coalesce(queries, F.lit(False))), id_col, vector), "vectors")
    low, high, n_ids, n, size = every.agg(F.min("norm"), F.max("norm"), F.count_distinct("id"), F.count("*"), F.max(F.length("v"))).first()
    longest = None if low is None or high <= low * (1 + 1e-6) else high
    dimensions = (size or 8) // 8 + (longest is not None)
    axes = widths(n, dimensions, BUCKET)
    coarse = len(widths(n, dimensions, GROUP))
    inner = int(np.prod([2 * w for w in axes[coarse:]], dtype=np.int64))
    bound = needed_cost(every, k, longest, n_tables, seed, axes)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _directions(_matrix(pdf["v"]), pdf["norm"].to_numpy(), longest, False)
            for t in range(n_tables):
                code = joined_codes(codes(x, t, seed, axes), axes, len(x))
                yield pd.DataFrame({"tab": t, "bucket": code // inner, "sub": code % inner, "id": pdf["id"], "v": pdf["v"]})

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 128):
                few = pdf.iloc[i : i + 128]
                y = _directions(_matrix(few["v"]), few["norm"].to_numpy(), longest, True)
                for t in range(n_tables):
                    query, code = probed_buckets(costs(y, t, seed, axes), bound)
                    first = np.flatnonzero(np.diff(query * (1 << 40) + code // inner, prepend=-1))
                    subs = np.split(code % inner, first[1:])
                    own = query[first]
                    yield pd.DataFrame({"tab": t, "bucket": code[first] // inner, "subs": subs, "id": few["id"].to_numpy()[own], "v": few["v"].to_numpy()[own]})

    candidates = stored(every.mapInPandas(hashed, "tab int, bucket long, sub long, id long, v binary"), "candidates")
    probed = stored(every.filter("query").mapInPandas(probing, "tab int, bucket long, subs array<long>, id long, v binary"), "probes")
    found = stored(_top(_compared(candidates, probed, k), k), "found")
    full = found.groupBy("query_id").count().filter(F.col("count") >= min(k, n_ids - 1)).select(F.col("query_id").alias("id"))
    one = [F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket"), "id", "v"]
    none = F.lit(0).cast("long")
    short = stored(every.filter("query").join(full, "id", "left_anti").select(*one, F.array(none).alias("subs")), "short")
    if short.isEmpty():
        return found
    return _top(found.drop("rank").unionByName(_compared(every.select(*one, none.alias("sub")), short, k)), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compared(candidates: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of each block of candidates in its buckets."""
    sizes = candidates.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / CANDIDATE_BLOCK).alias("c"))
    q_sizes = probed.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("q"))
    blocks = stored(sizes.join(q_sizes, ["tab", "bucket"]), "groups")
    if blocks.count() <= BROADCAST_GROUPS:
        blocks = F.broadcast(blocks)
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    left = candidates.join(blocks, ["tab", "bucket"]).withColumn("cb", own % F.col("c")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
    right = probed.join(blocks, ["tab", "bucket"]).withColumn("qb", own % F.col("q")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    keys = ["tab", "bucket", "cb", "qb"]

    def compared(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        c = c.sort_values("sub", kind="stable")
        x, y = _matrix(c["v"]), _matrix(q["v"])
        ids, out, sub = c["id"].to_numpy(), [], c["sub"].to_numpy()
        first = np.flatnonzero(np.diff(sub, prepend=-1))
        lengths = q["subs"].map(len).to_numpy()
        wanted = np.concatenate(q["subs"].tolist())
        place = np.searchsorted(sub[first], wanted)
        there = (place < len(first)) & (sub[first][np.minimum(place, len(first) - 1)] == wanted)
        looks = np.zeros((len(q), len(first)), bool)
        looks[np.repeat(np.arange(len(q)), lengths)[there], place[there]] = True
        rough = np.full((len(q), len(c)), -np.inf)
        for j, (begin, end) in enumerate(zip(first, np.append(first[1:], len(c)), strict=True)):
            own = np.flatnonzero(looks[:, j])
            if len(own):
                rough[own, begin:end] = y[own] @ x[begin:end].T
        for i, query in enumerate(q["id"].to_numpy()):
            other = np.flatnonzero((rough[i] > -np.inf) & (ids != query))
            if len(other) > k:
                r = rough[i, other]
                edge = np.partition(r, len(r) - k)[len(r) - k]
                other = other[r >= edge - 1e-9 * (1 + abs(edge))]
            score = (x[other] * y[i]).sum(1)
            best = _best(ids[other], score, k)
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[other][best], "score": score[best]}))
        return pd.concat(out)

    return left.select(*keys, "sub", "id", "v").groupBy(*keys).cogroup(right.select(*keys, "subs", "id", "v").groupBy(*keys)).applyInPandas(compared, "query_id long, vec_id long, score double")


def op4_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
