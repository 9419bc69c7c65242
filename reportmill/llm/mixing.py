"""Mixing sources to target weights by balanced sampling with the cube method.

A source's rate is its target over its size; each document is taken floor(rate) times for certain and once more with
probability frac(rate). Within a source the cube method settles these probabilities to 0 or 1: a flight step moves three of
them along the null-space of the constraints "documents taken" and "words taken" until one reaches 0 or 1, so both totals
stay as they are. Documents fly in cells of bounded size, large ones first; what a cell leaves open, two documents at
most, flies again with the leavings of other cells, level by level, until one cell a source is left. Its landing gives up
the document count, rounds the last document and exchanges a few others while that brings the words taken nearer.

Chance comes from hashes of (seed, doc_id, text), cells from hashes and counts: reruns and other partitionings agree.
Null sources are a source, after all others; null and empty texts have size 0 and are taken 0 words; texts of any length are
counted whole, and only their sizes go on; repeated rows are drawn one by one. An empty table gives an empty mix. Other columns are kept by ``mixed`` and not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, packed, stored, table, unpacked

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a cell, about.
CELL = 4096
SEED = 17
#: Documents that a landing may exchange.
EXCHANGES = 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, docs -> and its target: shares of all sizes by weight, none above most times its size.

    Capped sources are those whose share of the final level exceeds their cap: in order of cap over weight, the level at a
    source is what is left by the capped ones before it over the weights from it on.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    all_rows = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("heavy"),
        F.row_number().over(order).alias("nth"),
    ).withColumn("level", F.col("left") / F.col("heavy"))
    capped = F.col("level") * F.col("weight") > most * F.col("source_size")
    level = F.min(F.when(~capped, F.struct("nth", "level"))).over(all_rows)["level"]
    target = F.least(F.coalesce(level, F.lit(math.inf)) * F.col("weight"), most * F.col("source_size").cast("double"))
    return levels.select("source", "source_size", "docs", "weight", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _step(p: list[float], u: list[float], chance: float) -> list[float]:
    """Move p along u, up or down as far as [0, 1] allows, so that the mean stays."""
    up = min(((1 - a) / b if b > 0 else -a / b) for a, b in zip(p, u, strict=True) if b)
    down = min((a / b if b > 0 else (a - 1) / b) for a, b in zip(p, u, strict=True) if b)
    by = up if chance < down / (up + down) else -down
    moved = [a + by * b for a, b in zip(p, u, strict=True)]
    return [0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in moved]


def flight(sizes: list[int], probabilities: list[float], chances: list[float], land: bool) -> list[float]:
    """Settle a cell in the given order; two probabilities stay open at most, none if it lands."""
    out = list(probabilities)
    open_: list[int] = []
    for i, chance in enumerate(chances):
        if not 0 < out[i] < 1:
            continue
        open_.append(i)
        if len(open_) == 3:
            x = [sizes[j] for j in open_]
            u = [float(x[2] - x[1]), float(x[0] - x[2]), float(x[1] - x[0])]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            for j, p in zip(open_, _step([out[j] for j in open_], u, chance), strict=True):
                out[j] = p
            open_ = [j for j in open_ if 0 < out[j] < 1]
    if land:
        if len(open_) == 2:
            i, j = open_
            out[i], out[j] = _step([out[i], out[j]], [float(sizes[j]), -float(sizes[i])], chances[j])
            open_ = [k for k in open_ if 0 < out[k] < 1]
        for k in open_:
            out[k] = float(out[k] >= 0.5)
        _landed(sizes, probabilities, out)
    return out


def _landed(sizes: list[int], probabilities: list[float], out: list[float]) -> None:
    """Exchange a few of the documents that chance has settled while that brings the words taken nearer."""
    size, p = np.array(sizes, np.float64), np.array(probabilities)
    free = (p > 0) & (p < 1)
    taken = np.array(out)
    over = float(((taken - p) * size).sum())
    for _ in range(EXCHANGES):
        could = free & (taken == (over > 0))
        left = np.where(could, np.abs(abs(over) - size), np.inf)
        if not len(left) or not left.min() < abs(over):
            break
        i = int(left.argmin())
        out[i] = taken[i] = 1 - taken[i]
        over += size[i] * (1 if taken[i] else -1)


def _flown(df: DataFrame, land: Column) -> DataFrame:
    """One level: rows with source, cell, size, p, u, key and others; p is settled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
        return pdf.assign(p=flight(pdf["size"].tolist(), pdf["p"].tolist(), pdf["u"].tolist(), bool(pdf["land"].iloc[0])))

    ready = df.withColumn("land", land)
    return ready.groupBy("source", "cell").applyInPandas(run, ready.schema)


def _row_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """doc_id, key, source, size, source_size, target, times, taken for every row of documents(doc_id, text, source).

    key hashes the row's source and text, so that (doc_id, key) tells rows apart unless they are repeated. Only ids and sizes are
    shuffled, never texts.
    """
    own = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), _row_key(seed).alias("key")), "mix-sizes")
    by_source = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = stored(targets(by_source, weights, most), "mix-targets").withColumnRenamed("source", "of").drop("weight")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    cells = F.greatest(F.ceil(F.col("docs") / cell), F.lit(1))
    rows = own.join(goals, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        "key",
        "source",
        "size",
        "source_size",
        "target",
        F.floor(rate).alias("sure"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"),
        _uniform(F.lit(seed + 1), "doc_id", "key").alias("u"),
        F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "key"), cells).alias("cell"),
        cells.cast("long").alias("cells"),
    )
    flown = stored(_flown(rows, F.col("cells") == 1), "mix-level")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    settled = flown.filter(~open_)
    most_cells = flown.agg(F.max("cells")).first()[0] or 1
    while most_cells > 1:
        merged = F.greatest(F.ceil(F.col("cells") * 2 / cell), F.lit(1)).cast("long")
        again = flown.filter(open_).withColumn("cells", merged).withColumn("cell", F.pmod("cell", "cells")).drop("land")
        flown = stored(_flown(again, F.col("cells") == 1), "mix-level")
        settled = settled.unionByName(flown.filter(~open_))
        most_cells = math.ceil(most_cells * 2 / cell)
    times = F.when(F.col("size") > 0, F.col("sure") + F.col("p").cast("long")).otherwise(0).cast("long")
    return settled.select("doc_id", "key", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Rows equal in doc_id, source and text share what the mix takes of them: rows that are equal in all columns are counted
    before they meet, and a count takes its part of the total in the order of a hash of all columns.
    """
    none = F.lit(-(1 << 63)).cast("long")
    keys = [F.coalesce("doc_id", none).alias("id"), "key"]
    picked = stored(mix(docs, seed=seed, **how).groupBy(*keys).agg(F.sum("times").alias("all"), F.count("*").alias("rows")).filter("all > 0"), "mix-picked")
    own = docs.select(packed(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), _row_key(seed).alias("key"))
    once = own.join(picked.filter("rows = 1"), ["id", "key"]).select("row", F.col("all").alias("times"))
    again = own.join(picked.filter("rows > 1"), ["id", "key"]).withColumn("hash", F.sha2(F.to_json("row"), 256))
    counted = again.groupBy("id", "key", "all", "rows", "hash").agg(F.count("*").alias("same"), F.first("row").alias("row"))
    upto = F.sum("same").over(Window.partitionBy("id", "key").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0))
    part = lambda rows: F.call_function("div", F.col("all") * rows, F.col("rows"))
    dealt = counted.withColumn("upto", upto).select("row", (part(F.col("upto")) - part(F.col("upto") - F.col("same"))).alias("times"))
    every = once.unionByName(dealt)
    return every.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select(*unpacked("row", docs.columns))


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
