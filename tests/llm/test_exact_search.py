"""Neighbours where probes of a fixed number miss: unequal lengths, small tables, many dimensions."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import neighbours


def recall(spark, x, k=20, step=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % step == 0, k).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in range(0, len(x), step):
        score = x @ x[q]
        score[q] = -np.inf
        want = set(np.argsort(-score, kind="stable")[: min(k, len(x) - 1)].tolist())
        assert len(got[q]) == min(k, len(x) - 1)
        hits.append(len(got[q] & want) / len(want))
    return float(np.mean(hits))


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("longest", [3.0, 100.0])
def test_one_long_vector(spark, longest):
    x = unit(4000, 64, 1)
    x[7] *= longest
    found = recall(spark, x)
    print("longest", longest, "recall", found)
    assert found >= 0.9


def test_small_table_gives_all(spark):
    assert recall(spark, unit(25, 64, 2), k=30, step=5) == 1.0


def test_128_dimensions(spark):
    found = recall(spark, unit(4000, 128, 3))
    print("128 dimensions, recall", found)
    assert found >= 0.9
