"""Every registered operator on empty tables, and on rows that are repeated, tied, null in any column or very long."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reportmill.llm import chat, neighbours
from reportmill.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "embeddings", "conversations", "benchmark")


def written(spark, path, change):
    for name in TABLES:
        change(name, spark.read.parquet(f"{SF}/{name}.parquet")).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("empty")), lambda name, df: df.limit(0))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows twice, and once more with each column null in turn; one text of a million characters."""

    def change(name, df):
        out = df.limit(40)
        twice = out
        for c in df.columns:
            out = out.unionByName(twice.limit(3).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        if name == "documents":
            out = out.unionByName(df.limit(1).withColumns({"doc_id": F.lit(777_777).cast("long"), "text": F.repeat(F.lit("long text, Ünïcode 42; "), 45_000)}))
        return out.unionByName(twice)

    return written(spark, str(tmp_path_factory.mktemp("odd")), change)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, nothing, name):
    rows = QUERIES[name](spark, nothing).collect()
    assert [r.conv_id for r in rows] == ([-7] if name.startswith("op8_") else [])


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    n = spark.read.parquet(f"{odd}/documents.parquet").count()
    if name[2:].split("_")[0] in ("1", "2", "3", "6", "7", "9", "10", "11"):
        assert len(got) == n  # a row a row of the table
    else:
        assert got


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 2, 3).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 1, 7, 2.0), (2, 2, 8, 2.0), (2, 3, 1, 1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_branching_trees_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for tree in range(6):
        n = rng.randrange(1, 40)
        parent = {i: (None if i == 0 else rng.randrange(max(0, i - 4), i)) for i in range(n)}
        score = {i: rng.choice((0.0, 0.5, 1.0, None)) for i in parent}
        rows += [(tree, i, p, rng.choice(("user", "assistant")), f"t{tree} n{i} <|end|>", score[i]) for i, p in parent.items()]
        branches = []
        for leaf in set(parent) - set(parent.values()):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parent[at]
            branches.append((-sum(score[i] or 0.0 for i in path), leaf, [f"t{tree} n{i} <|end|>" for i in reversed(path)]))
        want |= {(tree, leaf): (k, -s, texts) for k, (s, leaf, texts) in enumerate(sorted(branches), 1)}
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat.chosen_paths(df).select("tree", "leaf", "rank", "score", chat.parsed(F.col("formatted"))["text"].alias("texts")).collect()
    assert {(r.tree, r.leaf): (r.rank, r.score, r.texts) for r in got} == want
    first = chat.chosen_paths(df, 1).select("tree", "leaf").collect()
    assert {(r.tree, r.leaf) for r in first} == {k for k, v in want.items() if v[0] == 1}
