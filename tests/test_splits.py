"""Splits of all candidates against ranking by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from reportmill.jobs import queries as own
from reportmill.jobs import views as V
from reportmill.operators import sampling as S

SF = "/root/testdata/sf0.001"


def chance(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:12], 16), key


def test_every_candidate_is_split(spark):
    ids = sorted((r.id for r in V.candidates(spark, SF).collect()), key=lambda x: chance(V.SEED, x))
    got = {r.id: r.part for r in own.QUERIES["w10_two_thirds_whole"](spark, SF).collect()}
    assert len(got) == len(ids) and {x for x in got if got[x] == "train"} == set(ids[: round(len(ids) * 2 / 3)])


@pytest.mark.parametrize("bins", [1, 4, 1 << 16])
def test_first_by_group(spark, monkeypatch, bins):
    monkeypatch.setattr(S, "BINS", bins)
    df = spark.createDataFrame([(str(i), None if i % 3 == 2 else i % 3) for i in range(90)], "id string, g int")
    k = {0: 7, 1: 0, None: 500}
    got = S.among_first(df, F.col("g"), lambda g, _: F.when(g == 0, 7).when(g == 1, 0).otherwise(500), "s").filter("_in").collect()
    for g in k:
        want = sorted((str(i) for i in range(90) if (None if i % 3 == 2 else i % 3) == g), key=lambda x: chance("s", x))[: k[g]]
        assert {r.id for r in got if r.g == g} == set(want)


def test_split_ranks_one_bin(spark):
    plan = S.split_two_thirds(spark.range(1000).selectExpr("string(id) id"), "s")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [x for x in plan.splitlines() if "row_number()" in x]
    assert len(ranks) == 1 and "_bin" in plan.split(ranks[0])[1]
