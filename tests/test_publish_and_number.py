"""Baselines by write, audit and publish; batches that no partitioning changes; rules over raw JSON rows; cleaned rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from reportmill.functions import cleanup
from reportmill.operators import evaluate as E
from reportmill.operators import labels as L
from reportmill.operators import sampling as S
from reportmill.sources import issues as I

COUNTS = "check string, decided long, wrong long, missing_found long"


def decided(spark, path):
    return {r.check: r.decided for r in E.baseline(spark, path).collect()}


def test_only_an_audited_version_is_seen(spark, tmp_path):
    path = str(tmp_path / "b")
    counts = lambda *rows: spark.createDataFrame(list(rows), COUNTS)
    with pytest.raises(FileNotFoundError):
        E.baseline(spark, path)
    assert E.publish(counts(("steps", 40, 3, 9)), path).isEmpty()
    worse = E.publish(counts(("steps", 38, 5, 9)), path).collect()
    assert {(r.metric, r.worse_by) for r in worse} == {("decided", 2), ("wrong", 2)} and decided(spark, path) == {"steps": 40}
    assert E.publish(counts(("steps", 39, 4, 10)), path).isEmpty() and decided(spark, path) == {"steps": 39}


def test_interrupted_and_losing_writers_leave_the_baseline(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    counts = lambda n: spark.createDataFrame([("steps", n, 0, 0)], COUNTS)
    E.refresh(counts(1), path)
    with monkeypatch.context() as m:
        m.setattr(E, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            E.publish(counts(2), path)
    assert decided(spark, path) == {"steps": 1}
    E.publish(counts(3), path, seen=1)  # two writers looked at version 1
    with pytest.raises(E.Outdated):
        E.publish(counts(4), path, seen=1)
    assert decided(spark, path) == {"steps": 3}
    assert {r.decided for r in E.baseline(spark, path, 1).collect()} == {1}
    assert E.publish(counts(4), path).isEmpty() and decided(spark, path) == {"steps": 4}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_batches_under_any_partitioning(spark, parts):
    rows = [(f"r{i}", f"title {i}", None if i % 9 == 0 else f"text {i}") for i in range(263)]
    df = spark.createDataFrame(rows, "id string, summary string, description string").repartition(parts)
    order = [r.id for r in df.orderBy(S.u("batches", F.col("id")), "id").select("id").collect()]
    got = {r.batch: [json.loads(x)["id"] for x in r.lines.split("\n")] for r in L.batches(df).collect()}
    assert got == {b: order[20 * b : 20 * b + 20] for b in range(14)}
    assert {k for r in L.batches(df).collect() for x in r.lines.split("\n") for k in json.loads(x)} == {"id", "summary", "description"}


def test_rules_over_raw_rows(spark):
    row = {"id": "a", "source": "public", "tracker": "t", "project": "p", "summary": "s", "description": "d"}
    rows = [("train", row), ("train", row | {"id": "b", "core": True}), ("eval", row | {"id": "b", "summary": "  "}), ("train", row | {"id": "c", "extra": [1, 2], "more": None, "project": "q"})]
    lines = [(s, json.dumps(r)) for s, r in rows] + [("train", "{no json"), ("train", "[1]"), ("eval", json.dumps({"id": "d", "description": "x"}))]
    got = {(r.rule, r.key, r.detail) for r in L.raw_set_problems(spark.createDataFrame(lines, '`set` string, raw string'), {("train", "public"): 3, ("eval", "public"): 2}).collect()}
    assert got == {
        ("broken", "{no json", None), ("broken", "[1]", None), ("unexpected field", "c", "extra"), ("unexpected field", "c", "more"),
        ("missing field", "d", "source"), ("missing field", "d", "tracker"), ("missing field", "d", "project"),
        ("blank", "b", "summary"), ("blank", "d", "summary"), ("duplicate", "b", "2"), ("shared project", "t/p", "2"), ("count", "eval/public", "1"), ("count", "eval", "1"),
    }


def test_rules_over_very_long_and_odd_raw_rows(spark):
    """Lines of over 20,000,000 characters are read like others; a field given twice and lenient JSON make a line broken."""
    row = '{"id": "%s", "source": "public", "tracker": "t", "project": "p", "summary": "s", "description": "'
    long = F.concat(F.lit(row % "long"), F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit('", "extra": {"a": 1}}'))
    lines = spark.range(20_000_001, 20_000_003).select(F.lit("train").alias("set"), long.alias("raw"))
    odd = ['{"id": "a", "id": "b"}', "{'id': 'a'}", '{"id": NaN}', "", "null", '{"id": "a"', None]
    lines = lines.unionByName(spark.createDataFrame([("train", x) for x in odd], "`set` string, raw string"))
    got = [tuple(r) for r in L.raw_set_problems(lines, {("train", "public"): 2}).collect()]
    want = [("broken", x, None) for x in odd] + [("unexpected field", "long", "extra")] * 2 + [("duplicate", "long", "2")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_public_rows_are_cleaned(spark):
    rows = [("k1", "T", "P", "[UI] Title", "h2. Head\r\n<!-- x -->*bold* &lt;b&gt;\r\n\r\n\r\n\r\n!shot.png!", True), ("k2", "T", "P", "Title", None, False)]
    df = spark.createDataFrame(rows, "key string, tracker string, project string, summary string, description string, wiki boolean")
    got = {r.id: (r.summary, r.description) for r in I.cleaned_public_row(df).collect()}
    assert got == {"T:k1": ("Title", "## Head\n**bold** <b>\n\n[image]"), "T:k2": ("Title", "")}
    assert cleanup.fused("plain", False) == "plain"
