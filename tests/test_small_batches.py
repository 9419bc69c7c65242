"""Helpers get small batches, however many rows a task has, and give memory back."""

from __future__ import annotations

import pandas as pd
import pytest

from reportmill.functions import cleanup, rules
from reportmill.functions.workers import BATCH_ROWS
from reportmill.jobs import views
from reportmill.operators import decide, scoring

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def large_batches(spark):
    was = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    yield spark
    spark.conf.set(ROWS, was)


def test_a_predictor_gets_small_batches(large_batches):
    df = large_batches.range(0, 3500, 1, 1).selectExpr("cast(id as string) as text")
    rows_of_a_batch = lambda: lambda pdf: pd.DataFrame({"rows": [len(pdf)]})
    got = [r.rows for r in decide.scored_batches(df, rows_of_a_batch, "rows int").collect()]
    assert sum(got) == 3500 and max(got) <= BATCH_ROWS


@pytest.mark.parametrize("job", [
    lambda spark: views.reports(spark, SF),
    lambda spark: cleanup.clean_reports(spark.createDataFrame([("a", "b", False)], "summary string, description string, wiki boolean")),
    lambda spark: scoring.state_windows(spark.createDataFrame([("a", "b")], "summary string, description string")),
])
def test_jobs_with_helpers_ask_for_small_batches(large_batches, job):
    assert job(large_batches).count() > 0
    assert int(large_batches.conf.get(ROWS)) <= BATCH_ROWS


def test_lines_are_read_batch_by_batch():
    given = [pd.Series(["### Steps\n1. Open", None]), pd.Series([""])]
    first, second = rules._read_lines(iter(given))
    assert first["sections"][0] == [{"field": "steps", "content": "\n1. Open"}] and len(first) == 2 and second["result"].tolist() == [""]
