"""Queries without SQL read reports to their end."""

from __future__ import annotations

import pytest

from reportmill.jobs import queries as own
from reportmill.jobs import views as V


@pytest.fixture(scope="module")
def long_reports(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    filler = "plain words of a report\n" * 60
    steps = "\n1. Open tailword\n2. Save\n\n**Expected result:** kept\n**Actual result:** lost\n"
    # doc_id % 12 == 3 plants no steps and no sections
    rows = [(15, filler + steps, "en", "web", 1500), (27, filler, "en", "web", 1440), (39, "w " * 900, "en", "web", 1800)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_tokens_of_whole_texts(spark, long_reports):
    got = {r.id: r.tokens for r in V.candidates(spark, long_reports).collect()}
    assert got["web:39"] == 900 + 6 and got["web:27"] == 5 * 60 + 6


def test_end_of_text_is_cleaned_and_read(spark, long_reports):
    cleaned = {r.id: r.description for r in own.QUERIES["p13_clean_reports"](spark, long_reports).collect()}
    assert "tailword" in cleaned["web:15"]
    missing = {r.id: r.missing for r in own.QUERIES["r12_r15_strict_missing"](spark, long_reports).collect()}
    assert "steps" not in missing["web:15"] and "steps" in missing["web:27"]


def test_long_class_is_not_sampled(spark, long_reports):
    assert {r.id for r in own.QUERIES["w6_w7_sample"](spark, long_reports).select("id").collect()} <= {"web:15", "web:27"}
