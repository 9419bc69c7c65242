"""Rules, decisions and comments on hand-made reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reportmill.functions import rules as R
from reportmill.operators import decide as D
from reportmill.operators.labels import CHECKS


def test_sections_end_at_the_next_heading():
    got = R.sections("### Steps to reproduce\n1. a\n2. b\n**Expected:** c\nNote:\nd\nActual: e\nf")
    assert got == [("steps", "\n1. a\n2. b"), ("expected", "c"), ("actual", "e\nf")]


@pytest.mark.parametrize(("text", "stated"), [("It should work.", True), ("Should it work?", False), ("Nothing", False), ("Fix proposal\nuse b", True), ("```\nexpected ;\n```", False)])
def test_expectation(text, stated):
    assert R.expectation_stated(text) is stated


@pytest.mark.parametrize(("text", "build"), [("Version: latest", False), ("Build: prod 4.18.2", None), ("no field", None), ("### Version\n\nmaster", False), ("Version:\n# Steps", None), ("seen in 4.1.9", True)])
def test_build_version(spark, text, build):
    df = spark.createDataFrame([("s", text)], "s string, d string")
    assert df.select(R.build_version(F.col("s"), F.col("d"), r"\b4\.1\.\d+\b")).first()[0] is build


@pytest.mark.parametrize(
    ("text", "missing"),
    [
        ("1. a\n2. b\nIt should be c but shows null", []),
        ("It doesn't work", ["steps", "expected", "actual"]),
        ("### Steps\n1.\n### Expected\nTBD\n### Actual\n[image]", ["steps", "expected"]),
        ("File > Open > New, expected: <1> but was:<2>. The header lacks the port", []),
    ],
)
def test_strict(spark, text, missing):
    df = spark.createDataFrame([(text,)], "description string").withColumn("l", R.read_lines("description"))
    assert df.select(R.strict_missing(F.col("description"), F.col("l"))).first()[0] == missing


def decided(spark, description, settings=D.Settings(), windows=1, **p):
    chances = {c: p.get(c, 0.99) for c in CHECKS}
    df = spark.createDataFrame([("s", description, windows, "Open", *chances.values())], "summary string, description string, windows int, state string, " + ", ".join(f"p_{c} double" for c in CHECKS))
    return D.decided(df, settings).select("*", D.complete().alias("complete"), D.comment(settings).alias("comment")).first()


def test_decision_order(spark):
    assert decided(spark, "text", steps=0.6).steps == "unsure"
    assert decided(spark, "").steps == "missing"
    assert decided(spark, "### Expected\n-").expected == "missing"
    long = decided(spark, "text", windows=2)
    assert (long.steps, long.summary_what, long.long) == ("unsure", "present", True)
    assert decided(spark, "Version: latest", windows=2).build_version == "missing"
    assert decided(spark, "It doesn't work", D.Settings(strict=True)).actual == "missing"


def test_comment(spark):
    full = decided(spark, "seen in prod on qa1")
    assert full.complete and full.comment.startswith("✅") and full.comment.endswith("Environment: qa1, prod.</sub>")
    part = decided(spark, "text", steps=0.01, actual=0.7, summary_what=0.0)
    assert not part.complete
    assert "- **Steps to reproduce**: list the steps" in part.comment and "Not sure about: **Actual result**. Please check it yourself." in part.comment and "Suggestions (1)" in part.comment
