"""Cleanup, by hand-made cases; native forms agree with the helper's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reportmill.functions import cleanup as C
from reportmill.functions import text as T


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.line_feeds, "a\r\nb\rc", "a\nb\nc"),
        (T.line_feeds, None, ""),
        (T.without_comments, "a<!-- x\ny -->b", "ab"),
        (T.without_struck, "a ~~gone\nfar~~ b", "a  b"),
        (T.without_struck, "a ~~stays\n\nfar~~ b", "a ~~stays\n\nfar~~ b"),
        (T.without_tags, " [UI] [API] Crash: no", "Crash: no"),
        (T.media_marked, "![x](a.png){width=3} !b.png|thumb! [^c.log] a != null !important!", "[image] [image] [image] a != null !important!"),
        (T.links_marked, "[log](https://h.org:80/x) <https://a.org/b>, https://c.org/x.", "log [link: h.org:80] [link: a.org], [link: c.org]."),
        (T.links_marked, "[https://a.org](https://a.org/x)", "[link: a.org]"),
        (T.blank_lines_joined, "\n a\n\n\n\nb ", "a\n\nb"),
        (T.without_skipped_answers, "x\n_No response_ \na _No response_", "x\n\na _No response_"),
    ],
)
def test_native(spark, f, given, want):
    assert one(spark, f, given) == want


@pytest.mark.parametrize("text", ["```\na\n```\nb", "x\n```py\n1\n2\n3\n4\n5\n6\n7\n```\ny", "```\n1\n2\n3\n4\n5\n```", "```\n1\n2\n3\n4\n5\n6\n```\nmid\n```\nz\n```", "```\nopen"])
def test_fences_native_and_by_lines(spark, text):
    assert one(spark, T.fences_cut, text) == C.fences_shortened(text)


@pytest.mark.parametrize(
    ("given", "wiki", "want"),
    [
        ("?a=1&copy=2 &lt;b&gt; &#39;", False, "?a=1&copy=2 <b> '"),
        ("{code:java}\nx\n{code}", True, "`x`"),
        ("{noformat}\n1\n2\n{NOFORMAT}", False, "```\n1\n2\n```"),
        ("E: x\n" + "\tat a.b(C.java:1)\n" * 7 + "end", False, "E: x\n" + "\tat a.b(C.java:1)\n" * 5 + T.TRUNCATED + "\nend"),
        ("Traceback (most recent call last):\n" + "  File x\n" * 6 + "ValueError: no", False, "Traceback (most recent call last):\n" + "  File x\n" * 4 + T.TRUNCATED + "\nValueError: no"),
        ("h2. Head\n# one\n## two\n*bold* {{mono}} [l|https://a.org/b]", True, "## Head\n1. one\n  1. two\n**bold** `mono` [l](https://a.org/b)"),
        ("`*code*` and -gone-", True, "`*code*` and ~~gone~~"),
    ],
)
def test_helper(given, wiki, want):
    assert C.fused(given, wiki) == want


def test_whole_pipeline_is_stable(spark):
    rows = [("[UI] Crash", "A\r\n<!-- x -->\n~~no~~ see https://a.org/b ![s](s.png)\n\n\n\nend", False), (None, None, True), ("x", "", False)]
    df = spark.createDataFrame(rows, "summary string, description string, wiki boolean")
    once = C.clean_reports(df)
    assert [tuple(r)[:2] for r in once.collect()] == [("Crash", "A\n\n see [link: a.org] [image]\n\nend"), ("", ""), ("x", "")]
    assert C.clean_reports(once.withColumn("wiki", F.lit(False))).collect() == once.withColumn("wiki", F.lit(False)).collect()
