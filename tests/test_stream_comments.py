"""The stream's comments are the table's, over any order and any cut into micro-batches; unchanged reports are not scored."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reportmill.operators import decide as D
from reportmill.operators import labels as L
from reportmill.operators import sampling as S
from reportmill.streaming import comments as C

START = datetime(2024, 1, 1)
SCHEMA = "repo long, number long, ts timestamp, event_id long, fp string, complete boolean, comment string"


def history(rng, issues=25):
    rows, n = [], 0
    for number in range(issues):
        for _ in range(rng.randrange(1, 9)):
            fp = rng.choice("abcd")
            n += 1
            # equal fingerprints of an issue say the same and are as complete
            rows.append((number % 3, number, START + timedelta(minutes=rng.randrange(6)), n, f"{number}{fp}", hash((number, fp)) % 3 > 0, f"text {number} {fp}"))
    return rows


def run(spark, df, batches, base, success, compact):
    """The stream's events, batch by batch, and the comments that stand at the end."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{i:03}")
    seen = []
    sink = C.upsert_comments(f"{base}/out", compact)

    def both(batch, i):
        batch.persist()
        seen.extend(batch.collect())
        sink(batch, i)
        sink(batch, i)  # a batch that runs again

    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    q = C.stream_actions(source, success).writeStream.foreachBatch(both).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return seen, {(r.repo, r.number): (r.fp, r.comment) for r in C.current_comments(spark.read.parquet(f"{base}/out")).collect()}


@pytest.mark.parametrize(("seed", "success", "compact"), [(1, False, 2), (2, True, 3), (3, False, 100)])
def test_shuffled_micro_batches_leave_the_tables_comments(spark, tmp_path, seed, success, compact):
    rng = random.Random(seed)
    rows = history(rng)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r.repo, r.number): (r.fp, r.comment) for r in C.comments_table(df, success).collect()}
    rng.shuffle(rows)
    cut = len(rows) // 5
    seen, got = run(spark, df, [rows[i : i + cut] for i in range(0, len(rows), cut)], tmp_path, success, compact)
    assert got == want and want
    by_issue = {}
    for r in seen:
        by_issue.setdefault((r.repo, r.number), []).append(r.action)
    assert all(a.count("created") <= 1 for a in by_issue.values())
    ids = {(r.repo, r.number, r.comment_id) for r in seen if r.action in ("created", "updated", "skipped")}
    assert len(ids) == len(want)  # one comment an issue


def test_compaction_leaves_few_folders(spark, tmp_path):
    sink = C.upsert_comments(str(tmp_path / "c"), 2)
    rows = "repo long, number long, ts timestamp, event_id long, fp string, action string, comment string"
    for i in range(11):
        sink(spark.createDataFrame([(0, i % 4, START, i, "f", "updated", f"t{i}")], rows), i)
    folders = sorted(int(p.name[6:]) for p in (tmp_path / "c").iterdir())
    assert folders == [-10, -8, 8, 9, 10]
    assert {(r.number, r.comment) for r in C.current_comments(spark.read.parquet(str(tmp_path / "c"))).collect()} == {(0, "t8"), (1, "t9"), (2, "t10"), (3, "t7")}


def test_an_unchanged_report_is_not_scored(spark, tmp_path):
    issue = "struct<number:long,title:string,body:string,state:string,type:struct<name:string>,labels:array<struct<name:string>>>"
    body = ["1. Open", "1. Open", "2. Save", "2. Save"]
    rows = [(0, 7, START + timedelta(hours=i), i, (7, "T", b, "open", ("Bug",), [])) for i, b in enumerate(body)]
    schema = f"repo long, number long, ts timestamp, event_id long, issue {issue}"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.parquet(f"{tmp_path}/in/{i}")
    asked = tmp_path / "asked"
    asked.mkdir()

    def make():
        def predict(pdf):
            for d in pdf["description"]:
                (asked / f"{d}-{random.random()}").touch()
            return pd.DataFrame({f"p_{c}": 0.01 for c in L.CHECKS} | {"windows": 1}, index=pdf.index)

        return predict

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = []
    out = C.stream_flow(source, C.predictor(make), D.Settings()).writeStream.foreachBatch(lambda b, i: seen.extend(b.collect()))
    assert out.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    assert [r.action for r in sorted(seen, key=lambda r: r.event_id)] == ["created", "skipped", "updated", "skipped"]
    assert sorted(p.name.split("-")[0] for p in asked.iterdir()) == ["1. Open", "2. Save"]
    texts = {r.event_id: r.comment for r in seen}
    assert texts[0].startswith("**This report lacks:**") and texts[1] is None and texts[3] is None


def test_recorded_answers_are_only_asked_for_changed_states(spark):
    df = spark.createDataFrame([("s", "d", True), ("other", "d", False)], "summary string, description string, changed boolean")
    scores = D.recorded(df.filter("changed"), lambda t: {c: S.u(c, t) for c in L.CHECKS})
    assert [r.windows for r in C.replay(scores)(df).orderBy(F.desc("changed")).collect()] == [1, None]
