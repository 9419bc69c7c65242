"""The stream gives what the table form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportmill.streaming import comments as C

ROWS = [(0, 1, "2024-01-01 00:00:00", 1, "a", True), (0, 1, "2024-01-01 00:01:00", 2, "b", False), (0, 1, "2024-01-01 00:02:00", 3, "b", False), (0, 1, "2024-01-01 00:03:00", 4, "c", True), (0, 2, "2024-01-01 00:00:00", 5, "x", True)]


def checked(spark):
    return spark.createDataFrame(ROWS, "repo long, number long, ts string, event_id long, fp string, complete boolean").withColumn("ts", F.to_timestamp("ts"))


def test_actions(spark):
    got = {r.event_id: r.action for r in C.actions(checked(spark)).collect()}
    assert got == {1: "silent", 2: "created", 3: "skipped", 4: "updated", 5: "silent"}
    assert {r.event_id: r.action for r in C.actions(checked(spark), success_comment=True).collect()}[5] == "created"


def test_stream_equals_table_and_upserts(spark, tmp_path):
    source = str(tmp_path / "in")
    checked(spark).repartition(3).write.parquet(source)
    sink = C.upsert_comments(str(tmp_path / "comments"))
    stream = C.stream_actions(spark.readStream.schema(checked(spark).schema).parquet(source))
    seen = []

    def both(batch, i):
        batch.persist()
        seen.extend(batch.collect())
        sink(batch, i)

    q = stream.writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.action for r in seen} == {r.event_id: r.action for r in C.actions(checked(spark)).collect()}
    assert [(r.number, r.fp) for r in C.current_comments(spark.read.parquet(str(tmp_path / "comments"))).collect()] == [(1, "c")]
