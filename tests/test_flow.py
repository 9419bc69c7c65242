"""The whole flow from events to comments, on a table and on a stream; label files, records, baselines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reportmill.jobs import views as V
from reportmill.operators import decide as D
from reportmill.operators import evaluate as E
from reportmill.operators import labels as L
from reportmill.operators import sampling as S
from reportmill.sources import issues as I
from reportmill.streaming import comments as C

SF = "/root/testdata/sf0.001"
SETTINGS = D.Settings(success_comment=False)


@pytest.fixture(scope="module")
def events(spark):
    return V.events(spark, SF).filter("event_id < 400")


def scores(events):
    return D.recorded(C.states(events, SETTINGS), lambda text: {c: S.u(c, text) for c in L.CHECKS})


def test_flow_on_a_stream_equals_the_table(spark, events, tmp_path):
    known = scores(events)
    want = {r.event_id: r.action for r in C.actions(C.flow(events, known, SETTINGS)).collect()}
    source = str(tmp_path / "in")
    events.write.parquet(source)
    stream = C.stream_actions(C.flow(spark.readStream.schema(events.schema).parquet(source), known, SETTINGS))
    seen = []
    q = stream.writeStream.foreachBatch(lambda batch, i: seen.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert want and {r.event_id: r.action for r in seen} == want


def test_closed_and_other_issues_are_not_checked(events):
    assert C.states(events, SETTINGS).filter("type <> 'bug' or state is null").count() == 0


def test_replay_refuses_states_that_were_never_scored(events):
    states = C.states(events, SETTINGS)
    assert D.replayed(states, scores(events)).filter("p_steps is null").count() == 0
    with pytest.raises(Exception, match="no recorded answer"):
        D.replayed(states, scores(events).limit(1)).select("windows").collect()


def test_strings_are_no_booleans_and_bad_lines_have_numbers(spark):
    answer = '{"id": "a", ' + ", ".join(f'"{c}": true' for c in L.CHECKS) + "}"
    rows = [(1, answer.replace("true", '"true"')), (2, answer.replace('"a"', '"b"'))]
    got = L.answer_problems(spark.createDataFrame(rows, "line int, answer string"), spark.createDataFrame([("a",), ("b",)], "id string"))
    assert sorted((r.rule, r.key) for r in got.collect()) == sorted(("not boolean", f"a:{c}") for c in L.CHECKS)
    files = spark.createDataFrame([("f", '{"steps": true}\n\n{"steps": \n[1]\n"x"')], "file string, text string")
    assert {r.line: r.answer and r.answer.steps for r in I.parse_answers(files, "steps boolean").collect()} == {1: True, 3: None, 4: None, 5: None}


def test_unexpected_fields_and_thin_codes(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", None, None)], "id string, note string, core string")
    assert [(r.key, r.detail) for r in L.unexpected_fields(rows).collect()] == [("a", "note")]
    assert L.unexpected_fields(rows.select("id")).count() == 0
    specs = spark.createDataFrame([(["V1", "V2"],)] * 8 + [(["V1"],)], "codes array<string>")
    assert {r.code: r.n for r in L.thin_codes(specs, ("V1", "V2", "V3"), 9).collect()} == {"V2": 8, "V3": 0}


def test_baseline_is_refreshed(spark, tmp_path):
    path = str(tmp_path / "baseline")
    for n in (1, 2):
        E.refresh(spark.createDataFrame([("steps", n)], "check string, decided int"), path)
    assert [tuple(r) for r in E.baseline(spark, path).select("check", "decided").collect()] == [("steps", 2)]


def test_questions_cover_the_checks(spark):
    q = spark.range(1).select(L.questions().alias("q")).first().q
    assert set(q) == set(L.CHECKS) and all(v.type == "noul" and v.text and v.criteria["false"] == "missing" for v in q.values())


def test_quotas_with_a_minimum_that_bites():
    q = S.sqrt_quotas({"a": 10_000, "b": 100, "c": 1, "d": 1}, 20, 3)
    assert sum(q.values()) == 20 and min(q.values()) == 3 and q["a"] > q["b"]
