"""The handlers of the keyed states get groups of issues: one call serves many, and each issue keeps its own state."""

from __future__ import annotations

import random

import pandas as pd
from test_stream_comments import SCHEMA, START, history, run

from reportmill.streaming import comments as C


class Map:
    """The map state of one group, in memory."""

    def __init__(self):
        self.rows = {}

    def getMapState(self, name, key, value):  # noqa: N802, N803
        return self

    def getValue(self, key):  # noqa: N802
        return self.rows.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value


def test_one_call_of_a_handler_serves_many_issues():
    rng = random.Random(5)
    rows = history(rng, 200)
    rng.shuffle(rows)
    pdf = pd.DataFrame(rows, columns=["repo", "number", "ts", "event_id", "fp", "complete", "comment"])
    pdf["ts"] = pdf["ts"].astype("datetime64[us]").astype("int64")
    newest, issues = Map(), Map()
    changes, actions = C._Changes(), C._Actions(False)
    changes.init(newest)
    actions.init(issues)
    for part in (pdf.iloc[: len(pdf) // 2], pdf.iloc[len(pdf) // 2 :]):
        (marked,) = changes.handleInputRows((0,), iter([part]), None)
        (done,) = actions.handleInputRows((0,), iter([marked]), None)
        assert len(done) == len(part)
    last = pdf.sort_values(["ts", "event_id"]).groupby(["repo", "number"]).last()
    has = ~pdf.groupby(["repo", "number"])["complete"].all()
    assert {k: v[2] for k, v in newest.rows.items()} == last["fp"].to_dict()
    assert {k: v[3] for k, v in issues.rows.items()} == last["comment"].to_dict()
    assert {k: v[4] is not None for k, v in issues.rows.items()} == has.to_dict()


def test_null_ids_and_times_come_first_and_large_ids_stay_exact(spark, tmp_path):
    big = (1 << 53) + 1
    rows = [
        (None, big, START, 1, "a", False, "first"), (None, big, None, 2, "b", False, "no time"),
        (0, None, START, None, "c", False, "no id"), (0, None, START, big, "d", False, "large id"),
        (0, big, None, None, "e", False, "nothing else"), (0, big + 1, START, 3, "f", True, "complete"),
    ]
    want = {(r.repo, r.number): (r.fp, r.comment) for r in C.comments_table(spark.createDataFrame(rows, SCHEMA), False).collect()}
    seen, got = run(spark, None, [rows], tmp_path, False, 100)
    assert got == want == {(None, big): ("a", "first"), (0, None): ("d", "large id"), (0, big): ("e", "nothing else")}
    assert {r.event_id for r in seen} == {1, 2, 3, None, big}
