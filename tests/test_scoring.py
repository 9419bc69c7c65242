"""Tokens and windows of the JSON state against a walk; answers are recorded once, by model and settings."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reportmill.operators import decide as D
from reportmill.operators import evaluate as E
from reportmill.operators import labels as L
from reportmill.operators import sampling as S
from reportmill.operators import scoring as X

public_tokenizers = pytest.importorskip("public_tokenizers")


@given(st.integers(0, 300), st.integers(1, 40), st.data())
def test_windows_cover_all_tokens_and_overlap(tokens, room, data):
    overlap = data.draw(st.integers(0, room - 1))
    got = X.windows_of(tokens, room, overlap)
    assert got[0][0] == 0 and got[-1][1] == tokens
    assert all(b - a == room for a, b in got[:-1]) and got[-1][1] - got[-1][0] <= room
    assert all(c[0] == a[1] - overlap for a, c in zip(got, got[1:], strict=False))
    assert len(got) == 1 or got[-1][1] - got[-1][0] > overlap  # no window that holds nothing new
    assert (len(got) > 1) == (tokens > room)


STATES = [("T", "word " * 50), ("T", "a"), ("Ünïc😀de \"q\"", "līne\nbreak \\ back 中文字 end " * 9), (None, None), ("T", "a")]


@pytest.mark.parametrize("file", [None, "byte_bpe_50k.json"])
def test_tokens_of_the_json_state(spark, file):
    make = X.by_blanks if file is None else X.by_file(public_tokenizers.path(file))
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(STATES)], "i int, summary string, description string").withColumn("json", X.state_json())
    got = {r.i: r for r in df.select("i", "json", X.tokenized(F.col("json"), make, 20, 5).alias("t")).collect()}
    for i, (summary, description) in enumerate(STATES):
        text = json.dumps({"summary": summary or "", "description": description or ""}, ensure_ascii=False, separators=(",", ":"))
        assert got[i].json == text
        spans = make()([text])[0]
        assert got[i].t.tokens == len(spans)
        assert [(w.begin, w.end) for w in got[i].t.windows] == [(spans[a][0], spans[b - 1][1]) for a, b in X.windows_of(len(spans), 20, 5)]


def test_largest_chance_over_windows(spark):
    df = spark.createDataFrame(STATES, "summary string, description string")
    windows = X.state_windows(df, X.by_blanks, 20, 5)
    score = lambda rows: rows.withColumns({f"p_{c}": S.u(c, F.col("text")) for c in L.CHECKS})
    rows = score(windows).collect()
    got = {r.state: r for r in X.answered(windows, score).collect()}
    assert len(got) == 4 and max(r.windows for r in got.values()) == 4
    for state, r in got.items():
        own = [x for x in rows if x.state == state]
        assert r.windows == len(own) and r.p_steps == max(x.p_steps for x in own)


def test_only_unseen_states_are_scored(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def make():
        def predict(pdf):
            for i in range(len(pdf)):
                (calls / f"{abs(hash(pdf['text'].iloc[i]))}").touch()
            return pd.DataFrame({f"p_{c}": pdf["text"].str.len() / 1000 for c in L.CHECKS}, index=pdf.index)

        return predict

    df = spark.createDataFrame(STATES, "summary string, description string")
    store = X.AnswerStore(spark, str(tmp_path / "s"), "m1", {"threshold": 0.8})
    assert store.answers() is None and store.missing(df).count() == 4
    assert store.update(df.limit(2), X.predictions(make)) == 2
    assert store.update(df, X.predictions(make)) == 2
    seen = len(list(calls.iterdir()))
    assert seen == 4 and store.update(df, X.predictions(make)) == 0 and len(list(calls.iterdir())) == seen
    assert store.replay(df).count() == 5 and store.replay(df).columns == ["summary", "description", *(f"p_{c}" for c in L.CHECKS), "windows"]
    with pytest.raises(ValueError, match="new one"):
        store.replay(df.unionByName(spark.createDataFrame([("new one", "x")], df.schema)))
    for model, settings in (("m2", {"threshold": 0.8}), ("m1", {"threshold": 0.9})):
        with pytest.raises(ValueError, match="holds the answers of"):
            X.AnswerStore(spark, str(tmp_path / "s"), model, settings)
    X.AnswerStore(spark, str(tmp_path / "s"), "m1", {"threshold": 0.8})


def test_long_reports_are_unsure(spark):
    df = spark.createDataFrame([("T", "word " * 50), ("T", "word")], "summary string, description string")
    answers = X.answered(X.state_windows(df, X.by_blanks, 20, 5), lambda rows: rows.withColumns({f"p_{c}": F.lit(0.99) for c in L.CHECKS}))
    got = {r.long: r.expected for r in D.decided(D.replayed(df, answers)).collect()}
    assert got == {True: "unsure", False: "present"}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_quantiles_from_counts(spark, n):
    import random
    from statistics import quantiles

    rng = random.Random(n)
    rows = [(rng.choice("ab"), rng.randrange(40)) for _ in range(n)]
    got = {r.tracker: r for r in E.token_profile(spark.createDataFrame(rows, "tracker string, tokens int"), (7, 20)).collect()}
    for tracker in {t for t, _ in rows} | {"total"}:
        own = [k for t, k in rows if tracker in (t, "total")]
        q = quantiles(own, n=100, method="inclusive") if len(own) > 1 else own * 99
        assert (got[tracker].n, got[tracker].median, got[tracker].p90, got[tracker].p99) == (len(own), round(q[49]), round(q[89]), round(q[98]))
        assert got[tracker].over_20 == pytest.approx(sum(k > 20 for k in own) / len(own))
