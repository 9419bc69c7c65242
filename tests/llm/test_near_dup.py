from __future__ import annotations

import random
from itertools import combinations

import pytest

from reportmill.llm import near_dup as N

SCHEMA = "doc_id long, text string, kept string"


def brute(rows, size, percent=80):
    sets = {i: N.shingles(t, size) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows, base = [], []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 12, 60)))]
        for c in range(rng.choice((1, 3, 9))):
            own = list(words)
            for _ in range(c % 4):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(own) if c % 2 else " ".join(own).upper(), "n"))
    rows += [(1000, None, "n"), (1001, "", "n"), (1002, " \t\n", "n"), (1003, "one", "n"), (1004, "ONE", "n"), (1005, "a " * 30_000, "n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2).collect()}
    assert got == brute(rows, 2)
    assert got[1000] == (0, 1000) and got[1004] == (1, 1003) and got[1005] == (1, 1005)
    left = N.deduplicated(spark.createDataFrame(rows, SCHEMA), size=2)
    assert left.columns == ["doc_id", "text", "kept"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in brute(rows, 2).items() if i == c)


def test_chain_and_members_away_from_the_hub(spark):
    """Neighbours in a chain link; its ends don't: one component all the same."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[15 * i : 15 * i + 150]), "n") for i in range(8)]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()} and set(got.values()) == {0}


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, None, "x"), (2, "a b c d e f", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.component_id for r in N.near_duplicates(df).collect() if r.doc_id] == [1, 1, 1]
    left = N.deduplicated(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "a b c d e f"), (1, "a b c d e f")]
    assert N.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 7, 320])
def test_signature_agreement_estimates_similarity(k):
    import numpy as np

    a = np.arange(1000, dtype=np.uint32) * np.uint32(2654435761)
    s = N.signatures([a, np.concatenate([a[:800], a[:0]])], 2000)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.05
