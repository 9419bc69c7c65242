"""Lexical search, repeated windows and spelling variants against slow versions of their contracts, and their edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from reportmill.llm import lexical, repeats, spelling
from reportmill.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# Repeated windows ----------------------------------------------------------------------------------------------------
def slow_repeats(rows, depth=400):
    """(doc_id, n_bytes, n_removed, n_spans, digest of what is left), a row a document."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + depth] for _, b in texts for p in range(len(b) - depth + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - depth + 1):
            if seen[b[p : p + depth]] > 1:
                gone[p : p + depth] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "béta", "gamma", "δέλτα", "eps")) + str(rng.randrange(999)) for _ in range(n))


def test_repeats_equal_the_slow_version(spark):
    rng = random.Random(1)
    shared, line = prose(rng, 80), prose(rng, 30)
    edited = shared[:300] + "X" + shared[301:]
    rows = [(1, shared), (2, "before " + shared + " after"), (3, edited), (4, line * 9), (5, "a" * 3000), (6, "ab" * 700), (7, None), (8, ""), (9, "short")]
    rows += [(20 + i, prose(rng, 5) + line + prose(rng, 40) + shared[: 380 + 4 * i] + prose(rng, 30)) for i in range(8)]
    rows += [(40, rows[9][1]), (40, rows[9][1]), (None, rows[10][1]), (None, "x" + rows[10][1])]
    assert digests(repeats.without_repeats(spark.createDataFrame(rows, DOCS))) == slow_repeats(rows)


@pytest.mark.parametrize(("depth", "gram"), [(64, 32), (60, 59), (50, 50)])
def test_repeats_at_other_depths(spark, depth, gram):
    rng = random.Random(2)
    parts = [prose(rng, 12) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts)[rng.randrange(40) :] for _ in range(6))) for i in range(40)]
    assert digests(repeats.without_repeats(spark.createDataFrame(rows, DOCS), depth, gram)) == slow_repeats(rows, depth)


def test_very_long_texts_are_cut_without_loss(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=2 * repeats.CHUNK + 5000))
    edge = long[repeats.CHUNK - 700 : repeats.CHUNK + 700]
    rows = [(1, long), (2, "zz" + edge), (3, long[:500])]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in repeats.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [(0, 500), (repeats.CHUNK - 700, repeats.CHUNK + 700)], 2: [(2, 1402)], 3: [(0, 500)]}


def test_repeats_of_no_rows_and_other_columns(spark):
    assert repeats.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    more = spark.createDataFrame([(1, "a" * 401, 2, "x", 3)], DOCS + ", own long, _of string, first int")
    assert digests(repeats.without_repeats(more)) == slow_repeats([(1, "a" * 401)])


def test_op11_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_radix_repeats"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == slow_repeats(rows)


# Spelling ------------------------------------------------------------------------------------------------------------
def slow_variants(rows, letters=5, times=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run if h % 97 else run[:k] + run[k + 1 :]] += 1
    own = {w: n for w, n in counts.items() if len(w) >= letters and n >= times}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = defaultdict(list)
    for w in own:
        by[w] = [v for v in own if near(w, v)]
    best = {w: min(v, key=lambda x: (-own[x], x)) for w, v in by.items() if v}
    form = {w: f for w, f in best.items() if own[f] >= 2 * own[w]}
    out = {}
    for w in own:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, own[w], len(by[w]), own[form[w]] if w in form else None)
    return out


def table_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_the_slow_version(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcé", k=rng.randrange(5, 10))) for _ in range(60)] + ["aaaaa", "aaaaaa", "a" * 40, "b" + "a" * 40, "ababab", "bababa", "ÀÉÎÕÜ", "×÷×÷×"]
    words = []
    for w in base:
        words += [w] * rng.randrange(1, 30)
        k = rng.randrange(len(w))
        words += [w[:k] + rng.choice("abcé") + w[k + 1 :]] * 3 + [w[:k] + w[k + 1 :]] * 4 + [w[:k] + "b" + w[k:]] * 2
    rng.shuffle(words)
    rows = [(i % 90 or None, " ".join(words[i * 9 : i * 9 + 9]).title() + " 7,") for i in range(len(words) // 9 + 1)] + [(3, None), (4, ""), (5, rows_text := " ".join(words[:40])), (5, rows_text)]
    want = slow_variants(rows)
    assert len(want) > 100 and max(v[3] for v in want.values()) > 3
    assert table_of(spelling.variants(spark.createDataFrame(rows, DOCS))) == want


def test_blocks_of_a_long_list_lose_no_pair():
    import pandas as pd

    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=7)) for _ in range(90)} | {"".join(rng.choices("ab", k=8)) for _ in range(90)})
    rows = [(w, len(w) == 8, rng.randrange(3)) for w in words]
    got = set()
    for i in range(3):
        for j in range(i, 3):
            part = pd.DataFrame([(7, "x", 0, i, j, b, longer, w, 1) for w, longer, b in sorted(rows, key=lambda r: r[1]) if b in (i, j)], columns=["size", "gram", "at", "i", "j", "block", "longer", "word", "n"])
            df = spelling.list_pairs(part)
            pairs = list(zip(df["a"], df["b"], strict=True))
            assert not got & set(pairs)
            got |= set(pairs)
    short, long = [w for w in words if len(w) == 7], [w for w in words if len(w) == 8]
    want = {frozenset((a, b)) for a in short for b in short if sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    want |= {frozenset((a, b)) for a in short for b in long if any(b[:k] + b[k + 1 :] == a for k in range(8))}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)


def test_a_pair_comes_once_in_whatever_order_lists_hold_it():
    import pandas as pd

    lists = [("ab", 0, ["abcde", "abcdf"]), ("bc", 1, ["abcdf", "abcde"])]
    rows = [(5, gram, at, 0, 0, 0, False, w, 3) for gram, at, words in lists for w in words]
    df = spelling.list_pairs(pd.DataFrame(rows, columns=["size", "gram", "at", "i", "j", "block", "longer", "word", "n"]))
    assert list(zip(df["a"], df["b"], strict=True)) == [("abcde", "abcdf")]


def test_variants_without_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "one two"), (2, None)], DOCS)).count() == 0
    with pytest.raises(ValueError):
        spelling.words(spark.createDataFrame([], DOCS), letters=3)


def test_op12_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert table_of(QUERIES["op12_spelling_variants"](spark, SF)) == slow_variants(rows)


# Lexical search ------------------------------------------------------------------------------------------------------
def slow_search(docs, items, top=20):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    tf = [(i, Counter(term.findall(low(t)))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    queries = defaultdict(Counter)
    for i, text in items:
        queries[i].update(term.findall(low(text)))
    out = []
    for i, q in queries.items():
        scored = []
        for doc, c in tf:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(i, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(9000)]
    docs = [(i, " ".join(words[i * 40 : i * 40 + rng.randrange(1, 60)]).title() + "!") for i in range(200)]
    docs += [(300 + i, docs[3][1]) for i in range(50)] + [(7, docs[3][1]), (None, docs[3][1]), (400, None), (401, ""), (402, "...")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(30)] + [(3, "w1 w2 W1"), (None, "w5 w5 w7"), (50, None), (51, "nothing-matches"), (52, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("top", "block"), [(20, 100_000), (1, 100_000), (500, 40)])
def test_search_equals_the_slow_version(spark, corpus, top, block):
    docs, items = corpus
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert found(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), top, block)) == slow_search(docs, items, top)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 5, "x")], DOCS + ", row int, terms string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(one, items.limit(0)).count() == 0
    assert found(lexical.search(one, items)) == slow_search([(1, "a b")], [(1, "a")])


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted((tuple(map(int, r)) for r in con.execute(f"select item_id, rank, doc_id, score from ({ORACLES['op13_lexical_search']})").fetchall()), key=str)
    assert found(QUERIES["op13_lexical_search"](spark, SF)) == want and want
