"""Each of the first ten queries on a small folder, clashing columns and odd rows included, held against its contract."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import chat, media, secrets
from reportmill.llm.registry import QUERIES

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [(900001, None, "en", "src1"), (900002, "", None, None), (900003, " \n\t", "fr", "src1"), (900004, "ünïcode 中文 ß", "de", None), (900005, "word " * 9000, "en", "src2"), (900006, "́​…", "en", "src1")]
CLASHES = ("row", "id", "key", "source_size", "taken", "base", "spans", "start", "rank", "score", "held_out", "n_tokens", "media", "digest", "_row", "times", "hash", "own")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contract"))
    for name in ("documents", "labels", "embeddings", "conversations", "benchmark"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "documents":
            odd = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
            df = df.unionByName(odd.select(df.columns)).withColumns({c: F.lit(f"user's {c}") for c in CLASHES})
        df.repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "lang").collect()


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(file, text, known={}):  # noqa: B006
    if file not in known:
        known[file] = tokenizers.Tokenizer.from_file(public_tokenizers.path(file))
    return [*known[file].encode(text or "", add_special_tokens=False).ids, 2]


def test_op1(spark, folder, docs):
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0d]+", d.text or "")) for d in docs}
    of = {d.doc_id: d.source for d in docs}
    size = Counter()
    for i, s in of.items():
        size[s] += words[i]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:  # the excess of capped sources is shared again by weight
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] if s in capped else level * weight[s] for s in (capped or free)}
        left -= sum(target[s] for s in capped)
        free = free - capped if capped else set()
    got, taken = rows(spark, folder, "op1_cube_mix"), Counter()
    assert sorted(r.doc_id for r in got) == sorted(of)
    for r in got:
        s = of[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    longest = defaultdict(int)
    for i, s in of.items():
        longest[s] = max(longest[s], words[i])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in names)
    again = {(r.doc_id, r.taken) for r in QUERIES["op1_cube_mix"](spark, folder).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_op2(spark, folder, docs):
    at, want = 0, []
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = ids_of("byte_bpe_50k.json", d.text)
        want.append((d.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, folder, "op2_rans_tokens")) == want


def test_op3(spark, folder, docs):
    got = {r.doc_id: r for r in rows(spark, folder, "op3_toxicity_knn")}
    assert sorted(got) == sorted(d.doc_id for d in docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    same = defaultdict(set)
    for d in docs:
        same[d.text or ""].add(got[d.doc_id].score)
    assert all(len(s) == 1 for s in same.values())  # the text alone counts


def test_op4(spark, folder):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()}
    got = defaultdict(list)
    for r in sorted(rows(spark, folder, "op4_cross_polytope_ann"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, matrix, found, wanted = np.array(list(v)), np.stack(list(v.values())), 0, 0
    assert set(got) == {i for i in v if i % 20 == 0}
    for q, near in got.items():
        score = (matrix * v[q]).sum(1)
        other = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [r for r, _, _ in near] == list(range(1, len(other) + 1))
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near) and all(s == pytest.approx(float(v[q] @ v[i]), abs=1e-12) for _, i, s in near)
        found += len({int(ids[i]) for i in other} & {i for _, i, _ in near})
        wanted += len(other)
    assert found >= 0.9 * wanted


def test_op5(spark, folder, docs):
    ids = {d.doc_id: ids_of("word_bpe_49k.json", d.text) for d in docs}
    parts, room = defaultdict(list), defaultdict(list)
    for r in rows(spark, folder, "op5_mixture_packing"):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        parts[r.doc_id].append((r.start, r.length))
        room[r.sequence_id].append((r.offset, r.length))
    for mine, total in [*((parts[i], len(x)) for i, x in ids.items()), *((x, None) for x in room.values())]:
        at = 0
        for start, length in sorted(mine):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= 4096
    assert len(room) == -(-sum(map(len, ids.values())) // 4096)


def test_op6(spark, folder, docs):
    kinds = [("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    got = {r.doc_id: r for r in rows(spark, folder, "op6_secret_randomness")}
    assert len(got) == len(docs)
    for d in docs:
        spans = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(d.text or "") if len(m[g]) >= least]
        text = [f"{name}:{a}:{b}" for a, _, b, name in sorted(spans)]
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert set(text) <= set(r.spans.split(",")) if text else True


def test_op6_battery_reports_random_runs_and_leaves_words(spark):
    rng = np.random.default_rng(4)
    b62 = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    words = ["configuration", "repository", "administrator", "international", "documentation", "implementation"]
    text = lambda extra: " ".join(rng.choice(words, 60)) + f" {extra} " + " ".join(rng.choice(words, 40))
    docs = [(i, text("".join(rng.choice(b62, 48)) if i < 100 else "")) for i in range(400)]
    found = secrets.with_spans(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", F.size("spans").alias("n")).collect()
    n = Counter((r.doc_id < 100, r.n > 0) for r in found)
    assert n[True, True] >= 95 and n[False, True] <= 15


def test_op7(spark, folder, docs):
    got = {r.doc_id: r for r in rows(spark, folder, "op7_language_id")}
    known = {d.lang for d in docs if d.lang and zlib.crc32(str(d.doc_id).encode()) % 4 != 2}
    assert sorted(got) == sorted(d.doc_id for d in docs)
    right = []
    for d in docs:
        r = got[d.doc_id]
        letters = any(c.isalpha() for c in d.text or "")
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in known if letters else r.lang_pred == "und"
        if r.held_out and letters and d.lang and d.doc_id < 900000:
            right.append(r.lang_pred == d.lang)
    assert np.mean(right) >= 0.95


def test_op8(spark, folder):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in rows(spark, folder, "op8_reply_trees")}
    assert set(got) == set(turns)
    for i, own in turns.items():
        said = "".join(t for role, t in own if role == "assistant")
        assert (got[i].n_turns, got[i].loss_chars) == (len(own), len(said)) and got[i].formatted_chars > 0
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert "chosen_paths" in dir(chat)


def test_op9(spark, folder, docs):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])

    sets = {d.doc_id: shingles(d.text) for d in docs}
    low = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, folder, "op9_circulant_minhash")}
    assert got == {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def test_op10(spark, folder, docs):
    got = {r.doc_id: r for r in rows(spark, folder, "op10_gif_media")}
    files = {r.doc_id: r.media for r in media.text_media(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    for d in docs:
        own = (d.text or "").encode()
        payload = own + bytes(-len(own) % 64 or (0 if own else 64))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[d.doc_id]), hashlib.sha256(files[d.doc_id]).hexdigest())
        assert sum(sum(f.histogram) for f in r.timed) == len(payload) and [f.start_ms for f in r.timed] == sorted(f.start_ms for f in r.timed)
