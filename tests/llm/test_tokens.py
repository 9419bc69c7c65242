from __future__ import annotations

import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reportmill.llm import packing as P
from reportmill.llm import token_store as S
from reportmill.llm import tokens
from reportmill.llm.tokens import Encoder

TEXT = st.text(alphabet=st.sampled_from("abAZ .,'\n\t0129é\xa0ßő中😀́ΣςIİ<|>s-_²\x1c\r\x85"), max_size=40)
ENCODERS = {f: Encoder(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def library(e, text):
    return array("I", e.tok.encode(text or "", add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("file", ENCODERS)
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=8))
def test_same_ids_as_the_library(file, texts):
    e = ENCODERS[file]
    assert e.encode_many(texts) == [library(e, t) for t in texts]


@pytest.mark.parametrize("text", [None, "", " ", "a  b", "\na", "don't <|endoftext|> x", " lead", "trail "])
@pytest.mark.parametrize("file", ENCODERS)
def test_edges(file, text):
    assert ENCODERS[file].encode_many([text, text]) == [library(ENCODERS[file], text)] * 2


@pytest.mark.parametrize("file", ENCODERS)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("abAZ  .,'\n0é\xa0中😀́<|>_\x1c\r"), max_size=80), max_size=4))
def test_long_texts_are_cut_at_sure_borders(file, texts):
    """With pieces of few characters, so that every cut is tried."""
    e = ENCODERS[file]
    whole = tokens.PIECE, tokens.CHUNK_BYTES
    tokens.PIECE, tokens.CHUNK_BYTES = 3, 9
    try:
        assert e.encode_many(texts) == [library(e, t) for t in texts]
    finally:
        tokens.PIECE, tokens.CHUNK_BYTES = whole


@pytest.mark.parametrize("n", [1, 5, 2047, 2048, 2049, 300_000])
def test_block_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint32)
    freq = S.scaled({int(t): int(c) for t, c in zip(*np.unique(ids, return_counts=True), strict=True)})
    table = S.Frequencies(np.array(list(freq)), np.array(list(freq.values())))
    data = S.encode_block(ids, table)
    assert (S.decode_block(data, table) == ids).all()
    for a, b in ((n // 2, n), (n - 1, n), (n // 3, n // 3 + 1)):
        assert (S.decode_block(data, table, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        S.decode_block(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], table)


ROWS = [(5, "b b", "s1", 0), (3, None, None, 0), (3, "", "s2", 0), (9, "word " * 9000, "s1", 0), (None, "x y", "s3", 0), (4, "same", "s2", 0), (4, "same", "s2", 0)]
SCHEMA = "doc_id long, text string, source string, start int"


def ids_of(file, text):
    return np.frombuffer(library(ENCODERS[file], text), "<u4").tolist() + [2]


def test_store_in_order(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    S.write_tokens(df, str(tmp_path / "t"), block_tokens=100)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in S.read_documents(spark, str(tmp_path / "t")).collect()))
    assert [x[1] for x in got] == [None, 3, 3, 4, 4, 5, 9]
    at, stream = 0, []
    for start, doc, n, crc in got:
        text = {None: "x y", 3: "", 4: "same", 5: "b b", 9: "word " * 9000}[doc]
        own = ids_of("byte_bpe_50k.json", text)
        assert (start, n, crc) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += n
        stream += own
    part = sorted((r.first, list(r.ids)) for r in S.read_range(spark, str(tmp_path / "t"), 4, 5000).collect())
    assert [x for _, ids in part for x in ids] == stream[4:5004]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    S.write_tokens(none, str(tmp_path / "t"))
    assert S.read_documents(spark, str(tmp_path / "t")).count() == 0
    assert P.pack(none).count() == 0


@pytest.mark.parametrize("max_queues", [2, 256])
def test_packing_places_each_id_once(spark, max_queues):
    rows = ROWS + [(100 + i, f"doc {i} " * (i % 50), f"s{i % 5}", 0) for i in range(150)]
    pieces = P.pack(spark.createDataFrame(rows, SCHEMA), length=256, quantum=16, max_queues=max_queues, with_ids=True).collect()
    filled = {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        for k in range(p.length):
            assert (p.sequence_id, p.offset + k) not in filled
            filled[p.sequence_id, p.offset + k] = 1
    assert sorted(filled) == [(i // 256, i % 256) for i in range(len(filled))]
    assert len(filled) == sum(len(ids_of("word_bpe_49k.json", r[1])) for r in rows)


def test_windows_follow_the_shares():
    totals = [70_000, 20_000, 9_000, 1_000, 3]
    r = P.Rounds(totals, 1000, 10)
    taken = np.zeros((len(totals), r.windows + 1), int)
    for q, n in enumerate(totals):
        doc, start, size, at = r.pieces(np.array([q]), np.array([0]), np.array([n]))
        np.add.at(taken[q], at // 1000, size)
    assert (taken.sum(0)[: r.windows - 1] == 1000).all()
    assert (np.abs(taken[0, :-2] - 700) <= 40).all() and (np.abs(taken[1, :-2] - 200) <= 40).all()


@pytest.mark.parametrize("file", ENCODERS)
def test_the_library_is_asked_once_for_many_strings(file):
    """New strings go to the library joined, not one by one, and their ids are the same."""
    e, asked = Encoder(file), 0
    tok = e.tok

    class Counting:
        def encode_batch_fast(self, texts, **rest):
            nonlocal asked
            asked += len(texts)
            return tok.encode_batch_fast(texts, **rest)

    e.tok = Counting()
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i}\xa0 é{i}\ny" for i in range(3000))
    assert e.encode_many([text, "\n" + text]) == [library(ENCODERS[file], text), library(ENCODERS[file], "\n" + text)]
    assert 0 < asked < 100


def test_without_a_parting_token_strings_go_one_by_one():
    e = Encoder("byte_bpe_50k.json")
    e.between = None
    assert e.encode_many(["one two", "two  three\n"]) == [library(e, "one two"), library(e, "two  three\n")]
    e.between = (e.tok.token_to_id("a"), "a")  # one that the strings hold too
    assert Encoder.encode_many(e, ["ab ba"]) == [library(e, "ab ba")]
