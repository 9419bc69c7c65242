"""Token-id output: static range asymmetric numeral system over shared frequencies, in independent interleaved blocks.

A store is a folder of three Parquet tables: ``freq`` (token, freq: the shared table, summing to 2**20), ``parts``
(part, first_token) and ``blocks`` (one row a block: which documents, and ``data``, a self-describing byte string).

A block's bytes: header, start states of the lanes, checkpoints, words, crc32 of all before. Token i of a block belongs to
lane i mod lanes; one step decodes a token in every lane. A lane's state is 64 bits wide and takes a 32-bit word when it
falls below 2**31. A checkpoint holds the states and the place in the words before its step, so that a reader starts
there. The header carries a crc32 of the block's ids, checked after decoding.

Null doc_ids come first, repeated ids follow each other by text, a null text is an empty one, a text
of any length stays in one block, which is as long as that takes; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import giving_back, scratch_path, stored, table
from .tokens import encoder, merged, with_end

BYTE_BPE = "byte_bpe_50k.json"
SCALE_BITS = 20
LANES = 2048
#: Ids after which a block closes, at the end of a document; steps between checkpoints.
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 64
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sQIIIII")
_MAGIC = b"RNS1"


class Frequencies:
    """The shared table with its cumulative sums and, for decoding, the token of each slot."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray):
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[tokens] = freqs
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def scaled(counts: dict[int, int], bits: int = SCALE_BITS) -> dict[int, int]:
    """Counts to frequencies that sum to 2**bits, each at least 1; what is left goes to the largest."""
    total, out = sum(counts.values()), {}
    room = (1 << bits) - len(counts)
    if room < 0:
        raise ValueError("more distinct tokens than slots")
    for t in sorted(counts):
        out[t] = 1 + counts[t] * room // total
    if out:
        out[max(sorted(out), key=counts.__getitem__)] += (1 << bits) - sum(out.values())
    return out


def encode_block(ids: np.ndarray, table: Frequencies, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    states, chunks, points, written = np.full(lanes, _LOW, np.uint64), [], [], 0
    shift, top = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    for s in range(steps - 1, -1, -1):
        sym = ids[s * lanes : (s + 1) * lanes]
        x = states[: len(sym)]
        f = table.freq[sym]
        full = x >= f << top
        chunks.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        written += len(chunks[-1])
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        states[: len(sym)] = (q << shift) + (x - q * f) + table.cum[sym]
        if s and s % every == 0:
            points.append((s, written, states.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    out = [_HEAD.pack(_MAGIC, n, lanes, every, len(points), len(words), zlib.crc32(ids.astype("<u4").tobytes())), states.astype("<u8").tobytes()]
    for s, done, at in reversed(points):
        out += [struct.pack("<II", s, len(words) - done), at.astype("<u8").tobytes()]
    body = b"".join([*out, words.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes, table: Frequencies, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a block, from the last checkpoint before start."""
    body, crc = data[:-4], struct.unpack("<I", data[-4:])[0]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's bytes don't match their checksum")
    magic, n, lanes, every, n_points, n_words, ids_crc = _HEAD.unpack_from(body)
    if magic != _MAGIC:
        raise ValueError("not a block")
    stop = n if stop is None else min(stop, n)
    at = _HEAD.size
    states = np.frombuffer(body, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, at + n_points * (8 + 8 * lanes)).astype(np.uint64)
    step = place = 0
    use = min(n_points, start // lanes // every)
    if use:
        at += (use - 1) * (8 + 8 * lanes)
        step, place = struct.unpack_from("<II", body, at)
        states = np.frombuffer(body, "<u8", lanes, at + 8).astype(np.uint64)
    first, out = step * lanes, np.empty(max(0, -(-stop // lanes) - step) * lanes, np.uint32)
    mask, shift, slots = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), table.slots
    for s in range(step, -(-stop // lanes)):
        k = min(lanes, n - s * lanes)
        x = states[:k]
        slot = x & mask
        sym = slots[slot]
        x = table.freq[sym] * (x >> shift) + slot - table.cum[sym]
        low = np.flatnonzero(x < _LOW)
        x[low] = x[low] << np.uint64(32) | words[place : place + len(low)]
        place += len(low)
        states[:k] = x
        out[(s - step) * lanes : (s - step) * lanes + k] = sym
    if not start and stop == n and zlib.crc32(out[:n].astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids don't match their checksum")
    return out[start - first : stop - first]


_RAW = "part int, seq int, part_token long, n_tokens long, doc_ids array<long>, doc_lens array<long>, width int, ids binary"
#: The number of a task's last row, which holds how often it has written each id.
COUNTS = -1
_LONGS = pa.list_(pa.int64())
_RAW_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", _LONGS), ("doc_lens", _LONGS), ("width", pa.int32()), ("ids", pa.binary())])


def _tokenized(file: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        kind = np.dtype("<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4")
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal seq, before
            docs = [d for own, _, _ in waiting for d in own]
            lengths, ids = (np.concatenate([w[k] for w in waiting]) for k in (1, 2))
            row = {"part": [part], "seq": [seq], "part_token": [before], "n_tokens": [len(ids)], "doc_ids": [docs], "doc_lens": [lengths], "width": [kind.itemsize], "ids": [ids.tobytes()]}
            seq, before = seq + 1, before + len(ids)
            waiting.clear()
            return pa.RecordBatch.from_pydict(row, schema=_RAW_ARROW)

        n, seen = 0, np.zeros(enc.vocab_size + 1, np.int64)
        for batch in merged(batches):
            docs = batch.column("doc_id").to_pylist()
            for a, b, ids, lengths in enc.chunks(batch.column("text")):
                ids, lengths = with_end(ids, lengths, end_id)
                new = np.bincount(ids)
                seen = np.pad(seen, (0, max(0, len(new) - len(seen))))
                seen[: len(new)] += new
                ends, done = np.cumsum(lengths), 0
                while done < b - a:
                    upto = int(np.searchsorted(ends, block_tokens - n + (ends[done - 1] if done else 0))) + 1
                    upto = min(upto, b - a)
                    first = int(ends[done - 1]) if done else 0
                    waiting.append((docs[a + done : a + upto], lengths[done:upto], ids[first : ends[upto - 1]].astype(kind)))
                    n += int(ends[upto - 1]) - first
                    done = upto
                    if n >= block_tokens:
                        yield block()
                        n = 0
        if waiting:
            yield block()
        counts = {"part": [part], "seq": [COUNTS], "part_token": [before], "n_tokens": [0], "doc_ids": [None], "doc_lens": [None], "width": [8], "ids": [seen.astype("<i8").tobytes()]}
        yield pa.RecordBatch.from_pydict(counts, schema=_RAW_ARROW)

    return giving_back(run)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for pdf in batches:
        for ids in pdf["ids"]:
            new = np.frombuffer(ids, "<i8")
            if len(new) > len(total):
                total = np.pad(total, (0, len(new) - len(total)))
            total[: len(new)] += new
    some = np.flatnonzero(total)
    yield pd.DataFrame({"token": some, "n": total[some]})


def write_tokens(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode documents(doc_id, text) in ascending doc_id order into a store at path.

    Documents are dealt by ranges of doc_id (and text, for repeated ids) and tokenized once; the ids wait in the shared
    folder for the counts. What reaches the driver is the frequency table, one row a vocabulary entry.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    every = stored(dealt.mapInArrow(_tokenized(tokenizer, end_id, block_tokens), _RAW), "ids", "none")
    raw = every.filter(F.col("seq") != COUNTS)
    counts = every.filter(F.col("seq") == COUNTS).select("ids").mapInPandas(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    freq = scaled({r["token"]: r["n"] for r in counts.collect()})
    spark.createDataFrame([(k, v) for k, v in freq.items()], "token int, freq int").coalesce(1).write.parquet(f"{path}/freq")
    totals = raw.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first_token")).write.parquet(f"{path}/parts")
    tokens, freqs = np.fromiter(freq.keys(), np.int64, len(freq)), np.fromiter(freq.values(), np.int64, len(freq))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Frequencies(tokens, freqs)
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i : i + 1]
                ids = np.frombuffer(row["ids"].iloc[0], f"<u{row['width'].iloc[0]}")
                yield row.drop(columns=["ids", "width"]).assign(data=[encode_block(ids, shared)])

    raw.mapInPandas(giving_back(encoded), _RAW.replace("width int, ids binary", "data binary")).write.parquet(f"{path}/blocks")


def _shared(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/freq").collect()
    return np.array([r["token"] for r in rows], np.int64), np.array([r["freq"] for r in rows], np.int64)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts")
    return spark.read.parquet(f"{path}/blocks").join(parts, "part").withColumn("first_token", F.col("first_token") + F.col("part_token"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the store; its ids too if asked."""
    tokens, freqs = _shared(spark, path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Frequencies(tokens, freqs)
        for pdf in batches:
            for first, docs, lens, data in zip(pdf["first_token"], pdf["doc_ids"], pdf["doc_lens"], pdf["data"], strict=True):
                ids = decode_block(data, shared).astype("<u4")
                ends = np.cumsum(lens)
                starts = ends - lens
                each = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "start": first + starts, "n_tokens": lens, "ids_crc32": [zlib.crc32(x.tobytes()) for x in each]})
                yield out.assign(ids=each) if with_ids else out

    return _blocks(spark, path).select("first_token", "doc_ids", "doc_lens", "data").mapInPandas(giving_back(decoded), schema)


def read_range(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """(first, ids) rows that cover the stream's ids start to start + length; only blocks and checkpoints that they need are decoded."""
    tokens, freqs = _shared(spark, path)
    near = _blocks(spark, path).filter((F.col("first_token") < start + length) & (F.col("first_token") + F.col("n_tokens") > start))

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Frequencies(tokens, freqs)
        for pdf in batches:
            for first, n, data in zip(pdf["first_token"], pdf["n_tokens"], pdf["data"], strict=True):
                a, b = max(0, start - first), min(n, start + length - first)
                yield pd.DataFrame({"first": [first + a], "ids": [decode_block(data, shared, a, b).astype(np.int64)]})

    return near.select("first_token", "n_tokens", "data").mapInPandas(decoded, "first long, ids array<long>")


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
