"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length.

Every window of ``length`` ids credits each queue with its share of all ids. A queue is served in whole quanta once its
credit allows; what is left of the credit is its deficit, carried to the next window. As shares are constant, the quanta
served after w windows have a closed form, ``served``, so that any task knows any queue's deficit at any window without
asking the tasks before it: deficits carry across windows and partitions, and no task needs more than its own documents
and the queues' totals. Windows follow each other in one stream, which is cut into sequences; only the last is padded.

Queues: one for each of the largest sources, and one that all further sources share (``MAX_QUEUES`` in all), so the table of
totals that tasks get has a fixed bound. Null sources are a source; null texts hold the end id alone; texts of any
length go on over as many sequences as they need; repeated rows are packed again; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import giving_back, stored, table
from .tokens import as_binary, encoder, merged, with_end

WORD_BPE = "word_bpe_49k.json"
LENGTH = 4096
QUANTUM = 64
MAX_QUEUES = 256
#: Rows (a task and a source each) up to which the queues' offsets are broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


class Rounds:
    """The whole schedule, from the queues' totals alone."""

    def __init__(self, totals: list[int], length: int = LENGTH, quantum: int = QUANTUM):
        self.totals = np.array(totals, np.float64)
        self.whole = np.array(totals, np.int64)
        self.length, self.quantum = length, quantum
        self.windows = max(1, -(-sum(totals) // length))

    def served(self, queue: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Ids that a queue has given before a window: whole quanta within its credit; all of it at the end."""
        credit = self.totals[queue] * window / self.windows
        quanta = np.floor(credit / self.quantum).astype(np.int64) * self.quantum
        return np.where(window >= self.windows, self.whole[queue], np.minimum(quanta, self.whole[queue]))

    def window_of(self, queue: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """The window that takes a queue's n-th quantum."""
        need = (quantum + 1) * self.quantum
        w = np.ceil(need / np.maximum(self.totals[queue], 1) * self.windows).astype(np.int64) - 1
        w = np.clip(w, 0, self.windows - 1)
        last = need > self.whole[queue]
        while (back := ~last & (w > 0) & (self.served(queue, w) >= need)).any():
            w -= back
        while (on := ~last & (w < self.windows - 1) & (self.served(queue, w + 1) < need)).any():
            w += on
        return np.where(last, self.windows - 1, w)

    def place(self, queue: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Where in the stream a queue's part of a window begins."""
        out = np.zeros(len(window), np.int64)
        for q in range(len(self.whole)):
            out += self.served(np.full(len(window), q), window + (queue > q))
        return out

    def pieces(self, queue: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents' ids, by queue and place in it, as pieces: document, start in it, length, place in the stream."""
        first, last = begin // self.quantum, (begin + count - 1) // self.quantum
        n = last - first + 1
        doc = np.repeat(np.arange(len(begin)), n)
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc]
        q = queue[doc]
        w = self.window_of(q, each)
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (w[1:] != w[:-1])])) if len(doc) else np.zeros(0, np.int64)
        doc, q, w, each = doc[new], q[new], w[new], each[new]
        a = np.maximum(begin[doc], each * self.quantum)
        ends = begin[doc] + count[doc]
        b = np.where(np.append(doc[1:] == doc[:-1], False), np.append(a[1:], 0), ends)
        at = self.place(q, w) + a - self.served(q, w)
        cuts = (at + b - a - 1) // self.length - at // self.length + 1
        k = np.repeat(np.arange(len(at)), cuts)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        lo = np.where(nth == 0, at[k], (at[k] // self.length + nth) * self.length)
        hi = np.minimum(at[k] + (b - a)[k], (lo // self.length + 1) * self.length)
        return doc[k], a[k] - begin[doc[k]] + lo - at[k], hi - lo, lo


_KEPT = "part int, source string, doc_id long, begin long, n long, width int, ids binary"


def _tokenized(file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        kind = np.dtype("<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4")
        part, before = TaskContext.get().partitionId(), defaultdict(int)
        for batch in merged(batches):
            docs, sources = batch.column("doc_id"), batch.column("source").to_pylist()
            for a, b, ids, lengths in enc.chunks(batch.column("text")):
                ids, lengths = with_end(ids, lengths, end_id)
                begin = []
                for source, n in zip(sources[a:b], lengths.tolist(), strict=True):
                    begin.append(before[source])
                    before[source] += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, part, np.int32)),
                        pa.array(sources[a:b], pa.string()),
                        docs.slice(a, b - a),
                        pa.array(begin, pa.int64()),
                        pa.array(lengths),
                        pa.array(np.full(b - a, kind.itemsize, np.int32)),
                        as_binary(ids.astype(kind), lengths),
                    ],
                    names=["part", "source", "doc_id", "begin", "n", "width", "ids"],
                )

    return giving_back(run)


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 2, length: int = LENGTH, quantum: int = QUANTUM, max_queues: int = MAX_QUEUES, with_ids: bool = False) -> DataFrame:
    """Pieces of documents(doc_id, text, source) with their sequence and offset; their ids too if asked.

    Texts are tokenized where they are read; the ids wait in the shared folder for the totals. They are not shuffled while
    the offsets, one row a task and source, are few enough to be broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    kept = stored(rows.mapInArrow(_tokenized(tokenizer, end_id), _KEPT), "packing", "none")
    by_part = stored(kept.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-totals")
    by_source = by_part.groupBy("source").agg(F.sum("n").alias("n"))
    top = by_source.orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(max_queues - 1).collect()
    total = by_source.agg(F.sum("n")).first()[0] or 0
    rest = total - sum(r["n"] for r in top)
    rounds = Rounds([r["n"] for r in top] + [rest] * (rest > 0), length, quantum)
    own = docs.sparkSession.createDataFrame([(r["source"], i) for i, r in enumerate(top)], "own string, queue int")
    queued = by_part.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("own")), "left").withColumn("queue", F.coalesce("queue", F.lit(len(top)))).drop("own")
    ahead = Window.partitionBy("queue").orderBy("part", F.asc_nulls_last("source"))
    offsets = queued.select("part", F.col("source").alias("of"), "queue", (F.sum("n").over(ahead) - F.col("n")).alias("ahead"))
    offsets = stored(offsets.withColumnRenamed("part", "in"), "packing-offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = kept.join(offsets, (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                few = pdf.iloc[i : i + 1024].reset_index(drop=True)
                doc, start, size, at = rounds.pieces(few["queue"].to_numpy(np.int64), few["begin"].to_numpy(np.int64), few["n"].to_numpy(np.int64))
                ids = [memoryview(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(few["ids"], few["width"], strict=True)]
                cut = [ids[d][4 * a : 4 * (a + k)] for d, a, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": few["doc_id"].astype("Int64").to_numpy()[doc], "start": start, "length": size, "ids_crc32": [zlib.crc32(x) for x in cut], "doc_tokens": few["n"].to_numpy()[doc], "sequence_id": at // length, "offset": at % length, "queue": few["queue"].to_numpy()[doc]})
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out.assign(ids=[np.frombuffer(x, "<i4") for x in cut]) if with_ids else out

    return placed.select("doc_id", "queue", (F.col("begin") + F.col("ahead")).alias("begin"), "n", "width", "ids").mapInPandas(giving_back(run), PIECES + ", ids array<int>" * with_ids)


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
