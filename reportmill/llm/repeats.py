"""Exact removal of repeated passages: a depth-limited radix sort of windows by most-significant-digit passes.

Every window of ``depth`` bytes of every text is a suffix of limited depth. Equal windows fall into one group, as after a
radix sort that looks at the first depth bytes only; no order among groups is needed. A window is read from its anchor
on, round its end to its beginning: of the window's strings of ``gram`` bytes, the anchor is that with the least hash (the
last of these), so equal windows have equal anchors at equal places. Read so, neighbouring windows share their first digit:

pass 1, the first digit is the string at the anchor: one row stands for the run of windows that share it (about
(depth - gram) / 2 of them); groups of one leave here, with all their windows.
pass 2, the next digit is the rest of what such a run covers: in a group of several runs all windows repeat.
pass 3, for one run of each group of pass 2 and only where a first digit has several: the digit is what STEP neighbouring
windows have in common, all but STEP - 1 of their bytes.
pass 4, the rest of each window that is left: groups of several windows repeat; a run that was alone in pass 2 gets its
windows marked.

Digits are compared by hashes, 64 bits each of two independent functions, so that windows meet by 128 bits and place. Hot
groups are counted before they are shuffled; texts meet runs and spans by (doc_id, hash of the text), in joins that Spark
can split. Nothing is gathered by group; a document's runs and spans meet at the document, no more than it has bytes.

Edges: a null text is an empty one; texts under depth bytes keep all; texts of any length are cut into overlapping chunks, so
that memory does not grow with them; rows repeated in doc_id and text repeat each other; null ids are kept apart by text;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, stored, table

DEPTH, GRAM = 400, 200
#: Neighbouring places of windows in a run that one digit of pass 3 stands for.
STEP = 25
#: Window starts of a chunk; with the depth below 2**PLACE.
CHUNK, PLACE = 1 << 18, 20
_LOW = np.uint64((1 << PLACE) - 1)
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x7FB5D329728EA185)
    x = (x ^ (x >> _U64(27))) * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


class Hashes:
    """Hashes of any substring by prefix sums: sums of a number a byte value times a power of an odd base, mod 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U64(1)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n + 1, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self._reach(len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the strings from begin to before end; equal strings have equal hashes wherever they stand."""
        return _mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def all_of(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Of every string of that size."""
        return _mixed((sums[size:] - sums[:-size]) * self.down[: len(sums) - size])


FIRST, SECOND = Hashes(11), Hashes(12)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _chunks(n: int, depth: int) -> Iterator[tuple[int, int]]:
    """(first window, windows) of each chunk of a text of n bytes."""
    windows = n - depth + 1
    for begin in range(0, windows, CHUNK):
        yield begin, min(CHUNK, windows - begin)


def runs(raw: np.ndarray, depth: int, gram: int) -> np.ndarray:
    """A column a run of windows with one anchor: first digit, anchor's place in the first window, windows, digit 2, first window."""
    out = []
    for begin, count in _chunks(len(raw), depth):
        part = raw[begin : begin + count + depth - 1]
        digits = FIRST.all_of(FIRST.sums(part), gram)
        places = _LOW - np.arange(len(digits), dtype=np.uint64)
        anchor = (_LOW - (_least((digits & ~_LOW) | places, depth - gram + 1) & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        size = np.diff(first, append=count)
        rest = SECOND.of(SECOND.sums(part), first, first + size - 1 + depth)
        out.append(np.stack([digits[anchor[first]].view(np.int64), anchor[first] - first, size, rest.view(np.int64), begin + first]))
    return np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)


def _runs(depth: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(np.frombuffer(x.as_py(), np.uint8), depth, gram) for x in batch.column("text")]
            of = pa.array(np.repeat(np.arange(len(found)), [x.shape[1] for x in found]))
            columns = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("own").take(of), *map(pa.array, columns)], ["doc_id", "own", "digit", "lead", "size", "rest", "first"])

    return giving_back(run)


def _contexts(depth: int):
    """Texts with their open runs -> the runs, each with the bytes that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_ = batch.column("runs")
            of = np.repeat(np.arange(len(runs_)), runs_.value_lengths().to_numpy())
            flat = runs_.flatten()
            texts = batch.column("text").to_pylist()
            first, size = (flat.field(c).to_numpy() for c in ("first", "size"))
            covered = [texts[t][f : f + n - 1 + depth] for t, f, n in zip(of, first.tolist(), size.tolist(), strict=True)]
            where = [batch.column(c).take(pa.array(of)) for c in ("doc_id", "own")]
            yield pa.RecordBatch.from_arrays([*where, *(flat.field(c) for c in ("digit", "lead", "size", "first", "alone")), pa.array(covered, pa.binary())], ["doc_id", "own", "digit", "lead", "size", "first", "alone", "covered"])

    return giving_back(run)


def _rest(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """By the module's own table of powers: functions that are sent to workers would bring a copy of it along."""
    return SECOND.of(sums, begin, end)


def _strings(covered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over a column of bytes, and where each row begins in it."""
    sizes = np.array([len(x) for x in covered.to_pylist()], np.int64)
    return SECOND.sums(np.frombuffer(b"".join(covered.to_pylist()), np.uint8)), np.cumsum(sizes) - sizes


def _shared_parts(depth: int):
    """Open runs -> a row for each class of STEP neighbouring places: what all its windows have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "size"))
            low, high = (lead - size + 1) // STEP, lead // STEP
            of = np.repeat(np.arange(len(lead)), high - low + 1)
            part = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[of]
            sums, start = _strings(batch.column("covered"))
            begin = start[of] + lead[of] - part * STEP
            rest = _rest(sums, begin, begin - STEP + 1 + depth)
            yield pa.RecordBatch.from_arrays([batch.column("run").take(pa.array(of)), batch.column("digit").take(pa.array(of)), pa.array(part.astype(np.int32)), pa.array(rest.view(np.int64))], ["run", "digit", "part", "rest"])

    return giving_back(run)


def _windows(depth: int):
    """Open runs with their classes that are left -> a row a window: first digit, the rest's hash, and where it is (null: nobody asks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "size"))
            parts = batch.column("parts")
            of = np.repeat(np.arange(len(lead)), parts.value_lengths().to_numpy())
            low = parts.flatten().to_numpy().astype(np.int64) * STEP
            place = (low[:, None] + np.arange(STEP)).ravel()
            of = np.repeat(of, STEP)
            there = (place <= lead[of]) & (place > lead[of] - size[of])
            of, place = of[there], place[there]
            sums, start = _strings(batch.column("covered"))
            begin = start[of] + lead[of] - place
            rest = _mixed(_rest(sums, begin, begin + depth) + place.astype(np.uint64) * _U64(0x9E3779B97F4A7C15))
            at = batch.column("first").to_numpy()[of] + lead[of] - place
            asked = batch.column("alone").to_numpy(zero_copy_only=False)[of]
            own = [batch.column(c).take(pa.array(of)) for c in ("digit", "doc_id", "own")]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(rest.view(np.int64)), *own[1:], pa.array(at, mask=~asked)], ["digit", "rest", "doc_id", "own", "first"])

    return giving_back(run)


def _cut(depth: int):
    """Texts with their repeated runs of windows -> spans, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                raw, own = text.as_py(), []
                if found.is_valid:
                    first, size = (found.values.field(c).to_numpy() for c in ("first", "size"))
                    order = np.argsort(first, kind="stable")
                    begin = first[order]
                    end = np.maximum.accumulate(begin + size[order] - 1 + depth)
                    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                    own = list(zip(begin[new].tolist(), np.append(end[new[1:] - 1], end[-1]).tolist(), strict=True))
                edges = [0, *[x for span in own for x in span], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in batch.column("text").to_pylist()], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "kept", "spans"])

    return giving_back(run)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("own", F.xxhash64("text"))


def _at_texts(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    there = lists.withColumnsRenamed({"doc_id": "_of", "own": "_own"})
    return texts.join(there, (F.col("own") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_of")), how).drop("_of", "_own")


def repeated(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, own, first, size): runs of windows that start anywhere else too; own is the hash of the document's text."""
    texts = _texts(docs)
    every = texts.filter(F.octet_length("text") >= depth).mapInArrow(_runs(depth, gram), "doc_id long, own long, digit long, lead long, size long, rest long, first long")
    every = stored(every.withColumns({"lead": F.col("lead").cast("int"), "size": F.col("size").cast("int")}), "runs")
    twice = lambda df, *key: stored(df.groupBy(*key).count().filter("count > 1").select(*key), "twice")  # noqa: E731  written, so that joins with it can split hot keys
    shared = stored(every.join(twice(every, "digit"), "digit", "left_semi"), "shared")
    of = ["digit", "lead", "size", "rest"]
    groups = stored(shared.groupBy(*of).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "own", "first")]), "groups")
    whole = shared.join(groups.filter("n > 1").select(*of), of, "left_semi").select("doc_id", "own", "first", "size")
    open_ = groups.join(twice(groups, "digit"), "digit", "left_semi").select("doc_id", "own", F.struct("digit", "lead", "size", "first", (F.col("n") == 1).alias("alone")).alias("run"))
    lists = _at_texts(texts, open_.groupBy("doc_id", "own").agg(F.collect_list("run").alias("runs")), "inner").dropDuplicates(["doc_id", "own"])
    covered = lists.mapInArrow(_contexts(depth), "doc_id long, own long, digit long, lead int, size int, first long, alone boolean, covered binary")
    covered = stored(covered.select(F.monotonically_increasing_id().alias("run"), "*"), "covered")
    parts = stored(covered.select("run", "digit", "lead", "size", "covered").mapInArrow(_shared_parts(depth), "run long, digit long, part int, rest long"), "parts")
    key = ["digit", "part", "rest"]
    left = parts.join(twice(parts, *key), key, "left_semi").groupBy("run").agg(F.collect_list("part").alias("parts"))
    windows = stored(covered.join(left, "run").mapInArrow(_windows(depth), "digit long, rest long, doc_id long, own long, first long"), "windows")
    single = windows.filter("first is not null").join(twice(windows, "digit", "rest"), ["digit", "rest"], "left_semi").select("doc_id", "own", "first", F.lit(1).alias("size"))
    return whole.unionByName(single)


def without_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, kept (bytes that no repeated window covers), spans (start, end) that go."""
    found = repeated(docs, depth, gram).groupBy("doc_id", "own").agg(F.collect_set(F.struct("first", "size")).alias("found"))
    out = "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"
    return _at_texts(_texts(docs), found, "left").select("doc_id", "text", "found").mapInArrow(_cut(depth), out)


def op11_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
