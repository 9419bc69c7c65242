"""Near-duplicates: circulant MinHash, banding, exact Jaccard over whole shingle sets, connected components.

Signature: shingles are hashed into a ring of 2**32; one permutation places them (sigma), the second, circularly shifted
by k, gives coordinate k as the least value over the set. So two permutations give all coordinates. 60 bands of 7
coordinates miss a pair at similarity 0.8 with probability 8e-7, and propose pairs below 0.35 hardly ever.

Documents with equal sets form a class (by a 128-bit digest of the set and its size), and only one of each class, that
with the smallest doc_id, goes on: copies never meet each other. Within a band's bucket each class is first compared with
one hub, the class that meets most others over all bands, and verified links are joined to components. Then only members
of buckets that still hold several components are compared, across components, inside tasks that get blocks of a bucket:
in the first band that they share only: first by a byte of each coordinate (a pair at 0.8 falls five deviations below the
bound with probability below 1e-6), then those near enough by their whole sets. So a bucket gives rows for its members and
its links, never for its pairs. Every link is confirmed on the full sets of shingle strings.

Texts of any length are hashed whole, and a block of a bucket holds fewer sets the longer they are. Null doc_ids belong to a class but never name it; null, empty and blank texts have empty sets and link with nothing;
repeated rows are copies; other columns are kept by ``deduplicated`` and not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, column, giving_back, packed, stored, table, unpacked

BANDS, ROWS = 60, 7
#: Members of a block of a bucket, and their shingles, about: whichever is reached first.
BLOCK, BLOCK_SHINGLES = 1024, 200_000
#: Shingles whose sets a task keeps at once.
KEPT_SHINGLES = 100_000
#: A-Z to a-z in UTF-8 bytes.
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_U32 = np.uint32


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; bytes.split() parts at the same blanks as the contract."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """Distinct word n-grams; the whole sequence if it is shorter; nothing without words."""
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(size)), strict=False))


def _mixed(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the ring of 2**32."""
    x = x ^ (x >> _U32(16))
    x *= _U32(a)
    x ^= x >> _U32(15)
    x *= _U32(b)
    x ^= x >> _U32(16)
    return x


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row a set (of distinct 32-bit hashes, none empty), n coordinates each."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    placed = _mixed(np.concatenate(sets).astype(_U32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((n, len(sets)), _U32)
    x, high = np.empty_like(placed), np.empty_like(placed)
    for k in range(n):  # the second permutation, in place: times odd, folded, times odd
        np.subtract(placed, _U32(k), out=x)
        np.multiply(x, _U32(0x21F0AAAD), out=x)
        np.right_shift(x, _U32(15), out=high)
        np.bitwise_xor(x, high, out=x)
        np.multiply(x, _U32(0x735A2D97), out=x)
        np.minimum.reduceat(x, starts, out=out[k])
    return np.ascontiguousarray(out.T)


def _text_words(text: str) -> np.ndarray:
    """64-bit hashes of the text's words, all at once: sums of byte times a power, mixed."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    spans = np.diff(begin, append=len(raw))
    place = np.concatenate([np.zeros(begin[0], np.int64), np.arange(begin[0], len(raw)) - np.repeat(begin, spans)])
    power = _powers(int((end - begin).max()))
    part = np.where(blank, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)])
    return _mix64(np.add.reduceat(part, begin) + (end - begin).astype(np.uint64))


_power_table = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power_table
    if len(_power_table) <= n:
        table = np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)
        table[0] = 1
        _power_table = np.cumprod(table)
    return _power_table


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = _text_words(text or "")
    k = min(size, len(w))
    if not k:
        return w
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(out)


def _signed(size: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 128):
                few = pdf.iloc[i : i + 128]
                sets = [shingle_hashes(t, size) for t in few["text"]]
                full = [s for s in sets if len(s)]
                signed = signatures([(s >> np.uint64(32)).astype(_U32) for s in full], bands * rows) if full else np.zeros((0, bands * rows), _U32)
                keys, sketches = iter(_mix64(_fold(signed, bands, rows)).view(np.int64)), iter(signed.astype(np.uint8))
                yield pd.DataFrame({"doc_id": few["doc_id"].astype("Int64").tolist(), "n_shingles": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "keys": [next(keys) if len(s) else None for s in sets], "sketch": [next(sketches).tobytes() if len(s) else None for s in sets], "row": few["row"].tolist()}).astype({"doc_id": "Int64"})

    return giving_back(run)


def _fold(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, the band's number included."""
    by_band = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), by_band.shape[:2])
    for r in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + by_band[:, :, r])
    return key


def _verified(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, set()
        for pdf in batches:
            keep = []
            for a, text_a, text_b in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
                if a != last:
                    last, own = a, shingles(text_a, size)
                other = shingles(text_b, size)
                both = len(own & other)
                keep.append(100 * both >= percent * (len(own) + len(other) - both) and both > 0)
            yield pdf.loc[keep, ["a", "b"]]

    return giving_back(run)


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest reachable id) for every end of the edges (a, b), by large and small stars."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    was = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = checkpointed(small)
        is_now = small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        now = small
        if is_now == was:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        was = is_now


def _links(pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives that hold on their whole sets; pairs too unlike in size go first."""
    sizes = reps.select("rep", "n_shingles")
    likely = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    texts = reps.select("rep", "text")
    with_a = likely.join(texts.toDF("a", "text_a"), "a")
    return with_a.join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b").mapInPandas(_verified(size, percent), "a long, b long")


def _across(labelled: DataFrame) -> DataFrame:
    """Members of buckets that hold several components."""
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return labelled.join(several, "key")


def _in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members(key, rep, ...) dealt so that any two of a bucket meet in one task (key, i, j) of two blocks at most."""
    cut = members.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    return cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o", "blocks")


class _Block:
    """Rows of one task, sorted by (key, i, j), with their groups."""

    def __init__(self, pdf: pd.DataFrame):
        self.pdf = pdf
        place = pdf[["key", "i", "j"]].to_numpy()
        self.starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1)]))
        self.keys = np.stack(pdf["keys"])
        self.sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        self.n, self.part, self.b = (pdf[c].to_numpy() for c in ("n_shingles", "component", "b"))
        self.key, self.two = place[:, 0], place[:, 1] != place[:, 2]

    def near_pairs(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Rows that must be compared in full: of other components, sizes and sketches near, this band their first."""
        share, width = percent / 100, self.sketch.shape[1]
        least = width * share - 5 * np.sqrt(width * share * (1 - share))
        for begin, end in zip(self.starts, np.append(self.starts[1:], len(self.pdf)), strict=True):
            band = int((self.keys[begin] == self.key[begin]).argmax())
            for k in range(begin, end - 1):
                rest = slice(k + 1, end)
                near = (self.part[rest] != self.part[k]) & (100 * np.minimum(self.n[rest], self.n[k]) >= percent * np.maximum(self.n[rest], self.n[k]))
                if self.two[begin]:
                    near &= self.b[rest] != self.b[k]
                other = k + 1 + np.flatnonzero(near)
                if band and len(other):
                    other = other[~(self.keys[other, :band] == self.keys[k, :band]).any(1)]
                if len(other):
                    other = other[(self.sketch[other] == self.sketch[k]).sum(1) >= least]
                if len(other):
                    yield k, other


def _by_group(function):
    """mapInPandas over sorted rows: function gets a block of whole groups; a group that a batch cuts waits for its rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for pdf in batches:
            pdf = pdf if waiting is None else pd.concat([waiting, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf[["key", "i", "j"]].iloc[-1]
            whole = ~((pdf["key"] == last["key"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"]))
            if whole.any():
                yield function(_Block(pdf[whole].reset_index(drop=True)))
            waiting = pdf[~whole].reset_index(drop=True)
        if waiting is not None and len(waiting):
            yield function(_Block(waiting))

    return giving_back(run)


def _near_members(percent: int):
    def run(block: _Block) -> pd.DataFrame:
        near = np.zeros(len(block.pdf), bool)
        for k, other in block.near_pairs(percent):
            near[k] = near[other] = True
        return block.pdf.loc[near, ["key", "rep"]]

    return _by_group(run)


def _linked_members(size: int, percent: int):
    def run(block: _Block) -> pd.DataFrame:
        sets: dict[int, set] = {}
        kept = 0

        def own(x: int) -> set:
            nonlocal kept
            if x not in sets:
                if kept > KEPT_SHINGLES:
                    sets.clear()
                    kept = 0
                sets[x] = shingles(texts[x], size)
                kept += len(sets[x])
            return sets[x]

        texts, rep, part = (block.pdf[c].tolist() for c in ("text", "rep", "component"))
        done, out = set(), []
        for k, other in block.near_pairs(percent):
            for m in other.tolist():
                pair = (min(part[k], part[m]), max(part[k], part[m]))
                if pair in done:
                    continue
                a, b = own(k), own(m)
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    done.add(pair)
                    out.append((min(rep[k], rep[m]), max(rep[k], rep[m])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return _by_group(run)


def _together(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _links_across(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components, one for each two of a bucket at least, from open_(key, rep, component)."""
    sized = open_.join(texts.select("rep", "n_shingles"), "rep")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    sketched = _in_blocks(open_.join(texts.select("rep", "n_shingles", "sketch", "keys"), "rep"), blocks)
    near = stored(_together(sketched).mapInPandas(_near_members(percent), "key long, rep long").distinct(), "near")
    whole = _in_blocks(near.join(open_, ["key", "rep"]).join(texts.select("rep", "text", "n_shingles", "sketch", "keys"), "rep"), blocks)
    return _together(whole).mapInPandas(_linked_members(size, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (null: empty set), component_id, kept for every row of documents(doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    signed = stored(own.mapInPandas(_signed(size, bands, rows), "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary, row long"), "signatures")
    classes = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("of")).select("digest", F.col("of.doc_id").alias("rep"), F.col("of.row").alias("row"))
    reps = signed.join(classes.withColumnRenamed("row", "rep_row"), "digest").filter("doc_id = rep and row = rep_row")
    in_key = Window.partitionBy("key")
    buckets = reps.select("rep", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(in_key)).filter("n > 1")
    buckets = stored(buckets, "buckets")
    met = buckets.groupBy("rep").agg(F.sum("n").alias("met"))
    wanted = classes.join(met, "rep").select(F.col("rep").alias("doc_id"), "row", "met")
    texts = own.join(wanted, ["doc_id", "row"]).join(signed.filter("digest is not null").select("doc_id", "row", "n_shingles", "sketch", "keys"), ["doc_id", "row"])
    texts = stored(texts.select(F.col("doc_id").alias("rep"), "text", "n_shingles", "met", "sketch", "keys").dropDuplicates(["rep"]), "texts")
    members = buckets.select("key", "rep").join(texts.select("rep", "met"), "rep")
    hubs = members.groupBy("key").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("hub"))
    star = members.join(hubs, "key").filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = stored(_links(star, texts, size, percent), "links")
    joined = stored(components(links), "components")
    labelled = members.select("key", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = stored(_across(labelled), "open-buckets")
    more = stored(_links_across(open_, texts, size, percent), "links-across")
    every = joined if more.isEmpty() else components(links.unionByName(more))
    of_class = classes.join(every.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    return out.select("doc_id", "n_shingles", "digest", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, once. Rows without an id or words stay.

    Where one doc_id has several texts, each is a document of its own; of near copies with one doc_id one stays. Of rows
    equal in doc_id and text that stays whose other columns have the least hash. Other columns may have any name.
    """
    names = docs.columns
    rows = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").alias("text"), packed(docs, "text").alias("row"))
    texts = rows.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).distinct()
    if not texts.groupBy("id").count().filter("count > 1").isEmpty():  # each text gets a number in place of its doc_id
        own = stored(texts.orderBy("id", "hash").withColumn("n", F.monotonically_increasing_id()), "texts-of-ids")
        numbered = rows.join(own, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left")
        rows = stored(numbered.select(F.col("n").alias("doc_id"), "text", "row"), "numbered")
    return _deduplicated(rows, size, percent).select(*unpacked("row", names, text=F.col("text")))


def _deduplicated(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The same for rows(doc_id, text, row) of doc_ids with one text each."""
    found = stored(near_duplicates(rows, size, percent), "near-duplicates")
    gone = found.filter("doc_id is not null and not kept").select("doc_id").distinct()
    left = rows.join(gone, "doc_id", "left_anti")
    twice = found.filter("kept and digest is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return left.join(twice, "doc_id", "left_anti").unionByName(again)


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")
