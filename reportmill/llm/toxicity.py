"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words and the first 4 and 5 letters of longer ones: all terms of a bounded sample of labelled rows (``TOXIC`` and
``CLEAN`` documents by smallest hash of their id, exact copies of one label once), toxic and clean ones alike. Document
frequencies cover all documents. A term weighs its inverse document frequency times ``FLOOR`` plus how far, beyond two
standard errors, the sample's labels are apart on it, so that no term is dropped and those that tell labels apart count
most; a copy of an example has cosine 1 with it.

The sample's vectors form the index. Examples that are alike share a block, and each (term, block) keeps its largest
weight; a query opens blocks by falling bound until no bound can beat its k-th neighbour, so its neighbours are exact
(ties: smaller example). A vote is the neighbours' labels by cosine, with ``PRIOR`` votes for the base rate of all labelled
rows; isotonic regression on leave-one-out votes of the sample calibrates it. Neighbours are the evidence.

Null and empty texts hold no term and get the calibrated score of the base rate; very long texts are read whole; repeated
rows are scored each, and learned from once. Null labels teach nothing; of a doc_id's several labels the larger counts;
without any label every score is 0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod4, stored, table
from .tokens import Memory, Ragged, joined_ranges

TOXIC, CLEAN = 1200, 1800
NEIGHBOURS, PRIOR, BLOCK = 16, 0.5, 64
#: A neighbour's vote is its cosine to this power.
SHARPNESS = 2
#: What a term counts that does not tell the labels apart.
FLOOR = 0.02
#: Terms of the dense head at most, and the examples that each holds at least.
HEAD, LEAST_HEAD = 2048, 16
#: Blocks that every query opens; those that can beat their k-th example follow. What rounding may add to a bound.
OPENED, SLACK = 3, 1e-5
#: Texts that are compared at once; characters whose terms are counted at once, about.
TOGETHER, CHUNK_CHARS = 256, 4 << 20


def terms(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in (4, 5) if len(word) > n]


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words (runs of letters, in small ones) of many texts; each word's place among them; words a text."""
    small = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), ""))
    lists = pc.split_pattern_regex(small, r"[^\p{L}\p{M}]+")
    flat, n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    some = pc.binary_length(flat).to_numpy() > 0
    ends = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(n)])]
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(ends)


class Vocabulary:
    """The numbers of texts' known terms."""

    def __init__(self, number: dict[str, int]):
        self.number, self.memory = number, Memory(self._numbers)

    def __reduce__(self):
        return Vocabulary, (self.number,)

    def _numbers(self, words: list[str], _: np.ndarray) -> Ragged:
        get = self.number.get
        ids = [[i for t in terms(w) if (i := get(t)) is not None] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return Ragged(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of each text's known terms, in ascending order."""
        words, at, n = words_of(texts)
        places, size = self.memory.places(words)[at], max(1, len(self.number))
        known = self.memory.ids.take(places, np.ones(len(places), np.int64))
        text = np.repeat(np.repeat(np.arange(len(texts)), n), known.lengths)
        pair, times = np.unique(text * size + known.pool, return_counts=True)
        self.memory.trim()
        return pair // size, pair % size, times


def chunks(texts: pd.Series) -> Iterator[slice]:
    """Slices of a bounded number of texts and characters."""
    done = np.cumsum(texts.str.len().fillna(0).to_numpy()) // CHUNK_CHARS
    cuts = np.unique(np.concatenate([[0, len(texts)], np.flatnonzero(np.diff(done)) + 1]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield slice(a, b)


def by_text(text: np.ndarray, n: int, *arrays: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The arrays' parts of each of n texts."""
    cuts = np.searchsorted(text, np.arange(n + 1))
    return [tuple(x[a:b] for x in arrays) for a, b in zip(cuts, cuts[1:], strict=False)]


def unit(at: np.ndarray, times: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The text's vector, of length 1, over its terms."""
    v = (1 + np.log(times)) * weight[at]
    size = float(np.sqrt((v * v).sum()))
    return v / size if size else v


def alike_in_blocks(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """An order of the vectors in which neighbours are alike: halved again and again across the widest direction."""
    rng = np.random.default_rng(3)
    directions = rng.standard_normal((n_terms, 16)).astype(np.float32)
    x = np.array([v @ directions[at] for at, v in vectors], np.float64).reshape(len(vectors), 16)
    parts = [np.arange(len(vectors))]
    while len(parts[0]) > BLOCK:
        halves = []
        for p in parts:
            centred = x[p] - x[p].mean(0)
            _, axes = np.linalg.eigh(centred.T @ centred)
            p = p[np.argsort(centred @ axes[:, -1], kind="stable")]
            halves += [p[: len(p) // 2], p[len(p) // 2 :]]
        parts = halves
    return np.concatenate(parts)


Vector = dict[int, float] | tuple[np.ndarray, np.ndarray]


def _arrays(vector: Vector) -> tuple[np.ndarray, np.ndarray]:
    """A vector's terms and weights."""
    if isinstance(vector, dict):
        return np.array(list(vector), np.int64), np.array(list(vector.values()), np.float64)
    return vector


class Index:
    """Unit vectors of the examples as postings by term, with the largest weight of each term and block.

    The ``HEAD`` terms that most examples hold are kept as a dense matrix a block, so that a block is compared with many
    queries at once; the postings of all other terms are short and are added up in full. A block's bound is its head's bound
    plus the best that the other terms give any of its examples. Candidates are compared again in double precision, term
    by term, so that equal vectors tie exactly.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[Vector], n_terms: int):
        self.vectors = [tuple(x[np.argsort(v[0])] for x in v) for v in map(_arrays, vectors)]
        self.order, self.n_terms = alike_in_blocks(self.vectors, n_terms), n_terms
        self.ids, self.labels = ids, labels
        sizes = np.array([len(self.vectors[i][0]) for i in self.order], np.int64)
        term = np.concatenate([self.vectors[i][0] for i in self.order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([self.vectors[i][1] for i in self.order] or [np.zeros(0)])
        example = np.repeat(np.arange(len(self.order)), sizes)
        held = np.bincount(term, minlength=n_terms)
        head = np.argsort(-held, kind="stable")[:HEAD]
        head = head[held[head] >= LEAST_HEAD]
        self.head = np.full(n_terms, -1, np.int64)
        self.head[head] = np.arange(len(head))
        dense = self.head[term] >= 0
        self.starts = np.arange(0, max(1, len(self.order)), BLOCK)
        self.matrix = np.zeros((len(head), len(self.order)), np.float32)
        self.matrix[self.head[term[dense]], example[dense]] = weight[dense]
        self.most = np.nextafter(np.maximum.reduceat(self.matrix, self.starts, axis=1), np.float32(2)) if len(self.order) else np.zeros((len(head), 1), np.float32)
        term, example, weight = term[~dense], example[~dense], weight[~dense]
        by_term = np.argsort(term, kind="stable")
        self.example, self.weight = example[by_term], weight[by_term].astype(np.float32)
        ends = np.searchsorted(term[by_term], np.arange(n_terms + 1))
        self.begin, self.postings = ends[:-1], np.diff(ends)

    def nearest(self, vector: Vector, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
        return self.nearest_of([vector], k)[0]

    def nearest_of(self, vectors: list[Vector], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """Each vector's k examples of largest cosine above 0, as (place, cosine); but holds a doc_id each to leave out."""
        vectors, n, m = [_arrays(v) for v in vectors], len(vectors), len(self.order)
        if not n or not m:
            return [[] for _ in vectors]
        query = np.repeat(np.arange(n), [len(at) for at, _ in vectors])
        at, weight = np.concatenate([a for a, _ in vectors]), np.concatenate([w for _, w in vectors])
        column = self.head[at]
        dense = np.zeros((n, len(self.matrix)), np.float32)
        dense[query[column >= 0], column[column >= 0]] = weight[column >= 0]
        query, at, weight = query[column < 0], at[column < 0], weight[column < 0]
        times = self.postings[at]
        places = joined_ranges(self.example, self.begin[at], times) + np.repeat(query * m, times)
        shares = joined_ranges(self.weight, self.begin[at], times) * np.repeat(weight, times)
        rough = np.bincount(places, shares, n * m).reshape(n, m).astype(np.float32)
        if but is not None:
            rough[np.array(but)[:, None] == self.ids[self.order][None, :]] = -4
        bounds = dense @ self.most + np.maximum.reduceat(rough, self.starts, axis=1) + SLACK
        opened, best = np.zeros(bounds.shape, bool), np.full(n, -np.inf)
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, :OPENED], True, axis=1)
        seen = np.full((n, m), -np.inf, np.float32)
        for wanted in (lambda: first, lambda: ~opened & (bounds > 0) & (bounds >= best[:, None])):
            now = wanted()
            for block in np.flatnonzero(now.any(0)):
                own, part = np.flatnonzero(now[:, block]), slice(self.starts[block], self.starts[block] + BLOCK)
                seen[own, part] = rough[own, part] + dense[own] @ self.matrix[:, part]
            opened |= now
            if m > k:
                best = np.maximum(0, np.partition(seen, m - k, axis=1)[:, m - k]) - SLACK
        whole, out = np.zeros(self.n_terms), []
        for (at, weight), near in zip(vectors, seen >= np.maximum(best, -SLACK)[:, None], strict=True):
            some = self.order[np.flatnonzero(near)]
            if not len(some) or not len(at):
                out.append([])
                continue
            whole[at] = weight
            score = np.array([float((whole[self.vectors[i][0]] * self.vectors[i][1]).sum()) for i in some.tolist()])
            whole[at] = 0
            top = np.lexsort((self.ids[some], -score))[:k]
            out.append([(i, s) for i, s in zip(some[top].tolist(), score[top].tolist(), strict=True) if s > 0])
        return out


def vote(near: list[tuple[int, float]], labels: np.ndarray, base: float) -> float:
    weights = [s**SHARPNESS for _, s in near]
    return (sum(w * float(labels[i]) for (i, _), w in zip(near, weights, strict=True)) + PRIOR * base) / (sum(weights) + PRIOR)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising means of y by x (pool adjacent violators), one point a level."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a * c, b * c, c])
        if len(pools) > 1 and abs(pools[-2][0] / pools[-2][2] - a) < 1e-12:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def labelled_sample(docs: DataFrame, labels: DataFrame, learn) -> tuple[DataFrame, float]:
    """(doc_id, toxic) of the sample, and the share of toxic rows among all that may be learned from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(learn(F.col("doc_id")))
    base = known.agg(F.avg("toxic")).first()[0]
    by = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]
    parts = [known.filter(f"toxic {op} 0").orderBy(*by).limit(n) for op, n in ((">", TOXIC), ("=", CLEAN))]
    return parts[0].unionByName(parts[1]), float(base or 0.0)


def _document_frequencies(own: DataFrame, vocabulary, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents: each task adds up its own documents first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs = np.zeros(n_terms, np.int64), 0
        for pdf in batches:
            for part in chunks(pdf["text"]):
                total += np.bincount(vocabulary.value.counted(pdf["text"].iloc[part].tolist())[1], minlength=n_terms)
            docs += len(pdf)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(total[some], docs)})

    counts = own.select("text").mapInPandas(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms + 1, np.int64)
    out[counts["term"]] = counts["n"]
    return out[:n_terms], int(out[-1])


def toxicity(docs: DataFrame, labels: DataFrame, learn=lambda doc_id: F.lit(True)) -> DataFrame:
    """doc_id, score, neighbours (array<struct<doc_id, cosine, toxic>>) for every row of documents(doc_id, text)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen, base = labelled_sample(docs, labels, learn)
    joined = own.join(F.broadcast(chosen), "doc_id")  # TOXIC + CLEAN rows at most
    # Of copies with one label one stays; rows that share a doc_id but not the text are examples of their own.
    sample = stored(joined.groupBy("toxic", "text").agg(F.min("doc_id").alias("doc_id")), "toxic-sample")
    n_toxic, n_clean = sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") == 0)).first()

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                own_terms = {t for w in words_of([text])[0].to_pylist() for t in terms(w)}
                if own_terms:  # a labelled text may be null or empty
                    yield pd.DataFrame({"term": sorted(own_terms), "toxic": int(toxic > 0)})

    # Bounded by the sample: its own terms.
    seen = sample.mapInPandas(words, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("term").toPandas()
    vocabulary = spark.sparkContext.broadcast(Vocabulary({t: i for i, t in enumerate(seen["term"])}))
    df, n_docs = _document_frequencies(own, vocabulary, len(seen))
    t, c = seen["t"].to_numpy(float) + 0.5, (seen["n"] - seen["t"]).to_numpy(float) + 0.5
    apart = np.abs(np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1))) / np.sqrt(1 / t + 1 / c)
    weight = np.log((n_docs + 2) / (df + 1)) * (FLOOR + np.maximum(0, apart - 2))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, at, times = vocabulary.value.counted(pdf["text"].tolist())
            each = by_text(text, len(pdf), at, times)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [a.tobytes() for a, _ in each], "times": [n.tobytes() for _, n in each]})

    rows = stored(sample.mapInPandas(vectors, "doc_id long, toxic int, terms binary, times binary"), "toxic-examples").toPandas()
    rows = rows.sort_values(["doc_id", "toxic", "terms", "times"], ignore_index=True)
    each = [(np.frombuffer(a, np.int64), np.frombuffer(n, np.int64)) for a, n in zip(rows["terms"], rows["times"], strict=True)]
    toxic = (rows["toxic"].to_numpy() > 0).astype(float)
    index = spark.sparkContext.broadcast(Index(rows["doc_id"].to_numpy(), toxic, [(a, unit(a, n, weight)) for a, n in each], len(seen)))
    weights = spark.sparkContext.broadcast(weight)

    def voted(texts: pd.Series, but: pd.Series | None = None) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        for part in chunks(texts):
            own = texts.iloc[part].tolist()
            text, at, times = vocabulary.value.counted(own)
            each = [(a, unit(a, n, weights.value)) for a, n in by_text(text, len(own), at, times)]
            without = None if but is None else but.iloc[part].tolist()
            for i in range(0, len(each), TOGETHER):
                near_each = index.value.nearest_of(each[i : i + TOGETHER], but=without and without[i : i + TOGETHER])
                for near in near_each:
                    yield vote(near, index.value.labels, base), near

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [v for v, _ in voted(pdf["text"], pdf["doc_id"])]
            yield pd.DataFrame({"raw": raw, "toxic": (pdf["toxic"] > 0).astype(float)})

    # Leave-one-out votes, weighed so that the sample's classes have their true shares.
    tasks = max(1, min(64, (n_toxic + n_clean) // 64))
    raw = sample.repartition(tasks).mapInPandas(left_out, "raw double, toxic double").toPandas()
    true_share = np.where(raw["toxic"] > 0, base / max(1, n_toxic), (1 - base) / max(1, n_clean))
    levels, means = isotonic(raw["raw"].to_numpy(), raw["toxic"].to_numpy(), true_share) if len(raw) else (np.zeros(1), np.zeros(1))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = list(voted(pdf["text"]))
            score = np.clip(np.interp([v for v, _ in found], levels, means), 0, 1)
            ids, kinds = index.value.ids, index.value.labels
            near = [[{"doc_id": int(ids[i]), "cosine": s, "toxic": int(kinds[i])} for i, s in n] for _, n in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score, "neighbours": near})

    return own.mapInPandas(scored, "doc_id long, score double, neighbours array<struct<doc_id:long,cosine:double,toxic:int>>")


def op3_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = lambda doc_id: crc_mod4(doc_id) != 2
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours")
