"""Spelling variants: words one edit apart, from a positional q-gram inverted index with a count filter.

Runs of letters are counted within tasks and over them; words that are long and frequent enough go into the index. A
posting is (q-gram, position, word), in lists a length; q is 2 for pairs whose shorter word has under 7 letters, else 3. One
edit destroys at most q grams of a word, so of its q + 1 rarest grams (by frequency over all words) one at least also
stands among the partner's rarest, at the same position or one off: only these grams' postings are needed to find every
pair. A list joins the words of one length with each other, and with those one letter longer; long lists are cut into
blocks that meet two by two, each in a task of its own. Within a list, the postings of all other grams are merged under
the position limit, words that share fewer grams than one edit leaves (the longer word's grams less q) go, and what is
left is verified letter by letter. So rows come out for near pairs, not for pairs of a list.

A word's form is its most frequent near word if that is at least twice as frequent; roots follow forms by pointer doubling,
a logarithm of rounds in the longest chain, which halves its frequency at each step.

Edges: null and empty texts have no runs; runs of any length are words; a null doc_id counts as an empty one in the hash;
rows repeated in doc_id count each; ties of frequency go to the smaller word in code-point order; without words the
result is empty; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, stored, table

LETTERS, TIMES, DAMAGE = 5, 3, 97
#: Words of fewer letters can share no gram with a near word.
LEAST = 4
#: Words of a block of a list, and cells (words times words times letters) that are compared at once, about.
BLOCK, CELLS = 2048, 1 << 22
#: Runs that a task counts before it sends them on, and postings that it compares at once.
COUNTED, AT_ONCE = 200_000, 20_000
#: A run's letters are Latin-1: A-Z, a-z and U+00C0 to U+00FF.
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def damaged(doc_id: int | None, run: str, every: int = DAMAGE) -> str:
    """The lower-cased run, without one letter if the hash of "doc_id:run" is a multiple of every."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[: (k := h % len(run))] + run[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for run, n in Counter(_RUN.findall(text.as_py().translate(_LOWER).decode())).items():
                counts[damaged(doc_id, run)] += n
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
    yield out()


def words(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n): distinct runs of so many letters (LEAST at least) and occurrences over all documents."""
    if letters < LEAST:
        raise ValueError(f"words need {LEAST} letters or more")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    each = own.mapInArrow(giving_back(_counted), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter((F.char_length("word") >= letters) & (F.col("n") >= times))


def gram_size(length: int) -> int:
    """q of pairs whose shorter word has so many letters."""
    return 2 if length < 7 else 3


def _grams(pdf: pd.DataFrame) -> pd.DataFrame:
    """Postings of whole words, a row a gram; only used to count grams."""
    found = Counter(w[i : i + q] for w in pdf["word"] for q in {gram_size(len(w)), gram_size(len(w) - 1)} for i in range(len(w) - q + 1))
    return pd.DataFrame({"gram": list(found), "n": list(found.values())})


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _grams(pdf)


def rarest(word: str, q: int, k: int, often: dict[str, int]) -> list[tuple[str, int]]:
    """The word's k rarest positional grams, in an order that all words share."""
    each = sorted((often.get(word[i : i + q], 0), word[i : i + q], i) for i in range(len(word) - q + 1))
    return [(g, i) for _, g, i in each[:k]]


def _postings(often):
    """Words -> rows (length of the list, gram, position, longer, word, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = often.value
        for pdf in batches:
            out = []
            for word, n in zip(pdf["word"], pdf["n"], strict=True):
                size = len(word)
                q = gram_size(size)
                out += [(size, g, i, False, word, n) for g, i in rarest(word, q, q + 1, known)]
                if size > LEAST:  # as the longer word of a pair: its grams may stand one further to the left in the shorter
                    q = gram_size(size - 1)
                    out += [(size - 1, g, at, True, word, n) for g, i in rarest(word, q, q + 1, known) for at in (i - 1, i) if 0 <= at <= size - 1 - q]
            yield pd.DataFrame(out, columns=["size", "gram", "at", "longer", "word", "n"])

    return giving_back(run)


def _letters(words_: list[str]) -> np.ndarray:
    """A row a word, all of one length."""
    return np.frombuffer("".join(words_).encode("latin-1"), np.uint8).reshape(len(words_), -1)


def _coded(letters: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((len(letters), letters.shape[1] - q + 1), np.uint32)
    for i in range(q):
        out = out * np.uint32(256) + letters[:, i : letters.shape[1] - q + 1 + i]
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Grams that each word of a shares with each of b, merged position by position; b may be one longer."""
    shift = b.shape[1] - a.shape[1]
    out = np.zeros((len(a), len(b)), np.int32)
    for i in range(a.shape[1]):
        here = a[:, i, None] == b[None, :, i]
        out += here | (a[:, i, None] == b[None, :, i + 1]) if shift else here
    return out


def _verified(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Are the words of each row one edit apart, letter by letter? v is as long as u or one longer."""
    size = u.shape[1]
    if v.shape[1] == size:
        return (u != v).sum(1) == 1
    head = np.logical_and.accumulate(u == v[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((u == v[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= size


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b (letters, as long or one longer) that are one edit apart; same: a is b, each pair once."""
    size, q = a.shape[1], gram_size(a.shape[1])
    least = b.shape[1] - q + 1 - q
    ga, gb = _coded(a, q), _coded(b, q)
    step = max(1, CELLS // max(1, len(b) * size))
    found = []
    for begin in range(0, len(a), step):
        x, y = np.nonzero(_shared(ga[begin : begin + step], gb) >= least)
        x += begin
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), max(1, CELLS // size)):
            part = slice(k, k + max(1, CELLS // size))
            near = _verified(a[x[part]], b[y[part]])
            found.append((x[part][near], y[part][near]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _products(starts: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each list, every row of the a from starts on with every row of the b from others on, list after list."""
    n = a * b
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return starts[of] + nth // b[of], others[of] + nth % b[of]


def _of_short_lists(own: np.ndarray, more: np.ndarray, starts, a, others, b) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Near pairs of many short lists at once: (rows of own, rows of own or of more, the latter?)."""
    size, q = own.shape[1], gram_size(own.shape[1])
    codes = _coded(own, q)
    for right, begin, count, longer in ((own, starts, a, False), (more, others, b, True)):
        if not len(right):
            continue
        others_codes = _coded(right, q)
        least = right.shape[1] - q + 1 - q
        group = np.cumsum(a * count * size) // CELLS
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group)) + 1):
            x, y = _products(starts[part], a[part], begin[part], count[part])
            if not longer:
                x, y = x[x < y], y[x < y]
            u, v = codes[x], others_codes[y]
            shared = (u == v[:, :-1]) | (u == v[:, 1:]) if longer else u == v
            likely = shared.sum(1) >= least
            x, y = x[likely], y[likely]
            near = _verified(own[x], right[y])
            yield x[near], y[near], longer


_KEY = ["size", "gram", "at", "i", "j"]
#: Members of a list up to which it is compared together with others.
SHORT = 48


def list_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, n_a, b, n_b): near pairs of whole lists, once each, sorted by _KEY and longer: among words of a list's length, and of these with
    longer ones; where a list is cut into blocks i and j, of one with the other."""
    words_, n, longer, block = pdf["word"].to_numpy(object), pdf["n"].to_numpy(), pdf["longer"].to_numpy(bool), pdf["block"].to_numpy()
    place = pdf[_KEY]
    new = (place[1:].to_numpy() != place[:-1].to_numpy()).any(1)
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    ends = np.append(starts[1:], len(pdf))
    own = np.add.reduceat(~longer, starts)
    size, i, j = (pdf[c].to_numpy()[starts] for c in ("size", "i", "j"))
    left, right = [], []
    for length in np.unique(size):
        here = np.flatnonzero((size == length) & (ends - starts > 1) & (own > 0))
        if not len(here):
            continue
        rows = np.arange(starts[here[0]], ends[here[-1]])
        rows_own, rows_more = rows[~longer[rows]], rows[longer[rows]]
        letters = _letters(words_[rows_own].tolist())
        more = _letters(words_[rows_more].tolist()) if len(rows_more) else np.zeros((0, length + 1), np.uint8)
        at_own = np.searchsorted(rows_own, starts[here])
        at_more = np.searchsorted(rows_more, starts[here])
        a, b = own[here], ends[here] - starts[here] - own[here]
        short = (a + b <= SHORT) & (i[here] == j[here])
        for x, y, is_longer in _of_short_lists(letters, more, at_own[short], a[short], at_more[short], b[short]):
            left.append(rows_own[x])
            right.append((rows_more if is_longer else rows_own)[y])
        for k in np.flatnonzero(~short):
            mine, theirs = np.arange(at_own[k], at_own[k] + a[k]), np.arange(at_more[k], at_more[k] + b[k])
            low, high = i[here[k]], j[here[k]]
            blocks = {z: (mine[block[rows_own[mine]] == z], theirs[block[rows_more[theirs]] == z]) for z in (low, high)}
            joins = [(blocks[low][0], blocks[high][0], False, low == high), (blocks[low][0], blocks[high][1], True, False)]
            if low != high:
                joins.append((blocks[high][0], blocks[low][1], True, False))
            for x, y, is_longer, same in joins:
                if len(x) and len(y):
                    p, r = near_pairs(letters[x], (more if is_longer else letters)[y], same)
                    left.append(rows_own[x[p]])
                    right.append((rows_more if is_longer else rows_own)[y[r]])
    p, r = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    turned = ~longer[r] & (words_[p] > words_[r]).astype(bool)  # lists hold their words in any order; a pair of one length comes smaller word first
    p, r = np.where(turned, r, p), np.where(turned, p, r)
    return pd.DataFrame({"a": words_[p], "n_a": n[p], "b": words_[r], "n_b": n[r]}).drop_duplicates(["a", "b"])


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted postings -> near pairs; lists that a batch cuts wait for their rest, and short batches for more rows."""
    waiting: list[pd.DataFrame] = []
    for pdf in batches:
        waiting.append(pdf)
        if sum(map(len, waiting)) < AT_ONCE:
            continue
        pdf = pd.concat(waiting, ignore_index=True)
        whole = (pdf[_KEY] != pdf[_KEY].iloc[-1]).any(axis=1).to_numpy()
        if whole.any():
            yield list_pairs(pdf[whole])
        waiting = [pdf[~whole]]
    if sum(map(len, waiting)):
        yield list_pairs(pd.concat(waiting, ignore_index=True))


def near_words(found: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words one edit apart, once each; found(word, n) has distinct words."""
    spark = found.sparkSession
    often = {r.gram: r.n for r in found.select("word").mapInPandas(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    # at most 90**2 + 90**3 grams, as letters are of 90 kinds
    postings = found.mapInPandas(_postings(spark.sparkContext.broadcast(often)), "size int, gram string, at int, longer boolean, word string, n long")
    postings = stored(postings, "postings")
    sizes = postings.groupBy("size", "gram", "at").agg(F.count_if(~F.col("longer")).alias("own"), F.count("*").alias("members")).filter("own > 0 and members > 1")
    sizes = sizes.select("size", "gram", "at", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    cut = postings.join(sizes, ["size", "gram", "at"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "blocks")
    together = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY, "longer")
    return stored(together.mapInPandas(giving_back(_near), "a string, n_a long, b string, n_b long").distinct(), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer doubling; forms(word, form) has no rings."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not now.filter("open").isEmpty():
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")), "roots")
    return now.select("word", "root")


def variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    found = stored(words(docs, letters, times), "words")
    pairs = near_words(found)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), "b")).alias("best"))
    known = found.join(best, "word", "left")
    more = -F.col("best.n")
    form = F.when(more >= 2 * F.col("n"), F.col("best.b"))
    formed = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), more).alias("form_n")), "forms")
    return formed.join(roots(formed.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
