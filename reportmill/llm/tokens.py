"""Ids of public tokenizers for whole texts, at the cost of their distinct words.

A public BPE tokenizer cuts a text into pre-tokens before it merges, and merges never cross them. A text is cut here at
places that are such borders for certain, and the library encodes each distinct part once while a worker remembers it.
Texts in which a border is in doubt (control characters that Python and the library class differently, strings of special
tokens) are encoded whole, up to CHUNK_BYTES; a longer text is first cut into pieces between words of ASCII letters, so that
memory grows with its ids alone. Words are made distinct, looked up and laid side by side for many texts at once, as arrays.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of Latin-1, for which Python and the library agree.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Parts that end at a sure border: a run of letters before an ASCII non-letter, what is left up to a blank, blanks.
_PARTS = re.compile(rf" ?[{_LETTERS}]++(?=[\x00-\x7f]|\Z)| ?\S+|\s+(?!\S)|\s+")
_DOUBT = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")
#: Strings that a worker remembers at most, for each of two levels; beyond it those used least are forgotten.
REMEMBERED = 300_000
#: Strings that the library gets at once: what it gives back is many times their size.
AT_ONCE = 4096
#: Strings that it gets as one, with a special token after each: what it makes beside the ids is paid once for all of them.
TOGETHER = 256
#: Bytes of text that are encoded at once, about.
CHUNK_BYTES = 6 << 20
#: Characters of a piece of a text that is longer than that.
PIECE = 1 << 20
#: A border of pre-tokens in every tokenizer: a blank between ASCII letters, which belongs to the word after it or to none.
_BORDER = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of CHUNK_BYTES about, as each look into a memory of words costs its whole size."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.nbytes for b in waiting) >= CHUNK_BYTES:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting = []
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def joined_ranges(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of every range, one after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return pool[np.arange(total) + np.repeat(shift, lengths)]


class Ragged:
    """Arrays of ids side by side in one pool."""

    def __init__(self, pool: np.ndarray, lengths: np.ndarray):
        self.pool, self.lengths = pool, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, at: np.ndarray, groups: np.ndarray) -> Ragged:
        """The arrays at these places, the first groups[0] of them joined to one, and so on."""
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.concatenate([[0], np.cumsum(groups)])
        return Ragged(joined_ranges(self.pool, self.starts[at], lengths), np.diff(ends[cuts]))


def _strings(column: pa.Array) -> list[str]:
    """to_pylist() of strings, at a fraction of its cost."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _odd(strings: list[str], column: pa.Array) -> np.ndarray:
    """Which are empty or have white space at an end: an ASCII byte tells at once, only other ends are looked at as characters."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    some = ends[1:] > ends[:-1]
    out = ~some
    if some.any():
        first, last = raw[ends[:-1][some]], raw[ends[1:][some] - 1]
        sure = (first > 32) & (first < 127) & (last > 32) & (last < 127)
        look = np.flatnonzero(some)[~sure]
        out[look] = [strings[i][0].isspace() or strings[i][-1].isspace() for i in look.tolist()]
    return out


class Memory:
    """Ids by string, and, where that is asked for, whether it is empty or has white space at an end. Places hold until ``trim``."""

    def __init__(self, make: Callable[[list[str], np.ndarray], Ragged], ends: bool = False):
        self.make, self.ends = make, ends
        self.keys = pa.array([], pa.string())
        self.uses = np.zeros(0, np.int32)
        self.odd = np.zeros(0, bool)
        self.ids = Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def places(self, keys: pa.Array) -> np.ndarray:
        """Where the ids of each of these distinct strings are; unknown ones are made."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.uses[at[at >= 0]] += 1
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self.keys) + np.arange(len(missing))
            new = keys.take(pa.array(missing))
            strings = _strings(new)
            odd = _odd(strings, new) if self.ends else np.zeros(len(strings), bool)
            made = self.make(strings, odd)
            self.odd = np.concatenate([self.odd, odd])
            self.keys = pa.concat_arrays([self.keys, new])
            self.uses = np.concatenate([self.uses, np.zeros(len(missing), np.int32)])
            self.ids = Ragged(np.concatenate([self.ids.pool, made.pool]), np.concatenate([self.ids.lengths, made.lengths]))
        return at

    def trim(self) -> None:
        if len(self.keys) > REMEMBERED:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
            self.keys, self.uses, self.odd = self.keys.take(pa.array(keep)), self.uses[keep] // 2, self.odd[keep]
            self.ids = self.ids.take(keep, np.ones(len(keep), np.int64))


def _distinct(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings, and each string's place among them."""
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


class Encoder:
    """The ids of texts by the tokenizers library."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file if "/" in file else public_tokenizers.path(file))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab_size = self.tok.get_vocab_size()
        added = self.tok.get_added_tokens_decoder()
        self.doubt = (*_DOUBT, *(t.content for t in added.values() if "<|" not in t.content))
        #: A token that parts whatever it stands between, and its string, which is none of a sure text.
        self.between = next(((i, t.content) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        #: Does a blank before a word belong to its pre-token?
        self.blanks = "Removed" not in str(self.tok.pre_tokenizer)
        self.parts, self.words = Memory(self._together), Memory(self._word_parts, ends=True)

    def _library(self, texts: list[str]) -> Ragged:
        ids: list[list[int]] = []
        for i in range(0, len(texts), AT_ONCE):
            ids += [e.ids for e in self.tok.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return Ragged(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def _together(self, parts: list[str], _: np.ndarray) -> Ragged:
        """The same of strings that hold no special token."""
        if self.between is None:
            return self._library(parts)
        token, string = self.between
        out = []
        for i in range(0, len(parts), AT_ONCE):
            some = parts[i : i + AT_ONCE]
            joined = [string.join(some[j : j + TOGETHER]) + string for j in range(0, len(some), TOGETHER)]
            out += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(out)
        ends = np.flatnonzero(ids == token)
        if len(ends) != len(parts):  # a tokenizer that gives this id for other strings too
            return self._library(parts)
        return Ragged(np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)

    def _from_parts(self, parts: pa.Array, groups: np.ndarray) -> Ragged:
        words, at = _distinct(parts)
        places = self.parts.places(words)
        return self.parts.ids.take(places[at], groups)

    def _from_lists(self, lists: list[list[str]]) -> Ragged:
        return self._from_parts(pa.array(list(chain.from_iterable(lists)), pa.string()), np.fromiter(map(len, lists), np.int64, len(lists)))

    def _word_parts(self, words: list[str], odd: np.ndarray) -> Ragged:
        """Words that begin and end with a character are cut in one go: there a part with a blank before it begins a word."""
        parts = pa.array(_PARTS.findall("".join([" " + w for w, o in zip(words, odd.tolist(), strict=True) if not o])), pa.string())
        first = np.flatnonzero(pc.starts_with(parts, " ").to_numpy(zero_copy_only=False))
        plain = self._from_parts(parts if self.blanks else pc.utf8_ltrim(parts, " "), np.diff(first, append=len(parts)))
        if not odd.any():
            return plain
        apart = self._from_lists([_PARTS.findall(" " + words[i] if self.blanks else words[i]) for i in np.flatnonzero(odd).tolist()])
        order = np.empty(len(words), np.int64)
        order[~odd], order[odd] = np.arange(len(first)), len(first) + np.arange(int(odd.sum()))
        every = Ragged(np.concatenate([plain.pool, apart.pool]), np.concatenate([plain.lengths, apart.lengths]))
        return every.take(order, np.ones(len(words), np.int64))

    def _chunk(self, texts: pa.Array) -> Ragged:
        """Words are what blanks part; a text with blanks side by side or at an end is cut into parts from its start."""
        unsure = np.zeros(len(texts), bool)
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        raw = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]])
        for s in self.doubt:
            if s.encode() in raw:  # most chunks hold none, which all their bytes at once tell sooner
                unsure |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        del raw
        cut = pc.split_pattern(texts, " ") if self.blanks else pc.ascii_split_whitespace(texts)
        n = cut.value_lengths().to_numpy().astype(np.int64)
        first_at = np.cumsum(n) - n
        flat, is_rest = cut.flatten(), np.repeat(~unsure, n)
        if self.blanks:
            is_rest[first_at] = False
        words, at = _distinct(flat)
        used = np.zeros(len(words), bool)
        used[at[is_rest]] = True
        at = self.words.places(words.filter(pa.array(used)))[(np.cumsum(used) - 1)[at[is_rest]]]
        own = np.where(unsure, 0, n - self.blanks)
        heads: list[list[str]] = [[] for _ in range(len(texts))]
        if self.blanks:
            begins = _strings(flat.take(pa.array(first_at)))
            odd = np.concatenate([[0], np.cumsum(self.words.odd[at])])[np.concatenate([[0], np.cumsum(own)])]
            whole = np.diff(odd) > 0
            whole |= (own > 0) & np.fromiter((not b or b[-1].isspace() for b in begins), bool, len(begins))
            whole &= ~unsure
            entire = dict(zip(np.flatnonzero(whole).tolist(), _strings(texts.filter(pa.array(whole))), strict=True))
            heads = [[] if u else _PARTS.findall(entire.get(i, b)) for i, (b, u) in enumerate(zip(begins, unsure.tolist(), strict=True))]
            at, own = at[~np.repeat(whole, own)], np.where(whole, 0, own)
        rest = self.words.ids.take(at, own)
        head = self._from_lists(heads)
        asked = self._library(_strings(texts.filter(pa.array(unsure))))
        pool = np.concatenate([head.pool, rest.pool, asked.pool])
        lengths = np.concatenate([head.lengths, rest.lengths, asked.lengths])
        order = np.stack([np.arange(len(texts)), len(texts) + np.arange(len(texts))], 1)
        order[unsure, 1] = 2 * len(texts) + np.arange(int(unsure.sum()))
        self.words.trim()
        self.parts.trim()
        return Ragged(pool, lengths).take(order.ravel(), np.full(len(texts), 2))

    def _long(self, text: str) -> np.ndarray:
        """The ids of one long text, cut at sure borders, so that only its ids are held whole; without a border it is one piece."""
        out, begin = [], 0
        while begin < len(text):
            border = _BORDER.search(text, min(len(text), begin + PIECE))
            end = border.start() if border else len(text)
            out.append(self._chunk(pa.array([text[begin:end]], pa.string())).pool)
            begin = end
        return np.concatenate(out)

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, lengths) of the texts first to last, a bounded number of bytes at once; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        group = np.cumsum(size) // CHUNK_BYTES
        long = size > CHUNK_BYTES
        new = (np.diff(group) > 0) | long[1:] | long[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if long[a]:
                ids = self._long(texts[a].as_py())
                yield a, b, ids, np.array([len(ids)])
            else:
                got = self._chunk(texts.slice(a, b - a))
                yield a, b, got.pool, got.lengths

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out = []
        for _, _, ids, lengths in self.chunks(pa.array(texts, pa.string())):
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths) * 4
            out += [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return out


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same arrays with one more id at the end of each."""
    out = np.full(len(ids) + len(lengths), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(lengths + 1) - 1] = False
    out[own] = ids
    return out, lengths + 1


def as_binary(pool: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrays that lie side by side as one binary value each."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * pool.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(pool.tobytes())])


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One per worker process, as Spark reuses its Python workers."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]
