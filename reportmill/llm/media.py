"""GIF columns: decode LZW code streams, apply palettes, disposal and transparency, keep timed frames with histograms.

Decoding a code stream needs no loop over codes: entry j of the table is what code j wrote and the first index of code
j + 1, so each output index is a copy of an earlier one, and pointer doubling over all of them finds the literals.

A null text is empty; empty payloads hold 64 zero bytes; repeated rows give equal values; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, stored, table

WIDTH = 64
#: Rows of a frame at most, and hundredths of a second that each is shown.
FRAME_ROWS = 1024
DELAY = 4
_TABLE = 4096


def _widths(since: np.ndarray, least: int) -> np.ndarray:
    """Bits of the codes that come so many codes after a clear code: the table has grown by one for each but the first."""
    known = (1 << (least - 1)) + 1 + since
    bits = np.frexp(known.astype(np.float64))[1]
    return np.where(since == 0, least, np.clip(bits, least, 12))


@cache
def _schedule(room: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bit, end and mask of so many codes after a clear code."""
    widths = _widths(np.arange(room), least)
    ends = np.cumsum(widths)
    return ends - widths, ends, ((1 << widths) - 1).astype(np.uint32)


def lzw_codes(payload: bytes) -> list[int]:
    """Greedy codes of 8-bit indices; the table is cleared when full."""
    out, table, free = [256], {}, 258
    add, get = out.append, table.get
    if not payload:
        return [256, 257]
    at = payload[0]
    for c in payload[1:]:
        key = at << 8 | c
        code = get(key)
        if code:
            at = code
            continue
        add(at)
        if free < _TABLE:
            table[key] = free
            free += 1
        else:
            add(256)
            table.clear()
            free = 258
        at = c
    add(at)
    add(257)
    return out


def pack_codes(codes: list[int]) -> bytes:
    c = np.array(codes, np.uint32)
    at = np.arange(len(c))
    clears = np.flatnonzero(c == 256)
    since = at - np.repeat(clears + 1, np.diff(np.append(clears, len(c))))
    since[clears[1:]] = clears[1:] - clears[:-1] - 1
    since[0] = 0
    ends = np.cumsum(_widths(since, 9))
    begin = np.concatenate([[0], ends[:-1]])
    c = c << (begin & 7).astype(np.uint32)
    size = (int(ends[-1]) + 7) // 8 + 2
    out = sum(np.bincount((begin >> 3) + k, (c >> (8 * k)) & 255, size) for k in range(3))
    return out.astype(np.uint8)[:-2].tobytes()


def lzw_indices(data: bytes, least: int = 8) -> np.ndarray:
    """The indices that a code stream writes. least: the palette's bits, as the stream's first byte has it."""
    clear = 1 << least
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    n_bits, start, out = 8 * len(data), 0, []
    ended = False
    while not ended and start + least < n_bits:
        room = _TABLE + 512
        while True:  # codes up to the next clear or end code, guessing how many
            begin, ends, mask = _schedule(room, least + 1)
            fits = int(np.searchsorted(ends, n_bits - start, "right"))
            at, ends = begin[:fits] + start, ends[:fits] + start
            b = at >> 3
            codes = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (at & 7).astype(np.uint32)) & mask[:fits]
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops) or fits < room:
                break
            room *= 4
        n = int(stops[0]) if len(stops) else len(codes)
        ended = not len(stops) or codes[n] == clear + 1
        start = int(ends[n]) if len(stops) else n_bits
        if n:
            out.append(_written(codes[:n].astype(np.int64), clear))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _written(codes: np.ndarray, clear: int) -> np.ndarray:
    """The output of codes without a clear code among them."""
    n = len(codes)
    literal = codes < clear
    source = np.where(literal, np.arange(n), codes - clear - 2)
    if (source < 0).any() or (source > np.arange(n)).any() or (~literal & (source == np.arange(n))).any():
        raise ValueError("a code outside the table")
    length, hop = (~literal).astype(np.int64), source
    while True:  # hops to a literal, by pointer doubling
        further = hop[hop]
        if (further == hop).all():
            break
        length += length[hop]
        hop = further
    length += 1
    begin = np.concatenate([[0], np.cumsum(length)])
    total = int(begin[-1])
    where = np.arange(total) + np.repeat(begin[source] - begin[:-1], length)
    root = np.zeros(total, np.uint8)
    root[begin[:-1][literal]] = codes[literal]
    while True:
        further = where[where]
        if (further == where).all():
            break
        where = further
    return root[where]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """Each byte a pixel of a 256-grey palette, row by row, in as many timed frames as it takes."""
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), bytes(x for i in range(256) for x in (i, i, i))]
    for top in range(0, rows, frame_rows):
        part = payload[top * width : (top + frame_rows) * width]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0), b"\x08", _blocks(pack_codes(lzw_codes(part)))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    number: int
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    rgba: np.ndarray


def decode_gif(data: bytes) -> list[Frame]:
    """Every frame as its own indices and as the canvas that a viewer shows at that time."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def colours(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    palette, at = colours(flags, at)
    canvas, frames, now = np.zeros((height, width, 4), np.uint8), [], 0
    delay = disposal = 0
    transparent: int | None = None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = sub_blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("neither an image nor an extension")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = colours(flags, at + 10)
        least = data[at]
        body, at = sub_blocks(at + 1)
        indices = lzw_indices(body, least)[: w * h]
        if len(indices) < w * h:
            raise ValueError("a frame ends early")
        image = indices.reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            image = image[np.argsort(rows)]
        colour = own if own is not None else palette if palette is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = image[: area.shape[0], : area.shape[1]]
        drawn = np.ones(shown.shape, bool) if transparent is None else shown != transparent
        solid = np.full((max(256, len(colour)), 4), 255, np.uint8)
        solid[: len(colour), :3] = colour
        area[drawn] = solid[shown[drawn]]
        frames.append(Frame(len(frames), now, delay * 10, disposal, transparent, image.ravel(), canvas.copy()))
        now += delay * 10
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    return frames


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Visible pixels by 64 colours, two bits a channel."""
    seen = rgba.reshape(-1, 4)
    bins = (seen[:, 0] >> 6 << 4) | (seen[:, 1] >> 6 << 2) | seen[:, 2] >> 6
    return np.bincount(bins[seen[:, 3] > 0], minlength=64)


FRAMES = "frame int, start_ms long, delay_ms long, disposal int, width int, height int, indices binary, rgba binary, histogram array<long>, error string"


def gif_frames(df: DataFrame, key: str = "media_id", data: str = "media") -> DataFrame:
    """One row a frame of each GIF of a binary column; a row with the error for bytes that are none, none for null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, media in zip(pdf[key], pdf[data], strict=True):
                if media is None:
                    continue
                try:
                    rows = [(k, f.number, f.start_ms, f.delay_ms, f.disposal, f.rgba.shape[1], f.rgba.shape[0], f.indices.tobytes(), f.rgba.tobytes(), histogram(f.rgba), None) for f in decode_gif(media)]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(k, *[None] * 9, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in FRAMES.split(", "))])

    return df.select(key, data).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {FRAMES}")


_MEDIA = "doc_id long, n_bytes long, media binary"


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled up to whole lines, as the pixels of a GIF; equal texts, equal files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            media = [encode_gif(x + bytes(-len(x) % WIDTH or (0 if x else WIDTH))) for x in own]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(x) for x in own], "media": media})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(giving_back(run), _MEDIA)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, timed array<struct<frame: int, start_ms: long, delay_ms: long, disposal: int, height: int, histogram: array<long>>>"


def media_features(media: DataFrame) -> DataFrame:
    """text_media() rows, decoded: digests of the pixels and of the file; frames with their times and colour histograms; the
    histogram of all frames as the feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, n, gif in zip(pdf["doc_id"].astype("Int64"), pdf["n_bytes"], pdf["media"], strict=True):
                frames = decode_gif(gif)
                back = b"".join(f.indices.tobytes() for f in frames)
                each = [histogram(f.rgba[: len(f.indices) // WIDTH]) for f in frames]
                timed = [{"frame": f.number, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "disposal": f.disposal, "height": len(f.indices) // WIDTH, "histogram": h.tolist()} for f, h in zip(frames, each, strict=True)]
                feature = f"{len(frames)}x{WIDTH}:" + ",".join(map(str, sum(each).tolist()))
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, len(frames), timed))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "timed"]).astype({"doc_id": "Int64"})

    return media.select("doc_id", "n_bytes", "media").mapInPandas(giving_back(run), _FEATURES)


def text_media_features(docs: DataFrame) -> DataFrame:
    """Each text as a GIF that is stored in the shared folder, and what is read back from there.

    Nulls and empty texts are one line of zeros; texts of any length, in frames; repeated rows give rows each; an empty table none.
    """
    return media_features(stored(text_media(docs), "media", "none"))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_features(table(spark, sf_dir, "documents"))
