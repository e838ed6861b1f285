"""GIF files as a media column: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

read() decodes any GIF87a or GIF89a file; it restores the row order of interlaced frames and skips plain-text blocks.
write() stores a payload of 8-bit samples as palette indices in frames 64 pixels wide, each LZW-coded, so that the
joined samples of the decoded frames are the payload again. shown() renders a file's timed frames (palette,
transparency, disposal of the frames before) with a colour histogram of each canvas; frames() makes them rows, and the
feature of decoded() is the sum of those histograms, the number of frames and the time they take.

Edge cases: a null or empty text has a payload of 64 zero bytes; equal texts give equal files; a damaged file, or one
with a canvas of over MOST_PIXELS, raises GifError in read(), and decoded() and frames() give such a row null columns
and its error; a null media value is such a file; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lodestar.llm import common

WIDTH, FRAME_ROWS, DELAY = 64, 512, 10
CLEAR, END, FIRST = 256, 257, 258
#: Codes between clears: the table never fills, so code widths follow from positions alone.
RUN = 3836
#: A header can claim any canvas of up to 65535 x 65535; larger ones than this are refused before memory is taken.
MOST_PIXELS = 1 << 24


class GifError(ValueError):
    pass


@cache
def default_palette() -> np.ndarray:
    """256 colours: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3], axis=1).astype(np.uint8)


#: Child codes by prefix code and next sample; lzw_encode leaves it empty.
CHILD = [0] * (4096 << 8)


def lzw_encode(samples: bytes) -> bytes:
    """An 8-bit LZW code stream. Its codes' widths depend only on how many codes stand since the last clear."""
    child, parts, out, made = CHILD, [], [CLEAR], []
    push, keep, nxt, last = out.append, made.append, FIRST, FIRST + RUN
    rest = iter(samples)
    w = next(rest, -1)
    for b in rest:
        k = w << 8 | b
        if c := child[k]:
            w = c
            continue
        push(w)
        child[k] = nxt
        keep(k)
        nxt += 1
        w = b
        if nxt == last:
            push(CLEAR)
            parts.append(out)
            for k in made:
                child[k] = 0
            out, made, nxt = [], [], FIRST
            push, keep = out.append, made.append
    for k in made:
        child[k] = 0
    if w >= 0:
        push(w)
    push(END)
    parts.append(out)
    n = np.concatenate([np.arange(len(p)) - (i == 0) for i, p in enumerate(parts)])  # the first part begins with the clear itself
    flat = np.concatenate([np.array(p, np.uint16) for p in parts])
    ends = np.cumsum(code_widths(n, 8))
    begin = np.concatenate([[0], ends[:-1]])
    value, at = flat.astype(np.uint32) << (begin & 7).astype(np.uint32), begin >> 3
    packed = np.zeros(int(ends[-1] + 7 >> 3) + 2, np.uint8)
    for i in range(3):  # a code has over eight bits, so no two start in one byte
        packed[at + i] |= (value >> np.uint32(8 * i)).astype(np.uint8)
    return packed[: int(ends[-1] + 7 >> 3)].tobytes()


def code_widths(since: np.ndarray, min_size: int) -> np.ndarray:
    """Bits of the code that follows so many codes since a clear."""
    edges = np.array([1 << i for i in range(min_size + 1, 12)]) - (1 << min_size) - 1
    return np.minimum(12, min_size + 1 + np.searchsorted(edges, since, "right"))


def lzw_decode(data: bytes, min_size: int, count: int) -> bytes:
    """At most count samples of a code stream with any minimum code size, deferred clears included.

    Code i (since a clear) that names table entry j repeats what code j gave and the sample after that, so it copies
    from where code j's output starts. Lengths and copies are resolved for a whole run of codes at once, by doubling.
    """
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
    raw = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    out, made, at, total = [], 0, 0, 8 * len(data)
    makers = 4096 - end  # the codes after a clear that, with the one after them, make table entries
    carried, since = np.zeros(0, np.uint32), 0  # those read so far, and all codes since the last clear
    while made < count:
        n = np.arange(since, since + min(4096, (total - at) // (min_size + 1) + 1))
        width = code_widths(n, min_size)
        begin = at + np.concatenate([[0], np.cumsum(width)])
        fit = int(np.searchsorted(begin[1:], total, "right"))
        if not fit:
            break
        first = begin[:fit]
        codes = (raw[first >> 3] >> (first & 7).astype(np.uint32)) & ((1 << width[:fit]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        m = int(stop[0]) if len(stop) else fit
        run = np.concatenate([carried, codes[:m]])
        if m:
            got = expand(run, end + 1, len(carried))
            out.append(got)
            made += len(got)
        at = int(begin[m + 1] if len(stop) else begin[fit])
        if len(stop):
            if codes[m] == end:
                break
            carried, since = carried[:0], 0
        else:
            carried, since = run[:makers], since + m
    return b"".join(out)[:count]


def expand(codes: np.ndarray, first: int, skip: int = 0) -> bytes:
    """The samples of the codes after the first skip ones; all stand after one clear. Entry first + j is code j's
    samples and the one after them."""
    codes = codes.astype(np.int64)
    n = len(codes)
    entry = np.where(codes >= first, codes - first, np.arange(n))
    literal = codes < first
    if (entry[~literal] >= np.flatnonzero(~literal)).any():
        raise GifError("code beyond the table")
    length, jump = (~literal).astype(np.int64), entry.copy()
    while (jump[jump] != jump).any():
        length, jump = length + length[jump], jump[jump]
    length += 1
    start = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(start[-1])
    shift = np.where(literal, 0, start[entry] - start[:-1])
    source = place + np.repeat(shift, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(start[-1], np.uint8)
    value[start[:-1][literal]] = codes[literal]
    return value[source[start[skip] :]].tobytes()


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


def write(samples: bytes, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the samples, whose number must be a positive multiple of WIDTH."""
    if not samples or len(samples) % WIDTH:
        raise GifError(f"{len(samples)} samples are no positive multiple of {WIDTH}")
    rows, per = len(samples) // WIDTH, WIDTH * FRAME_ROWS
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), default_palette().tobytes()]
    for i in range(0, len(samples), per):
        part = samples[i : i + per]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # height x width palette indices
    palette: np.ndarray
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: np.ndarray
    frames: list[Frame] = field(default_factory=list)

    def samples(self) -> bytes:
        return b"".join(f.samples.tobytes() for f in self.frames)

    def rendered(self) -> Iterator[tuple[int, np.ndarray]]:
        """The start in hundredths of a second and the RGB canvas of each frame, after disposal of those before."""
        canvas, now = np.broadcast_to(self.background, (self.height, self.width, 3)).copy(), 0
        for f in self.frames:
            kept = canvas.copy() if f.disposal == 3 else None
            h, w = f.samples.shape
            area = canvas[f.top : f.top + h, f.left : f.left + w]
            index = f.samples[: area.shape[0], : area.shape[1]]
            if f.transparent is None:
                area[:] = f.palette[index]
            else:
                seen = index != f.transparent
                area[seen] = f.palette[index[seen]]
            yield now, canvas if f is self.frames[-1] else canvas.copy()
            now += f.delay
            if f.disposal == 2:
                area[:] = self.background
            elif kept is not None:
                canvas = kept


def read(data: bytes) -> Gif:
    try:
        return _read(data)
    except (IndexError, struct.error) as e:
        raise GifError("the file ends early") from e


def _read(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise GifError(f"a canvas of {width} x {height}")
    at, palette = 13, np.zeros((256, 3), np.uint8)

    def colours(at: int, bits: int) -> tuple[np.ndarray, int]:
        n, out = 2 << bits, np.zeros((256, 3), np.uint8)
        if len(data) < at + 3 * n:
            raise GifError("the palette ends early")
        out[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        return out, at + 3 * n

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        palette, at = colours(at, flags & 7)
    gif, delay, disposal, clear = Gif(width, height, palette[back] if flags & 0x80 else np.zeros(3, np.uint8)), 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label, (body, end) = data[at + 1], joined(at + 2)
            if label == 0xF9:
                how, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = how >> 2 & 7, index if how & 1 else None
            at = end
        elif kind == 0x2C:
            left, top, w, h, how = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = colours(at + 10, how & 7) if how & 0x80 else (palette, at + 10)
            size, (body, at) = data[at], joined(at + 1)
            if not 1 <= size <= 8:
                raise GifError("minimum code size out of range")
            flat = lzw_decode(body, size, w * h)
            if len(flat) < w * h:
                raise GifError("a frame ends early")
            samples = np.frombuffer(flat, np.uint8).reshape(h, w)
            if how & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            gif.frames.append(Frame(left, top, samples, own, delay, disposal, clear))
            delay, disposal, clear = 0, 0, None
        else:
            raise GifError(f"unknown block {kind}")
    return gif


def shown(gif: Gif) -> Iterator[tuple[int, Frame, np.ndarray, np.ndarray]]:
    """Of each timed frame: start in hundredths of a second, frame, RGB canvas, and its pixels by quarter of the red,
    green and blue range."""
    for f, (start, rgb) in zip(gif.frames, gif.rendered(), strict=True):
        quarters = (rgb >> 6).reshape(-1, 3)
        yield start, f, rgb, np.concatenate([np.bincount(quarters[:, c], minlength=4) for c in range(3)])


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % 64 or 64 * (not raw))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a GIF file) of each text, written to a table in the shared folder and read from it."""
    common.small_batches(docs.sparkSession)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i : i + 64]
                made = [padded(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in made], "media": [write(p) for _, p in made]})

    return common.materialize(common.texts(docs).mapInPandas(encoded, "doc_id long, n_bytes long, media binary"), "media")


FRAME = "doc_id long, frame int, start_cs long, delay_cs int, width int, height int, rgb binary, histogram array<long>, error string"


def frames(media: DataFrame) -> DataFrame:
    """One row for each rendered frame of a media column: doc_id, frame, start_cs, delay_cs, width, height, rgb and its
    colour histogram; one row with the error of a file that cannot be read."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FRAME.split(", ")]
        for b in batches:
            for doc, data in zip(b["doc_id"].astype("Int64"), b["media"], strict=True):
                try:
                    gif = read(b"" if data is None else bytes(data))
                    made = ([doc, i, start, f.delay, gif.width, gif.height, rgb.tobytes(), hist, None] for i, (start, f, rgb, hist) in enumerate(shown(gif)))
                    for row in made:  # a frame at a time, since a canvas may be large
                        yield pd.DataFrame([row], columns=names).astype({"doc_id": "Int64"})
                except GifError as e:
                    yield pd.DataFrame([[doc, *[None] * 7, str(e)]], columns=names).astype({"doc_id": "Int64"})

    return media.select("doc_id", "media").mapInPandas(rows, FRAME)


def decoded(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the digests of the samples read back and of the file, and the feature of the rendered frames."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, n, data in zip(b["doc_id"], b["n_bytes"], b["media"], strict=True):
                file = b"" if data is None else bytes(data)
                row = [doc, n, None, None, None, len(file), hashlib.sha256(file).hexdigest(), None, None]
                try:
                    gif = read(file)
                    back = gif.samples()
                    hist = sum((h for *_, h in shown(gif)), np.zeros(12, np.int64))
                    feature = ",".join(map(str, [*hist, len(gif.frames), sum(f.delay for f in gif.frames)]))
                    row[2:5], row[7] = [len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:])], feature
                except GifError as e:
                    row[8] = str(e)
                rows.append(row)
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])
            yield out.astype({"doc_id": "Int64", "payload_bytes": "Int64", "tail_crc32": "Int64"})

    return media.mapInPandas(digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
