"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a model file; their scores are log probabilities fitted here. A space becomes the marker U+2581
and the text gets one marker in front, as the model expects. The best segmentation maximises the sum of scores; a
character that no piece covers costs the least score less 10 and becomes one piece for each of its UTF-8 bytes. No
piece holds a marker after another character, a character outside the pieces' alphabet, or certain marks next to a letter, so a text falls into units
that are segmented on their own and remembered. decode() joins pieces and bytes and turns markers back to spaces; a
marker that stood in the text itself is encoded by its bytes, so every text comes back as it was.

The file's own scores are merge ranks, no probabilities. So units are counted over all documents, and expectation
maximisation over best segmentations runs on the distinct units: from equal scores, each round counts the pieces of the
best segmentations and sets a piece's score to the log of its share, SMOOTH added to each count. What a round brings
to the driver is one count for each piece of the vocabulary.

Edge cases: a null or empty text has no pieces; equal texts have equal ids; of equally good segmentations the one
whose last piece is longest wins; without any text all pieces have equal scores; a null doc_id and repeated rows count
and are encoded as any row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

MARK = "▁"
MODEL = "piece_bpe_32k.model"
PENALTY = 10.0
ROUNDS, SMOOTH = 2, 0.1


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each stretch of so many places, one stretch after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class DoubleArray:
    """A trie of byte strings: from state s, byte b leads to base[s] + b if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = value
        size = 16 * len(children) + 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0], place, start, queue = 1, {0: 0}, 1, [0]
        self.value[0] = ends[0]
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            while used[start]:
                start += 1
            at = max(1, start - kids[0])
            first = at
            while any(used[at + b] for b in kids):
                at += 1
            if at - first > 32:  # the array is nearly full so far
                start = at + kids[0]
            s = place[node]
            self.base[s] = at
            for b in kids:
                child = children[node][b]
                used[at + b], place[child] = 1, at + b
                self.check[at + b], self.value[at + b] = s, ends[child]
                queue.append(child)
        size = max(place.values()) + 257  # all that any state and byte can reach
        self.base, self.check, self.value = self.base[:size], self.check[:size], self.value[:size]


class Model:
    LIMIT, LONGEST = 250_000, 96  # units kept between texts, and the most bytes of one that is kept

    def __init__(self, pieces: list[str], byte_ids: dict[int, int], special: set[int]):
        self.pieces, self.byte_ids, self.special = pieces, byte_ids, special
        plain = {p.encode(): i for i, p in enumerate(pieces) if i not in special and i not in byte_ids.values() and p}
        if any(MARK in p.decode().lstrip(MARK) for p in plain):
            raise ValueError("a piece holds a marker after another character")
        self.trie = DoubleArray(plain)
        self.arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.plain = np.array(sorted(plain.values()), np.int64)
        alphabet = {c for p in plain for c in p.decode()}
        outside = "".join(c for c in "\t\n\r" if c not in alphabet)
        inside = {p[i : i + 2] for p in map(bytes.decode, plain) for i in range(len(p) - 1)}  # pairs that some piece spans
        marks = sorted(c for c in alphabet if not c.isalnum() and c != MARK)
        after, before = ({x[i] for x in inside if x[1 - i].isalnum()} for i in (1, 0))  # what pieces join to a letter or digit
        tail, head = ("".join(map(re.escape, (c for c in marks if c not in own))) for own in (after, before))
        units = [f"{MARK}*[^{MARK}{outside}]+", f"{MARK}+", *([f"[{outside}]+"] if outside else [])]
        if tail:  # a word ends before a mark that no piece joins to it, and begins after one that none joins to what follows
            follows = rf"(?<=[{head}])(?=[^\W_])|" if head else ""
            units[:0] = [rf"{MARK}*[^\W_]++(?![^{MARK}{outside}{tail}])", rf"[{tail}]++(?:{follows}(?![^{MARK}{outside}]))"]
        self.units = re.compile("|".join(units))
        self.longest = max(map(len, plain), default=0)
        self.from_byte = {v: bytes([k]) for k, v in byte_ids.items()}
        self.decoded = [b"" if i in special else self.from_byte.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.byte_table = np.array([byte_ids.get(b, 0) for b in range(256)], np.int32)
        self.rate(np.full(len(pieces), -math.log(max(1, len(plain)))))

    def rate(self, scores: np.ndarray) -> Model:
        """Take other scores."""
        self.weights, self.scores = scores, scores.tolist()
        self.unknown = float(scores[self.plain].min(initial=0.0)) - PENALTY
        self.forget()
        return self

    def forget(self) -> None:
        """Keep no unit but the marker of a text itself."""
        self.number: dict[str, int] = {}
        self.pool = np.array([self.byte_ids[b] for b in MARK.encode()] if self.byte_ids else [], np.int32)
        self.lengths, self.totals = np.array([len(self.pool)]), np.array([self.unknown])

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.vocab_size())
        return cls([m.id_to_piece(i) for i in n], {int(m.id_to_piece(i)[3:5], 16): i for i in n if m.is_byte(i)}, {i for i in n if m.is_control(i) or m.is_unknown(i)})

    def best(self, unit: str) -> tuple[tuple[int, ...], float]:
        data = unit.encode()
        n = len(data)
        score, back = [None] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        at = 0
        while at < n:
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            here = score[at]
            if here is not None:
                single, s, end = False, 0, at
                for b in data[at : at + self.longest]:  # the trie's walk from here
                    t = base[s] + b
                    if check[t] != s:
                        break
                    s = t
                    end += 1
                    piece = value[s]
                    if piece >= 0:
                        total = here + scores[piece]
                        if end == at + width:
                            single = True
                        if score[end] is None or total > score[end]:
                            score[end], back[end] = total, (at, piece)
                if not single:
                    end, total = at + width, here + self.unknown
                    if score[end] is None or total > score[end]:
                        score[end], back[end] = total, (at, -1)
            at += width
        out, at = [], n
        while at:
            start, piece = back[at]
            out.append([piece] if piece >= 0 else [self.byte_ids[b] for b in data[start:at]])
            at = start
        return tuple(i for p in reversed(out) for i in p), score[n]

    def best_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """best() of many units: how many pieces each has, all their pieces in turn, and their scores. Units of like
        length go through the trie together."""
        data = [u.encode() for u in units]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        lengths, scores, found = np.zeros(len(data), np.int64), np.zeros(len(data)), []
        order = np.argsort(sizes, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(sizes[order])) + 1, [len(order)]]) if len(order) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            size = int(sizes[order[lo]])
            for at in range(lo, hi, 8192):
                part = order[at : min(hi, at + 8192)]
                if size <= self.LONGEST:
                    own = self._best_of([data[i] for i in part.tolist()], size)
                else:
                    each = [self.best(units[i]) for i in part.tolist()]
                    own = np.array([len(i) for i, _ in each]), np.array([x for i, _ in each for x in i], np.int32), np.array([x for _, x in each])
                lengths[part], scores[part] = own[0], own[2]
                found.append((part, own[0], own[1]))
        start = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        for part, size, ids in found:
            flat[spread(start[part], size)] = ids
        return lengths, flat, scores

    def _best_of(self, data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of units of so many bytes each. Positions come first in all arrays, units second."""
        base, check, value = self.arrays
        n = len(data)
        grid = np.ascontiguousarray(np.frombuffer(b"".join(data), np.uint8).reshape(n, size).T).astype(np.int32)
        plain = bool((grid < 0x80).all())
        width = 1 if plain else np.where(grid < 0x80, 1, np.where(grid < 0xE0, 2, np.where(grid < 0xF0, 3, 4)))
        score = np.full((size + 1, n), -np.inf)
        score[0] = 0.0
        back, piece = np.zeros((size + 1, n), np.int16), np.full((size + 1, n), -1, np.int32)
        for at in range(size):
            own = score[at]
            rows = here = np.arange(n) if plain else np.flatnonzero(np.isfinite(own))
            single = np.zeros(n, bool)
            state = np.zeros(len(rows), np.int32)
            for end in range(at + 1, min(size, at + self.longest) + 1):
                to = base[state] + grid[end - 1][rows]
                ok = np.flatnonzero(check[to] == state)
                if not len(ok):
                    break
                rows, state = rows[ok], to[ok]
                v = value[state]
                hit = np.flatnonzero(v >= 0)
                if not len(hit):
                    continue
                r, v = rows[hit], v[hit]
                if plain:
                    if end == at + 1:
                        single[r] = True
                else:
                    single[r[width[at][r] == end - at]] = True
                total = own[r] + self.weights[v]
                up = np.flatnonzero(total > score[end][r])
                r = r[up]
                score[end][r], back[end][r], piece[end][r] = total[up], at, v[up]
            rest = here[~single[here]]
            if len(rest):
                end = at + (1 if plain else width[at][rest])
                total = own[rest] + self.unknown
                up = total > score[end, rest]
                r, e = rest[up], end if plain else end[up]
                score[e, r], back[e, r], piece[e, r] = total[up], at, -1
        rows, at = np.arange(n), np.full(n, size)
        steps: list[tuple[np.ndarray, np.ndarray]] = []  # (unit, id) from the last piece to the first
        while len(rows):
            ids, before = piece[at, rows], back[at, rows].astype(np.int64)
            steps.append((rows[ids >= 0], ids[ids >= 0]))
            other = np.flatnonzero(ids < 0)
            if len(other):  # a character by its bytes, the last first
                stop, begin, own = at[other], before[other], rows[other]
                for k in range(1, 5):
                    on = stop - k >= begin
                    steps.append((own[on], self.byte_table[grid[(stop - k)[on], own[on]]]))
            left = before > 0
            rows, at = rows[left], before[left]
        unit, ids = np.concatenate([u for u, _ in steps]), np.concatenate([i for _, i in steps])
        order = np.argsort(unit[::-1], kind="stable")
        return np.bincount(unit, minlength=n), ids[::-1][order], score[size]

    def split(self, text: str) -> list[list[str]]:
        """The units of each part of a text; between parts stands a marker of the text itself."""
        first, out = True, []
        for part in text.split(MARK):
            out.append(self.units.findall((MARK if first else "") + part.replace(" ", MARK)))
            first = False
        return out

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        """Ids and score of each text. Each unit has a number, under which its pieces and score are kept."""
        if len(self.number) > self.LIMIT or len(self.pool) > 8 * self.LIMIT:
            self.forget()
        number, parts = self.number, [self.split(t) if t else [] for t in texts]
        new = list(set().union(*(p for t in parts for p in t)).difference(number))
        lengths, ids, scores = self.best_many(new)
        number.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
        self.lengths, self.pool, self.totals = np.concatenate([self.lengths, lengths]), np.concatenate([self.pool, ids]), np.concatenate([self.totals, scores])
        starts = np.cumsum(self.lengths) - self.lengths
        out = []
        for t in parts:
            units = list(map(number.__getitem__, t[0])) if t else []
            for part in t[1:]:
                units += [0, *map(number.__getitem__, part)]  # 0: a marker of the text itself
            at = np.array(units, np.int64)
            out.append((self.pool[spread(starts[at], self.lengths[at])], float(self.totals[at].sum())))
        for u in new:
            if len(u) > self.LONGEST:
                del number[u]
        return out

    def encode(self, text: str) -> tuple[list[int], float]:
        ids, score = self.encode_many([text])[0]
        return ids.tolist(), score

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.decoded.__getitem__, ids))
        return out.decode("utf-8", "replace")[1:]


@cache
def model(path: str) -> Model:
    return Model.load(path)


MADE: dict[tuple[str, int], Model] = {}


def rated(path: str, scores: np.ndarray) -> Model:
    """This worker's model with these scores; it keeps one."""
    key = path, zlib.crc32(scores.tobytes())
    if key not in MADE:
        MADE.clear()
        MADE[key] = model(path).rate(scores)
    return MADE[key]


def unit_counts(docs: DataFrame, path: str) -> DataFrame:
    """unit and n: how often each unit occurs in all texts."""
    common.small_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, seen = model(path), Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"unit": list(seen), "n": list(seen.values())}).astype({"unit": object, "n": np.int64})
            seen.clear()
            return out

        held = 0
        for b in batches:
            for t in b["text"]:
                for part in m.split(t) if t else ():
                    seen.update(part)
                held += len(t)
                if len(seen) > 200_000 or held > 64 << 20:
                    yield flush()
                    held = 0
        yield flush()

    return common.texts(docs).select("text").mapInPandas(common.lean(rows), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """The pieces' log probabilities after so many rounds of expectation maximisation over all texts."""
    spark = docs.sparkSession
    units = common.materialize(unit_counts(docs, path), "units")
    m = model(path)
    scores = np.full(len(m.pieces), -math.log(max(1, len(m.plain))))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(scores)  # a number for each piece

        def pieces(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = rated(path, shared.value)
            total, units, times = np.zeros(len(m.pieces), np.int64), [], []

            def add() -> None:
                lengths, ids, _ = m.best_many(units)
                np.add.at(total, ids, np.repeat(np.array(times, np.int64), lengths))
                units.clear()
                times.clear()

            for b in batches:
                units += b["unit"].tolist()
                times += b["n"].tolist()
                if len(units) > 30_000:
                    add()
            add()
            at = np.flatnonzero(total)
            yield pd.DataFrame({"piece": at.astype(np.int32), "n": total[at]})

        found = units.mapInPandas(common.lean(pieces), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(scores))
        for r in found:
            counts[r["piece"]] = r["n"]
        own = counts[m.plain] + SMOOTH
        scores = np.full(len(scores), -math.log(max(1, len(m.plain))))
        scores[m.plain] = np.log(own / own.sum())
    common.release(units)
    return scores


def encoded(docs: DataFrame, path: str, scores: np.ndarray | None = None) -> DataFrame:
    """doc_id, ids and score of every whole text, under these scores or those fitted to the documents."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(fitted(docs, path) if scores is None else scores)  # a number for each piece

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = rated(path, shared.value)
        for b in batches:
            made = m.encode_many(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "ids": [i for i, _ in made], "score": [s for _, s in made]})
        m.forget()

    return common.texts(docs).mapInPandas(common.lean(rows), "doc_id long, ids array<int>, score double")


def digests(pieces: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit), score, and the digest of the decoded text."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "n_tokens": [len(i) for i in b["ids"]], "ids_crc32": [zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in b["ids"]],
                "score": b["score"], "decoded_sha256": [hashlib.sha256(m.decode(i.tolist()).encode()).hexdigest() for i in b["ids"]],
            })

    return pieces.mapInPandas(rows, "doc_id long, n_tokens long, ids_crc32 long, score double, decoded_sha256 string")
