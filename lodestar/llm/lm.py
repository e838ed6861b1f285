"""Language-model scores from an Elias-Fano n-gram trie.

Counts of words and of word pairs are gathered from all training texts. The first level holds every word (64-bit
hash) with its exact count, the second, for each context (32-bit hash of the word before, or the end token before a
first word), the words that followed it at least cutoff times (the query: once, so all of them) with their discounted
probability, quantised to 16 bits in log space. Each level is cut into shards by leading hash bits; a shard is a file in the shared folder of monotone
sequences in Elias-Fano form: contexts, pointers into the next level, and successors, where the successor of a context
is stored after all those of the contexts before it, so that the level is one monotone sequence. Scoring maps the
files into memory and searches a context's successors between its two pointers.

P(w|u) = P_kept(w|u) + (1 - sum of P_kept(.|u)) * P_base(w); P_base is the add-0.1 unigram estimate. Two words whose
32-bit hashes agree share second-level rows; first-level counts are exact up to 64-bit hashes.

The shared folder must be one that pyarrow.fs can open (a local or mounted path, hdfs, s3, gs); a local path is mapped,
another store's file is read once per worker.

Edge cases: a null doc_id is held out; a null or empty text is the end token alone; equal texts have equal scores; without training texts all
counts are 0 and every token has the uniform probability of a vocabulary of one.
"""

from __future__ import annotations

import json
import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

CUTOFF, DISCOUNT = 2, 0.75
END = xxhash.xxh64_intdigest(b" end ")  # no word holds a space
SHARD_ROWS = 400_000
STEP = 1 / 4096  # of quantised log10 probabilities
LOW32 = np.uint64(0xFFFFFFFF)


# --- Elias-Fano sequences -----------------------------------------------------------------------------------------

_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _select_table() -> np.ndarray:
    out = np.zeros((256, 8), np.uint8)
    for b in range(256):
        for k, i in enumerate(i for i in range(8) if b >> i & 1):
            out[b, k] = i
    return out


_SELECT = _select_table()


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values: low bits packed, high parts in unary."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.n, self.low_bits, self.span = (int(x) for x in arrays[f"{prefix}.head"])
        self.low, self.bits = arrays[f"{prefix}.low"], arrays[f"{prefix}.bits"]
        self.ones = arrays[f"{prefix}.ones"].astype(np.int64)  # ones, and zeros, before each word of the high parts
        self.zeros, self.words = np.arange(len(self.ones)) * 64 - self.ones, np.append(self.bits.view(np.uint64), np.uint64(0))

    @staticmethod
    def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low)).astype(np.int64)
        span = (int(high[-1]) if n else 0) + 1
        bits = np.zeros(-(-(n + span + 1) // 64) * 8, np.uint8)
        where = high + np.arange(n)
        np.bitwise_or.at(bits, where >> 3, (1 << (where & 7)).astype(np.uint8))
        groups = _BYTE_ONES[bits].reshape(-1, 8).sum(axis=1)
        words = np.zeros(n * low // 64 + 2, np.uint64)
        if low and n:
            part, at = values & np.uint64((1 << low) - 1), np.arange(n, dtype=np.uint64) * np.uint64(low)
            k, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, k, part << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(words, k[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return {f"{prefix}.head": np.array([n, low, span], np.int64), f"{prefix}.low": words, f"{prefix}.bits": bits, f"{prefix}.ones": np.concatenate([[0], np.cumsum(groups)]).astype(np.uint32)}

    def low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        k, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        right = self.low[k] >> shift
        left = np.where(shift > 0, self.low[np.minimum(k + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (right | left) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Position of the k-th (from 0) zero or one: its word by search, then halves of the word by their counts."""
        group = np.searchsorted(self.zeros if zeros else self.ones, k, "right") - 1
        left = k - (self.zeros if zeros else self.ones)[group]
        word = self.words[group]
        if zeros:
            word = ~word
        at = group * 64
        for width in (32, 16, 8):
            here = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            skip = left >= here
            left -= here * skip
            word = np.where(skip, word >> np.uint64(width), word)
            at += width * skip
        return at + _SELECT[(word & np.uint64(255)).astype(np.int64), np.minimum(left, 7)]

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, zeros=False) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self.low_part(i)

    def locate(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, at or after begin and before end; -1 where it is not in the sequence. The values that
        share a high part lie between two zeros; among them the low parts ascend and are searched by halves."""
        high, low = (values >> np.uint64(self.low_bits)).astype(np.int64), values & np.uint64((1 << self.low_bits) - 1)
        out = np.full(len(values), -1, np.int64)
        h = np.minimum(high, self.span - 1)
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), zeros=True) + 1 - h, 0)
        stop = self._select(h, zeros=True) - h
        if begin is not None:
            at, stop = np.maximum(at, begin), np.minimum(stop, end)
        last = stop.copy()
        open_ = np.flatnonzero((high < self.span) & (at < stop))
        sought = open_
        while len(open_):
            middle = (at[open_] + stop[open_]) >> 1
            less = self.low_part(middle) < low[open_]
            at[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < stop[open_]]
        sought = sought[at[sought] < last[sought]]
        same = sought[self.low_part(at[sought]) == low[sought]]
        out[same] = at[same]
        return out


# --- shard files --------------------------------------------------------------------------------------------------


def to_file(arrays: dict[str, np.ndarray]) -> bytes:
    at, entries, parts = 0, {}, []
    for name, a in arrays.items():
        data = a.tobytes()
        entries[name] = (a.dtype.str, at, len(a))
        parts.append(data + bytes(-len(data) % 8))
        at += len(parts[-1])
    head = json.dumps(entries).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *parts])


def put(uri: str, data: bytes) -> None:
    """Write a file under another name and move it into place, so that a repeated task does no harm."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{xxhash.xxh64_hexdigest(np.random.bytes(16))}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def opened(uri: str) -> dict[str, np.ndarray]:
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with store.open_input_file(path) as f:
            data = f.read()
    n = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, d, c, 8 + n + at) for k, (d, at, c) in json.loads(data[8 : 8 + n]).items()}


def word_shard(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return to_file(EliasFano.build(keys, "words") | {"counts": counts.astype(np.int64)})


def pair_shard(context: np.ndarray, word: np.ndarray, count: np.ndarray, total: np.ndarray) -> bytes:
    """Rows sorted by context, then word. Probabilities become codes; what a context's codes leave is its rest."""
    contexts, first = np.unique(context, return_index=True)
    p = (count - DISCOUNT) / np.maximum(total, count)
    code = np.clip(np.round(-np.log10(p) / STEP), 0, 65_535).astype(np.uint16)
    rest = 1 - np.add.reduceat(10.0 ** (code * -STEP), first) if len(first) else np.zeros(0)
    rank = np.searchsorted(contexts, context).astype(np.uint64)
    out = EliasFano.build(contexts.astype(np.uint64), "contexts") | EliasFano.build(np.append(first, len(context)).astype(np.uint64), "pointers")
    return to_file(out | EliasFano.build(rank << np.uint64(32) | word.astype(np.uint64), "successors") | {"codes": code, "rest": np.clip(rest, 1e-6, 1).astype(np.float32)})


# --- counting -----------------------------------------------------------------------------------------------------


class Numbers(dict):
    """Gives each new word the next number and keeps its hash."""

    def __init__(self, hashes: list[int]):
        super().__init__()
        self.hashes = hashes

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


class Tokens:
    """Numbers of the words of texts, each text closed by END, and where texts start; hashes are those of the numbers."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes = [END]
        self.known = Numbers(self.hashes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        parts, lengths = [], []
        end = np.zeros(1, np.int64)
        for t in texts:
            words = t.encode().lower().split()
            parts += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), end]
            lengths.append(len(words) + 1)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum([0, *lengths])

    def full(self) -> bool:
        return len(self.hashes) > 400_000


def pairs(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """context << 32 | word of each token."""
    before = np.concatenate([[np.uint64(END)], tokens[:-1]])
    before[starts[:-1]] = np.uint64(END)
    return (before & LOW32) << np.uint64(32) | tokens & LOW32


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokenize, held = Tokens(), [[], []]

    def flush() -> Iterator[pd.DataFrame]:
        for kind, parts in enumerate(held):
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                for i in range(0, len(keys), 200_000):
                    yield pd.DataFrame({"kind": np.int8(kind), "key": keys[i : i + 200_000].view(np.int64), "n": n[i : i + 200_000].astype(np.int64)})
                parts.clear()

    for b in batches:
        if tokenize.full():
            tokenize.clear()
        numbers, starts = tokenize(b["text"].tolist())
        tokens = np.array(tokenize.hashes, np.uint64)[numbers]
        held[0].append(tokens)
        held[1].append(pairs(tokens, starts))
        if sum(map(len, held[0])) > 3_000_000:
            yield from flush()
    yield from flush()


def train(docs: DataFrame, held_out_mod: int = 10, cutoff: int = CUTOFF) -> dict:
    """Count, write the shards and return the model: its folder, bits of a shard's number, totals and shard list."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = common.texts(docs).where(common.crc_mod("doc_id", held_out_mod) != 0).select("text")
    counts = texts.mapInPandas(counted, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where(f"kind = 0 or n >= {cutoff}")
    counts = common.materialize(counts, "counts")
    words, second = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    tokens, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_pairs = second.count()
    folder = common.fresh_path(spark, "trie")
    bits = {"words": max(0, (vocabulary // SHARD_ROWS).bit_length()), "pairs": max(0, (n_pairs // SHARD_ROWS).bit_length())}
    shard = lambda k: F.shiftrightunsigned("key", 64 - bits[k]).cast("int") if bits[k] else F.lit(0)

    def write_words(g: pd.DataFrame) -> pd.DataFrame:
        keys, n = g["key"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy()
        order = np.argsort(keys)
        put(f"{folder}/words-{g['shard'].iloc[0]}.ef", word_shard(keys[order] - (np.uint64(g["shard"].iloc[0]) << np.uint64(64 - bits["words"]) if bits["words"] else np.uint64(0)), n[order]))
        return pd.DataFrame({"kind": ["words"], "shard": [g["shard"].iloc[0]]})

    def write_pairs(g: pd.DataFrame) -> pd.DataFrame:
        keys = g["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        context, n = (keys >> np.uint64(32))[order], g["n"].to_numpy()[order]
        if "total" in g:
            total = g["total"].to_numpy()[order]
        else:
            which = np.unique(context, return_inverse=True)[1]
            total = np.bincount(which, n).astype(np.int64)[which]
        put(f"{folder}/pairs-{g['shard'].iloc[0]}.ef", pair_shard(context, (keys & LOW32)[order], n, total))
        return pd.DataFrame({"kind": ["pairs"], "shard": [g["shard"].iloc[0]]})

    joined = second
    if cutoff > 1:  # else a context's pairs, all in one shard, add up to its count: each word but END has a next one
        totals = words.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("context")).agg(F.sum("n").alias("total"))
        joined = second.withColumn("context", F.shiftrightunsigned("key", 32)).join(totals, "context").select("key", "n", "total")
    made = words.withColumn("shard", shard("words")).groupBy("shard").applyInPandas(write_words, "kind string, shard int")
    made = made.unionByName(joined.withColumn("shard", shard("pairs")).groupBy("shard").applyInPandas(write_pairs, "kind string, shard int"))
    shards = [(r["kind"], r["shard"]) for r in made.collect()]  # one row for about SHARD_ROWS entries
    common.release(counts)
    return {"folder": folder, "bits": bits, "tokens": int(tokens), "vocabulary": int(vocabulary), "shards": shards}


class Trie:
    """The model as a worker sees it: shards are opened when first asked for."""

    def __init__(self, model: dict):
        self.model, self.open = model, {}
        self.have = set(map(tuple, model["shards"]))
        self.base = model["tokens"] + 0.1 * (model["vocabulary"] + 1)

    def shard(self, kind: str, k: int):
        if (kind, k) not in self.open:
            a = opened(f"{self.model['folder']}/{kind}-{k}.ef") if (kind, k) in self.have else None
            names = ("words",) if kind == "words" else ("contexts", "pointers", "successors")
            self.open[kind, k] = a and {**a, **{n: EliasFano(a, n) for n in names}}
        return self.open[kind, k]

    def _by_shard(self, kind: str, keys: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
        """keys ascend, so those of a shard are neighbours."""
        bits = self.model["bits"][kind]
        of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        for k in np.unique(of).tolist():
            s = self.shard(kind, k)
            if s is not None:
                yield s, np.arange(np.searchsorted(of, k), np.searchsorted(of, k, "right")), k

    def counts(self, words: np.ndarray) -> np.ndarray:
        out, bits = np.zeros(len(words), np.int64), self.model["bits"]["words"]
        for s, at, k in self._by_shard("words", words):
            i = s["words"].locate(words[at] - (np.uint64(k) << np.uint64(64 - bits) if bits else np.uint64(0)))
            out[at] = np.where(i >= 0, s["counts"][np.maximum(i, 0)], 0)
        return out

    def kept(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending context << 32 | word: the kept probability, and what the context leaves to the base."""
        p, rest = np.zeros(len(keys)), np.ones(len(keys))
        for s, at, _ in self._by_shard("pairs", keys):
            context, back = np.unique(keys[at] >> np.uint64(32), return_inverse=True)
            c = s["contexts"].locate(context)
            known = np.maximum(c, 0)
            begin, end = s["pointers"].access(known).astype(np.int64), s["pointers"].access(known + 1).astype(np.int64)
            ok = c[back] >= 0
            rank = known[back]
            i = s["successors"].locate(rank.astype(np.uint64) << np.uint64(32) | keys[at] & LOW32, begin[back], end[back])
            found = ok & (i >= 0)
            p[at] = np.where(found, 10.0 ** (s["codes"][np.maximum(i, 0)] * -STEP), 0)
            rest[at] = np.where(ok, s["rest"][rank], 1)
        return p, rest


def score_batches(model: dict, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie, tokenize = Trie(model), Tokens()
    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of the words numbered so far
    for b in batches:
        if tokenize.full():
            tokenize.clear()
            hashes, counts = hashes[:0], counts[:0]
        numbers, starts = tokenize(b["text"].tolist())
        new = np.array(tokenize.hashes[len(hashes) :], np.uint64)
        order = np.argsort(new)
        found = np.zeros(len(new), np.int64)
        found[order] = trie.counts(new[order])
        hashes, counts = np.concatenate([hashes, new]), np.concatenate([counts, found])
        tokens, c = hashes[numbers], counts[numbers]
        base = (c + 0.1) / trie.base
        keys, which = np.unique(pairs(tokens, starts), return_inverse=True)
        p, rest = trie.kept(keys)
        full = np.log10(p[which] + rest[which] * base)
        add = lambda x: np.add.reduceat(x, starts[:-1]) if len(starts) > 1 else np.zeros(0)
        yield pd.DataFrame({
            "doc_id": b["doc_id"].astype("Int64"), "n_tokens": np.diff(starts), "n_known": add((c > 0).astype(np.int64)), "train_tokens": model["tokens"],
            "base_score": add(np.log10(base)), "score": add(full),
        })


def scored(docs: DataFrame, model: dict, held_out_mod: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    out = common.texts(docs).mapInPandas(lambda batches: score_batches(model, batches), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", F.coalesce(common.crc_mod("doc_id", held_out_mod) == 0, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def evaluated(docs: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    return scored(docs, train(docs, cutoff=cutoff))

