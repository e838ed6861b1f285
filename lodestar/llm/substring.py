"""Remove long repeated passages, by compaction of the De Bruijn graph of the corpus.

Each window of WINDOW consecutive words is an edge of the graph. The window's anchor is the least of its ANCHOR-word
hashes (the rightmost of equal ones); windows in a row with one anchor occurrence form a path, which is compacted to
one row: the anchor, a hash of the path's words, its document and its word range. An anchor of only one document
cannot be repeated and is dropped. Where all occurrences of an anchor have the same path, the path does not branch and
its least document decides for all of its windows at once. Where paths of an anchor differ, each has an example in its least
document. That is the source of the whole path in later documents; its own sources lie in other paths, so the examples
alone are expanded to windows, which meet by (anchor, window hash) in one shuffle, and only windows with an earlier
document go on. Windows in a row with one source are one range again. Each range carries the coordinates of its source (doc_id, text hash, first word). The words at the source
give a 128-bit digest, which goes with the range to its document, and there the covered words are removed where their own
digest is the same.

Every window of equal words has the same anchor, so joins on anchors lose no repeat. A range whose words are not those at
its source (64-bit hashes of different words agree) stays.

Edge cases: a null or empty text has no words; a document of under WINDOW words loses none; a window repeated within
one document, or in rows with the same doc_id, does not count; a null doc_id neither loses words nor takes any from
others; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import common

WINDOW, ANCHOR = 50, 8
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
POSITION = (1 << 24) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of BASE and of its inverse, as long as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            cls.up, cls.down = _powers(BASE, n), _powers(INVERSE, n)


class Words:
    """A text's words and the hash of any range of them."""

    def __init__(self, words: list[bytes], hashes: np.ndarray):
        self.n = len(words)
        Powers.reach(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * Powers.down[: self.n], dtype=np.uint64)])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * Powers.up[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def hashed(texts: list[str]) -> Iterator[tuple[list[bytes], Words]]:
    known = common.WordHashes()
    for t in texts:
        words = t.encode().split()
        yield words, Words(words, np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width keys, by doubling."""
    span = 1
    while 2 * span <= width:
        keys, span = np.minimum(keys[:-span], keys[span:]), 2 * span
    rest = width - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def paths(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each compacted path: anchor hash, path hash, first window and last window (word positions)."""
    if words.n < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    at = np.arange(words.n - anchor + 1)
    grams = words.hash(at, at + anchor)
    keys = (grams & np.uint64(~POSITION & (1 << 64) - 1)) | (POSITION - (at & POSITION)).astype(np.uint64)
    least = window_min(keys, window - anchor + 1)
    first = np.arange(len(least))
    place = first + ((POSITION - (least & np.uint64(POSITION)).astype(np.int64) - first) & POSITION)
    lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    hi = np.concatenate([lo[1:], [len(place)]]) - 1
    return grams[place[lo]], words.hash(lo, hi + window), lo, hi


ROW = "anchor long, path long, doc_id long, th long, lo int, hi int"


def compacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts = []
        for (_, words), doc, th in zip(hashed(b["text"].tolist()), b["doc_id"], b["th"], strict=True):
            if pd.notna(doc):
                a, p, lo, hi = paths(words)
                parts.append((a.view(np.int64), p.view(np.int64), np.full(len(a), int(doc)), np.full(len(a), th), lo, hi))
        if parts:
            yield pd.DataFrame(dict(zip(("anchor", "path", "doc_id", "th", "lo", "hi"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document as if nothing were removed."""
    for b in batches:
        words = [common.split_words(t) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "th": b["th"], "n_words": [len(w) for w in words], "whole": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]})


def squeezed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        known = b[b["doc_id"].notna()]
        yield pd.DataFrame({"doc_id": known["doc_id"].astype(np.int64), "th": known["th"], "packed": [pack.compress(t.encode()) for t in known["text"]]})


def expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of the paths of which this document is the example."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        texts, parts, held = (unpack.decompress(p).decode() for p in b["packed"]), [], 0
        for (_, words), doc, th, rows in zip(hashed(texts), b["doc_id"], b["th"], b["rows"], strict=True):
            anchor, path, lo, hi = np.array([(r["anchor"], r["path"], r["lo"], r["hi"]) for r in rows], np.int64).T
            n = hi - lo + 1
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(lo, n) + j
            parts.append((np.repeat(anchor, n), np.repeat(path, n), j, words.hash(at, at + WINDOW).view(np.int64), np.full(len(at), doc), np.full(len(at), th), at))
            held += len(at)
            if held > EXPANDED:
                yield expansion(parts)
                parts, held = [], 0
        if parts:
            yield expansion(parts)


#: Windows gathered before they leave the worker.
EXPANDED = 100_000


def expansion(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("anchor", "path", "j", "window", "least", "th", "at"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def seen(words: list[bytes], lo: int, hi: int) -> bytes:
    """A digest of the words of the windows that start in lo to hi."""
    return hashlib.blake2b(b" ".join(words[lo : hi + WINDOW]), digest_size=16).digest()


def sourced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digests of the source ranges that this document is asked for."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for doc, th, data, rows in zip(b["s_doc"], b["s_th"], b["packed"], b["rows"], strict=True):
            words = unpack.decompress(data).split()
            out += [(doc, th, r["s_lo"], r["span"], seen(words, r["s_lo"], r["s_lo"] + r["span"])) for r in rows]
        yield pd.DataFrame(out, columns=["s_doc", "s_th", "s_lo", "span", "seen"])


def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for doc, th, data, ranges in zip(b["doc_id"], b["th"], b["packed"], b["ranges"], strict=True):
            words = unpack.decompress(data).split()
            edges = np.zeros(len(words) + 1, np.int64)
            own = {(r["lo"], r["hi"]) for r in ranges}
            own = {x: seen(words, *x) for x in own}
            same = [(r["lo"], r["hi"]) for r in ranges if own[r["lo"], r["hi"]] == r["seen"]]
            lo, hi = np.array(same, np.int64).reshape(-1, 2).T
            np.add.at(edges, lo, 1)
            np.add.at(edges, hi + WINDOW, -1)
            gone = np.cumsum(edges[:-1]) > 0
            text = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            rows.append((doc, th, int(gone.sum()), text, hashlib.sha256(text).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "th", "n_removed", "kept", "kept_sha256"]).assign(kept=lambda d: [x.decode() for x in d["kept"]])


def follows(x: Column, y: Column) -> Column:
    """Whether window y is the next one after x in its path and at its source."""
    step = (y["j"] == x["j"] + 1) & (y["first"]["at"] == x["first"]["at"] + 1)
    return F.coalesce(step & (y["first"]["least"] == x["first"]["least"]) & (y["first"]["th"] == x["first"]["th"]), F.lit(False))


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word ranges to remove (doc_id, th, lo, hi: every window that starts in lo to hi) with the coordinates of their
    sources (s_doc, s_th, s_lo), and the packed texts of the documents with passages of others."""
    own = common.texts(docs).withColumn("th", F.xxhash64("text"))
    rows = common.materialize(own.mapInPandas(compacted, ROW), "paths")
    found = rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min("path") != F.max("path")).alias("branches")).where("least < most")
    found = common.materialize(found.select("anchor", "least", "branches"), "repeated-anchors")
    again = common.materialize(rows.join(found, "anchor"), "repeated-paths")
    common.release(rows)
    common.release(found)
    common.sweep(docs.sparkSession)
    some = common.materialize(again.select("doc_id", "th").distinct(), "touched")
    texts = common.materialize(own.mapInPandas(squeezed, "doc_id long, th long, packed binary").join(some, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]), "touched-texts")
    common.release(some)
    common.sweep(docs.sparkSession)
    at_least = again.where("not branches and doc_id = least").groupBy("anchor").agg(F.min(F.struct("th", "lo")).alias("s"))
    at_least = common.materialize(at_least.select("anchor", F.col("s.th").alias("s_th"), F.col("s.lo").alias("s_lo")), "least-places")
    plain = again.where("not branches and doc_id > least").join(at_least, "anchor").select("doc_id", "th", "lo", "hi", F.col("least").alias("s_doc"), "s_th", "s_lo")
    forks = again.where("branches")
    example = forks.groupBy("anchor", "path").agg(F.min(F.struct("doc_id", "th", "lo", "hi")).alias("e")).select("anchor", "path", "e.*")
    example = common.materialize(example, "examples")
    asked = example.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "path", "lo", "hi")).alias("rows"))  # at most a document's own paths
    windows = texts.join(asked, ["doc_id", "th"]).select("doc_id", "th", "packed", "rows").mapInPandas(expanded, "anchor long, path long, j int, window long, least long, th long, at int")
    windows = common.materialize(windows, "windows")
    common.sweep(docs.sparkSession)
    first = F.min(F.struct("least", "th", "at")).over(Window.partitionBy("anchor", "window"))
    earlier = windows.select("anchor", "path", "j", "least", first.alias("first")).where("first.least < least")
    by_path = earlier.groupBy("anchor", "path").agg(F.sort_array(F.collect_list(F.struct("j", "first"))).alias("firsts"))  # at most a path's own windows
    starts = F.filter("firsts", lambda x, i: ~follows(F.get("firsts", i - 1), x))
    ends = F.filter("firsts", lambda x, i: ~follows(x, F.get("firsts", i + 1)))
    by_path = by_path.select("anchor", "path", starts.alias("starts"), ends.alias("ends")).select("anchor", "path", F.arrays_zip("starts", "ends").alias("runs"))
    by_path = example.select("anchor", "path", F.col("doc_id").alias("e_doc"), F.col("th").alias("e_th"), F.col("lo").alias("e_lo")).join(by_path, ["anchor", "path"], "left")
    by_path = common.materialize(by_path, "path-runs")
    for done in (windows, example):
        common.release(done)
    common.sweep(docs.sparkSession)
    span = lambda a, b, doc, th, lo: F.struct(a.alias("a"), b.alias("b"), doc.alias("s_doc"), th.alias("s_th"), lo.alias("s_lo"))
    whole = F.array(span(F.lit(0), F.col("hi") - F.col("lo"), F.col("e_doc"), F.col("e_th"), F.col("e_lo")))
    own = F.transform("runs", lambda f: span(f["starts"]["j"], f["ends"]["j"], f["starts"]["first"]["least"], f["starts"]["first"]["th"], f["starts"]["first"]["at"]))
    # a document after the example has every window of the path from it; the example's own looks to other paths
    hit = forks.join(by_path, ["anchor", "path"]).withColumn("f", F.explode(F.when(F.col("e_doc") < F.col("doc_id"), whole).otherwise(own)))
    hit = hit.select("doc_id", "th", (F.col("lo") + F.col("f.a")).alias("lo"), (F.col("lo") + F.col("f.b")).alias("hi"), "f.s_doc", "f.s_th", "f.s_lo")
    out = common.materialize(plain.unionByName(hit), "ranges")
    for done in (again, at_least, by_path):
        common.release(done)
    return out, texts


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, of the documents that lose words, the kept text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    ranges, texts = removals(docs)
    common.sweep(spark)
    ranges = ranges.withColumn("span", F.col("hi") - F.col("lo"))
    asked = ranges.select("s_doc", "s_th", "s_lo", "span").distinct().groupBy("s_doc", "s_th").agg(F.collect_list(F.struct("s_lo", "span")).alias("rows"))  # ranges of one document
    asked = texts.join(asked, (F.col("doc_id") == F.col("s_doc")) & (F.col("th") == F.col("s_th"))).select("s_doc", "s_th", "packed", "rows")
    known = common.materialize(asked.mapInPandas(sourced, "s_doc long, s_th long, s_lo int, span int, seen binary"), "source-digests")
    by_doc = ranges.join(known, ["s_doc", "s_th", "s_lo", "span"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "seen")).alias("ranges"))  # at most a document's own windows
    changed = by_doc.join(texts, ["doc_id", "th"]).mapInPandas(kept, "doc_id long, th long, n_removed long, kept string, kept_sha256 string")
    changed = changed.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_removed", "kept", "kept_sha256")
    whole = common.texts(docs).withColumn("th", F.xxhash64("text")).mapInPandas(facts, "doc_id long, th long, n_words long, whole string")
    out = whole.join(changed, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept")
