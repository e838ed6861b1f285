"""SimHash near duplicates, linked through Golay-code keys.

A 64-bit fingerprint falls into three segments (22, 21 and 21 bits, each filled up to 23 with zeros). If two
fingerprints differ in at most two bits, then for some segment and the next one (cyclically) the first agrees and the
second differs in at most one bit: with errors (2,0,0) up to rotation two segments agree, with (1,1,0) the third
agrees and its successor has one error. The perfect [23,12,7] Golay code maps each 23-bit word to the one codeword
within three bits, and the words within one bit of a word map to at most six codewords. So a fingerprint joins under
three exact keys (segment, the next segment's codeword) those that list this codeword among their six; every link is
verified by counting bits.

A key that many different fingerprints share would join with the square of their number. Beyond HOT fingerprints a key
is handled exactly without pairs: each fingerprint lists itself and its one-bit neighbours outside the shared segment,
and fingerprints that list the same point are within two bits of each other, while any two within two bits share such
a point; each point links its fingerprints to the least of them.

Edge cases: a null or empty text, and one of only white space, has fingerprint zero and is linked like any other; a
text of one or two words has its whole word sequence as its one shingle; repeated rows share a fingerprint; a null
doc_id is never a component's name, and has a null component_id when nothing else is in its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import common

SEED, SHINGLE, DISTANCE, HOT = 42, 3, 2, 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the [23,12,7] Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return majority(np.array([digest(b" ".join(r), SEED) for r in runs], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    common.small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    return common.texts(docs).mapInPandas(made, "doc_id long, fp long")


@cache
def golay() -> np.ndarray:
    """The error pattern of each syndrome."""
    errors = np.zeros(2048, np.int32)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = (1 << i) | (1 << j) | (1 << k)
                errors[syndrome(np.array([e]))[0]] = e
    return errors


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word modulo the generator."""
    r = words.astype(np.int64).copy()
    for i in range(22, 10, -1):
        r ^= np.where(r >> i & 1, GENERATOR << (i - 11), 0)
    return r


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Of the only codeword within three bits of each word: its top twelve bits."""
    return (words ^ golay()[syndrome(words)]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """Rows of 24: the codeword indices of each word and of its 23 one-bit neighbours (at most six differ)."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    return codeword_index((words[:, None] ^ flips).ravel()).reshape(-1, 24)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _key(s: int, exact: np.ndarray, index: np.ndarray) -> np.ndarray:
    return (s << 40) | (exact << 12) | index


def own_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = b["fp"].to_numpy(np.int64)
        seg = _segments(fp)
        yield pd.DataFrame({"key": np.concatenate([_key(s, seg[s], codeword_index(seg[(s + 1) % 3])) for s in range(3)]), "fp": np.tile(fp, 3)})


def near_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = b["fp"].to_numpy(np.int64)
        seg = _segments(fp)
        for s in range(3):
            idx = np.sort(near_indices(seg[(s + 1) % 3]), axis=1)
            new = np.concatenate([np.ones((len(fp), 1), bool), idx[:, 1:] != idx[:, :-1]], axis=1)
            row, col = np.nonzero(new)
            yield pd.DataFrame({"key": _key(s, seg[s][row], idx[row, col]), "fp": fp[row]})


def midpoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For hot keys: the key's segment and value, and the points within one bit outside that segment."""
    for b in batches:
        fp, key = b["fp"].to_numpy(np.int64), b["key"].to_numpy(np.int64)
        for s, (at, n) in enumerate(SEGMENTS):
            own = fp[key >> 40 == s]
            flips = np.array([0, *(1 << i for i in range(64) if not at <= i < at + n)], np.uint64).view(np.int64)
            points = own[:, None] ^ flips
            yield pd.DataFrame({"s": np.int32(s), "point": points.ravel(), "fp": np.repeat(own, len(flips))})


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a > b of different fingerprints: enough of those within two bits to connect all of them."""
    pairs = "key long, fp long"
    near = common.materialize(distinct.mapInPandas(common.lean(near_keys), pairs), "near-keys")
    hot = near.groupBy("key").count().where(F.col("count") > HOT).select("key")
    hot = common.materialize(hot, "hot-keys")
    own = distinct.mapInPandas(common.lean(own_keys), pairs)
    cold = near.join(hot, "key", "left_anti")
    # linked fingerprints meet under the key of either one's own codeword, so one direction finds every pair
    found = own.withColumnRenamed("fp", "x").join(cold.withColumnRenamed("fp", "y"), "key").where(f"x <> y and bit_count(x ^ y) <= {DISTANCE}").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    spread = near.join(hot, "key", "left_semi").select(F.expr("cast(key div 1099511627776 as int)").alias("s"), "fp").distinct()
    points = spread.select((F.col("s").cast("long") * 1099511627776).alias("key"), "fp").mapInPandas(common.lean(midpoints), "s int, point long, fp long")
    least = points.groupBy("s", "point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("top > b").select("s", "point", "b")
    stars = points.join(least, ["s", "point"]).where("fp > b").select(F.col("fp").alias("a"), "b")
    out = common.materialize(found.unionByName(stars).distinct(), "links")
    common.release(near)
    common.release(hot)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) for each node of edges (a > b), by alternating large and small stars.

    The least neighbours are written before they are joined, so that a node with very many edges meets in a plain
    sort-merge join, which adaptive execution splits."""
    now = common.materialize(edges.select("a", "b"), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = common.materialize(large, "large-star")
        low = common.materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small = common.materialize(small, "small-star")
        n, sums = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for done in (now, least, large, low):
            common.release(done)
        now, was, state = small, state, (n, sums)
        if was == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links reach."""
    own = common.materialize(fingerprints(docs, shingle), "simhash")
    distinct = common.materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = common.materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    classes = common.materialize(classes, "classes")
    return own.join(classes, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


# --- near copies at a given similarity ------------------------------------------------------------------------------

SIMILARITY, BANDS, ROWS = 0.8, 16, 5


def ordered_hashes(text: str, shingle: int, known: common.WordHashes) -> np.ndarray:
    """A hash of each shingle in turn, repeats included: a polynomial of its words' hashes, mixed."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str, shingle: int, known: common.WordHashes | None = None) -> np.ndarray:
    """The distinct shingles' hashes."""
    return np.unique(ordered_hashes(text, shingle, common.WordHashes() if known is None else known))


MIXINGS = np.cumprod(np.full(BANDS * ROWS, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def samples(h: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of the ROWS shingles that are least under ROWS fixed mixings of their hashes."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 1024):
        x = h[i : i + 1024, None] * MIXINGS
        x ^= x >> np.uint64(29)
        least = np.minimum(least, x.min(axis=0))
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (a digest of the text), fp, n (distinct shingles) and bands of the documents that have a doc_id."""
    common.small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = common.WordHashes()
        for b in batches:
            rows = []
            for t in b["text"]:
                h = ordered_hashes(t, shingle, known)
                own = np.unique(h)
                rows.append((digest(t), majority(h) if len(h) else 0, len(own), samples(own)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(np.int64), "th": [r[0] for r in rows], "fp": np.array([r[1] for r in rows], np.uint64).view(np.int64), "n": [r[2] for r in rows], "bands": [r[3] for r in rows]})

    return common.texts(docs).where("doc_id is not null").mapInPandas(common.lean(made), "doc_id long, th binary, fp long, n int, bands array<long>")


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def buckets(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket, doc_id, n and weight for each bucket of two documents or more, and pairs a > b of documents whose
    fingerprints are linked. A document is in a bucket for each of its bands and in that of its fingerprint and all that
    links reach from it; weight is how many places its buckets have, greatest for a text that others are copies of."""
    by_fp = common.materialize(first.groupBy("fp").agg(F.min(F.struct("doc_id", "n")).alias("end"), F.count("*").alias("size")), "fp-least")
    linked = links(by_fp.select("fp"))
    ends = by_fp.select(F.col("fp").alias("f"), "end")
    pairs = linked.join(ends, F.col("a") == F.col("f")).select("b", F.col("end").alias("x")).join(ends, F.col("b") == F.col("f")).select("x", F.col("end").alias("y"))
    pairs = common.materialize(pairs, "fp-pairs")
    roots = common.materialize(components(linked), "fp-roots")
    grouped = by_fp.where("size > 1").select(F.col("fp").alias("f"), F.col("fp").alias("root")).join(roots, F.col("f") == F.col("node"), "left_anti").unionByName(roots.select(F.col("node").alias("f"), "root")).unionByName(roots.select(F.col("root").alias("f"), "root")).distinct()
    grouped = common.materialize(grouped, "fp-groups")
    by_link = first.join(grouped, F.col("fp") == F.col("f")).select(F.xxhash64(F.lit("fp"), "root").alias("bucket"), "doc_id", "n")
    every = common.materialize(first.select(F.explode("bands").alias("bucket"), "doc_id", "n").unionByName(by_link), "bands")
    # what is joined to a bucket's rows is written first: a large bucket is then split like any skewed join
    sizes = common.materialize(every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    met = common.materialize(every.join(sizes, "bucket"), "shared-bands")
    weights = met.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    out = common.materialize(met.join(weights, "doc_id").select("bucket", "doc_id", "n", "weight"), "buckets")
    for done in (by_fp, linked, roots, grouped, every, sizes, met):
        common.release(done)
    return out, pairs


def alike_in_size(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs x, y of structs of doc_id and n as distinct a > b, without those whose sizes alone rule the similarity out."""
    near = pairs.where("x.doc_id <> y.doc_id").where(F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n"))
    return near.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct()


def candidates(met: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """A first choice of pairs, in proportion to the buckets: each document with the least, the greatest and the weightiest
    of its bucket, and the least ones of linked fingerprints."""
    own = F.struct("doc_id", "n")
    ends = met.groupBy("bucket").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.max(F.struct("weight", "doc_id", "n")).alias("top"))
    ends = common.materialize(ends, "bucket-ends")
    stars = met.join(ends, "bucket").select(own.alias("x"), F.explode(F.array("lo", "hi", F.struct("top.doc_id", "top.n"))).alias("y"))
    out = common.materialize(alike_in_size(stars.unionByName(linked), similarity), "candidates")
    common.release(ends)
    return out


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id and label (its component) of the documents in buckets that links have not made one component."""
    labelled = common.materialize(met.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("label")), "labels")
    split = common.materialize(labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "split-buckets")
    out = common.materialize(labelled.join(split, "bucket", "left_semi").select("doc_id", "label").distinct(), "unsettled")
    common.release(labelled)
    common.release(split)
    return out


def prefixes(own: DataFrame, similarity: float) -> DataFrame:
    """doc_id, n, label, token and rest (how many of the set's tokens stand from this one on).

    Only shingles that different components have are tokens: two similar sets of different components share none but
    such. In any one order of all tokens, two sets of this similarity share one from which on each has at least
    ceil(similarity n) tokens; with frequent ones last, unlike texts seldom share one. A set with fewer tokens than that
    has no similar one in another component and drops out."""
    sets = own.select("doc_id", "label", F.size("s").alias("n"), F.explode("s").alias("token"))
    met = sets.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    met = common.materialize(met.select("token", "size"), "tokens")
    every = common.materialize(sets.join(met, "token"), "token-places")
    within = Window.partitionBy("doc_id")
    rest = F.count("*").over(within) - F.row_number().over(within.orderBy("size", "token")) + 1
    out = every.withColumn("rest", rest).where(F.col("rest") >= F.ceil(similarity * F.col("n") - 1e-9))
    out = common.materialize(out.select("doc_id", "n", "label", "token", "rest"), "prefixes")
    common.release(met)
    common.release(every)
    return out


def remaining(own: DataFrame, similarity: float) -> DataFrame:
    """All pairs of these documents that can have the similarity and lie in different components (label).

    Sets of sizes x and y with the similarity share at least (x + y) similarity / (1 + similarity) shingles. All of them
    stand at or after the first shared one, so that one has as many places left in each set; pairs are made only
    under tokens of which this holds."""
    every = prefixes(own, similarity)
    split = common.materialize(every.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token"), "split-tokens")
    tokens = common.materialize(every.join(split, "token", "left_semi"), "split-prefixes")
    # of two components that meet under a token, one at least is not the token's largest
    largest = tokens.groupBy("token", "label").count().groupBy("token").agg(F.max(F.struct("count", "label")).alias("top")).select("token", F.col("top.label").alias("largest"))
    largest = common.materialize(largest, "largest")
    fewer = tokens.join(largest, "token").where("label <> largest").select("token", F.struct("doc_id", "n").alias("x"), F.col("label").alias("lx"), F.col("rest").alias("rx"))
    fewer = common.materialize(fewer, "fewer")
    others = tokens.select("token", F.struct("doc_id", "n").alias("y"), F.col("label").alias("ly"), F.col("rest").alias("ry"))
    shared = (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9
    pairs = fewer.join(others, "token").where("lx <> ly").where(F.least("rx", "ry") >= shared)
    out = common.materialize(alike_in_size(pairs.select("x", "y"), similarity), "remaining")
    for done in (every, split, tokens, largest, fewer):
        common.release(done)
    return out


def verified(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity."""
    left = found.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = found.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common_n = F.size(F.array_intersect("sa", "sb"))
    return both.where(common_n >= similarity * (F.size("sa") + F.size("sb") - common_n)).select("a", "b")


def copy_groups(docs: DataFrame, first: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node and root for each document that similar ones in its buckets link: the first choice of pairs makes most
    components, then whatever pair of different components in a bucket can still be similar is compared."""
    spark = docs.sparkSession
    met, linked = buckets(first)
    pairs = candidates(met, linked, similarity)
    wanted = first.select("doc_id", "th").join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = common.materialize(wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("t")), "wanted")
    common.sweep(spark)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = common.WordHashes()
        for b in batches:
            b = b[[digest(x) == t for x, t in zip(b["text"], b["t"], strict=True)]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(np.int64), "s": [shingle_hashes(t, shingle, known).view(np.int64) for t in b["text"]]})

    # a plain shuffle at every size; of rows with one doc_id, those of the text that stands for it
    own = common.texts(docs).where("doc_id is not null").join(wanted.hint("merge"), F.col("doc_id") == F.col("d")).select("doc_id", "text", "t")
    found = common.materialize(own.mapInPandas(common.lean(sets), "doc_id long, s array<long>").dropDuplicates(["doc_id"]), "shingle-sets")
    common.sweep(spark)
    roots = common.materialize(components(verified(pairs, found, similarity)), "copy-roots")
    rest = common.materialize(found.join(left := unsettled(met, roots), "doc_id"), "unsettled-sets")
    common.sweep(spark)
    more = remaining(rest, similarity)
    common.sweep(spark)
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(more.join(pairs, ["a", "b"], "left_anti"), found, similarity)))
    for done in (met, linked, pairs, wanted, found, roots, left, rest, more):
        common.release(done)
    return out


def first_of_each(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns as they are, without all but the least doc_id of each group of near copies.

    Near copies are texts whose sets of shingles have a Jaccard similarity of at least similarity, and what such
    links reach. Golay keys reach two of 64 bits, while copies at 0.8 lie up to some 15 bits apart; so min-wise bands
    give further buckets, and every similar pair within a bucket is found or already linked by others.

    Edge cases: rows with a null doc_id stay; rows with one doc_id stay or go together, and of their different texts
    each counts for exact copies and the one with the least digest for similar ones; texts without words are copies of
    each other only where they are equal; an empty table gives an empty result; extra columns may have any names.
    """
    sig = common.materialize(signatures(docs, shingle), "signatures")
    exact = sig.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    exact = common.materialize(exact, "exact-classes")
    first = common.materialize(exact.groupBy("doc_id").agg(F.min(F.struct("th", "fp", "n", "bands")).alias("r")).select("doc_id", "r.*"), "first-texts")
    common.sweep(docs.sparkSession)
    roots = copy_groups(docs, first, shingle, similarity)
    gone = roots.select(F.col("node").alias("gone")).unionByName(sig.join(exact.select("th", F.col("doc_id").alias("least")), "th").where("doc_id > least").select(F.col("doc_id").alias("gone"))).distinct()
    gone = common.materialize(gone, "gone")
    for done in (sig, exact, first):
        common.release(done)
    common.sweep(docs.sparkSession)
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["gone"], "left_anti")
