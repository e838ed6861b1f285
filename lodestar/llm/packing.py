"""Token ids in fixed-width bit-packed images with block offsets.

An image holds whole documents in ascending doc_id order: a header, the doc_ids, the offset of each document, the byte
offset of each block of BLOCK ids, and the ids at the fewest bits that the vocabulary needs, least significant bit
first. Any range of ids is read by unpacking the blocks that it touches with numpy. Images are rows of a Parquet
table in the shared folder, so Spark's committer makes the write safe when executors are lost.

Edge cases: a null or empty text gives only the end id; null doc_ids come first; rows with the same doc_id are
ordered by their ids; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

BLOCK = 4096
HEAD = struct.Struct("<4sBxxxIIQ")  # magic, bits, block length, documents, ids
IMAGE_IDS = 2_000_000
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same bytes, without the detour over single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, (count * bits + 7) // 8), count=count * bits, bitorder="little")
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack_image(doc_ids: list[int], documents: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    ends = np.cumsum([len(d) for d in documents], dtype="<u8") if documents else np.zeros(0, "<u8")
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join([HEAD.pack(b"LSB1", bits, block, len(documents), len(ids)), np.asarray(doc_ids, "<i8").tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class PackedImage:
    """Random access to one image."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n_docs, self.n_ids = HEAD.unpack_from(data)
        if magic != b"LSB1":
            raise ValueError("not a packed token image")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.ends = np.frombuffer(data, "<u8", n_docs, at := at + 8 * n_docs).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * n_docs).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def read(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack_bits(self.body[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word once.

    The vocabulary's normaliser and pre-tokeniser neither keep nor cross white space, lower-case letters themselves and
    part a run of marks from the letters before it; so the ids of a text are those of its pieces between ASCII white
    space, and those of a piece of letters and marks (both from Latin-1) are its letters' and its marks'. Such a part
    is one sequence to BPE, whose last id, and no other, ends a word: many are encoded in one call and told apart by
    those ids. Any other piece is told from its neighbours by offsets. The tests hold this against whole texts.
    """

    PIECES, WORDS = 1_000_000, 700_000  # remembered between texts, some 150 bytes each
    TOGETHER = 500  # words encoded in one call

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces, self.words = Tokenizer.from_file(path), {"": b""}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = END_ID) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        edges = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.dictionary_encode()
        at = flat.indices.to_numpy()
        blobs = self.looked_up(flat.dictionary.to_pylist())
        data = np.frombuffer(b"".join(blobs), "<u4")
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = (np.cumsum(sizes) - sizes)[at]
        sizes = sizes[at]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = data[np.repeat(starts - (stops - sizes), sizes) + np.arange(total)]
        edges = np.concatenate([[0], stops])[edges]
        if end_id is not None:
            ids, edges = np.insert(ids, edges[1:], end_id), edges + np.arange(len(edges))
        return [ids[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def looked_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, learning those that are new."""
        if len(self.pieces) > self.PIECES:
            self.pieces = {"": b""}
        if len(self.words) > self.WORDS:
            self.words = {}
        known, words = self.pieces, self.words
        blobs = list(map(known.get, pieces))
        new = [i for i, x in enumerate(blobs) if x is None]
        parts, simple, other = [], set(), set()
        for i in new:
            found = PARTED(pieces[i])
            if found:
                word, marks = found.groups()
                word = word.lower()
                simple.add(word)
                if marks:
                    simple.add(marks)
            else:
                word, marks = pieces[i], ""
                other.add(word)
            parts.append((word, marks))
        self.learn([w for w in simple if w not in words], True)
        self.learn([w for w in other if w not in words], False)
        for i, (word, marks) in zip(new, parts, strict=True):
            blobs[i] = known[pieces[i]] = words[word] + words[marks] if marks else words[word]
        return blobs

    def learn(self, new: list[str], simple: bool) -> None:
        groups = [new[i : i + self.TOGETHER] for i in range(0, len(new), self.TOGETHER)]
        together = [" ".join(g) for g in groups]
        again = []
        if simple:
            for k, e in enumerate(self.tokenizer.encode_batch_fast(together, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                edges = np.flatnonzero(self.ends[ids]) + 1
                if len(edges) == len(groups[k]) and edges[-1] == len(ids):
                    self.keep(groups[k], ids, [0, *edges.tolist()])
                else:  # a vocabulary without such ids
                    again.append(k)
            groups, together = [groups[k] for k in again], [together[k] for k in again]
        for group, e in zip(groups, self.tokenizer.encode_batch(together, add_special_tokens=False), strict=True):
            starts = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            self.keep(group, np.array(e.ids, "<u4"), [0, *np.searchsorted(starts, np.cumsum([len(w) + 1 for w in group]) - 1).tolist()])

    def keep(self, group: list[str], ids: np.ndarray, edges: list[int]) -> None:
        data = ids.tobytes()
        for w, a, b in zip(group, edges, edges[1:], strict=False):
            self.words[w] = data[4 * a : 4 * b]


#: Latin-1 letters, which no normal form changes, and marks after them.
PARTED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch

ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def write_packed(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> str:
    """Encode every document and write the images; returns the table's path.

    Columns: bucket (rank of a doc_id range), seq, before (ids earlier in the bucket), n_ids, image.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    bounds = np.array(common.order_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", common.order_buckets(spark)), np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        bits = bits_for(enc.vocabulary())
        for b in batches:
            ids = enc.encode(b["text"], end_id)
            at = np.where(b["doc_id"].is_valid(), np.searchsorted(bounds, b["doc_id"].fill_null(0)), 0)
            columns = (at.astype(np.int32), b["doc_id"], np.array([len(x) for x in ids], np.int32), np.full(len(ids), bits, np.int32), pa.array([pack_bits(x, bits) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["bucket", "doc_id", "n", "bits", "ids"])

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, seq, before, size, ids, parts, bits = -1, 0, 0, 0, [], [], 0

        def flush() -> pd.DataFrame:
            n = sum(map(len, parts))
            return pd.DataFrame({"bucket": [bucket], "seq": [seq], "before": [before], "n_ids": [n], "image": [pack_image(ids, parts, bits)]})

        for b in batches:
            for at, doc, n, bits_now, data in zip(b["bucket"], b["doc_id"], b["n"], b["bits"], b["ids"], strict=True):
                if parts and (at != bucket or size > IMAGE_IDS):
                    yield flush()
                    seq, before = (seq + 1, before + size) if at == bucket else (0, 0)
                    size, ids, parts = 0, [], []
                bucket, bits = at, bits_now
                ids.append(NULL_ID if pd.isna(doc) else int(doc))
                parts.append(unpack_bits(data, n, bits))
                size += n
        if parts:
            yield flush()

    path = common.fresh_path(spark, "tokens")
    (
        common.texts(docs)
        .mapInArrow(encoded, "bucket int, doc_id long, n int, bits int, ids binary")
        .repartition(common.shuffle_partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "doc_id", "ids")
        .mapInPandas(images, "bucket int, seq int, before long, n_ids long, image binary")
        .write.option("compression", "none").parquet(path)
    )
    return path


#: Stands for a null doc_id inside an image.
NULL_ID = -(2**63)


def read_packed(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the images."""
    store = spark.read.schema("bucket int, seq int, before long, n_ids long, image binary").parquet(path)
    sums = {r[0]: r[1] for r in store.groupBy("bucket").agg(F.sum("n_ids")).collect()}  # a row for each bucket
    starts, total = {}, 0
    for k in sorted(sums):
        starts[k], total = total, total + sums[k]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, before, data in zip(b["bucket"], b["before"], b["image"], strict=True):
                image, rows, at = PackedImage(data), [], starts[bucket] + before
                for i, doc in enumerate(image.doc_ids.tolist()):
                    ids = image.document(i)
                    rows.append((None if doc == NULL_ID else doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return store.select("bucket", "before", "image").mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
