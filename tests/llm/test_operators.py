"""Each operator against a plain version, over the smallest documents and rows made to be awkward."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
import zstandard

from lodestar.llm import fingerprints, lm, media, mixing, packing, pii, queries, sentencepiece, simhash, substring, toxicity

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, bucket int"


@pytest.fixture(scope="session")
def docs(spark):
    """Real rows, and: null, empty, blank, one word, ties, repeats, a null doc_id, odd characters, a long text."""
    own = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(120).collect()]
    passage = " ".join(f"w{i}" for i in range(70))
    odd = ["", None, " \t\n ", "word", "same text twice", "same text twice", "é€😀 ▁ \x85 日本語", "mail a.b@c.org, ip 1.2.3.4 and +1 (743) 555-3824", "x " + passage, passage + " y", "word " * 30000, passage]
    rows = own + [(10_000 + i, t, "en" if i % 2 else None, None if i == 3 else "zz", None) for i, t in enumerate(odd)] + [(None, "no id at all", "en", "zz", 12), (10_004, "same text twice", None, "zz", None)]
    return spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def plain(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(doc):
    return (doc is None, doc or 0)


def test_fingerprints(docs, plain, empty):
    got = sorted((r.asDict() for r in fingerprints.fingerprinted(docs).collect()), key=lambda r: (key(r["doc_id"]), r["edited_sha256"]))
    order = sorted(plain, key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
    want = []
    for i, (doc, text, _) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(text) // 2
        want.append((doc, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == sorted(want, key=lambda w: (key(w[0]), w[2]))
    prints = {}
    for r in got:
        text = next(t for d, t, _ in plain if d == r["doc_id"])
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert [int(x.split(":")[1], 16) for x in r["fingerprint"].split()] == sorted({int(x.split(":")[1], 16) for x in r["fingerprint"].split()})
    assert fingerprints.fingerprinted(empty).count() == 0


def test_winnowing_keeps_rightmost_minimum(spark):
    words = [random.Random(3).choice("abc") for _ in range(200)]
    fp = spark.createDataFrame([(" ".join(words),)], "t string").select(fingerprints.chosen(fingerprints.F.col("t"))).first()[0]
    h = {w: spark.sql(f"select pmod(xxhash64('{w}'), {fingerprints.P})").first()[0] for w in "abc"}
    grams = []
    for i in range(len(words) - fingerprints.K + 1):
        x = 0
        for w in words[i : i + fingerprints.K]:
            x = (x * fingerprints.B + h[w]) % fingerprints.P
        grams.append(x)
    want = set()
    for i in range(len(grams) - fingerprints.WIDTH + 1):
        part = grams[i : i + fingerprints.WIDTH]
        want.add(i + max(j for j, g in enumerate(part) if g == min(part)))
    assert [(v >> 32, (1 << 32) - 1 - (v & ((1 << 32) - 1))) for v in fp] == [(grams[i], i) for i in sorted(want)]


def test_packing(spark, docs, plain, empty):
    path = public_tokenizers.path(packing.VOCABULARY)
    got = [tuple(r) for r in packing.read_packed(spark, packing.write_packed(docs, path)).collect()]
    t, at, want = packing.encoder(path).tokenizer, 0, []
    encoded = [(d, t.encode(x, add_special_tokens=False).ids + [1]) for d, x, _ in plain]
    for d, ids in sorted(encoded, key=lambda e: (e[0] is not None, e[0] or 0)):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert packing.read_packed(spark, packing.write_packed(empty, path)).count() == 0


def test_a_branching_path_is_one_range_in_later_copies(spark):
    run = lambda x, n: [f"{x}{i}" for i in range(n)]
    first, copy = run("p", 60) + run("a", 120) + run("q", 60), run("r", 60) + run("a", 110)[10:] + run("s", 60)
    rows = [(1, first), (2, copy), (2, ["own"] + copy), (3, copy), (3, run("t", 7) + copy), (4, run("r", 60))]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    ranges, _ = substring.removals(docs)
    of_3 = ranges.where("doc_id = 3").groupBy("th").count().collect()
    want = [len(substring.paths(words)[0]) for words in [w for _, w in substring.hashed([" ".join(copy)])]]
    assert want[0] in [r["count"] for r in of_3]  # paths of doc_id 3's first text: each whole from doc_id 2 or 1
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.deduplicated(docs).collect())
    assert got == [(1, 240, 0), (2, 220, 100), (2, 221, 100), (3, 220, 220), (3, 227, 220), (4, 60, 60)]


def test_packing_odd_words():
    enc = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY))
    odd = ["<|ENDOFTEXT|>abc", "<|endoftext|>abc x<|StartOfText|>y", "don't!! it'S O'Re%%% x' 's's", "İstanbul, naïve&&& ÜBER!! ß.. µm ªb ×a÷", "e\u0301, =\u0338 a\u0338= क़!", "", " \t\n", "\x1c a\x85b\u3000c\xa0d \x0b\x0ce", "ΣΑΣ. ΑΣ Ǆ,", "a1b2, 3.5 ...---", "日本語!! 😀,"]
    odd += [" ".join(chr(c) + m for m in ["", ".", "'", "&&&", "<|"]) for c in range(33, 384)] + [" ".join(f"{w}{i}{m}" for w in ("Eon", "éa") for m in ("", ",", "!!")) for i in range(300)]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in odd]
    assert [x.tolist() for x in enc.encode(odd)] == [x.tolist() for x in enc.encode(odd)] == want
    enc.ends[:] = False  # a vocabulary whose ids do not tell where words end
    enc.pieces, enc.words = {"": b""}, {}
    assert [x.tolist() for x in enc.encode(odd)] == want and enc.encode([]) == []


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 9001).astype(np.uint32)
    image = packing.PackedImage(packing.pack_image([5, 6, 7], [ids[:10], ids[10:10], ids[10:]], bits))
    assert (image.document(2) == ids[10:]).all() and len(image.document(1)) == 0 and (image.read(4000, 4200) == ids[4000:4200]).all()


def test_media(docs, plain, empty):
    got = {(r.doc_id, r.payload_sha256, r.n_bytes, r.tail_crc32) for r in media.decoded(media.store(docs)).collect()}
    want = set()
    for d, t, _ in plain:
        n, payload = media.padded(t)
        want.add((d, hashlib.sha256(payload).hexdigest(), n, zlib.crc32(payload[-64:])))
    assert got == want and media.decoded(media.store(empty)).count() == 0


def slow_lzw(codes, size):
    table, out, prev = [bytes([i]) for i in range(1 << size)] + [b"", b""], [], None
    for c in codes:
        if c == 1 << size:
            table, prev = table[: (1 << size) + 2], None
            continue
        s = table[c] if c < len(table) else prev + prev[:1]
        out.append(s)
        if prev is not None and len(table) < 4096:
            table.append(prev + s[:1])
        prev = s
    return b"".join(out)


def test_lzw_reads_any_stream():
    rng = random.Random(1)
    for size in (2, 5, 8):
        codes, n, first = [1 << size], 0, True
        for _ in range(9000):  # codes at random, deferred clears among them
            if rng.random() < 0.0005:
                codes.append(1 << size)
                n = 0
                continue
            top = min(4096, (1 << size) + 2 + max(0, n - 1)) + (1 if 0 < n < 3000 else 0)
            c = rng.randrange(top)
            codes.append(c if c not in (1 << size, (1 << size) + 1) and (n or c < 1 << size) and c < 4096 else 0)
            n += 1
        bits, value, n = 0, 0, 0
        for c in codes:
            width = int(media.code_widths(np.array([n if not first else 0]), size)[0])
            value |= c << bits
            bits += width
            n, first = (0, False) if c == 1 << size else (n + 1, False)
        want = slow_lzw(codes, size)
        assert media.lzw_decode(value.to_bytes(bits // 8 + 2, "little"), size, len(want)) == want


def test_gif_rendering():
    colours = media.default_palette()
    one = media.Frame(0, 0, np.full((2, 2), 5, np.uint8), colours, 10, 2)
    two = media.Frame(0, 0, np.array([[7, 9], [9, 9]], np.uint8), colours, 5, 0, 9)
    shown = list(media.Gif(2, 2, colours[0], [one, two]).rendered())
    assert [s for s, _ in shown] == [0, 10] and (shown[1][1][0, 0] == colours[7]).all() and (shown[1][1][1, 1] == colours[0]).all()
    with pytest.raises(media.GifError):
        media.read(media.write(bytes(64))[:-20])


def test_toxicity(spark, docs, empty):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = toxicity.rated(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.rated(empty, labels).count() == 0
    words = ["bad" + s for s in ("", "ly", "er")]
    rng = random.Random(5)
    texts, y = [], []
    for i in range(900):
        t = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(40)]
        if i % 6 == 0:
            t[7] = rng.choice(words)
        texts.append(" ".join(t))
        y.append(int(i % 6 == 0))
    m, h = toxicity.fit(texts[:600], y[:600], ["en"] * 600), toxicity.Hasher(toxicity.BUCKETS)
    s = np.array([m.score(h(t)) for t in texts[600:]])
    assert (s[np.array(y[600:]) == 1].min() > s[np.array(y[600:]) == 0].max()) and (s >= 0.7).sum() == sum(y[600:])
    long = h(" ".join(texts) * 3)
    assert np.allclose(m.features(long), m.pooled(long)[0])


def slow_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(docs, plain, empty):
    rng = random.Random(2)
    made = ["".join(rng.choice("a1@.+-() 0258b") for _ in range(60)) for _ in range(3000)] + [t for _, t, _ in plain]
    assert all(pii.base_spans(t) == slow_spans(t) for t in made)
    for r in pii.found(docs).collect():
        text = next(t for d, t, _ in plain if d == r.doc_id)
        assert r.base_sha256 == hashlib.sha256(pii.written(slow_spans(text)).encode()).hexdigest()
        assert set(filter(None, pii.written(slow_spans(text)).split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in r.spans.split(",")) for k in pii.KINDS]
    assert pii.found(empty).count() == 0


def test_tagger_accuracy():
    rng, m = np.random.default_rng(99), pii.trained()
    lines = [pii.made_line(rng) for _ in range(200)]
    hit = want = got = 0
    for (text, spans), found in zip(lines, pii.tagged([t for t, _ in lines], m), strict=True):
        good = {s for s in spans if pii.valid(s[0], text[s[1] : s[2]])}
        hit, want, got = hit + len(good & set(found)), want + len(good), got + len(found)
    assert hit / want > 0.85 and hit / got > 0.9


def test_reaches_are_the_whole_decoding():
    """1000 texts with long e-mails, cards and phones at any offset: one decoding of every character of the text, all
    of its windows scored, gives the same spans; and each valid stretch of a text lies in a reach."""
    r, m = random.Random(4), pii.trained()
    texts = []
    for _ in range(1000):
        part = lambda n: "".join(r.choice("abcdefghijklmnop._") for _ in range(n))
        group = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        x = r.choice([
            lambda: part(r.randint(2, 80)) + r.choice([" @ ", "@", " @", "@ "]) + part(r.randint(3, 90)) + ".com",
            lambda: r.choice([" ", ".", "-"]).join(group(4) for _ in range(r.randint(3, 5))),
            lambda: f"+1 ({group(3)}) {group(3)} / {group(4)}",
            lambda: "[.]".join(group(r.randint(1, 3)) for _ in range(4)),
        ])()
        filler = " ".join("word" for _ in range(r.randint(0, 60)))
        texts.append(filler + " " * r.randint(0, 3) + x + " " + filler)

    def whole(text):
        e = next(pii.emissions([text], [[(0, len(text))]], m))[2].astype(np.float64)
        inside = np.zeros(len(text), bool)
        for lo, hi in pii.reaches(text):
            inside[lo:hi] = True
        e[~inside, 1:] = -1e6
        return [s for s in pii.spans_of(0, m.decode(e[:, None], np.array([len(text)]))[0]) if pii.valid(s[0], text[s[1] : s[2]])]

    found = pii.tagged(texts, m)
    assert found == [whole(t) for t in texts] and sum(map(bool, found)) > 500
    for text in texts[:60]:
        inside = {i for lo, hi in pii.reaches(text) for i in range(lo, hi)}
        for kind in pii.KINDS:
            for i in range(0, len(text), 3):
                for j in range(i + 7, min(len(text), i + 60), 5):
                    assert not pii.valid(kind, text[i:j]) or set(range(i, j)) <= inside


def test_masking(spark, empty):
    rows = [(1, "mail a.b@c.org now", 18, "x"), (2, None, None, "y"), (None, "ip 1.2.3.4", 10, None), (3, "", 0, "z")]
    got = {r.spans: tuple(r) for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")).collect()}
    assert got["x"] == (1, "mail <EMAIL> now", 16, "x") and got["y"] == (2, None, None, "y") and got[None][1] == "ip <IP>" and got["z"][1] == ""
    assert pii.masked(empty).count() == 0


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, plain, empty):
    got = simhash.near_duplicates(docs).collect()
    fp = {t: slow_fingerprint(t) for _, t, _ in plain}
    root = {f: f for f in fp.values()}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 62)
    for d, t, _ in plain:
        if d is not None:
            least[top(fp[t])] = min(least[top(fp[t])], d)
    want = sorted((key(d), fp[t], least[top(fp[t])] if least[top(fp[t])] < 1 << 62 else None) for d, t, _ in plain)
    assert sorted((key(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_golay_links_are_complete(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(3)}
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a)}  # hot keys
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    d = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(d)).collect()}
    got = defaultdict(set)
    for (f,) in signed:
        got[roots.get(f, f)].add(f)
    left, want = {f for (f,) in signed}, []
    while left:
        part, rest = set(), [left.pop()]
        while rest:
            f = rest.pop()
            part.add(f)
            near = {g for g in left if ((f ^ g) % (1 << 64)).bit_count() <= 2}
            left -= near
            rest += near
        want.append(part)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_near_copies(spark, empty):
    base = [f"w{i}" for i in range(100)]
    near = base[:50] + ["new"] + base[51:]
    d = spark.createDataFrame([(1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(base), "c"), (4, "other text here", "d"), (5, None, "e"), (6, "", "f"), (None, " ".join(base), "g")], "doc_id long, text string, x string")
    assert sorted(r.x for r in simhash.first_of_each(d).collect()) == ["a", "d", "e", "g"]
    assert simhash.first_of_each(empty).count() == 0


def test_near_copies_of_a_hub_that_is_no_end(spark):
    """Groups whose copies are similar to the original and seldom to each other; within a bucket no similar pair is left out."""
    rng, rows = random.Random(5), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(250)]
        copies = [list(base) for _ in range(120)]
        for k, c in enumerate(copies[1:]):
            for j in rng.sample(range(250), 5):
                c[j] = f"g{g}c{k}x{j}"
        rows += [" ".join(c) for c in copies]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [f"{passage} " + " ".join(f"q{k}y{i}" for i in range(40)) for k in range(60)]
    rng.shuffle(rows)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in rows]
    shared = defaultdict(list)
    for i, t in enumerate(rows):
        for band in simhash.samples(simhash.shingle_hashes(t, 5)).tolist():
            shared[band].append(i)
    group = list(range(len(rows)))
    for a, b in {(a, b) for s in shared.values() for a in s for b in s if a > b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if x == high else x for x in group]
    assert sorted(r.doc_id for r in simhash.first_of_each(d).collect()) == sorted(set(group))
    one = spark.createDataFrame([(i, simhash.shingle_hashes(t, 5).view(np.int64).tolist(), i) for i, t in enumerate(rows)], "doc_id long, s array<long>, label long")
    found = {(r.a, r.b) for r in simhash.remaining(one, 0.8).collect()}
    similar = {(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert similar <= found


def slow_removed(plain):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t, _ in plain]
    for (d, _, _), w in zip(plain, words, strict=True):
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _, _), w in zip(plain, words, strict=True):
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - 49):
                if first[tuple(w[i : i + 50])] < d:
                    gone[i : i + 50] = [True] * 50
        out.append((key(d), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


def test_substring(spark, docs, plain, empty):
    got = sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicated(docs).collect())
    short = [p for p in plain if len(p[1]) < 100_000]
    want = slow_removed(short)
    assert [g for g in got if g[1] < 30000] == want and any(w[2] for w in want)
    assert substring.deduplicated(empty).count() == 0
    rng = random.Random(8)
    pieces = [" ".join(rng.choice("ab") + str(rng.randrange(9)) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    got = sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == slow_removed([(d, t, None) for d, t in rows])



def test_substring_verifies_words_at_the_source():
    words = [b"w%d" % i for i in range(120)]
    packed = zstandard.ZstdCompressor().compress(b" ".join(words))
    right, wrong = substring.seen(words, 3, 7), substring.seen(words, 4, 8)
    source = pd.DataFrame({"s_doc": [1], "s_th": [5], "packed": [packed], "rows": [[{"s_lo": 3, "span": 4}]]})
    assert next(substring.sourced(iter([source])))["seen"].tolist() == [right]
    for known, removed in ((right, 54), (wrong, 0)):
        batch = pd.DataFrame({"doc_id": [2], "th": [5], "packed": [packed], "ranges": [[{"lo": 3, "hi": 7, "seen": known}]]})
        assert next(substring.kept(iter([batch])))["n_removed"].tolist() == [removed]


def test_mixing(spark, docs, plain, empty):
    got = mixing.mix(docs, block=64).collect()
    size = Counter()
    for _, t, s in plain:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    target = mixing.targets(list(size.items()))
    assert math.isclose(sum(target.values()), min(sum(size.values()), 3 * sum(size.values())), rel_tol=1e-9)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(plain) and all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sorted((key(r.doc_id), r.size, r.taken) for r in mixing.mix(docs, block=64).collect()) == sorted((key(r.doc_id), r.size, r.taken) for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted((key(r.doc_id), r.taken) for r in mixing.mix(docs, block=64).collect()) == sorted((key(r.doc_id), r.taken) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.targets([("a", 1), ("b", 100), (None, 0)]) == {None: 0.0, "a": 3.0, "b": 98.0}


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1 << 63), (5000, 1 << 60), (5000, 6000)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        e = lm.EliasFano(lm.EliasFano.build(v, "x"), "x")
        assert (e.access(np.arange(len(v))) == v).all()
        if len(v):
            assert (e.locate(v) == np.arange(len(v))).all()
            other = np.setdiff1d(rng.integers(0, top, 500).astype(np.uint64), v)
            assert (e.locate(other) == -1).all()


def test_language_model(docs, plain, empty):
    got = lm.evaluated(docs).collect()
    tokens = [(d, t.encode().lower().split() + [b" end "]) for d, t, _ in plain]
    train = [t for d, t in tokens if d is not None and zlib.crc32(str(d).encode()) % 10]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b" end ", *t[:-1]], t, strict=True))
    n, v, kept = sum(c.values()), len(c), Counter()
    for (u, w), k in pairs.items():
        if k >= 2:
            kept[u] += (k - 0.75) / c[u]
    p0 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    want = []
    for d, t in tokens:
        s = sum(math.log10((pairs[u, w] - 0.75) / c[u] * (pairs[u, w] >= 2) + (1 - kept[u]) * p0(w)) if c[u] else math.log10(p0(w)) for u, w in zip([b" end ", *t[:-1]], t, strict=True))
        want.append((key(d), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p0(w)) for w in t), s))
    for g, w in zip(sorted((key(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), sorted(want), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=5e-3, abs_tol=1e-2 + 1.3e-4 * g[1])
    assert lm.evaluated(empty).count() == 0


def test_language_model_query_keeps_pairs_seen_once(spark):
    got = queries.op9_lm_scoring(spark, DIR).collect()
    tokens = [(r.doc_id, (r.text or "").encode().lower().split() + [b" end "]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    train = [t for d, t in tokens if d is not None and zlib.crc32(str(d).encode()) % 10]
    c, pairs, kept = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b" end ", *t[:-1]], t, strict=True)), Counter()
    for (u, _), k in pairs.items():
        kept[u] += (k - 0.75) / c[u]
    n, v = sum(c.values()), len(c)
    p0 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    p = lambda u, w: (max(0, pairs[u, w] - 0.75) / c[u] + (1 - kept[u]) * p0(w)) if c[u] else p0(w)
    want = [(key(d), len(t), sum(math.log10(p(u, w)) for u, w in zip([b" end ", *t[:-1]], t, strict=True))) for d, t in tokens]
    for g, w in zip(sorted((key(r.doc_id), r.n_tokens, r.score) for r in got), sorted(want), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=5e-3, abs_tol=1e-2 + 1.3e-4 * g[1])


def test_sentencepiece(docs, plain, empty):
    path = public_tokenizers.path(sentencepiece.MODEL)
    m = sentencepiece.model(path)
    for r in sentencepiece.digests(sentencepiece.encoded(docs, path), path).collect():
        assert r.decoded_sha256 in {hashlib.sha256(t.encode()).hexdigest() for d, t, _ in plain if d == r.doc_id}
    assert sentencepiece.encoded(empty, path).count() == 0
    score = {p: m.scores[i] for i, p in enumerate(m.pieces) if i not in m.special and i not in m.from_byte}

    def best(s):
        top = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 20), j):
                p = score.get(s[i:j], m.unknown if j - i == 1 else -math.inf)
                top[j] = max(top[j], top[i] + p)
        return top[-1]

    for t in ["the quick  brown fox", "naïve\tcafé 日本\n x", " lead", "aa" * 40, "😀"]:
        ids, total = m.encode(t)
        assert m.decode(ids) == t and math.isclose(total, best("▁" + t.replace(" ", "▁")))
    assert m.decode(m.encode("a▁b ▁")[0]) == "a▁b ▁"


def test_registered():
    assert [q for n in range(1, 11) for q in queries.QUERIES if q.startswith(f"op{n}_")] == list(queries.QUERIES)


def test_elias_fano_finds_values_in_dense_and_sparse_stretches():
    rng = np.random.default_rng(5)
    dense = 7_000_000_000 + np.sort(rng.choice(60_000, 20_000, replace=False)).astype(np.uint64)
    values = np.concatenate([np.sort(rng.choice(1 << 32, 500, replace=False)).astype(np.uint64), dense, dense[-1:] + np.uint64(1 << 40)])
    for v in (values, values[:1], values[:0]):
        seq = lm.EliasFano({k: a for k, a in lm.EliasFano.build(v, "x").items()}, "x")
        asked = np.unique(np.concatenate([values, values + np.uint64(1), values[1:] - np.uint64(1)]))
        at = np.searchsorted(v, asked)
        there = (at < len(v)) & (v[np.minimum(at, len(v) - 1)] == asked) if len(v) else np.zeros(len(asked), bool)
        assert (seq.locate(asked) == np.where(there, at, -1)).all()
        inside = (at >= len(v) // 3) & (at < len(v) // 2)
        begin, end = np.full(len(asked), len(v) // 3), np.full(len(asked), len(v) // 2)
        assert (seq.locate(asked, begin, end) == np.where(there & inside, at, -1)).all()


def test_media_features_are_those_of_rendered_frames(spark):
    texts = ["short", "x" * 40_000 + "é" * 30_000, None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.store(d)
    got = {r.doc_id: r for r in media.decoded(stored).collect()}
    shown = defaultdict(list)
    for r in media.frames(stored).collect():
        shown[r.doc_id].append(r)
    colours = media.default_palette().tolist()
    for k, text in enumerate(texts):
        payload = media.padded(text or "")[1]
        high, hist, canvas = min(len(payload), 64 * 512), np.zeros(12, np.int64), []
        for i in range(0, len(payload), 64 * 512):
            part = payload[i : i + 64 * 512]
            canvas = [*part, *canvas[len(part) : high]]
            own = np.zeros(12, np.int64)
            for v, n in Counter(canvas).items():
                for c in range(3):
                    own[4 * c + colours[v][c] // 64] += n
            hist += own
            frame = next(f for f in shown[k] if f.frame == i // (64 * 512))
            assert frame.histogram == own.tolist() and frame.start_cs == frame.frame * media.DELAY and len(frame.rgb) == 3 * high
        n = -(-len(payload) // (64 * 512))
        assert got[k].feature == ",".join(map(str, [*hist, n, n * media.DELAY])) and len(shown[k]) == n
        assert hashlib.sha256(payload).hexdigest() == got[k].payload_sha256
    bad = spark.createDataFrame([(1, 3, b"GIF89a" + b"\xff" * 7), (2, 0, None), (None, 1, b"no")], "doc_id long, n_bytes long, media binary")
    assert all(r.error and r.feature is None for r in media.decoded(bad).collect()) and all(r.error and r.rgb is None for r in media.frames(bad).collect())


def test_gif_offset_and_disposal_to_previous():
    colours = media.default_palette()
    first = media.Frame(0, 0, np.full((3, 3), 8, np.uint8), colours, 10, 1)
    second = media.Frame(1, 2, np.full((4, 2), 9, np.uint8), colours, 5, 3)  # partly outside the canvas
    third = media.Frame(0, 0, np.full((1, 1), 7, np.uint8), colours, 1, 0)
    shown = [rgb for _, _, rgb, _ in media.shown(media.Gif(3, 3, colours[0], [first, second, third]))]
    assert (shown[1][2, 1] == colours[9]).all() and (shown[1][1, 1] == colours[8]).all()
    assert (shown[2][2, 1] == colours[8]).all() and (shown[2][0, 0] == colours[7]).all()


def test_stages_keep_columns_of_any_name(spark):
    names = ["gone", "key", "_key", "_times", "_copy", "doc", "d", "t", "th", "fp", "node", "root", "a", "b", "score", "label_id", "at"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 0), (2, text, "en", "s", 0), (2, text + " more", "en", None, 0), (3, None, None, "s", None), (None, "a b c", "de", "t", 5), (4, "", "de", "t", 0), (5, "one two", "de", "t", 0), (5, "one two", "de", "t", 0)]
    d = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    kept = {"toxicity": toxicity.clean(d, labels), "copies": simhash.first_of_each(d), "pii": pii.masked(d), "mix": mixing.mixed(d)}
    for df in kept.values():
        assert df.columns == d.columns
    key = names.index("key") + 5
    got = {k: sorted(int(r[key][3:]) for r in df.collect()) for k, df in kept.items()}
    assert got["copies"] == [0, 3, 4, 6, 7] and got["pii"] == list(range(8)) and set(got["mix"]) <= {0, 1, 2, 4, 6, 7} and got["toxicity"] == list(range(8))


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "personal data", "source mix", "sentencepiece"]
    ids = {r.doc_id for r in given.collect()}
    m = sentencepiece.model(public_tokenizers.path(sentencepiece.MODEL))
    assert out and {r.doc_id for r in out} <= ids
    for r in out:  # nothing that the pattern finds is left
        assert not pii.base_spans(m.decode(list(r.ids)))


def test_scores_are_log_probabilities(spark, docs):
    path = public_tokenizers.path(sentencepiece.MODEL)
    m = sentencepiece.model(path)
    whole = [t or "" for (t,) in docs.select("text").collect()]
    likelihood = []
    for rounds in range(3):
        scores = sentencepiece.fitted(docs, path, rounds)
        assert math.isclose(np.exp(scores[m.plain]).sum(), 1, rel_tol=1e-9)
        own = sentencepiece.Model.load(path)
        own.rate(scores)
        likelihood.append(sum(s for _, s in own.encode_many(whole)))
    assert likelihood[0] < likelihood[1] < likelihood[2]
    again = sentencepiece.fitted(docs.repartition(3), path, 2)
    assert (again == scores).all()
    plain = set(m.plain.tolist())
    counts = Counter(i for ids, _ in own.rate(sentencepiece.fitted(docs, path, 1)).encode_many(whole) for i in ids.tolist() if i in plain)
    total = sum(counts.values())
    assert all(math.isclose(scores[i], math.log((n + 0.1) / (total + 0.1 * len(plain))), rel_tol=1e-6) for i, n in counts.most_common(20))


def test_segmentation_by_units_is_that_of_the_whole_text():
    m = sentencepiece.Model.load(public_tokenizers.path(sentencepiece.MODEL))
    m.rate(np.random.default_rng(0).normal(-9, 2, len(m.pieces)))
    r = random.Random(3)
    for t in ("".join(r.choice("ab.c,d-'(x)1 2:\n\té_ü!?…”#😀日") for _ in range(r.randint(1, 25))) for _ in range(1000)):
        ids, score = m.encode(t)
        assert m.decode(ids) == t and math.isclose(score, m.best("▁" + t.replace(" ", "▁"))[1], abs_tol=1e-6)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
