"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans in other spellings.

The patterns give the base spans (e-mail, IP address, payment card, phone). The tagger is trained in numpy from
labelled spans: lines of made-up words in which personal data in many spellings, and look-alikes that are none, are
set by a seeded generator. A text is cut into overlapping windows; a character's emission score is the mean of those
it has in the windows over it, and one Viterbi decoding over the joined scores of the whole text gives its tags.

A span must pass its kind's checks (valid()), which say what characters it may hold: so it lies in a reach, a run of
such characters around an @ or around enough digits. The decoding is bound to the tag "outside" at every character
out of all reaches. Where only one tag is possible, the best path before and after are independent of each other; so
decoding each reach by itself, between two outside tags, is the decoding of the whole text, and windows over no reach
need no scores. Added spans give way to base spans that they overlap.

Edge cases: a null or empty text has no spans; equal texts have equal spans; spans are counted in code points, end
exclusive; a digit group of any length is read without converting it to a number first; extra columns stay as they
are in masked() and are ignored in found(); repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lodestar.llm import common

KINDS = ("email", "ip", "card", "phone")
MASK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
Span = tuple[str, int, int]

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run that fails from its first digit fails from each later one, so runs are tried from their start only.
ADDRESS = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_byte(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or 0) <= 255


def is_card(s: str) -> bool:
    d = only_digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """By start, then kind as in KINDS."""
    if not ANCHOR.search(text):
        return []
    out = list(emails(text))
    out += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(map(is_byte, m.groups()))]
    out += [("card", *m.span()) for m in DIGITS.finditer(text) if is_card(m[0])]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the tagger -------------------------------------------------------------------------------------------------

WINDOW, STRIDE, HIDDEN, EMBED = 96, 48, 16, 8
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
CLASSES = 45
LINES, STEPS, BATCH, RATE = 1500, 160, 48, 0.02


def char_ids(text: str) -> np.ndarray:
    """A small alphabet: letters by rough class, each digit's class, and the marks that matter."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _table()[np.minimum(code, 127)]


@cache
def _table() -> np.ndarray:
    out = np.full(128, 1, np.int64)
    out[ord("a") : ord("z") + 1] = 2
    out[ord("A") : ord("Z") + 1] = 3
    out[ord("0") : ord("9") + 1] = [4, 5, 6, 6, 6, 6, 6, 6, 7, 7]
    for i, c in enumerate(" \n\t@.-+()_%/:;,!?#$&*\"'=<>[]{}|~^\\`"):
        out[ord(c)] = 8 + i
    return out


@dataclass
class Tagger:
    embed: np.ndarray
    fore: list[np.ndarray]  # input weights, recurrent weights, bias
    back: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.fore, *self.back, self.out, self.bias, self.moves]

    def scores(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """ids: windows x characters. Emission scores: characters x windows x tags."""
        x = self.embed[ids.T]
        f, b = lstm(x, *self.fore), lstm(x[::-1], *self.back)
        h = np.concatenate([f[0], b[0][::-1]], axis=2)
        return h @ self.out + self.bias, (x, f, b, h)

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags of stretches that stand between characters tagged outside. e: characters x stretches x tags,
        of which each stretch has its length."""
        n, w, k = e.shape
        best, back, every = self.moves[0] + e[0], np.zeros((n, w, k), np.int8), np.arange(w)
        for t in range(1, n):
            s = best[:, :, None] + self.moves
            on = (t < lengths)[:, None]
            back[t] = np.where(on, s.argmax(axis=1), np.arange(k))
            best = np.where(on, s.max(axis=1) + e[t], best)
        tags = np.zeros((n, w), np.int8)
        tags[-1] = (best + self.moves[:, 0]).argmax(axis=1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, every, tags[t]]
        return tags.T


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple:
    n, w, _ = x.shape
    h, c, k = np.zeros((w, HIDDEN), np.float32), np.zeros((w, HIDDEN), np.float32), HIDDEN
    hs, cs, gates, pre = np.zeros((n, w, k), np.float32), np.zeros((n, w, k), np.float32), np.zeros((n, w, 4 * k), np.float32), x @ wx + b
    for t in range(n):
        z = pre[t] + h @ wh
        g = gates[t]
        g[:, : 3 * k], g[:, 3 * k :] = sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
        c = g[:, :k] * c + g[:, k : 2 * k] * g[:, 3 * k :]
        h = g[:, 2 * k : 3 * k] * np.tanh(c)
        hs[t], cs[t] = h, c
    return hs, cs, gates


def lstm_back(d_hs: np.ndarray, x: np.ndarray, made: tuple, wx: np.ndarray, wh: np.ndarray) -> tuple:
    hs, cs, gates = made
    n, w, k = hs.shape
    d_wx, d_wh, d_b, d_x = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * k, np.float32), np.zeros_like(x)
    d_h, d_c = np.zeros((w, k), np.float32), np.zeros((w, k), np.float32)
    for t in range(n - 1, -1, -1):
        f, i, o, g = np.split(gates[t], 4, axis=1)
        th = np.tanh(cs[t])
        d_h = d_h + d_hs[t]
        d_c = d_c + d_h * o * (1 - th**2)
        last = cs[t - 1] if t else np.zeros_like(d_c)
        dz = np.concatenate([d_c * last * f * (1 - f), d_c * g * i * (1 - i), d_h * th * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
        d_wx += x[t].T @ dz
        d_wh += (hs[t - 1].T @ dz) if t else 0
        d_b += dz.sum(axis=0)
        d_x[t] = dz @ wx.T
        d_h, d_c = dz @ wh.T, d_c * f
    return d_wx, d_wh, d_b, d_x


def crf_gradient(e: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the gold tags (characters x windows), and its gradients."""
    n, w, k = e.shape
    lse = lambda s, axis: (m := s.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(s - m).sum(axis=axis))
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, n):
        a[t] = lse(a[t - 1][:, :, None] + moves, 1) + e[t]
    for t in range(n - 2, -1, -1):
        b[t] = lse(moves + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = lse(a[-1], 1)
    d_e = np.exp(a + b - z[None, :, None])
    d_moves = np.zeros_like(moves)
    for t in range(1, n):
        d_moves += np.exp(a[t - 1][:, :, None] + moves + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows, cols = np.arange(n)[:, None], np.arange(w)[None, :]
    score = e[rows, cols, gold].sum(axis=0) + moves[gold[:-1], gold[1:]].sum(axis=0)
    d_e[rows, cols, gold] -= 1
    np.add.at(d_moves, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    return float((z - score).mean()), d_e / w, d_moves / w


def made_line(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A line of made-up words with labelled personal data and look-alikes."""
    word = lambda: "".join(rng.choice(list("aeiourstnldmchpg"), rng.integers(2, 9)))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    group = lambda s, sizes, by: by.join(s[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return group(d, [4, 4, 4, 4], str(rng.choice(["", " ", "-", ".", "/", "  "])))

    def phone() -> str:
        d, by = digits(10), str(rng.choice([" ", "-", ".", "/"]))
        plus = str(rng.choice(["+1 ", "+44 ", "1" + by, "00 49 ", ""]))
        area = f"({d[:3]}) " if rng.random() < 0.5 else d[:3] + by
        return plus + area + d[3:6] + by + d[6:]

    def address() -> str:
        return str(rng.choice([".", ".", "[.]"])).join(str(rng.integers(0, 256)) for _ in range(4))

    def email() -> str:
        at = str(rng.choice(["@", "@", " @ "]))
        return word() + str(rng.choice(["", ".", "_"])) + word() + (digits(2) if rng.random() < 0.4 else "") + at + word() + "." + str(rng.choice(["com", "org", "example.net", "de"]))

    def other() -> str:
        return [lambda: digits(int(rng.integers(1, 7))), lambda: digits(4) + "-" + digits(2) + "-" + digits(2), lambda: digits(2) + ":" + digits(2), lambda: digits(1) + "." + digits(int(rng.integers(1, 4))), lambda: "".join(rng.choice(list("0123456789abcdef"), 32)), lambda: "v" + digits(1) + "." + digits(1) + "." + digits(2), lambda: "@" + word(), lambda: digits(16) + word()][int(rng.integers(0, 8))]()

    text, spans = "", []
    while len(text) < WINDOW:
        text += " ".join(word() for _ in range(rng.integers(1, 6))) + str(rng.choice([" ", " ", ", ", ". ", "\n", ": "]))
        if rng.random() < 0.5:
            kind = str(rng.choice(KINDS))
            piece = {"email": email, "ip": address, "card": card, "phone": phone}[kind]()
            spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        else:
            text += other()
        text += str(rng.choice([" ", " ", ". ", "!! ", ", "]))
    return text, spans


@cache
def trained(seed: int = 11) -> Tagger:
    rng = np.random.default_rng(seed)
    ids, gold = np.zeros((LINES, WINDOW), np.int64), np.zeros((LINES, WINDOW), np.int64)
    for i in range(LINES):
        text, spans = made_line(rng)
        cut = int(rng.integers(0, len(text) - WINDOW + 1))
        tags = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
        ids[i], gold[i] = char_ids(text)[cut : cut + WINDOW], tags[cut : cut + WINDOW]
    new = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    cell = lambda: [new(EMBED, 4 * HIDDEN), new(HIDDEN, 4 * HIDDEN), np.repeat(np.array([1, 0, 0, 0], np.float32), HIDDEN)]
    m = Tagger(new(CLASSES, EMBED), cell(), cell(), new(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    first, second = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()]
    for step in range(1, STEPS + 1):
        at = rng.integers(0, LINES, BATCH)
        e, (x, f, b, h) = m.scores(ids[at])
        _, d_e, d_moves = crf_gradient(e, m.moves, gold[at].T)
        d_h = d_e @ m.out.T
        fw, fh, fb, fx = lstm_back(d_h[:, :, :HIDDEN], x, f, *m.fore[:2])
        bw, bh, bb, bx = lstm_back(d_h[::-1, :, HIDDEN:], x[::-1], b, *m.back[:2])
        d_embed = np.zeros_like(m.embed)
        np.add.at(d_embed, ids[at].T, fx + bx[::-1])
        grads = [d_embed, fw, fh, fb, bw, bh, bb, np.einsum("twh,twk->hk", h, d_e), d_e.sum(axis=(0, 1)), d_moves]
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for p, g, u, v in zip(m.params(), grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    for to in range(2, TAGS, 2):  # inside only follows begin or inside of its kind
        m.moves[[i for i in range(TAGS) if i not in (to - 1, to)], to] = -1e4
    return m


def valid(kind: str, s: str) -> bool:
    digits = only_digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]{2,64} ?@ ?[^\s@]+\.[^\s@.]{2,}", s))
    if kind == "ip":
        parts = re.split(r"\[\.\]|\.", s)
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", p) and is_byte(p) for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./-]", s)
    return 10 <= len(digits) <= 15 and len(re.findall(r"[ ().+/-]+", s)) >= 2 and not re.search(r"[^0-9 ().+/-]", s) and s.count(".") < 3


def windows(n: int) -> np.ndarray:
    """Starts of the windows of a text of n characters."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


#: What valid() lets a number's span hold, and what a span on either side of an @ may.
NUMBER = re.compile(r"[0-9 ().+/\[\]-]+")
BEFORE, AFTER = re.compile(r"[^\s@]{2,64} ?\Z"), re.compile(r" ?[^\s@]+")
LOCAL_MOST = 64


def reaches(text: str) -> list[tuple[int, int]]:
    """Stretches, apart from each other and ascending, outside of which no valid span has a character."""
    out = []
    at = text.find("@")
    while at >= 0:
        before, after = BEFORE.search(text, max(0, at - LOCAL_MOST - 1), at), AFTER.match(text, at + 1)
        if before and after and "." in after[0]:
            out.append((before.start(), after.end()))
        at = text.find("@", at + 1)
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            digits = len(only_digits(m[0]))
            if digits >= 10 or digits >= 4 and m[0].count(".") >= 3:
                out.append(m.span())
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(out):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def emissions(texts: list[str], places: list[list[tuple[int, int]]], model: Tagger) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of each place (text, start): the mean scores that its characters have in the windows over them."""
    jobs, ids, asked = {}, [], []
    for k, own in enumerate(places):
        if not own:
            continue
        coded, starts = char_ids(texts[k]), windows(len(texts[k]))
        for lo, hi in own:
            first, last = np.searchsorted(starts, lo - WINDOW, "right"), np.searchsorted(starts, hi)
            mine = starts[first:last].tolist()
            for start in mine:
                if (k, start) not in jobs:
                    jobs[k, start] = len(ids)
                    part = coded[start : start + WINDOW]
                    ids.append(np.concatenate([part, np.zeros(WINDOW - len(part), np.int64)]))
            asked.append((k, lo, hi, mine))
    scores = [model.scores(np.stack(ids[i : i + 512]))[0] for i in range(0, len(ids), 512)]
    for k, lo, hi, mine in asked:
        total, n = np.zeros((hi - lo, TAGS), np.float32), np.zeros((hi - lo, 1), np.float32)
        for start in mine:
            j = jobs[k, start]
            a, b = max(lo, start), min(hi, start + WINDOW)
            total[a - lo : b - lo] += scores[j // 512][a - start : b - start, j % 512]
            n[a - lo : b - lo] += 1
        yield k, lo, total / n


def tagged(texts: list[str], model: Tagger, places: list[list[tuple[int, int]]] | None = None) -> list[list[Span]]:
    """Spans by the tagger alone, after the checks, of each text. places: where to look, the reaches unless given."""
    found = sorted(emissions(texts, [reaches(t) for t in texts] if places is None else places, model), key=lambda f: len(f[2]))
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(found):
        size = 1  # stretches of like length together, within a bound on their characters
        while at + size < len(found) and (size + 1) * len(found[at + size][2]) <= 50_000:
            size += 1
        part = found[at : at + size]
        lengths = np.array([len(e) for _, _, e in part])
        e = np.zeros((lengths[-1], size, TAGS), np.float32)
        for j, (_, _, own) in enumerate(part):
            e[: len(own), j] = own
        for (k, lo, _), tags, n in zip(part, model.decode(e, lengths), lengths.tolist(), strict=True):
            out[k] += [s for s in spans_of(lo, tags[:n]) if valid(s[0], texts[k][s[1] : s[2]])]
        at += size
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


def spans_of(at: int, tags: np.ndarray) -> Iterator[Span]:
    kind, start = 0, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        if kind and (t == 0 or t % 2 == 1 or (t + 1) // 2 != kind):
            yield KINDS[kind - 1], at + start, at + i
            kind = 0
        if t and not kind:
            kind, start = (t + 1) // 2, i


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base, places = [base_spans(t) for t in texts], [reaches(t) for t in texts]
    out, found, held = [], [], 0
    for k, own in enumerate(places):  # texts together up to a bound on what is decoded
        held += sum(hi - lo + WINDOW for lo, hi in own)
        if held > 400_000 or k == len(texts) - 1:
            found += tagged(texts[len(found) : k + 1], model, places[len(found) : k + 1])
            held = 0
    for own, more in zip(base, found, strict=True):
        starts, ends, far = [s[1] for s in own], [], 0
        for s in own:
            far = max(far, s[2])
            ends.append(far)  # of the spans up to this one, the furthest end
        added = []
        for s in more:
            before = bisect.bisect_left(starts, s[2])
            if not before or ends[before - 1] <= s[1]:
                added.append(s)
        out.append((own, sorted([*own, *added], key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind (of all spans), base_sha256 and spans."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(trained())  # a few thousand weights

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = all_spans(b["text"].tolist(), shared.value)
            out = {"doc_id": b["doc_id"].astype("Int64")} | {f"n_{k}": [sum(s[0] == k for s in a) for _, a in got] for k in KINDS}
            yield pd.DataFrame(out | {"base_sha256": [hashlib.sha256(written(s).encode()).hexdigest() for s, _ in got], "spans": [written(a) for _, a in got]})

    return common.texts(docs).mapInPandas(common.lean(rows), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """Each span (of overlapping ones, their union under the first one's kind) replaced by its kind's mark."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], MASK[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by marks, and n_chars as it then is; other columns as they are."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(trained())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = b["text"].notna()
            texts = b["text"].where(known, "").tolist()
            new = [mask(t, a) for t, (_, a) in zip(texts, all_spans(texts, shared.value), strict=True)]
            b = b.assign(text=pd.Series(new, b.index, object).where(known, None))
            if "n_chars" in b:
                b = b.assign(n_chars=pd.Series([len(n) if n != t else c for n, t, c in zip(new, texts, b["n_chars"], strict=True)], b.index))
            yield b

    return docs.mapInPandas(common.lean(rows), docs.schema)
