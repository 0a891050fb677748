"""Secret scan: pattern findings and a character convolutional network over every candidate in its context.

Candidates are the findings of the base patterns and every other token-like
string (16 or more of A-Za-z0-9+/_=- with a digit; what a base span leaves of
one counts by itself). The network reads a candidate with the text around it:
characters are embedded, those of the text around apart from those inside, and
one convolution with ReLU and max pooling feeds a logistic output. Long
candidates are read whole, in overlapping windows, and have their greatest score.

It is numpy throughout and trained here. Secrets are the base findings that are
token-like, without what their pattern keys on (keyword, prefix), each also
written in other alphabets (``spellings``), since a pattern knows one only. Not
secrets are plain words, numbers, and ids, paths and queries made of the
documents' words. Token-like strings that no pattern finds are unlabelled: only
numbers among them are taught. Each class is drawn by itself: secrets from all
documents (up to ``secrets`` distinct ones by hash), the others from about
``sample`` documents (up to ``most`` rows). A held-out quarter of both, drawn by
a secret's value, calibrates scores (a scale and a shift) and sets the
threshold: the highest one that still finds a share ``recall`` of its secrets.
Where that is under ``least`` the recall holds and a warning says so. New
spellings of every secret are held out too, so that even one is enough.

The method adds spans of kind ``model`` where a candidate that overlaps no base
span reaches the threshold; base spans always stay. Null and empty texts have
no spans. Without labelled secrets in the table nothing is added. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ship, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OTHER = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by start, then kind."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def other_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Token-like strings that overlap no base span; base spans divide them."""
    out = [m.span() for m in _OTHER.finditer(text) if _DIGIT.search(m[0])]
    if not base:
        return out
    left = []
    for a, b in out:
        for s, _, e in base:
            if a < e and s < b:
                left.append((a, s))
                a = max(a, e)
        left.append((a, b))
    return [(a, b) for a, b in left if b - a >= 16 and _DIGIT.search(text, a, b)]


BEFORE, INSIDE, AFTER = 24, 48, 8
#: Embedded characters: ASCII by itself, 0 for none, 127 for all others; 128 more for those around a candidate.
SIZE = 256


def window(text: str, start: int, end: int) -> np.ndarray:
    """Characters before, of and after a candidate, in places of their own."""
    return joined(text[max(0, start - BEFORE) : start], text[start : min(end, start + INSIDE)], text[end : end + AFTER])


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping parts of a candidate, of INSIDE characters at most; the last ends where it ends."""
    return [(a, min(end, a + INSIDE)) for a in (*range(start, max(start + 1, end - INSIDE), INSIDE // 2), *([end - INSIDE] if end - start > INSIDE else []))]


def joined(before: str, inside: str, after: str) -> np.ndarray:
    x = np.frombuffer((before.rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + after.ljust(AFTER, "\0")).encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.minimum(x, 127).astype(np.uint8)
    x[:BEFORE] |= 128
    x[BEFORE + INSIDE :] |= 128
    return x


def hidden(text: str, base: list[tuple[int, int, int]]) -> str:
    """The text with nothing in place of its base spans: what stands around other candidates."""
    parts, last = [], 0
    for s, _, e in base:
        if e > last:
            s = max(s, last)
            parts += [text[last:s], "\0" * (e - s)]
            last = e
    return "".join(parts) + text[last:]


_HEXES, _CAPS, _LOW, _NUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets that keys are written in.
SPELLINGS = (_HEXES, _HEXES.upper(), _HEXES + "ABCDEF", _CAPS + _LOW + _NUM, _CAPS + _LOW + _NUM + "+/", _CAPS + _LOW + _NUM + "-_", _CAPS + _NUM, _LOW + _NUM)


def spellings(value: str, salt: str = "") -> list[str]:
    """Strings as random as a secret, one for each alphabet, that depend on it and the salt only."""
    r = random.Random(zlib.crc32((salt + value).encode("utf-8", "surrogatepass")))
    out = []
    for letters in SPELLINGS:
        x = [r.choice(letters) for _ in range(r.choice((20, 24, 32, 40, 48)))]
        x[r.randrange(len(x))] = r.choice(_NUM)
        out.append("".join(x))
    return out


def labelled_secrets(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, str]]:
    """Text before, value and text after of base findings that are token-like and no numbers, without keyword, prefix and quote."""
    plain, out, last = hidden(text, base), [], 0
    for s, kind, e in sorted(base, key=lambda x: (x[0], -x[2])):
        if e <= last:
            continue  # inside another finding
        last = e
        value = _ASSIGN.match(text, s)[2] if kind == 0 else text[s + 4 : e] if kind == 1 else text[s:e]
        if _OTHER.fullmatch(value) and _DIGIT.search(value) and not _NUMBER.fullmatch(value):
            out.append((plain[max(0, s - BEFORE) : s], value, plain[e : e + AFTER].lstrip("\"'")))
    return out


_NUMBER = re.compile(r"[0-9+/_=-]+")
_WORD = re.compile(r"[^\W\d_]{2,24}")


def sure_others(text: str, base: list[tuple[int, int, int]], most: int = 8) -> list[tuple[str, str, str]]:
    """Text before, inside and after of what is no secret: numbers and words of the text, and ids, paths and queries made of its words."""
    plain = hidden(text, base)
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    spots = [(a, e) for a, e in other_spans(text, base) if _NUMBER.fullmatch(text, a, e)][:most]
    words = [m.span() for m in _WORD.finditer(hidden(plain, [(a, 0, e) for a, e in other_spans(plain, [])]), 0, 20_000)]
    spots += r.sample(words, min(most, len(words)))
    out = [(plain[max(0, a - BEFORE) : a], text[a:e], plain[e : e + AFTER]) for a, e in spots]
    if len(words) < 4:
        return out
    number = lambda k: str(r.randrange(10 ** (k - 1), 10**k))
    for _ in range(most // 2):
        w = [plain[a:e] for a, e in r.choices(words, k=6)]
        w = [x if x.isascii() else "".join(c for c in x if c.isascii()) or "a" for x in w]
        at = r.choice(words)[1]
        made = r.choice((
            lambda: "/" + "/".join(w[: r.randint(3, 6)]) + number(2), lambda: "_".join(w[:4]) + "_" + number(r.randint(1, 4)), lambda: "-".join(w[:5]) + "-" + number(4),
            lambda: "".join(x.capitalize() for x in w[:4]) + number(2), lambda: "_".join(w[:4]).upper() + "_" + number(2), lambda: f"{w[0]}={number(3)}/{w[1]}={w[2]}/{w[3]}={number(5)}",
            lambda: number(r.randint(16, 20)), lambda: f"20{number(2)}-{number(2)}-{number(2)}/{w[0]}-{w[1]}", lambda: "-".join("%0*x" % (k, r.getrandbits(4 * k)) for k in (8, 4, 4, 4, 12))))()
        out.append((plain[max(0, at - BEFORE + 1) : at] + " ", made, " " + plain[at + 1 : at + AFTER]))
    return out


class CharCNN:
    """Embedding, one convolution over ``width`` characters, ReLU, max over places, logistic output."""

    def __init__(self, dim: int = 8, width: int = 5, filters: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": rng.normal(0, 0.3, (SIZE, dim)), "w": rng.normal(0, (2 / (dim * width)) ** 0.5, (dim * width, filters)), "b": np.zeros(filters), "v": rng.normal(0, 0.2, filters), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, x: np.ndarray):
        n, length = x.shape
        emb = self.p["e"][x]
        cols = np.concatenate([emb[:, k : length - self.width + 1 + k] for k in range(self.width)], axis=2)
        z = cols @ self.p["w"] + self.p["b"]
        at = z.argmax(1)
        top = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0)
        return cols, at, top, top @ self.p["v"] + self.p["c"][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 2048])[3] for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.005, seed: int = 3) -> "CharCNN":
        """Adam on the logistic loss, classes weighted alike."""
        rng, m, s, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                k = order[i : i + batch]
                cols, at, top, out = self._forward(x[k])
                d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[k]) * weight[k] / len(k)
                dz = np.outer(d, self.p["v"]) * (top > 0)
                used = cols[np.arange(len(k))[:, None], at]
                g = {"v": top.T @ d, "c": np.array([d.sum()]), "b": dz.sum(0), "w": np.einsum("nf,nfc->cf", dz, used)}
                de = np.einsum("nf,cf->nfc", dz, self.p["w"]).reshape(len(k), -1, self.width, self.p["e"].shape[1])
                chars = x[k][np.arange(len(k))[:, None, None], at[:, :, None] + np.arange(self.width)]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], chars.ravel(), de.reshape(-1, self.p["e"].shape[1]))
                t += 1
                for q in self.p:
                    m[q] = 0.9 * m[q] + 0.1 * g[q]
                    s[q] = 0.999 * s[q] + 0.001 * g[q] ** 2
                    self.p[q] = self.p[q] - rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, least: float) -> "CharCNN":
        """Scale and shift of the logits by the logistic loss with smoothed targets, then the threshold."""
        z, pos = self.logit(x), int(y.sum())
        goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, w = p - goal, p * (1 - p) + 1e-9
            h = np.array([[np.sum(w * z * z) + 1e-6, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-6]])
            step = np.linalg.solve(h, np.array([np.sum(r * z), np.sum(r)]))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.shift = a, b
        found = np.sort(self.score(x)[y > 0])
        self.threshold = float(found[int(np.floor((1 - recall) * len(found)))]) if len(found) else 1.0
        if self.threshold < least:
            warnings.warn(f"a recall of {recall} needs the threshold {self.threshold:.3g}, under {least}", stacklevel=2)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(x) + self.shift, -30, 30)))


def train(docs: DataFrame, text_col: str = "text", *, sample: int = 8_000, most: int = 6_000, secrets: int = 1_000, recall: float = 0.98, least: float = 0.5) -> CharCNN | None:
    """The network fitted on up to ``secrets`` of the table's labelled secrets and others of at most about ``sample`` documents; None without secrets."""
    def find_secrets(batches):
        for b in batches:
            got = [x for t in b.column(0).to_pylist() if (base := base_spans(t)) for x in labelled_secrets(t, base)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.string()) for i in range(3)], names=["p", "v", "q"])

    def find_others(batches):
        for b in batches:
            xs = [joined(p, v[:INSIDE], q).tobytes() for t in b.column(0).to_pylist() for p, v, q in sure_others(t, base_spans(t))]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary())], names=["x"])

    ship(docs.sparkSession)
    some = docs.where(F.col(text_col).isNotNull()).select(text_col)
    yes = some.mapInArrow(find_secrets, "p string, v string, q string").groupBy("v").agg(F.min(F.struct("p", "q")).alias("c")).orderBy(F.xxhash64("v"), "v").limit(secrets).collect()
    if not yes:
        return None
    share = min(1.0, sample / max(1, docs.count()))
    drawn = some.where(F.pmod(F.xxhash64(text_col), F.lit(1_000_000)) < int(1_000_000 * share))
    no = drawn.mapInArrow(find_others, "x binary").distinct().orderBy(F.xxhash64("x"), "x").limit(most).collect()
    x, y, held = [np.frombuffer(bytes(r.x), np.uint8) for r in no], [0] * len(no), [i % 4 == 0 for i in range(len(no))]
    rounds, r = -(-50 // len(yes)), random.Random(5)  # few secrets are spelled anew more often
    for i, z in enumerate(yes):
        # a secret is held out whole, or else new spellings of it are
        apart = i % 4 == 3
        new = [(v, out) for k in range(rounds) for salt, out in (("", apart), ("held", True)) for v in spellings(z.v, f"{salt}{k}")]
        for value, out in [(z.v, apart), *new]:
            at = joined(z.c.p, value[:INSIDE], z.c.q)
            if value != z.v and no:  # text around any other candidate, so that what is around a few secrets is not learnt
                other = x[r.randrange(len(no))].copy()
                other[BEFORE : BEFORE + INSIDE] = at[BEFORE : BEFORE + INSIDE]
                at = other
            x.append(at)
            y.append(1)
            held.append(out)
    x, y, held = np.stack(x), np.array(y), np.array(held)
    return CharCNN().fit(x[~held], y[~held]).calibrate(x[held], y[held], recall, least)


NAMES = (*KINDS, "model")


def find(texts: list[str], model: CharCNN | None) -> tuple[list[list], list[list]]:
    """Base spans and the model's spans of each text, as (start, kind's number, end)."""
    base = [base_spans(t) for t in texts]
    at = [(i, a, e) for i, (t, s) in enumerate(zip(texts, base)) for a, e in other_spans(t, s)] if model is not None else []
    around = {i: hidden(texts[i], base[i]) for i, _, _ in at}
    added: list[list] = [[] for _ in texts]
    best = np.zeros(len(at))
    parts = ((k, i, s, f) for k, (i, a, e) in enumerate(at) for s, f in windows(a, e))
    while some := list(itertools.islice(parts, 4096)):
        np.maximum.at(best, [k for k, *_ in some], model.score(np.stack([window(around[i], s, f) for _, i, s, f in some])))
    for (i, a, e), p in zip(at, best.tolist()):
        if p >= model.threshold:
            added[i].append((a, len(KINDS), e))
    return base, added


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharCNN | None = None) -> DataFrame:
    """One row per text: id, n_assign, n_access, n_hex, n_model, base_sha256, spans."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def told(spans) -> str:
        return ",".join(f"{NAMES[k]}:{a}:{e}" for a, k, e in spans)

    def run(batches):
        for b in batches:
            base, added = find(["" if t is None else t for t in b.column(1).to_pylist()], model)
            every = [sorted(s + m) for s, m in zip(base, added)]
            n = [pa.array([sum(k == j for _, k, _ in s) for s in every], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array([hashlib.sha256(told(s).encode()).hexdigest() for s in base], pa.string()), pa.array([told(s) for s in every], pa.string())],
                                             names=[id_col, "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", model: CharCNN | None = None, put: str = "[secret]") -> DataFrame:
    """docs with every span of their texts replaced; overlapping spans are replaced once, null texts stay null."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            base, added = find(["" if t is None else t for t in texts], model)
            for i, (s, m) in enumerate(zip(base, added)):
                if s or m:
                    parts, last = [], 0
                    for a, _, e in sorted(s + m):
                        if a >= last:
                            parts += [texts[i][last:a], put]
                        last = max(last, e)
                    texts[i] = "".join(parts) + texts[i][last:]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, model=train(docs)).drop("n_model")
