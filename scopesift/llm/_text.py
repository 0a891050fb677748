"""Helpers that run inside tasks: word scanning and memoised use of a tokenizer library."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element-wise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch of texts, found by array operations.

    start, end: byte positions in ``data``; first: for text i its words are
    first[i]:first[i+1]; hashes: 64 bits a word, equal for equal words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        n = len(texts)
        bufs = texts.buffers()
        offs = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        lo, hi = (int(offs[0]), int(offs[-1])) if n else (0, 0)
        raw = np.frombuffer(bufs[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        self.data = np.zeros(len(raw) + 8, dtype=np.uint8)
        self.data[: len(raw)] = _LOWER[raw] if lower else raw
        offs = offs - lo
        if texts.null_count:  # a null's bytes, if any, are not text
            gone = np.asarray(texts.is_null())
            for i in np.flatnonzero(gone & (offs[1:] > offs[:-1])):
                self.data[offs[i] : offs[i + 1]] = 0x20
        solid = ~_SPACE[self.data[: len(raw)]]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        at = offs[:-1][offs[1:] > offs[:-1]]
        begins[at] |= solid[at]
        ends[at[at > 0] - 1] |= solid[at[at > 0] - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * _M3)
        eight = np.ndarray((max(len(self.data) - 7, 0),), dtype="<u8", buffer=self.data.data, strides=(1,))
        rows, at = np.arange(len(size)), 0
        while len(rows):
            left = size[rows] - at
            part = eight[self.start[rows] + at]
            short = left < 8
            part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            out[rows] = mix((out[rows] ^ part) * _M3 + np.uint64(1))
            at += 8
            rows = rows[left > 8]
        return out


def runs(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries (across text borders too; the caller drops those)."""
    n = max(len(hashes) - k + 1, 0)
    out = np.full(n, np.uint64(seed * 2 + 1), dtype=np.uint64)
    for j in range(k):
        out = out * _M3 + hashes[j : j + n] * np.uint64((0xD1342543DE82EF95 + 2 * j) & 0xFFFFFFFFFFFFFFFF)
    return mix(out)


def few(batches, rows: int = 1_000):
    """Batches in slices of at most so many rows, which bounds the arrays made of one."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_MEMO: dict = {}


def slices(batches, rows: int = 2_000, bytes_: int = 16 << 20, column: int = 1):
    """Batches in slices of at most so many rows and about so many bytes of a text column (a longer text is a slice by itself)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum(np.arange(b.num_rows) // rows, np.cumsum(size) // bytes_)
        at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(at[:-1], at[1:]):
            yield b.slice(lo, hi - lo)


class Lexicon:
    """Token ids of texts as the word-end BPE model gives them, by distinct words of a batch.

    Arrow divides a batch at spaces and numbers its distinct words; only those
    are looked up, and the ids of all texts are gathered by numpy. A new word of
    plain letters, digits and marks is divided as the model's own pattern
    divides it, so that its pieces, far fewer than words, are remembered too; the
    library's model encodes each new piece. All other words go to the library whole, divided by a special token.
    About ``limit`` words are kept; then all are forgotten.
    """

    #: ASCII, line ends and the letters of Latin-1: in normal form as they stand, lower case by one character each.
    PLAIN = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    #: Fixed value: the model's pattern, for lower-case text of PLAIN.
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, special: str, limit: int):
        from tokenizers import Tokenizer

        self.tok, self.special, self.limit = Tokenizer.from_file(path), special, limit
        self.cut = self.tok.token_to_id(special)
        # how the model writes the bytes of each letter, as its own pre-tokenizer tells
        self.bytes = {c: self.tok.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self._forget()

    @classmethod
    def of(cls, path: str, special: str = "<|endoftext|>", limit: int = 600_000) -> "Lexicon":
        """One for each Python worker and setting."""
        key = (path, special, limit)
        if key not in _MEMO:
            _MEMO[key] = cls(*key)
        return _MEMO[key]

    def _forget(self) -> None:
        self.words, self.pieces = {}, {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _add(self, words: list[str], raws: list[bytes]) -> None:
        ids, first = np.frombuffer(b"".join(raws), np.uint32), len(self.words)
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while first + len(words) > len(self.start):
            self.start, self.size = (np.append(x, np.zeros_like(x)) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + len(words)] = size
        self.start[first : first + len(words)] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.words.update(zip(words, range(first, first + len(words))))

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.limit and self.words:
            self._forget()
            new = words
        plain = [w for w in new if self.PLAIN.fullmatch(w) and "<|" not in w]
        if len(plain) < len(new):
            have = set(plain)
            odd = [w for w in new if w not in have]
            alone = [w for w in odd if self.special in w]
            self._add(alone, [self._encode(w).tobytes() for w in alone])
            odd = [w for w in odd if self.special not in w]
            for i in range(0, len(odd), 4_096):
                some = odd[i : i + 4_096]
                ids = self._encode(self.special.join(some))
                at = np.flatnonzero(ids == self.cut)
                if len(at) != len(some) - 1:
                    raise ValueError("a special token was not split off")
                self._add(some, [x[x != self.cut].tobytes() for x in np.split(ids, at)])
        for i in range(0, len(plain), 50_000):
            some = plain[i : i + 50_000]
            cut = [self.PIECE.findall(w.lower()) for w in some]
            self._learn_pieces({p for c in cut for p in c if p not in self.pieces})
            get = self.pieces.__getitem__
            self._add(some, [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut])

    def _learn_pieces(self, new: set[str]) -> None:
        model, pieces = self.tok.model.tokenize, self.pieces
        for p in new:
            pieces[p] = array("I", [t.id for t in model(p if p.isascii() else p.translate(self.bytes))]).tobytes()

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row (unsigned 32 bits), end_id after each text, and where each text's ids end. Null: as empty."""
        lists = pa.compute.split_pattern(texts.fill_null(""), " ")
        offs = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        entry = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.size[entry]
        end = np.cumsum(size)
        out = self.flat[np.repeat(self.start[entry] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        stop = np.append(0, end)[offs[1:] - offs[0]]
        return np.insert(out, stop, end_id), stop + np.arange(1, len(stop) + 1)


class Memo(dict):
    """Token ids of space-separated parts of texts, as a tokenizers model gives them.

    A part is keyed by its text; ``lead`` is put before it when it is encoded.
    Parts are encoded many at a time, divided by the model's own special
    token, which the library splits off before anything else, so each part is
    encoded just as if it stood alone. About ``limit`` parts are remembered, in two generations: when
    the younger is full it becomes the elder, and what is met again comes back
    without being encoded anew.
    """

    def __init__(self, path: str, special: str, lead: str, count: bool, limit: int):
        super().__init__()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special, self.lead, self.count, self.limit, self.elder = special, lead, count, limit, {}
        self.cut = self.tok.token_to_id(special)

    @classmethod
    def of(cls, path: str, special: str, lead: str = "", count: bool = False, limit: int = 1_000_000) -> "Memo":
        """One for each Python worker and setting."""
        key = (path, special, lead, count, limit)
        if key not in _MEMO:
            _MEMO[key] = cls(path, special, lead, count, limit)
        return _MEMO[key]

    def _value(self, ids: np.ndarray):
        return len(ids) if self.count else ids.astype("<u2").tobytes()

    def learn(self, parts) -> None:
        """parts: a set of texts."""
        new = [x for x in parts if x not in self]
        if len(self) + len(new) > self.limit // 2:
            self.elder = dict(self)
            self.clear()
            new = list(parts)
        if self.elder:
            self.update((x, self.elder[x]) for x in new if x in self.elder)
            new = [x for x in new if x not in self]
        odd = [x for x in new if self.special in x]
        if odd:
            gone = set(odd)
            new = [x for x in new if x not in gone]
        for x in odd:
            self[x] = self._value(np.asarray(self.tok.encode(self.lead + x, add_special_tokens=False).ids, dtype=np.int64))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = np.asarray(self.tok.encode_batch_fast([self.special.join([self.lead + x for x in some])], add_special_tokens=False)[0].ids, dtype=np.int64)
            at = np.flatnonzero(ids == self.cut)
            assert len(at) == len(some) - 1, "a special token was not split off"
            lo, hi = np.append(-1, at) + 1, np.append(at, len(ids))
            if self.count:
                self.update(zip(some, (hi - lo).tolist()))
            else:
                raw = ids.astype("<u2").tobytes()
                self.update((x, raw[2 * a : 2 * b]) for x, a, b in zip(some, lo.tolist(), hi.tolist()))
