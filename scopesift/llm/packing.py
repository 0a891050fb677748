"""Hierarchical multi-length packing of documents into training sequences.

Tiers are context sizes, each half the next (512, 1024, 2048, 4096). A
document's ids fill whole windows of the largest tier first; what is left goes
to the least tier that holds it. Every tier's sequences open with its own
leftovers, longest tier first; the gap of each is filled with the longest
leftovers of shorter tiers that fit, and closed by cutting a shorter one, so a
closed sequence is exactly as long as its tier. What cannot close a sequence
waits for the next documents of the task. At a task's end the rest is cut into
sequences of tier sizes and one last, shorter sequence: fewer than 512 ids a
task share a padded sequence, whatever the task's size.

Closed sequences are dealt to step groups of ``step_tokens`` tokens, longest
first; tiers being powers of two, every group but a task's last is exactly
full, so steps hold equal work.

Nothing is shuffled: each scan task packs its own documents, and a sequence's
id is the task's number and a counter. Null and empty texts hold the end id
alone; repeated rows are packed as they come; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._spark import ship, table
from ._text import Lexicon, slices

TIERS = (512, 1024, 2048, 4096)


class Packer:
    """Packs (document row, ids) of one task. A piece is (row, first id's place, ids as bytes, four an id)."""

    def __init__(self, tiers=TIERS, step_tokens: int = 65_536):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.top = self.tiers[-1]
        self.sizes: list[int] = []  # leftovers by ascending length
        self.left: list[tuple] = []
        self.sequence = self.step = self.in_step = 0

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        at = bisect.bisect_left(self.sizes, n)
        self.sizes.insert(at, n)
        self.left.insert(at, piece)

    def _take(self, most: int) -> tuple | None:
        """The longest leftover of at most that length."""
        at = bisect.bisect_right(self.sizes, most) - 1
        if at < 0:
            return None
        self.sizes.pop(at)
        return self.left.pop(at)

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        row, start, raw = piece
        return (row, start, raw[: 4 * n]), (row, start + n, raw[4 * n :])

    def _fill(self, size: int) -> list[tuple]:
        """A sequence of exactly ``size`` ids from the leftovers, which hold that many."""
        got, gap = [], size
        while gap:
            piece = self._take(gap)
            if piece is None:  # all are longer than the gap: cut the shortest
                piece, self.sizes[0:1] = self.left.pop(0), []
                piece, rest = self._cut(piece, gap)
                self._put(rest)
            got.append(piece)
            gap -= len(piece[2]) // 4
        return got

    def pack(self, docs, last: bool = False):
        """docs: (row, ids as bytes). Yields (sequence, tier, step, pieces) for the sequences that this closes."""
        closed = []
        for row, raw in docs:
            n = len(raw) // 4
            for at in range(0, n - self.top + 1, self.top):
                closed.append((self.top, [(row, at, raw[4 * at : 4 * (at + self.top)])]))
            if n % self.top:
                at = n - n % self.top
                self._put((row, at, raw[4 * at :]))
        total = sum(self.sizes)
        for tier in reversed(self.tiers):
            under = self.tiers[self.tiers.index(tier) - 1] if tier > self.tiers[0] else 0
            while total >= tier and self.sizes and (self.sizes[-1] > under or last):
                closed.append((tier, self._fill(tier)))
                total -= tier
        if last and total:
            closed.append((total, self._fill(total)))
        for size, pieces in sorted(closed, key=lambda x: -x[0]):
            if self.in_step + size > self.step_tokens:
                self.step, self.in_step = self.step + 1, 0
            self.in_step += size
            yield self.sequence, next((t for t in self.tiers if t >= size), self.top), self.step, pieces
            self.sequence += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long, ids binary"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, end_id: int = 2,
                   special: str = "<|endoftext|>", tiers=TIERS, step_tokens: int = 65_536, memo: int = 600_000, with_ids: bool = True) -> DataFrame:
    """One row per piece; ids holds the piece's ids as little-endian unsigned 32-bit integers (left out unless with_ids)."""
    ship(docs.sparkSession)
    path = model or public_tokenizers.path("word_bpe_49k.json")
    schema = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        words, packer = Lexicon.of(path, special, memo), Packer(tiers, step_tokens)
        base = TaskContext.get().partitionId() << 32

        def rows(sequences):
            out = []
            for seq, tier, step, pieces in sequences:
                offset = 0
                for (doc, n), start, raw in pieces:
                    k = len(raw) // 4
                    out.append((doc, start, k, zlib.crc32(raw), n, base + seq, offset, tier, base + step, raw))
                    offset += k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))], names=names)

        def documents(b):
            ids, ends = words.ids(b.column(1), end_id)
            raw, start = ids.astype("<u4").tobytes(), 0
            for doc, end in zip(b.column(0).to_pylist(), ends.tolist()):
                yield (doc, end - start), raw[4 * start : 4 * end]
                start = end

        for b in slices(batches):
            yield from rows(packer.pack(documents(b)))
        yield from rows(packer.pack((), last=True))

    return docs.selectExpr(f"cast(`{id_col}` AS long) AS i", f"`{text_col}` AS t").mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
