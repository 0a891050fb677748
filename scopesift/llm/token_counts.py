"""Token counts of whole texts as a byte-level BPE model of the tokenizers library gives them.

Ordinary texts are summed from remembered parts. Huge texts go through
overlap resynchronisation: chunks that overlap are encoded with offsets and
spliced where both encodings have a token border that is proven stable; where
an overlap has none, it is widened.

A border before a space is stable when a character that is no white space
stands before that space and another after it: the model's pattern then ends a
piece before the space whatever stands further left or right.

Edge cases: null and empty texts have 0 tokens and 0 bytes; repeated rows give
repeated rows; columns other than the two named are ignored; an empty table
gives an empty result. A special token's string inside a text counts as the
library counts it by default.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._spark import ship, table
from ._text import Memo

SPECIAL = "<|endoftext|>"
_CUTS = re.compile(r"(?<=\S)(?= \S)")


def stable_borders(text: str, lo: int, hi: int) -> list[int]:
    """Positions in lo..hi before a space that has other characters on both sides."""
    return [lo + m.start() for m in _CUTS.finditer(text[lo:hi]) if 0 < m.start()]


def count_huge(tok, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a long text from overlapping chunks."""
    total, begin = 0, 0
    while True:
        end = min(len(text), begin + chunk)
        left = np.asarray([a for a, _ in tok.encode(text[begin:end], add_special_tokens=False).offsets], dtype=np.int64) + begin
        if end == len(text):
            return total + len(left)
        lap, at = overlap, None
        while at is None:
            low = max(begin + 1, end - lap)
            # the last borders are near the chunk's end, where its own encoding may still change
            found = stable_borders(text, low - 1, end)
            right = np.asarray([a for a, _ in tok.encode(text[low:min(len(text), end + lap)], add_special_tokens=False).offsets], dtype=np.int64) + low
            both = np.intersect1d(np.intersect1d(np.asarray(found, dtype=np.int64), left), right)
            if len(both):
                at = int(both[-1])
            elif low > begin + 1:
                lap *= 2
            else:  # no stable border in the whole chunk: take a longer one
                chunk *= 2
                break
        if at is not None:
            total += int(np.searchsorted(left, at))
            begin = at


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None,
                 limit: int = 512, huge_chars: int = 65_536, overlap: int = 1_024, memo: int = 1_000_000) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. huge_chars: longer texts are cut into chunks of that many characters."""
    path = model or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        parts = Memo.of(path, SPECIAL, " ", True, memo)
        heads = Memo.of(path, SPECIAL, "", True, memo // 4)
        for b in batches:
            texts = ["" if x is None else x for x in b.column(1).to_pylist()]
            cut, new, first = [], set(), set()
            for x in texts:
                if not x or len(x) > huge_chars:
                    cut.append(None)
                    continue
                p = x.split(" ")
                # white space beside a space: cut at stable borders only
                if "" in p or any(q[0].isspace() or q[-1].isspace() for q in p):
                    p = _CUTS.split(x)
                    p[1:] = [q[1:] for q in p[1:]]
                cut.append(p)
                first.add(p[0])
                new.update(p)
            parts.learn(new)
            heads.learn(first)
            get = parts.__getitem__
            n = [0 if not x else count_huge(parts.tok, x, huge_chars, overlap) if p is None else heads[p[0]] + sum(map(get, p[1:])) for x, p in zip(texts, cut)]
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), n, pa.compute.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
