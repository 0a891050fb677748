"""Periodic runs of words, found by online dyadic square catching.

Words are appended, a slice of whole texts at a time. Each completed block of
2^k words opens a catcher: it watches the words that follow for the block's next
occurrence at a distance q of 2^k to 2^(k+1) - 1. Where a block and the one
after it are met again at the same distance, two suffix comparisons, one to the
left of the block and one to the right, advance word by word until they fail;
the words between are squares of period q that touch, and merge into one run. A
run of four periods holds two whole blocks at least at every offset, so none is
missed, and a streak of blocks is compared once, from its first.

Levels go up from one word, so a run with a smaller period is known before its
multiples are met; a catcher inside it does not watch multiples of that period.
All catchers of a level and all appended words are one array comparison, and
windows of 2^(k+1) words are hashed from two of 2^k, so n words take time
n log n and memory n. Words are compared by 64-bit hashes; every run is then
compared word by word, and a text in which that fails is done again by exact
numbers of its words.

Null and empty texts have no runs; repeated rows give repeated rows; other
columns are ignored; an empty table gives an empty result. A very long text is
a slice by itself. Of runs of the same length the first stands for the longest,
then the one of the smallest period.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ship, table
from ._text import Words, mix, slices

_TIMES = np.uint64(0x9E3779B97F4A7C15)
#: Fixed by the operator's definition: a run has so many periods and so many words at least.
PERIODS, LEAST = 4, 6


def _advance(words: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """For every pair of places how many words from there on (step 1, or -1: before them and backward) are equal. A place outside is equal to none."""
    equal, rows, width, n = np.zeros(len(x), np.int64), np.arange(len(x)), 16, len(words)
    while len(rows):
        go, still = np.arange(width) * step, []
        for some in np.array_split(rows, max(len(rows) * width >> 20, 1)):
            a, b = ((z[some] + equal[some] * step)[:, None] + go for z in (x, y))
            inside = (a >= 0) & (b < n)
            same = inside & (words[np.where(inside, a, 0)] == words[np.where(inside, b, 0)])
            whole = same.all(1)
            equal[some] += np.where(whole, width, same.argmin(1))
            still.append(some[whole])
        rows, width = np.concatenate(still), min(width * 2, 1 << 12)
    return equal


def _covers(known: np.ndarray, size: int, blocks: int) -> np.ndarray:
    """Period of the known run that holds a block and the two after it, for every block (0: none; there is one at most)."""
    out = np.zeros(blocks, np.int64)
    lo, hi = -(-known[0] // size), np.minimum((known[1] - 3 * size) // size + 1, blocks)
    n = np.maximum(hi - lo, 0)
    out[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(known[2], n)
    return out


def catch_runs(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """words: of several texts, each followed by a word that stands nowhere else; size: words of each. Runs as rows of text, start in it, length, period."""
    text = np.arange(len(size))
    start = np.cumsum(size + 1) - size - 1
    window, block, runs = words, 1, np.zeros((4, 0), np.int64)
    while len(size) and PERIODS * block <= size.max():
        long = size >= PERIODS * block
        if (size[long] + 1).sum() * 2 < len(words):  # go on with the texts that can have longer periods
            at = np.repeat(start[long] - (np.cumsum(size[long] + 1) - size[long] - 1), size[long] + 1)
            at += np.arange(len(at))
            words, window, text, size = words[at], window[at], text[long], size[long]
            start = np.cumsum(size + 1) - size - 1
        n = (len(words) - block) // block
        met = (window[block : block + n * block].reshape(n, block) == window[: n * block : block][:, None]).ravel()
        head = np.flatnonzero(met)
        head = head[head + block < len(met)]
        head = head[met[head + block]]
        head = head[(head < block) | ~met[head - block]]
        b, q = head // block, block + head % block
        if len(head) and runs.shape[1]:
            here = np.searchsorted(text, runs[0])
            in_text = (here < len(text)) & (text[np.minimum(here, len(text) - 1)] == runs[0])
            s = start[here[in_text]] + runs[1, in_text]
            cover = _covers(np.stack([s, s + runs[2, in_text], runs[3, in_text]]), block, n)[b]
            new = (cover == 0) | (q % np.maximum(cover, 1) > 0)
            b, q = b[new], q[new]
        if len(b):
            x = b * block
            left = _advance(words, x - 1, x + q - 1, -1)
            right = _advance(words, x, x + q, 1)
            length = left + right + q
            run = length >= PERIODS * q
            t = np.searchsorted(start, x[run], "right") - 1
            runs = np.append(runs, np.stack([text[t], (x - left)[run] - start[t], length[run], q[run]]), 1)
        after = window * _TIMES
        after[:-block] += window[block:]
        window, block = after ^ (after >> np.uint64(29)), block * 2
    return runs[:, runs[2] >= LEAST]


def _exact(words: list[bytes]) -> np.ndarray:
    """Runs of one text by numbers of its words."""
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    return catch_runs(np.append(numbers, np.uint64(len(ids))), np.asarray([len(words)]))


def _told(words: list[bytes], runs: np.ndarray) -> tuple:
    """Of one text: number of runs, the longest one's start, length and period, all runs and the kept words."""
    runs = sorted(zip(*(x.tolist() for x in runs[1:4])), key=lambda r: (r[0], r[2]))
    keep = bytearray(b"\x01") * len(words)
    for s, length, q in runs:
        keep[s + q : s + length] = bytes(length - q)
    most = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return len(runs), *most, runs, b" ".join(words if all(keep) else compress(words, keep))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, slice_bytes: int = 8 << 20) -> DataFrame:
    """One row per text: id, n_runs, start, length and period of the longest run, runs (array of start, length, period), collapsed (the text's words without all but the first period of every run, joined by one space)."""
    kind = docs.schema[id_col].dataType.simpleString()
    one = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def run(batches):
        for b in slices(batches, bytes_=slice_bytes):
            found = Words(b.column(1))
            size = np.diff(found.first)
            at = found.first[:-1] + np.arange(len(size)) + size  # of the word after each text
            words = np.empty(len(found.hashes) + len(size), np.uint64)
            real = np.ones(len(words), bool)
            real[at] = False
            words[real] = found.hashes
            words[at] = mix(np.arange(1, len(size) + 1, dtype=np.uint64) * _TIMES)
            runs = catch_runs(words, size)
            runs = runs[:, np.argsort(runs[0], kind="stable")]
            edge = np.searchsorted(runs[0], np.arange(len(size) + 1))
            out = []
            for i, t in enumerate(b.column(1).cast(pa.large_binary()).to_pylist()):
                split, mine = (t or b"").split(), runs[:, edge[i] : edge[i + 1]]
                if any(split[s : s + n - q] != split[s + q : s + n] for _, s, n, q in mine.T.tolist()):
                    mine = _exact(split)
                out.append(_told(split, mine))
            n, s, length, q, every, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, s, length, q)),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in every], pa.list_(one)), pa.array(kept, pa.binary())],
                names=[id_col, "n_runs", "start", "length", "period", "runs", "collapsed"])

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id, text: as op13 is defined, the words of each tenth document by crc32 of its id, from one of them on, start over again and again."""
    h = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    cut = h.withColumn("w", F.when(F.expr("h % 10 = 0"), F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    n = cut.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    a = n.withColumn("a", F.expr("if(n > 0, g % n, NULL)"))
    p = a.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(concat(slice(w, 1, int(a)), transform(sequence(int(a), n - 1), i -> w[int(a + (i - a) % p)])), ' ')")
    return p.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic_runs(repeating(table(spark, sf_dir, "documents")))
    told = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return got.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
                      F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
