"""Token-ID output as length-delimited binary records, with a separate offset index.

A data file is a row of frames; a frame is

    length of payload, unsigned 64 bits little-endian
    masked checksum of those 8 bytes, unsigned 32 bits
    payload
    masked checksum of the payload, unsigned 32 bits

and a payload is the document id (signed 64 bits; a null id is the least
value) and the token ids, 16 bits each where the model's vocabulary and the end
id allow it, else 32; the manifest tells which. A checksum is crc32, turned right by 15 bits, plus a constant, so that a
checksum stored inside checked data does no harm. The index beside a data file
holds per record the frame's offset, the document id and the number of ids of
this file before it (three 64-bit integers), so records can be read in any
order.

Files hold documents in ascending id order (equal ids: by a hash of the text,
so that even they are dealt over many files) and follow one another in that order. Each attempt of a task writes files under a name of its
own; only the files of attempts whose rows came back are listed in the
manifest (a few numbers a file), so lost executors and repeated tasks do no
harm. Null and empty texts hold the end id alone; an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import shared_dir, ship, table
from ._text import Lexicon, slices

# Fixed values of the format.
MASK_DELTA = 0xA282EAD8
NULL_ID = -(2**63)

MANIFEST = "first_id long, first_hash long, last_id long, last_hash long, name string, n_docs long, n_tokens long, n_bytes long, width long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return size + masked(size).to_bytes(4, "little") + payload + masked(payload).to_bytes(4, "little")


def unframe(data, at: int) -> tuple[bytes, int]:
    """The payload that begins at ``at`` and the place after it; ValueError if a checksum differs."""
    size = bytes(data[at : at + 8])
    n = int.from_bytes(size, "little")
    if masked(size) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"damaged length at byte {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) != n or masked(payload) != int.from_bytes(data[at + 12 + n : at + 16 + n], "little"):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


def store(uri: str):
    """File system and path of a folder; any scheme that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None,
                  end_id: int = 1, special: str = "<|endoftext|>", memo: int = 600_000) -> list[dict]:
    """Encode, append end_id and write; returns the manifest, one dict a file in id order.

    The manifest has a row for each file, not for each document.
    """
    ship(docs.sparkSession)
    path = model or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        words = Lexicon.of(path, special, memo)
        width = 2 if max(words.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, root = store(to)
        name, out, index, offset, tokens = f"part-{uuid.uuid4().hex}", None, [], 0, 0
        for b in slices(batches):
            ids, ends = words.ids(b.column(1), end_id)
            raw, start = ids.astype(f"<u{width}").tobytes(), 0
            hashes = b.column(2).to_pylist()
            if out is None:
                out, first = fs.open_output_stream(f"{root}/{name}.rec"), hashes[0]
            for doc, end in zip(b.column(0).to_pylist(), ends.tolist()):
                doc = NULL_ID if doc is None else doc
                f = frame(doc.to_bytes(8, "little", signed=True) + raw[width * start : width * end])
                index.append((offset, doc, tokens))
                out.write(f)
                offset += len(f)
                tokens += end - start
                start = end
            last = hashes[-1]
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx") as x:
            x.write(np.asarray(index, dtype="<i8").tobytes())
        row = (index[0][1], first, index[-1][1], last, name, len(index), tokens, offset, width)
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if k == "name" else pa.int64()) for k, x in zip(names, row)], names=names)

    fs, root = store(to)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).repartitionByRange("i", "h").sortWithinPartitions("i", "h")
    found = sorted((r.asDict() for r in rows.mapInArrow(run, MANIFEST).collect()), key=lambda r: (r["first_id"], r["first_hash"], r["last_id"], r["last_hash"]))
    start = 0
    for r in found:
        r["start"] = start
        start += r["n_tokens"]
    return found


RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_records(spark: SparkSession, at: str, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """Every record of the files, checked: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit integers; left out unless with_ids)."""
    ship(spark)
    schema = RECORDS if with_ids else RECORDS.removesuffix(", ids binary")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        fs, root = store(at)
        for b in batches:
            for name, base, width in zip(*(c.to_pylist() for c in b.columns)):
                index = np.frombuffer(fs.open_input_stream(f"{root}/{name}.idx").read(), dtype="<i8").reshape(-1, 3)
                with fs.open_input_file(f"{root}/{name}.rec") as f:
                    ends = np.append(index[1:, 0], f.size())
                    for lo in range(0, len(index), 2_000):  # a block of records at a time
                        hi = min(lo + 2_000, len(index))
                        first = int(index[lo, 0])
                        f.seek(first)
                        data = memoryview(f.read(int(ends[hi - 1]) - first))
                        rows = []
                        for k in range(lo, hi):
                            payload, _ = unframe(data, int(index[k, 0]) - first)
                            doc = int.from_bytes(payload[:8], "little", signed=True)
                            if doc != index[k, 1]:
                                raise ValueError(f"index and record {k} of {name} differ")
                            ids = np.frombuffer(payload, dtype=f"<u{width}", offset=8).astype("<u4")
                            rows.append((None if doc == NULL_ID else doc, base + int(index[k, 2]), len(ids), zlib.crc32(ids), *([ids.tobytes()] if with_ids else [])))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)

    files = spark.createDataFrame([(r["name"], r["start"], r["width"]) for r in manifest], "name string, start long, width long")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, schema)


def read_shuffled(at: str, manifest: list[dict], seed: int, epoch: int = 0):
    """Records in an order drawn from (seed, epoch), by the index alone: for a training loader. Yields (doc_id, ids)."""
    fs, root = store(at)
    rng = np.random.default_rng([seed, epoch])
    for k in rng.permutation(len(manifest)):
        name, width = manifest[k]["name"], manifest[k]["width"]
        index = np.frombuffer(fs.open_input_stream(f"{root}/{name}.idx").read(), dtype="<i8").reshape(-1, 3)
        with fs.open_input_file(f"{root}/{name}.rec") as f:
            ends = np.append(index[1:, 0], f.size())
            for j in rng.permutation(len(index)):
                f.seek(int(index[j, 0]))
                payload, _ = unframe(f.read(int(ends[j] - index[j, 0])), 0)
                doc = int.from_bytes(payload[:8], "little", signed=True)
                yield None if doc == NULL_ID else doc, np.frombuffer(payload, dtype=f"<u{width}", offset=8)


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_dir(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), to)
    return read_records(spark, to, manifest, with_ids=False)
