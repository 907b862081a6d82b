"""Token ids in files of byte planes.

Documents are range-partitioned by id and sorted, so the files, read in the order of
(part, seq), hold all documents in ascending id order. A file takes whole documents
until it has ``FILE_IDS`` ids. Its ids are cut into blocks of ``BLOCK`` ids; each block
is transposed into byte planes (all low bytes, then all second bytes, ...), each plane
is compressed with zstandard, and a chunk index at the end of the file holds every
plane's place, so that one block can be read without the others. Ids above 65,535 get
as many planes as they need.

    magic "KFP1" | planes ... | document table | chunk index | trailer

The files are cells of a table that Spark's own writer commits, so a lost executor or a
second attempt leaves no half-written file and any store that Spark writes will do;
``unpack`` reads the bytes of one file wherever they lie.

Defined results: a null or empty text has only the end id. Repeated documents are all
stored; those of one id in the order of a hash of their text, then of the text. Ids must be whole
numbers (or text that spells them). Documents with a null id come first. An empty table gives no files and no rows.
Other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import LibraryBpe
from .common import staged, task, text_of

MAGIC = b"KFP1"
BLOCK = 1 << 16
FILE_IDS = 1 << 20
TRAILER = struct.Struct("<QIQIII")


def pack(keys: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of one file from document keys and their packed 32-bit ids."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    every = np.frombuffer(b"".join(ids), "<u4")
    width = max(1, (int(every.max()).bit_length() + 7) // 8) if len(every) else 1
    out, index, at = [MAGIC], [], len(MAGIC)
    for start in range(0, len(every), BLOCK):
        block = every[start : start + BLOCK]
        planes = block.view("u1").reshape(-1, 4).T[:width]
        for plane in planes:
            out.append(squeeze(np.ascontiguousarray(plane).tobytes()))
            index += [at, len(out[-1])]
            at += len(out[-1])
    docs = b"".join(
        (
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], "u1").tobytes(),
            np.array([len(x) // 4 for x in ids], "<i8").tobytes(),
        )
    )
    docs, places = squeeze(docs), squeeze(np.array(index, "<u8").tobytes())
    return b"".join([*out, docs, places, TRAILER.pack(len(every), len(keys), at, len(docs), len(places), width)])


def block_ids(file: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` of a file, by way of its chunk index."""
    expand = zstandard.ZstdDecompressor().decompress
    n, _, docs_at, docs_len, index_len, width = TRAILER.unpack(file[-TRAILER.size :])
    index = np.frombuffer(expand(file[docs_at + docs_len : docs_at + docs_len + index_len]), "<u8").reshape(-1, width, 2)
    size = min(BLOCK, n - k * BLOCK)
    planes = np.zeros((4, size), "u1")
    for j, (at, length) in enumerate(index[k].tolist()):
        planes[j] = np.frombuffer(expand(file[at : at + length]), "u1")
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def unpack(file: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of every document of a file, checked against its own counts."""
    if file[:4] != MAGIC:
        raise ValueError("not a token plane file")
    expand = zstandard.ZstdDecompressor().decompress
    n, n_docs, docs_at, docs_len, _, _ = TRAILER.unpack(file[-TRAILER.size :])
    docs = expand(file[docs_at : docs_at + docs_len])
    keys = np.frombuffer(docs[: 8 * n_docs], "<i8").tolist()
    absent = docs[8 * n_docs : 9 * n_docs]
    sizes = np.frombuffer(docs[9 * n_docs :], "<i8")
    if int(sizes.sum()) != n:
        raise ValueError("document table and ids disagree")
    every = np.concatenate([block_ids(file, k) for k in range(-(-n // BLOCK))]) if n else np.zeros(0, "<u4")
    ends = np.cumsum(sizes)
    for key, none, size, end in zip(keys, absent, sizes.tolist(), ends.tolist()):
        yield (None if none else key), every[end - size : end]


def write_files(df: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, append ``end_id`` to each document and store; (part, seq, n_ids, file), read back from the store."""

    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task():
            yield from encoded(batches)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = LibraryBpe.load(path), TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        keys, ids, held, seq = [], [], 0, 0

        def file():
            cells = [[part], [seq], [held], [pack(keys, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["part", "seq", "n_ids", "file"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024).to_pydict()
                for k, t in zip(rows[key], rows[text]):
                    x = bpe.encode(t)
                    keys.append(k)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= FILE_IDS:
                        yield file()
                        keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield file()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias(key), text_of(text).alias(text))
    files = rows.repartitionByRange(n, key).sortWithinPartitions(key, F.xxhash64(text), text).mapInArrow(run, "part int, seq int, n_ids long, file binary")
    return staged(files, "token-files")


def read_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every stored document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, file = (batch.column(i)[row].as_py() for i in range(3))
                keys, starts, sizes, crcs, at = [], [], [], [], 0
                for k, ids in unpack(file):
                    keys.append(k)
                    starts.append(at)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                cells = [[part] * len(keys), [seq] * len(keys), keys, starts, sizes, crcs]
                types = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cells, types)], ["part", "seq", key, "local", "n_tokens", "ids_crc32"]
                )

    rows = files.select("part", "seq", "file").mapInArrow(
        run, f"part int, seq int, {key} long, local long, n_tokens long, ids_crc32 long"
    )
    # Offsets from two small sums: of the parts before, one row a task, and of a part's files before.
    of_parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = of_parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("within")).join(parts, "part")
    return rows.join(offsets, ["part", "seq"]).select(
        key, (F.col("first") + F.col("within") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
