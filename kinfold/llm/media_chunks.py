"""Payload columns stored as content-defined chunks.

A payload (8-bit samples) is cut where a rolling gear hash of its last 32 bytes has its low
bits all zero, so equal passages are cut alike wherever they stand. Chunks are known by their
SHA-256 digest and stored once, as zstandard frames.

1. Cutting every payload gives its recipe: the ordered (digest, size) list. Payloads with
   the same recipe are one media object, held by the least document.
2. Joins on digests find the chunks that several objects share; the least (object, place)
   owns a chunk, the others refer to it.
3. The store has a row for each object: its recipe, and the frames of the chunks it owns.
   It is written from the documents as they are read; only the list of documents that store
   nothing or refer to others is joined to them (broadcast if it was written in at most 8 MB).
4. Objects are read back, the frames that they refer to are fetched from their owners, each
   chunk is checked against its digest, and samples and features come from these bytes.

The stored form of an object is, for each chunk in order, its digest, its size and its
frame's size as little-endian 32-bit integers, and its frame.

Defined results: null and empty payloads are padding alone. Equal payloads have equal
values; repeated rows repeat, and a holder's row that is there twice is stored twice. A null doc_id is kept and counts as the least; ids
must be whole numbers (or text that spells them). An empty table gives no rows. Other columns are ignored. A frame that doesn't give its digest fails the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from .common import arrow_map, small, staged, text_of

#: Least and greatest chunk, and the bits of the hash that must be zero (4,096 bytes on average beyond the least).
LEAST, GREATEST, BITS = 1024, 16384, 12
#: The payload is padded with bytes 255 to a multiple of this.
UNIT = 576
HEAD = struct.Struct("<32sII")


def gear_table() -> np.ndarray:
    """256 numbers of 32 bits, from SHA-256 of each byte value."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear" + bytes([i])).digest()[:4], "little") for i in range(256)], "u4")


GEAR = gear_table()


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    n = max(1, -(-len(raw) // unit)) * unit
    return raw + b"\xff" * (n - len(raw))


def cuts(data: bytes) -> np.ndarray:
    """Ends at which a chunk may stop: the rolling hash of the 32 bytes before has its low bits zero."""
    h = GEAR[np.frombuffer(data, "u1")]
    for k in (1, 2, 4, 8, 16):  # after the step for k, h holds the last 2k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    # The highest bits see all 32 bytes.
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunks(payloads: list[bytes]) -> list[list[bytes]]:
    """Each payload's chunks. A chunk's end depends on its own bytes alone: the least chunk outlasts the hash's window."""
    data = b"".join(payloads)
    ends = cuts(data)
    out, start = [], 0
    for p in payloads:
        mine = ends[np.searchsorted(ends, start) : np.searchsorted(ends, start + len(p), "right")] - start
        got, at = [], 0
        marks = mine.tolist()
        k = 0
        while at < len(p):
            while k < len(marks) and marks[k] < at + LEAST:
                k += 1
            end = min(marks[k] if k < len(marks) else len(p), at + GREATEST, len(p))
            got.append(p[at:end])
            at = end
        out.append(got)
        start += len(p)
    return out


def feature(samples: np.ndarray) -> str:
    """Mean, spread, sign changes about the middle, entropy and a 16-bin histogram of 8-bit samples."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    levels = np.arange(256)
    mean = float((counts * levels).sum() / n)
    spread = float(np.sqrt((counts * (levels - mean) ** 2).sum() / n))
    p = counts[counts > 0] / n
    high = samples >= 128
    turns = int(np.count_nonzero(high[1:] != high[:-1]))
    bins = ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))
    return f"mean={mean:.6f};spread={spread:.6f};turns={turns};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.6f};bins={bins}"


def _payload(text: str | None) -> bytes:
    return pad((text or "").encode())


def recipes(rows: DataFrame) -> DataFrame:
    """(doc_id, least, object, recipe) of (doc_id, text) rows; ``least`` is doc_id with null as the least of all."""
    piece = StructType([StructField("digest", BinaryType()), StructField("size", IntegerType())])
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("object", BinaryType()), StructField("recipe", ArrayType(piece))])

    def make():
        def work(cols):
            recipe = [
                [{"digest": hashlib.sha256(c).digest(), "size": len(c)} for c in parts]
                for parts in chunks([_payload(t) for t in cols["text"]])
            ]
            objects = [hashlib.sha256(b"".join(c["digest"] for c in r)).digest() for r in recipe]
            return {"doc_id": cols["doc_id"], "object": objects, "recipe": recipe}

        return work

    return arrow_map(rows, schema, make).withColumn("least", least(F.col("doc_id")))


def least(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(-(2**63)))


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, object), stored objects): chunks of all payloads, each distinct one written once."""
    rows = docs.select("doc_id", text_of().alias("text"))
    known = staged(recipes(rows), "recipes")
    holders = known.groupBy("object").agg(F.min("least").alias("holder"))
    held = staged(
        known.join(holders, "object").select("doc_id", "least", "object", "recipe", (F.col("least") == F.col("holder")).alias("holds")),
        "held",
    )
    place = (
        held.where("holds")
        .dropDuplicates(["object"])
        .select("least", "object", F.posexplode("recipe").alias("seq", "c"))
        .select("least", "object", "seq", F.col("c.digest").alias("digest"))
    )
    place = staged(place, "places")
    owner = place.groupBy("digest").agg(F.min(F.struct("least", "object", "seq")).alias("own"), F.count("*").alias("n")).where("n > 1")
    refers = staged(
        place.join(owner.select("digest", "own"), "digest").where(F.struct("least", "object", "seq") != F.col("own")).select("least", "object", "seq", "digest"),
        "references",
    )
    # Documents that don't simply store all of their chunks.
    odd = (
        refers.groupBy("least", "object").agg(F.collect_list("seq").alias("refers")).select("least", "object", F.lit(True).alias("holds"), "refers")
    ).unionByName(
        held.where("not holds").select("least", "object", F.lit(False).alias("holds"), F.array().cast("array<int>").alias("refers")).distinct()
    )
    odd = staged(odd.groupBy("least").agg(F.collect_list(F.struct("object", "holds", "refers")).alias("odd")), "odd-documents")
    with_odd = rows.withColumn("least", least(F.col("doc_id"))).join(small(odd), "least", "left").select("text", "odd")
    stored = staged(with_odd.mapInArrow(_write, STORE), "chunk-store")
    return held.select("doc_id", "object"), stored


STORE = "object binary, digests array<binary>, sizes array<int>, frames array<binary>, whole boolean"


def _write(batches):
    """Store rows of (text, odd): nothing for a payload that another document holds."""
    import pyarrow as pa

    squeeze = zstandard.ZstdCompressor(level=3).compress
    kinds = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.bool_()]
    names = ["object", "digests", "sizes", "frames", "whole"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            cols = batch.slice(at, 512).to_pydict()
            out = []
            for odd, parts in zip(cols["odd"], chunks([_payload(t) for t in cols["text"]])):
                digests = [hashlib.sha256(c).digest() for c in parts]
                key = hashlib.sha256(b"".join(digests)).digest()
                mine = next((x for x in odd or () if x["object"] == key), None)
                if mine and not mine["holds"]:
                    continue
                away = set(mine["refers"]) if mine else ()
                frames = [None if i in away else squeeze(c) for i, c in enumerate(parts)]
                out.append((key, digests, [len(c) for c in parts], frames, not away))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def load(stored: DataFrame) -> DataFrame:
    """Whole objects from the store: (object, digests, sizes, frames), with the frames of shared chunks fetched."""
    whole = stored.where("whole").select("object", "digests", "sizes", "frames")
    part = stored.where("not whole")
    lacks = (
        part.select("object", F.posexplode(F.arrays_zip("digests", "frames")).alias("seq", "c"))
        .where("c.frames is null")
        .select("object", "seq", F.col("c.digests").alias("digest"))
        .distinct()
    )
    wanted = small(staged(lacks.select("digest").distinct(), "wanted"))
    has = (
        stored.select(F.explode(F.arrays_zip("digests", "frames")).alias("c"))
        .where("c.frames is not null")
        .select(F.col("c.digests").alias("digest"), F.col("c.frames").alias("frame"))
        .join(wanted, "digest", "left_semi")
        .dropDuplicates(["digest"])
    )
    fetched = lacks.join(has, "digest").groupBy("object").agg(F.map_from_entries(F.collect_list(F.struct("seq", "frame"))).alias("more"))
    filled = part.join(fetched, "object").select(
        "object",
        "digests",
        "sizes",
        F.transform("frames", lambda f, i: F.coalesce(f, F.element_at("more", i))).alias("frames"),
    )
    return whole.unionByName(filled)


def _facts(digests: list[bytes], sizes: list[int], frames: list[bytes]) -> dict:
    """Facts of one object, from the bytes that its frames give."""
    expand = zstandard.ZstdDecompressor().decompress
    parts, media, length = [], hashlib.sha256(), 0
    for digest, size, frame in zip(digests, sizes, frames):
        part = expand(frame)
        if len(part) != size or hashlib.sha256(part).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} is damaged")
        parts.append(part)
        media.update(HEAD.pack(digest, size, len(frame)))
        media.update(frame)
        length += HEAD.size + len(frame)
    payload = b"".join(parts)
    return {
        "n_bytes": len(payload.rstrip(b"\xff")),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": length,
        "media_sha256": media.hexdigest(),
        "feature": feature(np.frombuffer(payload, "u1")),
        "n_chunks": len(parts),
    }


def verified(loaded: DataFrame) -> DataFrame:
    """(object, payload facts, media facts, feature) of loaded objects; fails on a chunk that isn't what its digest says."""
    names = {
        "object": BinaryType(),
        "n_bytes": LongType(),
        "payload_bytes": LongType(),
        "payload_sha256": StringType(),
        "tail_crc32": LongType(),
        "media_bytes": LongType(),
        "media_sha256": StringType(),
        "feature": StringType(),
        "n_chunks": IntegerType(),
    }

    def make():
        def work(cols):
            facts = [*map(_facts, cols["digests"], cols["sizes"], cols["frames"])]
            return {"object": cols["object"], **{k: [f[k] for f in facts] for k in names if k != "object"}}

        return work

    return arrow_map(loaded, StructType([StructField(k, v) for k, v in names.items()]), make)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks) of every document."""
    whose, stored = store(docs)
    facts = staged(verified(load(stored)).dropDuplicates(["object"]), "media-facts")
    return whose.join(facts, "object").drop("object")
