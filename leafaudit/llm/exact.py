"""Exact deduplication in two passes over a Bloom filter.

Pass one sets, for each text's hash, a few bits in a filter and, where a bit was set
before, the same bit in a second filter. A hash with a bit that was set only once can't
be repeated. Pass two tests each row against the second filter: rows that surely are
alone go straight to the result, and only hashes of the others are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafaudit.llm.common import fresh, same_key, stored, text_or_empty

PROBES = 4
CHUNK = 1 << 15
#: The filter takes 32 bits a row up to this many bits (32 MB). It can't be too small for
#: right results: a fuller filter only sends more rows through the shuffle.
MOST_BITS = 1 << 28


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, as rows of PROBES columns."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def filter_bits(rows: int) -> int:
    return min(MOST_BITS, max(8 * CHUNK, 1 << (32 * max(rows, 1) - 1).bit_length()))


def repeated_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of bits set more than once, from a DataFrame with one long column."""
    sized = 8 * CHUNK

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            at = np.sort(places(batch.column(0).to_numpy(zero_copy_only=False), bits), axis=1)
            own = np.c_[np.ones(len(at), bool), at[:, 1:] != at[:, :-1]]  # a row counts once for a bit
            where, n = np.unique(at[own], return_counts=True)
            twice[where[(n > 1) | once[where]]] = True
            once[where] = True
        for c in range(0, bits, sized):
            part = once[c : c + sized]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c // sized]), pa.array([np.packbits(part).tobytes()], pa.binary()), pa.array([np.packbits(twice[c : c + sized]).tobytes()], pa.binary())],
                    ["chunk", "once", "twice"],
                )

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = np.zeros(CHUNK, np.uint8)
        for batch in batches:
            for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                once, twice = once | a, twice | b | (once & a)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([twice.tobytes()], pa.binary())], ["chunk", "twice"])

    parts = hashes.mapInArrow(marks, "chunk long, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("chunk").applyInArrow(merge, "chunk long, twice binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.twice, np.uint8)
    return out


def with_maybe(df: DataFrame, hash_column: str, bits: int) -> DataFrame:
    """Adds maybe: whether the row's hash may occur more than once."""
    shared = df.sparkSession.sparkContext.broadcast(repeated_filter(df.select(hash_column), bits))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(batch.schema.get_field_index(hash_column)).to_numpy(zero_copy_only=False), bits)
            hit = ((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "maybe"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(test, f"{kinds}, maybe boolean")


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", normalize=None) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their normalised form is (no change by default; null counts as
    empty); of equal texts the row with the largest id stays. Ids may be null (they stay
    last) and rows may repeat: of rows that share text and id, one stays. Other columns
    are ignored, and an empty table gives no rows."""
    body = text_or_empty(text)
    body = normalize(body) if normalize else body
    (probe,) = fresh("probe")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("text_sha256"))
    rows = stored(rows, "exact-hashes").withColumn(probe, F.xxhash64("text_sha256"))
    bits = filter_bits(rows.count())
    marked = with_maybe(rows, probe, bits).drop(probe)
    alone = marked.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    same = marked.filter("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    groups = same.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    members = same.join(groups, "text_sha256").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that exact_duplicates keeps, with all their columns. Rows that share
    text and id are one document listed twice; the one with the least other columns stays."""
    decided = exact_duplicates(docs, doc_id=doc_id, text=text).filter("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    keyed = docs.withColumn("_keep", F.col(doc_id)).withColumn("_sha", F.sha2(text_or_empty(text), 256)).dropDuplicates(["_keep", "_sha"])
    return keyed.join(decided, same_key(keyed, decided, ["_keep", "_sha"]), "left_semi").drop("_keep", "_sha")
