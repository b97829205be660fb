"""Packing documents into sequences along a space-filling curve.

Each document's hashed bag of tokens is projected to a few dimensions; its place on a Hilbert
curve through them becomes the sort key. Documents sorted by that key are one long run of tokens, which is cut
every 4096: neighbours on the curve share sequences, and only the last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored, table, text_of
from .word_bpe import word_ids

SEQUENCE, END_ID = 4096, 2
#: Hashed vector size, dimensions of the curve, bits per dimension.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve for each row of whole coordinates below 2**bits.

    Goes from the coarsest bit down: the orthant of each level is a digit of the key, by its Gray
    code, and what is finer is reflected and swapped into that orthant's frame (Skilling, 2004).
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in x:
            mirrored = (axis & bit) != 0
            swap = np.where(mirrored, 0, (x[0] ^ axis) & below)
            x[0] = np.where(mirrored, x[0] ^ below, x[0] ^ swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> level & 1
    return key


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.RandomState(20240517).standard_normal((BUCKETS, DIMENSIONS)) / np.sqrt(DIMENSIONS)


@lru_cache(1)
def _hashed(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each token id."""
    spread = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (spread % np.uint64(BUCKETS)).astype(np.int64), np.where(spread & np.uint64(1 << 20), 1.0, -1.0)


def curve_keys(ids: list[np.ndarray], vocabulary_size: int = 1 << 16) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    if not ids:
        return np.zeros(0, np.int64)
    bucket, sign = _hashed(vocabulary_size)
    vectors = np.stack([np.bincount(bucket[d], sign[d], BUCKETS) for d in ids])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    spread = np.tanh(vectors @ _projection()) * 0.5 + 0.5
    return hilbert_keys(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _encoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary)
        kind, size = encode.kind, len(encode.ends)
        end = np.array([END_ID], kind).tobytes()
        for part in slices(source):
            ids = [d + end for d in encode.of(part.column(1).to_pylist())]
            arrays = [np.frombuffer(d, kind) for d in ids]
            columns = [
                part.column(0),
                pa.array(curve_keys(arrays, size), pa.int64()),
                pa.array([len(a) for a in arrays], pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "n", "ids"])

    return rows.mapInArrow(batches, "id long, key long, n long, ids binary")


def _in_order(encoded: DataFrame) -> DataFrame:
    """Along the curve: ``range``, and ``local``, the tokens before a document in its range."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in source:
            n = batch.column("n").to_numpy()
            local = before + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
            before += int(n.sum())
            arrays = [batch.column(c) for c in ("id", "range", "n", "ids")] + [pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "range", "n", "ids", "local"])

    ranged = encoded.repartitionByRange("key", "id", "n").sortWithinPartitions("key", "id", "n")
    ranged = ranged.withColumn("range", F.spark_partition_id())
    return ranged.mapInArrow(batches, "id long, range int, n long, ids binary, local long")


def _cut(placed: DataFrame, size: int, kind: np.dtype) -> DataFrame:
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [field.split()[0] for field in schema.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            pieces = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "n", "ids", "place")))
            for doc, n, ids, place in rows:
                words = np.frombuffer(ids, kind).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, size)
                    length = min(size - offset, n - start)
                    crc = zlib.crc32(words[start : start + length].tobytes())
                    pieces.append((doc, start, length, crc, n, sequence, offset))
                    start += length
            columns = list(zip(*pieces)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return placed.mapInArrow(batches, schema)


def pack(
    docs: DataFrame, vocabulary: str, *, size: int = SEQUENCE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are those of its text and the end id; every id lies in exactly one piece, and
    sequences have no gaps. A null text is empty and packs its end id alone. Repeated rows are packed one by
    one, next to each other; a document longer than a sequence goes on in the next. No rows give
    no rows; other columns are not read. The result does not depend on partitioning.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    encoded = stored(_encoded(rows, vocabulary), "packing-ids")
    ordered = stored(_in_order(encoded), "packing-order")
    # One row per range, at most spark.sql.shuffle.partitions of them.
    ranges = ordered.groupBy("range").agg(F.sum("n").alias("tokens"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    placed = ordered.join(F.broadcast(ranges), "range").select("id", "n", "ids", (F.col("base") + F.col("local")).alias("place"))
    return _cut(placed, size, word_ids(vocabulary).kind)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_packing": op5}
