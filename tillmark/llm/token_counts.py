"""Token counts of every prefix of every text, stored, and what can be read off them.

The store has one signed byte for each code point of the text as the tokenizer normalises it:
by how much the token count of the prefix that ends there differs from the one before. Counts of
whole texts, counts at any cut and longest prefixes within a budget are sums over it; nothing is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, text_of
from .word_bpe import counter

LIMIT = 2048


def counts(deltas: bytes) -> np.ndarray:
    """Token count of each prefix, from the empty one on."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)])


def longest_within(deltas: bytes, budget: int) -> int:
    """Length of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(counts(deltas) <= budget)[-1])


def prefix_counts(
    docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text", store: bool = True
) -> DataFrame:
    """``id, n_bytes, n_tokens`` and, with ``store``, ``prefix_deltas``, one row per row.

    ``n_tokens`` is what the tokenizer's library gives for the whole text, special strings
    included, nothing cut or added. Null texts count as empty: no bytes, no tokens, an empty store. Repeated rows are
    counted one by one; no rows give no rows; other columns are not read. Batches are bounded by Spark, and
    work and memory for a text are linear in its length, however long a word in it is.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in slices(source):
            texts = batch.column(1).to_pylist()
            deltas = [known.deltas(text) for text in texts]
            columns = [
                batch.column(0),
                pa.array([len(text.encode()) for text in texts], pa.int64()),
                pa.array([int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas], pa.int64()),
            ]
            stores = [pa.array(deltas, pa.binary())] if store else []
            yield pa.RecordBatch.from_arrays([*columns, *stores], names=names)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    schema = "id long, n_bytes long, n_tokens long" + ", prefix_deltas binary" * store
    names = ["id", "n_bytes", "n_tokens"] + ["prefix_deltas"] * store
    return rows.mapInArrow(batches, schema)


def answers(store: DataFrame, budget: int) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, prefix_length`` for a budget, from the counts in a store of ``prefix_counts``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            at = [counts(d) for d in batch.column(2).to_pylist()]
            totals = [int(c[-1]) for c in at]
            # The longest prefix within the budget, which an earlier, shorter one may exceed.
            lengths = [int(np.flatnonzero(c <= budget)[-1]) for c in at]
            arrays = [
                batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array([n > budget for n in totals], pa.bool_()),
                pa.array(lengths, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_tokens", "over_limit", "prefix_length"])

    schema = "id long, n_bytes long, n_tokens long, over_limit boolean, prefix_length long"
    return store.select("id", "n_bytes", "prefix_deltas").mapInArrow(batches, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    found = answers(stored(found, "prefix-counts"), LIMIT)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit", "prefix_length")


QUERIES = {"op3_token_counts": op3}
