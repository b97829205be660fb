"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated once it is used up. A document's virtual
finish time is the number of words its source has served with it, divided by the source's
target. Sorted by that time, all sources advance in proportion to their targets, and the sorted
stream is cut where it reaches the total budget.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import running_sum
from .common import packed, salted_join, stored, table, text_of, unpacked

WEIGHTS = (3, 1, 2)
#: Total budget as a share of all words, and how often a document may be used.
BUDGET, REPEATS = 1.5, 2
#: A bucket of the shuffled order holds about so many rows.
BUCKET_ROWS = 50_000


def words_in(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS
) -> DataFrame:
    """``source, source_size, n, target`` from ``source, size`` (null: a source of its own).

    Sources take the weights in turn, by code points, null last. They share ``budget`` times all
    sizes by weight, but none gets more than ``repeats`` times its size; what is over is shared
    by weight among the others, until none is above. In the order of limit per weight, the sources at their
    limit come first, so running sums tell in one step where that ends.
    """
    named = sizes.select(F.col("source").isNull().cast("int").alias("missing"), F.coalesce("source", F.lit("")).alias("name"), "size")
    totals = named.groupBy("missing", "name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    numbered = running_sum(totals.withColumn("one", F.lit(1)), [F.col("missing"), F.col("name")], {"place": "one"})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered.select(
        "missing", "name", "source_size", "n",
        F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(repeats)).alias("limit"),
    ).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = [F.col("ratio"), F.col("missing"), F.col("name")]
    summed = stored(running_sum(weighed, order, {"limits_upto": "limit", "weights_upto": "weight"}), "mix-sources")
    whole = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"), F.sum("limit").alias("limits")).first()
    if whole["words"] is None:
        return summed.select(F.lit(None).cast("string").alias("source"), "source_size", "n", F.lit(0.0).alias("target"))
    total = min(float(whole["words"]) * budget, whole["limits"])
    # What remains for a source and those after it, if all before it are at their limit.
    left = F.lit(total) - (F.col("limits_upto") - F.col("limit"))
    weights_left = F.lit(float(whole["weights"])) - (F.col("weights_upto") - F.col("weight"))
    capped = F.col("ratio") * weights_left <= left
    split = summed.agg(
        F.coalesce(F.sum(F.when(capped, F.col("limit"))), F.lit(0.0)).alias("limits"),
        F.coalesce(F.sum(F.when(capped, F.col("weight"))), F.lit(0.0)).alias("weights"),
    ).first()
    rest, rest_weights = total - split["limits"], whole["weights"] - split["weights"]
    share = F.lit(rest) * F.col("weight") / F.lit(rest_weights) if rest_weights > 0 else F.col("limit")
    return summed.select(
        F.when(F.col("missing") == 0, F.col("name")).alias("source"), "source_size", "n",
        F.when(capped, F.col("limit")).otherwise(F.least(share, F.col("limit"))).alias("target"),
    )


def schedule(
    rows: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
    seed: int = 17,
    whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``rows`` (``id, tie, copy, source, size``), and ``rows`` with ``source_size, target``.

    The mix has one row per use of a document, ``id, tie, copy, use, words, finish, served``: the
    words it takes, its virtual finish time (1: the source's target is met), and the words of the
    whole mix up to it. The document at which a source meets its target is taken in part; with
    ``whole``, all of it or nothing, by whether half of it fits. ``id, tie, copy`` name a row.
    """
    name = ["id", "tie", "copy"]
    rows = stored(rows.select(*name, "source", "size"), "mix-rows")
    targets = stored(source_targets(rows, weights, budget, repeats), "mix-targets")
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("key")
    keyed = salted_join(rows.withColumn("key", key), targets.select(key, "source_size", "n", "target"), ["key"], "n", name)
    # The shuffled order is that of a hash, so equal slices of its range are buckets of equal size.
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    slice_of = F.floor((F.col("ticket") / 2.0**64 + 0.5) * buckets).cast("long")
    keyed = keyed.withColumn("ticket", F.xxhash64(F.lit(seed), *name)).withColumn("bucket", slice_of)
    keyed = stored(keyed, "mix-keyed")
    upto = W.partitionBy("key", "bucket").orderBy("ticket", *name).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = keyed.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = before.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    placed = keyed.withColumn("local", F.sum("size").over(upto)).join(before, ["key", "bucket"])
    uses = placed.withColumn("use", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    start = F.col("before") + F.col("local") - F.col("size") + (F.col("use") - 1) * F.col("source_size")
    room = F.floor("target").cast("long") - start
    if whole:
        words = F.when((F.col("size") > 0) & (room * 2 >= F.col("size")), F.col("size"))
        words = words.when((F.col("size") == 0) & (F.col("use") == 1), F.lit(0))
    else:
        words = F.when((F.col("size") > 0) & (room > 0), F.least("size", room))
    served = uses.withColumns({"words": words, "start": start}).where("words is not null")
    finish = F.when(F.col("words") > 0, (F.col("start") + F.col("words")) / F.col("target")).otherwise(F.lit(0.0))
    timed = served.select(*name, "use", "words", finish.alias("finish"))
    mix = running_sum(timed, [F.col(c) for c in ("finish", *name, "use")], {"served": "words"})
    total = math.ceil(targets.agg(F.sum("target")).first()[0] or 0.0)
    mix = mix.where((F.col("words") == 0) | (F.col("served") - F.col("words") < total))
    return mix, keyed.select(*name, "source", "size", "source_size", "target")


def _sized(docs: DataFrame) -> DataFrame:
    """Rows as ``schedule`` takes them; rows that agree in identifier and text are numbered."""
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(text_of("text")).alias("tie"), "source", words_in(F.col("text")).alias("size")
    )
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("id", "tie").orderBy("source")))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target`` (its source's) and ``taken``,
    the words the mix takes of it over all its uses.

    Null and empty texts have no words and are never taken; a null source is a source of its own,
    after all others. Repeated rows are taken one by one. An empty table gives no rows. Other
    columns are not read.
    """
    mix, rows = schedule(_sized(docs), **options)
    taken = mix.groupBy(F.col("id").alias("i"), F.col("tie").alias("t"), F.col("copy").alias("c")).agg(F.sum("words").alias("taken"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")) & (F.col("copy") == F.col("c"))
    return rows.join(taken, same, "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, whole, each as often as it is used.

    A document without words stays, since it takes nothing of any budget. Null sources and
    repeated rows: as in ``mix_report``.
    """
    mix, _ = schedule(_sized(docs), whole=True, **options)
    uses = mix.groupBy("id", "tie", "copy").agg(F.count(F.lit(1)).cast("int").alias("uses"))
    uses = uses.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(
        F.map_from_entries(F.collect_list(F.struct("copy", "uses"))).alias("_uses")
    )
    rows = packed(docs, _doc=F.col("doc_id"), _text=F.xxhash64(text_of("text")), _source=F.col("source"))
    joined = rows.join(uses.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_tie")))
    copy = F.row_number().over(W.partitionBy("_doc", "_text").orderBy("_source"))
    times = F.coalesce(F.try_element_at("_uses", F.col("_copy")), F.lit(0))
    each = joined.withColumn("_copy", copy).withColumn("_times", times).where("_times > 0")
    return unpacked(each.withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_times")))))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


QUERIES = {"op6_mixing": op6}
