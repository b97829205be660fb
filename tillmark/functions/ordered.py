"""Order-dependent arithmetic over frames of any size: running sums, exact quantiles, argmax.

A window without partition keys would pull all rows into one task. The helpers here split the
order into ranges instead, so no task and no group ever holds more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable


def running_sum(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums (new column -> summed column) along a unique total order.

    Three steps: range-partition and sort; sum each range; add to every range's local running
    sum what lies before it. The ranges are made durable first, because range limits come from
    sampling and both later steps must see the same ones. The broadcast side has one row per
    range, that is at most ``spark.sql.shuffle.partitions`` rows.
    """
    ranged = durable(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    upto_here = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
    before = before.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_before_{o}") for o in sums],
    )
    local = ranged.select("*", *[F.sum(c).over(upto_here).alias(f"_local_{o}") for o, c in sums.items()])
    joined = local.join(F.broadcast(before), "_range")
    return joined.select(
        *df.columns, *[(F.col(f"_local_{o}") + F.col(f"_before_{o}")).alias(o) for o in sums]
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group: ``by..., quantiles, n``.

    ``weight`` names a column that says how many rows a row stands for.

    Rows are first folded to one row per distinct value and its count (map-side combined), so
    a hot value costs one row. These are split into ranges of (group, value), and summed for each group
    within a range; what a group has in earlier ranges and in all comes from these sums, which are as many as ranges and
    groups together. No join or window runs over a whole group.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    keys = list(by) or ["_all"]
    if not by:
        clean = clean.withColumn("_all", F.lit(1))
    counts = clean.groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(
        (F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("_count")
    )
    ranged = durable(counts.repartitionByRange(*keys, "_value").withColumn("_range", F.spark_partition_id()))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_range", *keys).agg(F.sum("_count").alias("_sum")).select(
        "_range", *keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias("n")
    )
    upto_here = W.partitionBy("_range", *keys).orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    ranked = ranged.withColumn("_local", F.sum("_count").over(upto_here)).join(sums, ["_range", *keys])
    upto = F.col("_before") + F.col("_local")
    first = upto - F.col("_count")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < upto), F.col("_value")))

    places = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    picked = ranked.groupBy(*keys, "n").agg(
        *[at(F.floor(place)).alias(f"_lo{i}") for i, place in enumerate(places)],
        *[at(F.ceil(place)).alias(f"_hi{i}") for i, place in enumerate(places)],
    )
    values = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place - F.floor(place))
        for i, place in enumerate(places)
    ]
    return picked.select(*by, F.array(*values).alias("quantiles"), "n")


def arg_best(df: DataFrame, metric: str, *keys: str, largest: bool = True) -> DataFrame:
    """The row with the largest (smallest) metric; ties go to the smallest key.

    Runs as a distributed top-1, without a full sort.
    """
    ranked = df.where(F.col(metric).isNotNull())
    first = F.desc(metric) if largest else F.asc(metric)
    return ranked.orderBy(first, *[F.asc(k) for k in keys]).limit(1)


def key_of_best(metric: Column, key: Column, where: Column, largest: bool = True) -> Column:
    """Aggregate that gives the key with the largest (smallest) metric among the rows ``where``;
    ties go to the smallest key. Unknown keys and metrics do not compete."""
    rank = -metric if largest else metric
    competes = where & key.isNotNull() & metric.isNotNull()
    return F.min(F.when(competes, F.struct(rank.alias("rank"), key.alias("key")))).getField("key")
