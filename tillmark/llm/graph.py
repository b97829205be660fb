"""Connected components of a graph of any size and degree, by alternating star contraction.

Large-star links every node's larger neighbours to the smallest neighbour, small-star its smaller
ones (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Both keep the components and end, after
few rounds, with one star per component, whose centre is its smallest node. Every round is two
aggregations and joins over edges; nodes of many edges are combined before the shuffle and
spread over several join keys. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored


def _star(directed: DataFrame, include_self: bool) -> DataFrame:
    """For edges u -> v: edges v -> m(u), m(u) being the smallest of u's neighbours (and u)."""
    smallest = F.least("u", F.min("v")) if include_self else F.min("v")
    ends = stored(directed.groupBy("u").agg(smallest.alias("m"), F.count(F.lit(1)).alias("n")), "star-ends")
    joined = salted_join(directed, ends, ["u"], "n", ["v"])
    if include_self:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.union(ends.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for each node of an undirected edge list; the component is its
    smallest node. Loops, repeated edges and edges with a null end do not matter."""
    pair = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = stored(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_star(both, True), "large-star")
        links = stored(_star(large, False).distinct(), "small-star")
        # Stars are done once no centre hangs on another one: each then is a component.
        if links.join(links.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    centres = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        centres.select("node", F.col("node").alias("component"))
    )
