"""Hard-negative mining by angular triangle filtering.

Every vector keeps its angles to a few reference directions. Angles obey the triangle inequality, so with an
anchor at angles s and a vector at angles t to the same references, the angle between the two lies between the largest
|s - t| and the smallest of s + t and 2 pi - s - t. The cosines of these limits, times both norms and widened by
what rounding may take, bound the score. Vectors of a shard that are near in angle lie together, and a tile of them shares
one interval of angles and norms. Whole-number products are worked out only where a tile's bounds overlap what an anchor still asks for:
for positives scores from the kth best so far on, for negatives the windows of scores its positives open, from the kth best
so far in each window on. (Bounds of single vectors would cost more than their products, which BLAS gives for a tile at once.)

Rows lie in shards and anchors in blocks, both with norms and angles; each pair of a block and a shard is one row of
a join and is searched by itself. What shards find, at most a few rows per anchor, is merged by windows over the anchor.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

SHARD_ROWS, BLOCK_ROWS, TILE_ROWS = 8192, 512, 256
#: Reference directions, and rows they are chosen from (the first by a hash; results do not depend on them).
REFERENCES, SAMPLE_ROWS = 8, 1024
#: Angles from rounded cosines are off by less than this, and products by less than this share.
ANGLE_SLACK, SHARE_SLACK = 1e-6, 1e-9
_BEST = Iterator[pa.RecordBatch]


def references(points: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors that are far from each other in angle, as rows, from the points' directions."""
    norms = np.linalg.norm(points, axis=1)
    units = points[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, points.shape[1]))
    chosen, nearest = [int(np.argmin(units @ units.mean(0)))], np.full(len(units), -np.inf)
    while len(chosen) < min(count, len(units)):
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
        chosen.append(int(np.argmin(nearest)))
    return units[chosen]


def angles(points: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each direction; a zero vector has any angle, since its products are 0."""
    values = points.astype(float)
    norms = np.linalg.norm(values, axis=1)
    cosines = values @ directions.T / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1))


def tiles(norms: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    """First and last row of each tile, and the least and greatest norm and angles of its rows."""
    first = np.arange(0, len(norms), TILE_ROWS)
    at = {"first": first, "last": np.append(first[1:], len(norms))}
    for name, values in (("norm", norms), ("angle", own)):
        at |= {f"{name}_low": np.minimum.reduceat(values, first), f"{name}_high": np.maximum.reduceat(values, first)}
    return at


def score_bounds(norms: np.ndarray, own: np.ndarray, tile: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of each anchor (norms, angles) with the vectors of each tile."""
    least = np.zeros((len(norms), len(tile["first"])))
    most = np.full(least.shape, np.pi)
    for r in range(own.shape[1]):
        s, low, high = own[:, r, None], tile["angle_low"][None, :, r], tile["angle_high"][None, :, r]
        np.maximum(least, np.maximum(s - high, low - s), out=least)
        widest = np.where(s + high <= np.pi, s + high, np.where(s + low >= np.pi, 2 * np.pi - s - low, np.pi))
        np.minimum(most, widest, out=most)
    small, large = norms[:, None] * tile["norm_low"], norms[:, None] * tile["norm_high"]
    slack = SHARE_SLACK * large + 1e-6
    low, high = np.cos(np.minimum(most + ANGLE_SLACK, np.pi)), np.cos(np.maximum(least - ANGLE_SLACK, 0))
    return np.where(low < 0, large, small) * low - slack, np.where(high < 0, small, large) * high + slack


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact: by floats or 64-bit numbers where they hold them, else digit by digit."""
    top = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top[0] * top[1] * a.shape[1] < 2**63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    found = a.astype(object) @ b.T.astype(object)
    if found.size and max(abs(x) for x in found.flat) >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return found.astype(np.int64)


def _first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each group (higher scores, then smaller identifiers), and their rank from 0."""
    order = np.lexsort((rids, ids, -scores, groups))
    starts = np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k], rank[rank < k]


def search(anchors: dict, shard: dict, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """Anchor row, window, found row, identifier and score of the k best in each of an anchor's windows of scores
    (``lows`` to ``highs``, one column per window; none: every score), among vectors of the same label or of other ones."""
    count = len(anchors["ids"])
    whole = np.iinfo(np.int64)
    lows = anchors.get("lows", np.full((count, 1), whole.min))
    highs = anchors.get("highs", np.full((count, 1), whole.max))
    windows = lows.shape[1]
    wanted = np.where(lows <= highs, lows, whole.max)  # from where on scores are asked for
    at_least, at_most = score_bounds(anchors["norms"], anchors["angles"], shard)
    best = [np.zeros(0, np.int64)] * 4  # group, score, identifier, row
    top = highs.max(1)
    # Tiles that promise most come first, so that the scores asked for rise early.
    for t in np.argsort(-at_most.mean(0), kind="stable"):
        # A window without an end takes everything: scores beyond 64 bits are met, and refused, not passed over.
        above = (at_most[:, t, None] >= wanted) | (wanted == whole.min)
        below = (at_least[:, t, None] <= highs) | (highs == whole.max)
        asked = ((wanted <= highs) & above & below).any(1)
        asking = np.flatnonzero(asked)
        if not len(asking):
            continue
        own = slice(shard["first"][t], shard["last"][t])
        scores = whole_products(anchors["points"][asking], shard["points"][own])
        floor = wanted[asking].min(1)
        fit = (scores >= floor[:, None]) & (scores <= top[asking, None])
        fit &= (anchors["labels"][asking, None] == shard["labels"][None, own]) == same
        fit &= anchors["ids"][asking, None] != shard["ids"][None, own]
        rows, columns = np.nonzero(fit)
        if not len(rows):
            continue
        found, rows, columns = scores[rows, columns], asking[rows], columns + shard["first"][t]
        pairs, window = np.nonzero((found[:, None] >= wanted[rows]) & (found[:, None] <= highs[rows]))
        rows, columns, found = rows[pairs], columns[pairs], found[pairs]
        fresh = (rows * windows + window, found, shard["ids"][columns], shard["rids"][columns])
        best = [np.concatenate(x) for x in zip(best, fresh)]
        kept, rank = _first(*best, k)
        best = [x[kept] for x in best]
        full = rank == k - 1
        group = best[0][full]
        wanted[group // windows, group % windows] = best[1][full]
    return anchors["rids"][best[0] // windows], best[0] % windows, best[3], best[2], best[1]


# --- tables -------------------------------------------------------------------------------------


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as file:
        return dict(file)


def _packs(rows: DataFrame, part: str, directions: dict[int, np.ndarray], windows: int | None = None) -> DataFrame:
    """One row per part and vector length: ``part, d, data``. ``windows`` is how many columns of score windows rows bring."""

    def batches(source: _BEST) -> _BEST:
        now, held = None, []

        def made() -> pa.RecordBatch:
            rids, ids, labels, vectors, *limits = zip(*held)
            points = np.array(vectors, np.int64)
            directed = directions.get(now[1], np.zeros((0, points.shape[1])))
            norms, own = angles(points, directed)
            # Rows near the same direction, by their angle to it.
            near = np.lexsort((own.min(1), own.argmin(1))) if own.shape[1] else np.arange(len(norms))
            rids, ids, labels = (np.array(x, np.int64)[near] for x in (rids, ids, labels))
            points, norms, own = points[near], norms[near], own[near]
            arrays = {"rids": rids, "ids": ids, "labels": labels, "norms": norms, "angles": own, **tiles(norms, own)}
            arrays["points"] = points.astype(np.int32) if np.abs(points.astype(float)).max(initial=0) < 2**31 else points
            if windows is not None:
                arrays |= {n: np.array(x, np.int64).reshape(len(ids), windows)[near] for n, x in zip(("lows", "highs"), limits)}
            columns = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([_pack(arrays)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "d", "data"])

        for batch in source:  # sorted by part and length
            columns = [batch.column(c).to_pylist() for c in names]
            for key, row in zip(zip(*columns[:2]), zip(*columns[2:])):
                if key != now:
                    if held:
                        yield made()
                    now, held = key, []
                held.append(row)
        if held:
            yield made()

    names = ["part", "d", "rid", "id", "label", "v"] + ["lows", "highs"] * (windows is not None)
    dealt = rows.withColumn("part", F.col(part)).repartition("part").sortWithinPartitions("part", "d", "rid")
    return dealt.select(*names).mapInArrow(batches, "part int, d int, data binary")


def _met(blocks: DataFrame, shards: DataFrame, count: int, search, schema: str) -> DataFrame:
    """``search`` over every pair of a block of anchors and a shard of rows of the same length."""

    def batches(source: _BEST) -> _BEST:
        names = [field.split()[0] for field in schema.split(", ")]
        for batch in source:
            for i in range(batch.num_rows):
                found = search(*(_unpack(batch.column(c)[i].as_py()) for c in ("asked", "data")))
                columns = [pa.array(x.astype(np.int64), pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = blocks.select(F.col("part").alias("block"), "d", F.col("data").alias("asked"), every.alias("part"))
    pairs = asked.hint("shuffle_merge").join(shards, ["part", "d"])
    return pairs.select("asked", "data").mapInArrow(batches, schema)


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id`` (the identifier as long). An anchor's positives are the best rows of its label, its negatives for each of them the
    best rows of other labels whose score is between ``least`` and ``most`` percent of the positive's. Scores are inner
    products of the components as whole numbers; higher ones come first, ties by smaller identifier.

    Rows with a null identifier, label or vector, an empty vector, or a null or non-finite component take no
    part; vectors of different lengths are not compared. Rows sharing an identifier all take part, but are neither positives nor
    negatives of each other. No rows give no rows; other columns are not read. Scores beyond 64 bits are an error.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.select(
        F.col(id_column).cast("long").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    fit = named.where("id is not null and label is not null and v is not null and size(v) > 0").where(finite)
    whole = F.transform("v", lambda x: F.floor(x * float(scale)).cast("long"))
    vectors = fit.select("id", "label", whole.alias("v"), F.size("v").alias("d"))
    # Written once, so that the row numbers stay what they are.
    vectors = stored(vectors.withColumn("rid", F.monotonically_increasing_id()), "negatives-vectors")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    sample = vectors.orderBy(F.xxhash64("rid", "v")).limit(SAMPLE_ROWS).select("d", "v").collect()
    lengths = {row["d"] for row in sample}
    directions = {d: references(np.array([row["v"] for row in sample if row["d"] == d], float)) for d in lengths}
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    packed = stored(_packs(dealt, "shard", directions), "negatives-shards")

    anchors = vectors.where(is_anchor)
    blocks = max(1, -(-anchors.count() // BLOCK_ROWS))
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rid"), F.lit(blocks)).cast("int")), "negatives-anchors")
    asked = stored(_packs(anchors, "block", directions), "negatives-blocks")
    schema = "anchor long, place long, rid long, id long, score long"
    near = _met(asked, packed, shards, lambda a, s: search(a, s, positives, True), schema)
    near = stored(_merged(near.drop("place"), ["anchor"], positives), "negatives-positives")

    # Windows of scores, as whole numbers: least * p <= 100 * n <= most * p.
    p = F.col("score").cast("decimal(38,0)")
    window = F.struct(
        F.col("rank"), F.ceil(p * least / 100).cast("long").alias("low"), F.floor(p * most / 100).cast("long").alias("high")
    )
    windows = near.groupBy(F.col("anchor").alias("rid")).agg(F.sort_array(F.collect_list(window)).alias("w"))
    blank = [F.array_repeat(F.lit(x).cast("long"), positives) for x in (1, 0)]  # no more positives: empty windows
    filled = [F.slice(F.concat(f"w.{side}", b), 1, positives) for side, b in zip(("low", "high"), blank)]
    asked = anchors.join(windows, "rid").withColumns({"lows": filled[0], "highs": filled[1]})
    asked = stored(_packs(asked, "block", directions, positives), "negatives-windows")
    hard = _met(asked, packed, shards, lambda a, s: search(a, s, negatives, False), schema)
    hard = _merged(hard, ["anchor", "place"], negatives)
    hard = hard.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select(
        "anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    named = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return hard.join(near, ["anchor", "place"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


QUERIES = {"op12_hard_negatives": op12}

ORACLE = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id AS id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (
  SELECT anchor, anchor_id, rid AS positive, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, rid) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, id, rid) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor, anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, id, rid) <= 3"""
}
