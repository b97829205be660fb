"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their identifier, and each shard is kept as one row with
its ball tree. Queries go over all shards in blocks of bounded size. In a node with centre c
and radius r no vector scores above q.c + |q| r, so nodes whose bound is under the query's current kth score
are left out, and the others are visited from the highest bound down. The kth score is shared: every shard first
looks at its best leaf only, the kth best of what all shards found there is where the full search
starts, and a task carries it on from shard to shard.
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

SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 64, 2048
#: Stands for no score; below all scores, which fit 64 bits.
NONE = np.iinfo(np.int64).min


def build_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Order of the points, and nodes in levels: first and last point, children, centre, radius."""
    order = np.arange(len(points))
    first, last, left, right = [0], [len(points)], [-1], [-1]
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        if b - a > leaf_rows:
            own = points[order[a:b]]
            # Split at the median along the line between two far points.
            far = own[np.argmax(((own - own[0]) ** 2).sum(1))]
            other = own[np.argmax(((own - far) ** 2).sum(1))]
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
            left[at], right[at] = len(first), len(first) + 1
            first += [a, a + middle]
            last += [a + middle, b]
            left += [-1, -1]
            right += [-1, -1]
        at += 1
    centres = np.stack([points[order[a:b]].mean(0) for a, b in zip(first, last)])
    radii = np.array([np.sqrt(((points[order[a:b]] - c) ** 2).sum(1).max()) for a, b, c in zip(first, last, centres)])
    nodes = np.stack([first, last, left, right], 1)
    return {"order": order, "nodes": nodes, "centres": centres, "radii": radii}


class Best:
    """The k best (score, identifier) of each query so far, whole numbers; ties go to the smaller identifier."""

    def __init__(self, queries: int, k: int, floors: np.ndarray | None = None):
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.scores = np.full((queries, k), NONE)
        self.floors = np.full(queries, NONE) if floors is None else floors

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floors)

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (rows x candidates) of candidates with these identifiers; NONE: not a candidate."""
        some = ((scores >= self.kth()[rows, None]) & (scores > NONE)).any(1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        k = self.ids.shape[1]
        scores = np.concatenate([self.scores[rows], scores], 1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        top = np.lexsort((ids, ~scores), axis=1)[:, :k]
        self.scores[rows] = np.take_along_axis(scores, top, 1)
        self.ids[rows] = np.take_along_axis(ids, top, 1)


def _scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whole inner products; in floating point where that is exact, which BLAS makes fast, else in 64 bits."""
    most = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (queries, points)]
    if most[0] * most[1] * queries.shape[1] < 2**53:
        return (queries.astype(float) @ points.T.astype(float)).astype(np.int64)
    if most[0] * most[1] * queries.shape[1] < 2**63:
        return queries @ points.T
    found = queries.astype(object) @ points.T.astype(object)
    if max((abs(x) for x in found.flat), default=0) >= 2**63 - 1:
        raise OverflowError("an inner product does not fit 64 bits")
    return found.astype(np.int64)


def search_shard(
    tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best,
    first_leaf_only: bool = False,
) -> None:
    """Take the best of a shard into ``best``. ``points`` and ``ids`` lie in the tree's order."""
    nodes, lengths = tree["nodes"], np.linalg.norm(queries.astype(float), axis=1)
    # A rounding margin keeps a bound from falling below a score it stands for.
    bounds = queries.astype(float) @ tree["centres"].T + lengths[:, None] * tree["radii"]
    bounds += 1e-9 * (np.abs(bounds) + lengths[:, None] * (np.linalg.norm(tree["centres"], axis=1) + tree["radii"])) + 1e-6
    open_ = np.zeros(bounds.shape, bool)
    open_[:, 0] = True
    kth = best.kth()
    for n, (_, _, left, right) in enumerate(nodes):  # children come after their parents
        if left >= 0:
            bounds[:, [left, right]] = np.minimum(bounds[:, [left, right]], bounds[:, [n]])
            alive = open_[:, n] & (bounds[:, n] >= kth)
            open_[alive, left] = open_[alive, right] = True
    leaves = np.flatnonzero(nodes[:, 2] < 0)
    leaf_bounds = np.where(open_[:, leaves], bounds[:, leaves], -np.inf)
    ranked = np.argsort(-leaf_bounds, axis=1, kind="stable")
    asking = np.arange(len(queries))
    for turn in range(1 if first_leaf_only else len(leaves)):
        chosen = ranked[asking, turn]
        bound = leaf_bounds[asking, chosen]
        going = (bound >= best.kth()[asking]) & (bound > -np.inf)
        asking, chosen = asking[going], chosen[going]  # bounds only fall and kth scores only rise
        if not len(asking):
            break
        for leaf in np.unique(chosen):
            rows = asking[chosen == leaf]
            a, b = nodes[leaves[leaf], :2]
            scores = _scores(queries[rows], points[a:b])
            scores[query_ids[rows][:, None] == ids[a:b][None, :]] = NONE
            best.take(rows, scores, ids[a:b])


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as file:
        return dict(file)


def whole_vectors(rows: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """``id, v``: floor(scale * x) of each component, of vectors without null or non-finite ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fit = rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(finite & (F.size(vector) > 0))
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    return fit.select(F.col(id_column).cast("long").alias("id"), values.alias("v"))


def top_k(
    rows: DataFrame, is_query: Column, *, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query, its own row aside.

    Scores are inner products of the components as whole numbers, ties go to the smaller
    identifier; with fewer than k candidates, all. Null vectors, vectors holding a null or
    non-finite component, empty ones and null identifiers take no part; vectors of another length than a query's are no
    candidates for it. Rows that share an identifier all take part, as queries and as candidates, but not for each other.
    No rows give no rows. Inner products that do not fit 64 bits raise an error. Other columns are not read.
    """
    whole = whole_vectors(rows, id_column, vector, scale)
    # Written once, so that the row numbers stay what they are.
    vectors = stored(whole.withColumns({"d": F.size("v"), "rid": F.monotonically_increasing_id()}), "topk-vectors")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per shard and vector length."""
        parts: dict[tuple[int, int], tuple[list, list]] = {}

        def made(key: tuple[int, int]) -> pa.RecordBatch:
            ids, points = (np.array(x, np.int64) for x in parts.pop(key))
            tree = build_tree(points.astype(float))
            data = _pack(ids=ids[tree["order"]], points=points[tree["order"]], **tree)
            arrays = [pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["d", "tree"])

        for batch in batches:  # sorted by shard and length
            for shard, d, i, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "d", "id", "v"))):
                for key in [key for key in parts if key != (shard, d)]:
                    yield made(key)
                ids, points = parts.setdefault((shard, d), ([], []))
                ids.append(i)
                points.append(v)
        for key in list(parts):
            yield made(key)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "d", "id")
    trees = stored(dealt.select("shard", "d", "id", "v").mapInArrow(planted, "d int, tree binary"), "topk-trees")
    wanted = vectors.where(is_query)
    blocks = max(1, -(-wanted.count() // QUERY_ROWS))
    wanted = stored(wanted.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "rid"), F.lit(blocks)).cast("int")), "topk-queries")
    return _searched(trees, wanted, blocks, k)


def _searched(trees: DataFrame, wanted: DataFrame, blocks: int, k: int) -> DataFrame:
    """Blocks one after the other: each is a list of about QUERY_ROWS vectors, whatever the table's size."""
    spark, schema = trees.sparkSession, "query_id long, rank int, vec_id long, score long"
    found = None
    for block in range(blocks):
        own = wanted.where(F.col("block") == block).orderBy("d", "id").select("d", "id", "v").collect()
        for d in sorted({row["d"] for row in own}):
            ids = np.array([row["id"] for row in own if row["d"] == d], np.int64)
            queries = np.array([row["v"] for row in own if row["d"] == d], np.int64)
            own_trees = trees.where(F.col("d") == int(d)).select("tree")
            shared = spark.sparkContext.broadcast((ids, queries))
            seeds = stored(_pass(own_trees, shared, None, k), "topk-seeds")
            ranked = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
            floors = np.full(len(ids), NONE)
            kth = seeds.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
            for row in kth.select("query", "score").collect():
                floors[row["query"]] = row["score"]
            hits = _pass(own_trees, shared, floors, k).withColumn("rank", F.row_number().over(ranked))
            names = spark.createDataFrame([(i, int(q)) for i, q in enumerate(ids)], "query int, query_id long")
            hits = hits.where(F.col("rank") <= k).join(F.broadcast(names), "query")
            hits = stored(hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-hits")
            found = hits if found is None else found.union(hits)
    return spark.createDataFrame([], schema) if found is None else found


def _pass(trees: DataFrame, shared, floors: np.ndarray | None, k: int) -> DataFrame:
    """One search over all shards; without floors, of each shard's best leaf only."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best = Best(len(queries), k, floors)
        for batch in source:
            for data in batch.column("tree"):
                tree = _unpack(data.as_py())
                search_shard(tree, tree["points"], tree["ids"], queries, query_ids, best, floors is None)
        rows, places = np.nonzero(best.scores > NONE)
        arrays = [pa.array(rows.astype(np.int32)), pa.array(best.ids[rows, places]), pa.array(best.scores[rows, places])]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "vec_id", "score"])

    return trees.mapInArrow(batches, "query int, vec_id long, score long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES = {"op2_topk_search": op2}

ORACLE = {
    "op2_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""
}
