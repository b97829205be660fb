"""Quality classifier: ordinal regression on graded ratings.

A document's score is a weighted sum of hashed features of its text; K - 1 ordered thresholds cut the
score line into K grades, P(grade <= k) = 1 / (1 + exp(score - threshold k)). All grades share the weights
(McCullagh's cumulative-link model). The score gives the expected grade and the probability of each upper tail,
by which documents are selected.

The fit takes a bounded sample of rated documents, whole texts; each step of L-BFGS is one pass of
Spark over their stored features, and only sums of fixed size come to the driver.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, table, text_of

#: Hashed features, rated documents the fit reads at most, steps, and strength of the L2 penalty.
SIZE, MAX_RATED, STEPS, PENALTY = 1 << 16, 20_000, 30, 3e-4
FIT_PARTS = 8
REMEMBERED = 100_000
SHAPES = ("again", "upper", "shout", "sign", "number", "link", "marks", "many", "long")
#: Length of a text's word features taken together, and of each shape feature.
WORD_LENGTH, SHAPE_LENGTH = 24.0, 3.0
CUTS = (0.01, 0.03, 0.08, 0.2, 0.4, 0.6, 0.8)
_EDGE = re.compile(r"^\W+|\W+$")
_MARKS = re.compile(r"[^\w\s.]{2}")


def _slot(text: str) -> int:
    return zlib.crc32(text.encode()) % SIZE


def word_features(token: str) -> tuple[tuple[int, ...], int]:
    """Hashed features of a white-space token, and its shapes as bits."""
    word = _EDGE.sub("", token.lower())
    slots = {_slot("w" + word)}
    if len(word) > 4:
        slots |= {_slot("p" + word[:4]), _slot("q" + word[:6]), _slot("s" + word[-4:])}
    shape = 2 * (len(token) > 1 and token.isupper()) | 4 * token.endswith("!!") | 8 * (not word)
    shape |= 16 * token.isdigit() | 32 * ("http" in token or "www." in token) | 128 * (len(token) > 24)
    shape |= 256 * bool(_MARKS.search(token))
    return tuple(slots), shape


def shape_features(tokens: list[str], counts: Counter, shapes: dict[str, int]) -> list[int]:
    """Hashed features of the whole text: shares of token shapes and of repeats, in steps."""
    n = max(1, len(tokens))
    shares = [sum(map(operator.eq, tokens, islice(tokens, 1, None))) / n]
    shares += [sum([counts[t] for t, shape in shapes.items() if shape & bit]) / n for bit in (2, 4, 8, 16, 32, 256)]
    shares += [max(counts.values(), default=0) / n, sum([counts[t] for t, shape in shapes.items() if shape & 128]) / n]
    found = [_slot(f"{name} {sum(share > cut for cut in CUTS)}") for name, share in zip(SHAPES, shares)]
    size = int(math.log2(n))
    return [*found, _slot(f"size {size}"), _slot(f"distinct {size} {int(10 * len(counts) / n)}")]


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features, and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k but the last: one row per score."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds, -500, 500)))


class _Words:
    """Features of tokens, remembered by a task up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[tuple[int, ...], int]] = {}

    def of(self, text: str) -> tuple[list[int], list[int]]:
        """Word slots (each once) and shape slots of a text."""
        tokens = text.split()
        counts = Counter(tokens)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        slots, shapes = set(), {}
        for token in counts:
            entry = self.known.get(token)
            if entry is None:
                entry = word_features(token)
                if len(token) <= 64:
                    self.known[token] = entry
            slots.update(entry[0])
            if entry[1]:
                shapes[token] = entry[1]
        return sorted(slots), shape_features(tokens, counts, shapes)


def rated_features(docs: DataFrame, ratings: DataFrame, max_rated: int) -> DataFrame:
    """``grade, words, shapes`` of at most ``max_rated`` rated documents, by a hash of their ids."""
    rated = ratings.select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("grade")).dropna()
    sample = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(max_rated)
    rows = docs.select(F.col("doc_id").alias("id"), text_of("text").alias("text"))
    joined = rows.join(F.broadcast(sample), "id")  # at most max_rated rows

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(source):
            found = [words.of(text) for text in batch.column("text").to_pylist()]
            arrays = [batch.column("id"), batch.column("grade"), *[pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "grade", "words", "shapes"])

    schema = "id long, grade int, words array<int>, shapes array<int>"
    features = joined.select("id", "grade", "text").mapInArrow(batches, schema)
    return stored(features.repartition(FIT_PARTS, "id").sortWithinPartitions("id", "grade"), "rated-features")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grades, and rows, slots and values of the sparse feature matrix. Word features share one
    length, so that long texts do not outweigh short ones."""
    parts = []
    for name in ("words", "shapes"):
        column = batch.column(name)
        sizes = np.diff(column.offsets.to_numpy())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        value = WORD_LENGTH / np.sqrt(np.maximum(sizes, 1)) if name == "words" else np.full(len(sizes), SHAPE_LENGTH)
        parts.append((rows, column.flatten().to_numpy(), value[rows]))
    return batch.column("grade").to_numpy(), *[np.concatenate(x) for x in zip(*parts)]


def loss_and_slopes(
    weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, rows: np.ndarray, slots: np.ndarray, values: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, and its slopes by weights and thresholds."""
    score = np.bincount(rows, values * weights[slots], len(grades))
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    upper, lower = edges[grades + 1] - score, edges[grades] - score
    below = [1 / (1 + np.exp(-np.clip(x, -500, 500))) for x in (upper, lower)]
    below[0][np.isinf(upper)], below[1][np.isinf(lower)] = 1.0, 0.0
    chance = np.maximum(below[0] - below[1], 1e-12)
    steep = [b * (1 - b) / chance for b in below]
    by_score = steep[0] - steep[1]
    by_edge = np.bincount(grades + 1, -steep[0], len(edges)) + np.bincount(grades, steep[1], len(edges))
    return -np.log(chance).sum(), np.bincount(slots, values * by_score[rows], len(weights)), by_edge[1:-1]


def _ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds from free numbers: the first, and logarithms of the gaps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, *, max_rated: int = MAX_RATED, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Fit on ``ratings`` (``doc_id, grade`` from 0 to ``grades`` - 1).

    Nulls and ratings of unknown documents do not count; several ratings of a document count one
    by one. Without any ratings all weights are 0, and all documents get the same grade.
    """
    features = rated_features(docs, ratings, max_rated)
    spark = docs.sparkSession

    def evaluate(point: np.ndarray) -> tuple[float, np.ndarray]:
        weights, thresholds = point[:SIZE], _ordered(point[SIZE:])
        shared = spark.sparkContext.broadcast((weights, thresholds))

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, by_weight, by_edge, n = 0.0, np.zeros(SIZE), np.zeros(grades - 1), 0
            for batch in source:
                loss, own_weight, own_edge = loss_and_slopes(*shared.value, *_matrix(batch))
                total, n = total + loss, n + batch.num_rows
                by_weight += own_weight
                by_edge += own_edge
            if n:
                data = np.concatenate([[total, n], by_weight, by_edge]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["sums"])

        # FIT_PARTS sums, into however many files the features were written.
        parts = features.coalesce(FIT_PARTS).mapInArrow(batches, "sums binary").collect()
        parts = sorted(bytes(r["sums"]) for r in parts)
        shared.unpersist()
        sums = sum((np.frombuffer(p) for p in parts), np.zeros(2 + SIZE + grades - 1))
        n = max(1.0, sums[1])
        by_edge = sums[2 + SIZE :] / n
        # Every threshold holds the first free number and the gaps before it.
        gaps = np.concatenate([[1.0], np.exp(point[SIZE + 1 :])])
        by_free = np.cumsum(by_edge[::-1])[::-1] * gaps
        slopes = np.concatenate([sums[2 : 2 + SIZE] / n + penalty * weights, by_free])
        return sums[0] / n + penalty / 2 * weights @ weights, slopes

    start = np.concatenate([np.zeros(SIZE), [-1.0], np.zeros(grades - 2)])
    point = minimise(evaluate, start, steps)
    return Model(point[:SIZE], _ordered(point[SIZE:]))


def minimise(evaluate, point: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halving of steps that do not descend."""
    value, slope = evaluate(point)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(slope) < 1e-6:
            break
        direction, scales = slope.copy(), []
        for move, change in reversed(moves):
            scale = move @ direction / (move @ change)
            scales.append(scale)
            direction -= scale * change
        if moves:
            direction *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1])
        for (move, change), scale in zip(moves, reversed(scales)):
            direction += move * (scale - change @ direction / (move @ change))
        length = 1.0 if moves else min(1.0, 1 / np.linalg.norm(slope))
        for _ in range(12):
            there = point - length * direction
            new_value, new_slope = evaluate(there)
            if new_value <= value - 1e-4 * length * (slope @ direction):
                break
            length /= 2
        else:
            break
        if (there - point) @ (new_slope - slope) > 1e-12:
            moves = [*moves, (there - point, new_slope - slope)][-memory:]
        gain, point, value, slope = value - new_value, there, new_value, new_slope
        if gain < 1e-6:
            break
    return point


def score(docs: DataFrame, model: Model, *, at_least: int | None = None) -> DataFrame:
    """``text`` and the other columns as ``_row``, with ``expected`` grade and ``tail`` = P(grade >=
    ``at_least``, by default the best). Null texts count as empty; whole texts are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    best = len(model.thresholds) if at_least is None else at_least

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _Words(), shared.value
        for batch in slices(source):
            scores = []
            for text in batch.column("text").to_pylist():
                slots, shapes = words.of(text or "")
                words_part = WORD_LENGTH * known.weights[slots].sum() / math.sqrt(max(1, len(slots)))
                scores.append(words_part + SHAPE_LENGTH * known.weights[shapes].sum())
            at_most = known.at_most(np.array(scores, float))
            arrays = [batch.column("_row"), batch.column("text"), pa.array((1 - at_most).sum(1)), pa.array(1 - at_most[:, best - 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "text", "expected", "tail"])

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    rows = docs.select(rest, F.col("text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(batches, schema.add("expected", "double").add("tail", "double"))


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), F.col("quality") + 1)
    return labels.select("doc_id", grade.alias("grade"))


KEEP = 0.5


def select_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are good with a probability of at least ``keep``, all columns as they are."""
    good = score(docs, fit(docs, grades_of(labels), 3)).where(F.col("tail") >= keep)
    return good.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, grades_of(table(spark, sf_dir, "labels")), 3)
    found = score(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), F.round("expected", 6).alias("expected_grade"), F.round("tail", 6).alias("good"),
        (F.col("tail") >= KEEP).alias("kept"),
    )


QUERIES = {"op1_quality": op1}
