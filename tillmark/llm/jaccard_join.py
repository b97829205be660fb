"""N-gram Jaccard join: a chosen-path join, and classes of near-duplicate documents.

A document is its set of word shingles (hashes of 64 bits). Documents with equal sets are one copy
class, which goes on as one. A chosen path starts anew in every run: by a hash shared by all, a set of
size s chooses each of its shingles with probability 1 / (threshold s), and joins the bucket of each;
buckets that are still large split again by further shingles, chosen by a hash of the path so far, ``BRANCH`` times as many
of them, so that a pair that got into a large bucket is hardly lost on the way down, however deep that is. Sets with a Jaccard
similarity of at least the threshold share one or more first choices on average, so a run misses a
pair with probability of about 1/e, and runs are repeated until the target recall
(Christiani, Pagh and Sivertsen, "Scalable and Robust Set Similarity Join", 2018). What was in a bucket that splits again
takes part in some more runs, as many as ``DEPTH`` steps ask for.

Before a large bucket splits, its members are compared with its first one, and those that are much like it go no further: whatever
is similar to them is similar enough to the first one to be connected to it. After the first runs
what was found to be nearly equal to a first member, which is not so itself to an earlier one, takes no part in the others.

Choices are made among a sample of each set, itself chosen by a shared hash: it serves all runs and steps, and small
buckets compare their members by it with a wide margin. What they connect are groups of candidates; within
a group the whole sets are compared, so links and similarities are exact. No pairs leave a task:
buckets give spanning trees, groups give a count of links for each member and its class. A bucket that fits a
task splits further within it; larger ones are split by Spark, step by step. Buckets that no path splits, and groups
too large for one task, are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import likely, packed, salted_join, slices, stored, table, text_of, unpacked
from .graph import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 1 - 1e-5
#: Shared sample of two sets of the threshold's similarity; members of a bucket that are compared with each
#: other, and that fit a task; steps of a path; members of a block of whole sets.
SAMPLE, SMALL, TASK, STEPS, BLOCK = 64, 256, 20_000, 6, 512
#: Steps that pairs are still found behind with the target recall, be they Spark's or a task's.
DEPTH = 6
#: Choices of a step after the first one, as a multiple of those of the first; runs before what is settled is left out.
BRANCH, FIRST_RUNS = 2, 5
#: Buckets connect members whose samples agree to this share of the threshold.
MARGIN = 0.6
#: A member this similar to another one, by their samples, needs no further partners: by the triangle
#: inequality of the Jaccard distance these are all similar enough to that other one to be connected to it.
SETTLED = 0.85
#: The same for all further runs. Two sets of the threshold's similarity are then at least 0.6 similar by their first members.
SETTLED_FOR_ALL, STILL_SHARED = 0.9, 0.9
REMEMBERED = 100_000


def runs_for(recall: float, depth: int = 1, shared: float = SAMPLE) -> int:
    """Runs after which a pair has shared a path of ``depth`` choices with this probability.

    The pair shares ``shared`` shingles of its samples on average (Poisson), and all runs choose among the same ones."""
    each = np.arange(16 * SAMPLE)
    weight = np.exp(each * math.log(shared) - shared - np.array([math.lgamma(k + 1) for k in each]))
    missed = np.zeros(len(each))
    for step in range(depth, 0, -1):
        missed = (1 - (1 - missed) * (1 if step == 1 else BRANCH) / SAMPLE) ** each
    runs = 1
    while (weight * missed**runs).sum() > 1 - recall:
        runs += 1
    return runs


# --- sets ---------------------------------------------------------------------------------------

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, size: int = SHINGLE, known: dict[str, int] | None = None) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words (between white space, in lower case);
    of all words, if there are fewer; none without words. ``known`` remembers hashes of words."""
    known = {} if known is None else known
    if len(known) > REMEMBERED:
        known.clear()
    words = text.lower().split()
    try:
        hashes = [known[w] for w in words]
    except KeyError:
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = [known[w] for w in words]
    if not hashes:
        return np.zeros(0, np.uint64)
    row = np.array(hashes, np.uint64)
    take = min(size, len(row))
    total = np.full(len(row) - take + 1, take, np.uint64)
    for i in range(take):
        total = _mixed(total + row[i : len(row) - take + 1 + i] * _FACTORS[i % len(_FACTORS)])
    return np.unique(total)


def _part(probability: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(probability * 2**64)))


def sampled(tokens: np.ndarray, threshold: float, seed: int = 0x5EED) -> np.ndarray:
    """The shingles a set offers to all its choices: about SAMPLE / threshold of them."""
    if not len(tokens):
        return tokens
    return tokens[_mixed(tokens ^ np.uint64(seed)) <= _part(SAMPLE / (threshold * len(tokens)))]


def choice_rate(sample: int, threshold: float) -> float:
    """Share of its sample that a set chooses: 1 / SAMPLE, that is 1 / (threshold s) of the set; sets of fewer
    shingles than a sample are a sample as a whole. Of two sets the smaller rate decides what both choose."""
    return 1 / max(1, min(SAMPLE, threshold * sample))


def _sets(rows: DataFrame, threshold: float) -> DataFrame:
    """``id, text_hash, size, h1, h2`` (digest of the set) ``, sample``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(source):
            sets = [shingles(text, known=known) for text in batch.column("text").to_pylist()]
            digests = [xxhash.xxh128_intdigest(s.tobytes()) for s in sets]
            halves = [[(d >> shift & 2**64 - 1) - 2**63 for d in digests] for shift in (0, 64)]
            arrays = [
                batch.column("id"),
                batch.column("text_hash"),
                pa.array([len(s) for s in sets], pa.int64()),
                *[pa.array(h, pa.int64()) for h in halves],
                pa.array([sampled(s, threshold).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "text_hash", "size", "h1", "h2", "sample"])

    return rows.mapInArrow(batches, "id long, text_hash long, size long, h1 long, h2 long, sample array<long>")


# --- chosen paths -------------------------------------------------------------------------------


def _choices(sets: DataFrame, paths: DataFrame | None, runs: range, threshold: float) -> DataFrame:
    """``key, cls`` for each shingle chosen at the start of each run, or at the end of each path."""
    one_in = F.least(F.lit(float(SAMPLE)), F.size("sample") * F.lit(float(threshold))) / (1 if paths is None else BRANCH)
    limit = F.when(one_in <= 1, F.lit(2**63 - 1)).otherwise((F.lit(2.0**64) / one_in - F.lit(2.0**63)).cast("long"))
    if paths is None:
        chosen = sets.select("cls", "sample", F.explode(F.sequence(F.lit(runs[0]), F.lit(runs[-1])).cast("array<long>")).alias("path"))
    else:
        chosen = paths.withColumnRenamed("key", "path").join(_samples(sets, paths), "cls")
    tokens = F.filter("sample", lambda t: F.xxhash64("path", t) <= limit)
    each = chosen.select("cls", "path", F.explode(tokens).alias("token"))
    return each.select(F.xxhash64(F.lit(3), "path", "token").alias("key"), "cls")


def _samples(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Samples of the classes that are members of something."""
    return likely(sets.select("cls", "sample"), F.xxhash64("cls"), members, F.xxhash64("cls"))


def _share(one: str, other: str) -> F.Column:
    """Similarity of two sets by their samples."""
    both = F.size(F.array_intersect(one, other))
    return both / (F.size(one) + F.size(other) - both)


def _led(paths: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges ``a, b, alike`` from the first member of each bucket (``key, cls``), and ``key, cls`` of the members
    that are not much like it."""
    first = paths.groupBy("key").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("n"))
    leads = first.join(sets.select(F.col("cls").alias("lead"), F.col("sample").alias("led_by")), "lead")
    rows = salted_join(paths.join(_samples(sets, paths), "cls"), stored(leads, "bucket-leads"), ["key"], "n", ["cls"])
    rows = stored(rows.where("cls <> lead").select("key", "cls", "lead", _share("sample", "led_by").alias("share")), "bucket-led")
    edges = rows.where(F.col("share") >= MARGIN * threshold)
    edges = edges.select(F.col("lead").alias("a"), F.col("cls").alias("b"), (F.col("share") >= SETTLED_FOR_ALL).alias("alike"))
    return edges, rows.where(F.col("share") < SETTLED).select("key", "cls")


def _buckets(
    sets: DataFrame, runs: range, threshold: float, small: int, task: int, steps: int
) -> tuple[DataFrame, DataFrame, DataFrame | None, list[DataFrame], DataFrame]:
    """``members`` of small buckets, ``bucket, cls`` of those that fit a task, ``key, cls, n`` of buckets that never
    fit, edges found on the way, and ``cls`` of those in a bucket that is not small."""
    smalls, fits, paths, edges = None, None, None, []
    for step in range(steps):
        choices = stored(_choices(sets, paths, runs, threshold), f"paths-{step}")
        met = stored(choices.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"path-sizes-{step}")
        shared = stored(salted_join(choices, met.withColumn("size", F.col("n")), ["key"], "n", ["cls"]), f"path-members-{step}")
        near = shared.where(F.col("size") <= small).groupBy("key").agg(F.sort_array(F.collect_list("cls")).alias("members"))
        fit = shared.where((F.col("size") > small) & (F.col("size") <= task)).select(F.col("key").alias("bucket"), "cls")
        smalls = near.select("members") if smalls is None else smalls.union(near.select("members"))
        fits = fit if fits is None else fits.union(fit)
        if step == 0:
            deep = shared.where(F.col("size") > small).select("cls").distinct()
        paths = shared.where(F.col("size") > task).select("key", "cls")
        if paths.isEmpty():
            return smalls, fits, None, edges, deep
        found, rest = _led(paths, sets, threshold)
        edges.append(found)
        sizes = stored(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"path-rests-{step}")
        rest = salted_join(rest, sizes.withColumn("size", F.col("n")), ["key"], "n", ["cls"])
        fits = fits.union(rest.where(F.col("size") <= task).select(F.col("key").alias("bucket"), "cls"))
        paths = stored(rest.where(F.col("size") > task).select("key", "cls", F.col("size").alias("n")), f"path-ends-{step}")
        if paths.isEmpty():
            return smalls, fits, None, edges, deep
        if step < steps - 1:
            paths = paths.drop("n")
    return smalls, fits, paths, edges, deep


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each set with each of the others (default: among themselves)."""
    right = sets if others is None else others
    both = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (sets, right)]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets, right)]
    counts = np.zeros((len(sets), len(right)), np.int32)
    order = [np.argsort(b, kind="stable") for b in both]
    tokens, starts = np.unique(both[0][order[0]], return_index=True)
    ends = np.append(starts[1:], len(both[0]))
    lows = np.searchsorted(both[1][order[1]], tokens, "left")
    highs = np.searchsorted(both[1][order[1]], tokens, "right")
    left, right_owner = owners[0][order[0]], owners[1][order[1]]
    # Tokens of the same holders on both sides are counted together.
    common = np.flatnonzero((highs > lows) & ((ends - starts > 1) | (others is not None)))
    same: dict[tuple[bytes, bytes], int] = {}
    for t in common:
        key = (left[starts[t] : ends[t]].tobytes(), right_owner[lows[t] : highs[t]].tobytes())
        same[key] = same.get(key, 0) + 1
    for (a, b), n in same.items():
        counts[np.ix_(np.frombuffer(a, left.dtype), np.frombuffer(b, left.dtype))] += n
    return counts


def similar(sizes: np.ndarray, counts: np.ndarray, threshold: float, others: np.ndarray | None = None) -> np.ndarray:
    """Where the Jaccard similarity reaches the threshold, from sizes and intersections."""
    union = sizes[:, None] + (sizes if others is None else others)[None, :] - counts
    return (counts >= threshold * union - 1e-9) & (counts > 0)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric relation."""
    edges, todo = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & todo)
            todo[new] = False
            edges += [(at, int(n)) for n in new]
            queue += new.tolist()
    return edges


def _grouped(source: Iterator[pa.RecordBatch], key: list[str], value: list[str]):
    """Runs of equal keys in sorted batches: key, and a list of values for each column."""
    now, rows = None, []
    for batch in slices(source):
        keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
        values = list(zip(*(_values(batch.column(v)) for v in value)))
        for k, v in zip(keys, values):
            if k != now:
                if rows:
                    yield now, list(zip(*rows))
                now, rows = k, []
            rows.append(v)
    if rows:
        yield now, list(zip(*rows))


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    flat = flat.view(np.uint32).astype(np.uint64) if flat.dtype == np.int32 else flat
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]


def bucket_edges(
    path: int, samples: list[np.ndarray], threshold: float, small: int, steps: int
) -> list[tuple[int, int, bool]]:
    """Edges that connect the similar members of a bucket, by their samples, and whether the second one is nearly
    equal to the first.

    Small buckets are compared throughout. In a large one, members much like a pivot are linked to it and
    settled; the others split by the shingles they choose next. Members that are connected already, by whatever way, need
    not be compared with each other, as an edge between them would connect nothing: once most are connected, only
    the few others are compared, with all.
    """
    low = MARGIN * threshold
    sizes = np.array([len(s) for s in samples])
    tokens, flat = np.unique(np.concatenate(samples), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    limits = np.array([_part(BRANCH * choice_rate(n, threshold)) for n in sizes.tolist()], np.uint64)
    marked, edges, seen = np.zeros(len(tokens), bool), [], set()
    parent = list(range(len(samples)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(i: int, j: int, alike: bool) -> None:
        """Take an edge that connects what was not connected yet, or says that the second member is settled."""
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
        if a != b or alike:
            edges.append((i, j, alike))

    def connected(members: np.ndarray) -> bool:
        first = root(int(members[0]))
        return all(root(i) == first for i in members[1:].tolist())

    def apart(members: np.ndarray) -> np.ndarray:
        """Places of the members that are not connected to most of them."""
        names, which, counts = np.unique([root(i) for i in members.tolist()], return_inverse=True, return_counts=True)
        return np.flatnonzero(which != counts.argmax())

    def shares(place: int, members: np.ndarray, own: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Similarity of the member at this place to each of them."""
        pivot = own[np.searchsorted(owner, place) : np.searchsorted(owner, place, "right")]
        marked[pivot] = True
        both = np.bincount(owner[marked[own]], minlength=len(members))
        marked[pivot] = False
        return both / (sizes[members] + len(pivot) - both)

    def compared(members: np.ndarray) -> None:
        if members.tobytes() in seen or connected(members):  # many paths lead to the same few
            return
        seen.add(members.tobytes())
        own = [samples[i] for i in members]
        if len(own) == 2:
            n = len(np.intersect1d(own[0], own[1], assume_unique=True))
            if n and n >= low * (len(own[0]) + len(own[1]) - n) - 1e-9:
                link(int(members[0]), int(members[1]), False)
        else:
            linked = similar(sizes[members], overlaps(own), low)
            for i, j in spanning(linked):
                link(int(members[i]), int(members[j]), False)

    def held(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their tokens one after the other, and whose each is."""
        owner = np.repeat(np.arange(len(members)), sizes[members])
        first = np.cumsum(sizes[members]) - sizes[members]
        return flat[np.repeat(bounds[members] - first, sizes[members]) + np.arange(len(owner))], owner

    todo = [(np.arange(len(samples)), np.uint64(path & 2**64 - 1), 0)]
    while todo:
        members, at, step = todo.pop()
        if len(members) <= small:
            if len(members) > 1:
                compared(members)
            continue
        own, owner = held(members)
        while len(members) > small:
            share = shares(0, members, own, owner)
            near = np.flatnonzero(share >= low)[1:]
            first = int(members[0])
            for j, alike in zip(members[near].tolist(), (share[near] >= SETTLED_FOR_ALL).tolist()):
                link(first, j, alike)
            stay = share < SETTLED
            stay[0] = False
            before, members = len(members), members[stay]
            own, owner = own[stay[owner]], (np.cumsum(stay) - 1)[owner[stay[owner]]]
            if len(members) > 0.95 * before:
                break
        if len(members) <= small:
            if len(members) > 1:
                compared(members)
        elif len(others := apart(members)) <= small:
            for place in others.tolist():
                for j in members[shares(place, members, own, owner) >= low].tolist():
                    link(int(members[place]), j, False)
        elif step == steps:  # no path splits these
            members = members[np.argsort([root(i) for i in members.tolist()], kind="stable")]
            for i in range(0, len(members), small):
                for j in range(i, len(members), small):
                    part = np.unique(np.concatenate([members[i : i + small], members[j : j + small]]))
                    compared(part)
        else:
            chosen = _mixed(tokens[own] ^ _mixed(np.array([at + np.uint64(step + 1)], np.uint64))) <= limits[members][owner]
            own, owner = own[chosen], owner[chosen]
            order = np.argsort(own, kind="stable")
            keys, starts, counts = np.unique(own[order], return_index=True, return_counts=True)
            for key, start, n in zip(keys, starts, counts):
                if n > 1:
                    todo.append((members[owner[order[start : start + n]]], _mixed(np.array([at ^ tokens[key]], np.uint64))[0], step + 1))
    return edges


def _edges_of(members: DataFrame, threshold: float, small: int, steps: int) -> DataFrame:
    """``a, b, alike``: edges that connect the similar members of buckets (``bucket, left, cls, sample``;
    members with ``left`` false are compared with the others, not with each other)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), (lefts, classes, samples) in _grouped(source, ["bucket"], ["left", "cls", "sample"]):
            if all(lefts):
                names, edges = classes, bucket_edges(bucket, samples, threshold, small, steps)
            else:
                a, b = ([i for i, left in enumerate(lefts) if left is side] for side in (True, False))
                own, others = [samples[i] for i in a], [samples[i] for i in b]
                sizes = [np.array([len(s) for s in x]) for x in (own, others)]
                whole = np.zeros((len(classes),) * 2, bool)
                whole[: len(a), len(a) :] = similar(sizes[0], overlaps(own, others), MARGIN * threshold, sizes[1])
                edges, names = [(*e, False) for e in spanning(whole | whole.T)], [classes[i] for i in a + b]
            if edges:
                columns = [pa.array([names[e[i]] for e in edges], pa.int64()) for i in (0, 1)]
                alike = pa.array([bool(e[2]) for e in edges], pa.bool_())
                yield pa.RecordBatch.from_arrays([*columns, alike], names=["a", "b", "alike"])

    rows = members.repartition("bucket").sortWithinPartitions("bucket", F.desc("left"), "cls")
    return rows.select("bucket", "left", "cls", "sample").mapInArrow(batches, "a long, b long, alike boolean")


def _blocks(rows: DataFrame, group: str, count: str, member: str) -> DataFrame:
    """Members of groups, repeated for every pair of blocks they are in: ``bucket, left`` and the rest.

    A group of up to BLOCK members is one bucket; a larger one has a bucket for each pair of its blocks."""
    n = F.ceil(F.col(count) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(11), member), n.cast("long")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda other: F.struct(F.least(F.col("_own"), other).alias("i"), F.greatest(F.col("_own"), other).alias("j")),
    )
    dealt = rows.withColumns({"_n": n, "_own": own}).withColumn("_pair", F.explode(pairs))
    bucket = F.struct(F.col(group).alias("group"), F.col("_pair.i").alias("i"), F.col("_pair.j").alias("j"))
    return dealt.withColumns({"bucket": bucket, "left": F.col("_own") == F.col("_pair.i")}).drop("_n", "_own", "_pair")


def _run_edges(sets: DataFrame, runs: range, threshold: float, small: int, task: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """``a, b, alike`` from some runs, and the classes whose buckets split."""
    smalls, fits, large, edges, deep = _buckets(sets, runs, threshold, small, task, steps)
    # Similar sets meet in most runs; of small buckets one of each membership is enough.
    members = smalls.distinct().select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("cls"))
    members = members.union(fits).withColumn("left", F.lit(True))
    if large is not None:
        members = members.union(_blocks(large, "key", "n", "cls").select(F.xxhash64("bucket").alias("bucket"), "cls", "left"))
    members = stored(members, "bucket-members")
    # Half of each hash tells the shingles of a bucket apart well enough to find candidates.
    halves = _samples(sets, members).withColumn("sample", F.transform("sample", lambda t: F.shiftright(t, 32).cast("int")))
    found = _edges_of(members.join(halves, "cls"), threshold, small, steps)
    return stored(reduce(DataFrame.union, edges, found).distinct(), "run-edges"), deep


def _candidate_groups(sets: DataFrame, threshold: float, recall: float, small: int, task: int, steps: int) -> DataFrame:
    """``node, component`` of classes that may be similar to another one."""
    runs, more = (runs_for(recall, depth, STILL_SHARED * SAMPLE) for depth in (1, DEPTH))
    edges, first_deep = _run_edges(sets, range(1, FIRST_RUNS + 1), threshold, small, task, steps)
    # A member is left out for a first member that stays in; the smaller one of a pair is the first one.
    alike = edges.where("alike").select("a", "b")
    settled = alike.join(alike.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("b").alias("cls")).distinct()
    others = stored(sets.join(stored(settled, "settled"), "cls", "left_anti"), "unsettled")
    later, deep = _run_edges(others, range(FIRST_RUNS + 1, runs + 1), threshold, small, task, steps)
    edges = edges.union(later)
    deep = stored(first_deep.union(deep).distinct(), "deep-classes")
    if not deep.isEmpty():
        others = stored(others.join(deep, "cls", "left_semi"), "deep-sets")
        edges = edges.union(_run_edges(others, range(runs + 1, more + 1), threshold, small, task, steps)[0])
    return components(edges, "a", "b")


# --- whole sets ---------------------------------------------------------------------------------


def _compared(members: DataFrame, threshold: float) -> DataFrame:
    """For every member of a bucket (``bucket, left, n, cls, copies, text``) the number of documents of
    other classes linked to it there, ``cls, label, other, links``. ``label`` is the smallest class it is connected to, if the bucket is a whole group;
    else there are edges ``cls, other`` as well (links 0) that connect what is similar."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(source, ["group", "i", "j"], ["cls", "left", "n", "copies", "text"]):
            # A repeated row brings its class again.
            rows = zip(*[row for i, row in enumerate(zip(*rows)) if not i or rows[0][i - 1] != row[0]])
            classes, lefts, group_sizes, copies, texts = rows
            sets = [shingles(t) for t in texts]
            sizes, weight = np.array([len(s) for s in sets]), np.array(copies, np.int64)
            a = [i for i, left in enumerate(lefts) if left]
            b = [i for i, left in enumerate(lefts) if not left]
            if b:
                linked = similar(sizes[a], overlaps([sets[i] for i in a], [sets[i] for i in b]), threshold, sizes[b])
                whole = np.zeros((len(sets),) * 2, bool)
                whole[: len(a), len(a) :] = linked
                whole |= whole.T
            else:
                whole = similar(sizes, overlaps(sets), threshold)
                np.fill_diagonal(whole, False)
            links, edges = (whole @ weight).tolist(), spanning(whole)
            if group_sizes[0] <= BLOCK:
                # Trees are listed from their roots, and members by class: the root is the smallest.
                root = list(range(len(classes)))
                for x, y in edges:
                    root[y] = root[x]
                columns = [list(classes), [classes[r] for r in root], [None] * len(classes), links]
            else:
                columns = [
                    list(classes) + [classes[x] for x, _ in edges], [None] * (len(classes) + len(edges)),
                    [None] * len(classes) + [classes[y] for _, y in edges], links + [0] * len(edges),
                ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cls", "label", "other", "links"])

    rows = members.select(F.col("bucket.group"), F.col("bucket.i"), F.col("bucket.j"), "left", "n", "cls", "copies", "text")
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", F.desc("left"), "cls")
    return rows.mapInArrow(batches, "cls long, label long, other long, links long")


def _classes(
    docs: DataFrame,
    *,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    id_column: str = "doc_id",
    text_column: str = "text",
    small: int = SMALL,
    task: int = TASK,
    steps: int = STEPS,
) -> DataFrame:
    """``near_duplicates`` with ``text_hash``, and ``class_key``, which tells classes apart even if ids repeat."""
    text = text_of(text_column)
    every = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = every.where("id is not null")
    documents = stored(_sets(rows, threshold), "shingle-sets")
    digest = ["size", "h1", "h2"]
    classes = documents.groupBy(*digest).agg(
        F.min(F.struct("id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("sample").alias("sample")
    )
    classes = stored(classes.select(*digest, "first.id", "first.text_hash", "copies", "sample"), "shingle-classes")
    # Classes go by their smallest id; where an id stands for several texts, the others by a hash.
    apart = not classes.groupBy("id").count().where("count > 1").isEmpty()
    if not apart:
        classes = classes.withColumn("cls", F.col("id"))
    else:
        place = F.row_number().over(W.partitionBy("id").orderBy(*digest))
        classes = classes.withColumn("cls", F.when(place == 1, F.col("id")).otherwise(F.xxhash64("id", *digest)))
        classes = stored(classes, "classes-apart")
    sets = classes.where("size > 0").select("cls", "sample")
    groups = stored(_candidate_groups(sets, threshold, recall, small, task, steps), "candidate-groups")
    sized = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wanted = groups.join(sized, "component").withColumnRenamed("node", "cls")
    wanted = stored(wanted.join(classes.select("cls", "id", "text_hash", "copies"), "cls"), "candidates")
    # Texts of classes with candidates only, one row of each class.
    texts = likely(rows, F.xxhash64("id", "text_hash"), wanted, F.xxhash64("id", "text_hash"))
    if not documents.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "text_hash"])
    blocks = _blocks(wanted, "component", "n", "cls").join(texts, ["id", "text_hash"])
    compared = stored(_compared(blocks, threshold), "compared")
    found = compared.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    edges = compared.where("other is not null")
    if not edges.isEmpty():
        joined = components(edges, "cls", "other").withColumnRenamed("node", "cls")
        found = found.join(joined, "cls", "left").withColumn("label", F.coalesce("label", "component")).drop("component")
    named = classes.select(*digest, "id", "cls", "copies").join(found, "cls", "left")
    named = named.withColumn("class_key", F.coalesce("label", "cls"))
    if apart:  # a class's key need not be an id
        smallest = named.groupBy("class_key").agg(F.min("id").alias("class_id"))
        named = named.join(smallest, "class_key")
    else:
        named = named.withColumn("class_id", F.col("class_key"))
    named = named.select(
        *digest, F.col("id").alias("copy_id"), "copies", "class_id", "class_key",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"),
    )
    found = salted_join(documents.select("id", "text_hash", *digest), stored(named, "classes-named"), digest, "n", ["id", "text_hash"])
    found = found.select("id", "text_hash", "copy_id", "copies", "class_id", "class_key", "n_links")
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    alone = every.where("id is null").select(
        "id", "text_hash", none.alias("copy_id"), one.alias("copies"), none.alias("class_id"), none.alias("class_key"), (one - 1).alias("n_links")
    )
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row: ``id, copy_id, copies, class_id, n_links``.

    ``copy_id`` is the smallest id with an equal shingle set, ``copies`` how many rows have it; ``class_id`` is the
    smallest id that links of similarity ``threshold`` or more lead to; ``n_links`` counts the other rows
    of that similarity, copies included. Each link is found with a probability of at least ``recall``.

    Null texts count as empty; texts without words are copies of each other and similar to nothing else. Texts of
    fewer than five words are one shingle. Repeated rows are copies. Rows without an id are
    next to nothing, have no class, and change nothing for others. No rows give no rows; other columns are not read; whole texts are compared.
    """
    return _classes(docs, **options).select("id", "copy_id", "copies", "class_id", "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest id, all columns as they are.

    Of repeated rows one stays; rows without an id all stay.
    """
    found = stored(_classes(docs, **options).select("id", "text_hash", "class_key"), "classes")
    place = F.struct("id", "text_hash")
    kept = found.where("id is not null").groupBy("class_key").agg(F.min(place).alias("kept")).select("kept.*")
    rows = packed(docs, id=F.col("doc_id"), text_hash=F.xxhash64(text_of("text")))
    named = rows.where("id is not null")
    if not found.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["id", "text_hash"])
    stay = named.join(kept, ["id", "text_hash"], "left_semi")
    return unpacked(stay.select("_row").unionByName(rows.where("id is null").select("_row")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_jaccard_join": op10}
