"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

A candidate is a run of encoding characters with letters and digits. By its characters an
encoding is inferred, and three tests ask whether its symbols look drawn at random from that alphabet:
chi-squared for uniformity, runs above and below the middle, and serial correlation. Fisher's method makes one
p-value of them.

Random strings have uniform p-values; names and words pile up near 0, but the shorter a string, the
less the tests can tell. So the threshold is set for each encoding and length class, from counts over
the whole corpus: p-values above one half estimate how many candidates are random (Storey, 2002), and the
smallest threshold is taken beyond which the estimated share of others is at most ``rate``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, text_of

# The patterns of the base scan and the kinds of spans, in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS = 6, 20
ASSIGN_WORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets in the order they are tried, each with what a string needs besides to be taken for it.
ENCODINGS = {
    "hex": (DIGITS + "abcdef", 2),
    "hex_upper": (DIGITS + "ABCDEF", 2),
    "base32": (UPPER + "234567", 2),
    "base36": (DIGITS + LOWER, 2),
    "base64": (UPPER + LOWER + DIGITS + "+/", 3),
    "base64url": (UPPER + LOWER + DIGITS + "-_", 3),
}
PLACES = [{c: i for i, c in enumerate(alphabet)} for alphabet, _ in ENCODINGS.values()]
BINS = 50
#: Longer strings are tested each time they occur; what is remembered stays small.
REMEMBERED_CHARS = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # A run is taken whole, so asking for 24 characters or dropping shorter runs is the same.
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(symbols: list[int], size: int) -> float:
    """p-value of uniformity over as many equal parts of the alphabet as the length allows."""
    n = len(symbols)
    parts = max(2, min(size, n // 5))
    counts = Counter(s * parts // size for s in symbols)
    widths = Counter(s * parts // size for s in range(size))
    statistic = sum((counts[p] - n * w / size) ** 2 / (n * w / size) for p, w in widths.items())
    free = parts - 1
    z = ((statistic / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))  # Wilson-Hilferty
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(symbols: list[int], size: int) -> float:
    """p-value of the number of runs in the upper and the lower half of the alphabet."""
    high = [s * 2 >= size for s in symbols]
    n, up = len(high), sum(high)
    down = n - up
    if not up or not down:
        return 2.0 ** (1 - n)
    count = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * up * down / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((count - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def serial_correlation(symbols: list[int]) -> float:
    """p-value of the correlation of symbols with the next ones."""
    n = len(symbols)
    mean = sum(symbols) / n
    total = sum((s - mean) ** 2 for s in symbols)
    if not total:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(symbols, symbols[1:])) / total
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def combined(p_values: list[float]) -> float:
    """Fisher's method."""
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)
    term, total = 1.0, 1.0
    for k in range(1, len(p_values)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def tested(string: str) -> tuple[int, float] | None:
    """Inferred encoding and p-value of a candidate; None if it has no letters or no digits."""
    return _remembered(string) if len(string) <= REMEMBERED_CHARS else _tested(string)


def _tested(string: str) -> tuple[int, float] | None:
    classes = [any(c in own for c in string) for own in (DIGITS, LOWER, UPPER)]
    if not classes[0] or not any(classes[1:]):
        return None
    for encoding, (place, (alphabet, needed)) in enumerate(zip(PLACES, ENCODINGS.values())):
        if all(c in place for c in string):
            if sum(classes) < needed:
                return None
            symbols = [place[c] for c in string]
            p = combined([chi_squared(symbols, len(alphabet)), runs(symbols, len(alphabet)), serial_correlation(symbols)])
            return encoding, p
    return None


_remembered = lru_cache(100_000)(_tested)


def length_class(n: int) -> int:
    return int(2 * math.log2(n))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """Start, end, encoding and p-value of candidates that lie in no base span."""
    found, at = [], 0
    for match in CANDIDATE.finditer(text):
        result = tested(match.group())
        if result is None:
            continue
        start, end = match.span()
        while at < len(base) and base[at][1] < start and base[at][1] < end:
            at += 1
        if not any(a <= start and end <= b for a, b, _ in base[at:] if a <= start):
            found.append((start, end, *result))
    return found


def thresholds(counts: dict[tuple[int, int, int], int], rate: float) -> dict[tuple[int, int], float]:
    """For each encoding and length class the smallest p-value from which candidates are reported,
    from counts by encoding, length class and p-value bin."""
    strata: dict[tuple[int, int], list[int]] = {}
    for (encoding, length, place), n in counts.items():
        strata.setdefault((encoding, length), [0] * BINS)[min(place, BINS - 1)] += n
    found = {}
    for stratum, bins in strata.items():
        # One more, since few candidates say little: a single random one is then found like one of many.
        random = 2 * sum(bins[BINS // 2 :]) + 1
        for cut in range(1, BINS):
            above = sum(bins[cut:])
            if above and 1 - min(1.0, random * (1 - cut / BINS) / above) <= rate:
                found[stratum] = cut / BINS
                break
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans])


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rate: float = 0.05) -> DataFrame:
    """One row per row: ``id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind; ``spans``
    has those of the base patterns and, as kind ``random``, candidates that the tests let through
    and that no base span holds; ``base_sha256`` digests the base spans alone. Null texts count as
    empty and have no spans (the digest of an empty text). Repeated rows are scanned one by one, and count
    one by one for the thresholds. No rows give no rows; other columns are not read.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            base, odd = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text)
                base.append(own)
                odd.append(candidates(text, own))
            arrays = [
                batch.column(0),
                *[pa.array([sum(s[2] == kind for s in own) for own in base], pa.int64()) for kind in range(3)],
                pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own in base], pa.string()),
                pa.array([[dict(zip(("start", "end", "kind"), s)) for s in own] for own in base], span_type),
                pa.array([[dict(zip(("start", "end", "encoding", "p"), s)) for s in own] for own in odd], odd_type),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    whole = pa.int32()
    span_type = pa.list_(pa.struct([("start", whole), ("end", whole), ("kind", whole)]))
    odd_type = pa.list_(pa.struct([("start", whole), ("end", whole), ("encoding", whole), ("p", pa.float64())]))
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "odd"]
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string"
    spans = "array<struct<start: int, end: int, kind: int>>"
    odd_spans = "array<struct<start: int, end: int, encoding: int, p: double>>"
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    scanned = stored(rows.mapInArrow(batches, f"{schema}, base {spans}, odd {odd_spans}"), "secret-spans")

    # At most encodings x length classes x bins rows.
    each = scanned.select(F.explode("odd").alias("o"))
    length = F.floor(2 * F.log2((F.col("o.end") - F.col("o.start")).cast("double"))).cast("int")
    place = F.floor(F.col("o.p") * BINS).cast("int")
    counted = each.groupBy(F.col("o.encoding").alias("e"), length.alias("l"), place.alias("b")).count().collect()
    cuts = thresholds({(r["e"], r["l"], r["b"]): r["count"] for r in counted}, rate)

    def reported(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = []
            for base, odd in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                spans = [(s["start"], s["end"], s["kind"]) for s in base]
                spans += [
                    (s["start"], s["end"], 3) for s in odd
                    if s["p"] >= cuts.get((s["encoding"], length_class(s["end"] - s["start"])), 2.0)
                ]
                texts.append(_joined(sorted(spans, key=lambda s: (s[0], s[2]))))
            arrays = [*batch.columns[:5], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names[:5], "spans"])

    return scanned.mapInArrow(reported, f"{schema}, spans string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_secret_scan": op9}
