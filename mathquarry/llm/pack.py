"""Problem 7: filling containers of fixed capacity by exact-complement hashing.

The plan is made on the histogram of lengths, which has at most ``capacity``
rows however many items there are.  For every length, longest first, the gap it
leaves is looked up among the lengths, their pair sums and their triple sums;
combinations that fill it exactly are consumed as often as the available counts
allow.  What is left goes best-fit into the smallest gap that holds it.  Items
then get their container by their rank within their length, which needs no
group in one task: ranks are counted per bucket and offset by prefix sums.

Defined cases: an item over the capacity is cut into full containers and a
rest; null and negative lengths count as 0; items of length 0 are spread over
the containers behind the others; no items, no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SLOT = T.StructType([T.StructField(c, T.LongType(), False) for c in ("size", "lo", "hi", "per", "first", "place", "start")])


def exact_patterns(counts: np.ndarray, capacity: int, most: int = 4) -> list[tuple[int, list[int]]]:
    """Consume exact combinations of up to ``most`` lengths (4 at most) from ``counts`` (changed in place)."""
    plan: list[tuple[int, list[int]]] = []

    def take(parts: list[int]) -> bool:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        m = min(int(counts[p]) // k for p, k in need.items())
        if m <= 0:
            return False
        for p, k in need.items():
            counts[p] -= m * k
        plan.append((m, sorted(parts, reverse=True)))
        return True

    sums: np.ndarray | None = None  # sums[s]: some pair of available lengths has the sum s
    for size in range(capacity, 0, -1):
        while counts[size] > 0:
            gap = capacity - size
            if gap == 0:
                take([size])
                break
            before = counts > 0
            found = most >= 2 and counts[gap] > 0 and take([size, gap])
            if not found and most >= 3:
                found = _pair(counts, gap, lambda a, b: take([size, a, b]))
            if not found and most >= 4:
                if sums is None:
                    have = before.astype(np.float32)
                    n = 2 * len(have)
                    spectrum = np.fft.rfft(have, n)
                    sums = np.fft.irfft(spectrum * spectrum, n)[: capacity + 1] > 0.5
                thirds = np.flatnonzero(before[1:gap]) + 1
                for c in thirds[sums[gap - thirds]][::-1].tolist():
                    if _pair(counts, gap - c, lambda a, b: take([size, a, b, c])):
                        found = True
                        break
            if not found:
                break
            if not np.array_equal(before, counts > 0):
                sums = None
    return plan


def _pair(counts: np.ndarray, total: int, take) -> bool:
    a = np.arange(1, total // 2 + 1)
    hits = a[(counts[a] > 0) & (counts[total - a] > 0)]
    return any(take(int(x), int(total - x)) for x in hits[::-1])


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over what is left, whole groups of equal containers at a time."""
    open_by_gap: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    done: list[tuple[int, list[int]]] = []
    gaps = np.zeros(capacity + 1, dtype=bool)
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        counts[size] = 0
        while left:
            fits = np.flatnonzero(gaps[size:])
            if not len(fits):
                per = capacity // size
                full, rest = divmod(left, per)
                for n, k in ((full, per), (1, rest)):
                    if n and k:
                        gap = capacity - k * size
                        (open_by_gap[gap].append((n, [size] * k)) if gap else done.append((n, [size] * k)))
                        gaps[gap] = gap > 0
                break
            gap = size + int(fits[0])
            n, parts = open_by_gap[gap].pop()
            used = min(n, left)
            if n > used:
                open_by_gap[gap].append((n - used, parts))
            gaps[gap] = bool(open_by_gap[gap])
            rest, new = gap - size, (used, [*parts, size])
            if rest:
                open_by_gap[rest].append(new)
                gaps[rest] = True
            else:
                done.append(new)
            left -= used
    return done + [g for groups in open_by_gap.values() for g in groups]


def _fewest(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Exact combinations, then best fit.  Where few items have many lengths, combinations of many parts use up
    the small items that would fill gaps later; so the number of parts is the one that needs the fewest containers."""
    plans = []
    for most in (4, 3, 2, 1):
        left = counts.copy()
        plans.append(exact_patterns(left, capacity, most) + best_fit(left, capacity))
    return min(plans, key=lambda plan: sum(n for n, _ in plan))


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Rows (size, lo, hi, per, first, place, start): the items of that size with rank lo <= r < hi lie
    in container first + (r - lo) // per at place + (r - lo) % per; their tokens begin at start."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        counts[size] = n
    zeros, counts[0] = int(counts[0]), 0
    groups = _fewest(counts, capacity)
    total = sum(n for n, _ in groups)
    if zeros and not total:
        total = -(-zeros // capacity)
        groups = [(total, [])]
    per_zero = -(-zeros // total) if total else 0
    rank: dict[int, int] = defaultdict(int)
    slots, first = [], 0
    for n, parts in groups:
        place = start = 0
        for size in sorted(set(parts), reverse=True):
            k = parts.count(size)
            slots.append((size, rank[size], rank[size] + n * k, k, first, place, start))
            rank[size] += n * k
            place += k
            start += k * size
        if rank[0] < zeros:
            hi = min(zeros, rank[0] + n * per_zero)
            slots.append((0, rank[0], hi, per_zero, first, place, start))
            rank[0] = hi
        first += n
    return slots


def ranks_within(df: DataFrame, key: str, *order: str) -> DataFrame:
    """0-based ``rank`` of each row among those with its ``key``, without gathering a key's rows in one task."""
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(key, "bucket").count().select(key, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy(key, "bucket").orderBy(*order)).cast("long") - 1
    return df.withColumn("own", own).join(offsets, [key, "bucket"]).withColumn("rank", F.col("own") + F.col("offset")).drop("own", "offset", "bucket")


def pack(lengths: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, container, place, start, n_tokens) for items (doc_id, n_tokens).

    ``piece`` numbers the cuts of an item over the capacity, ``start`` is the
    position of the piece's first token in its container.  ``lengths`` is read
    more than once and should be a stored table.
    """
    spark = lengths.sparkSession
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long")
    items = lengths.select("doc_id", n.alias("n"))
    full, rest = F.floor(F.col("n") / capacity).cast("int"), F.pmod(F.col("n"), F.lit(capacity))
    sizes = F.concat(F.array_repeat(F.lit(capacity).cast("long"), full), F.when((rest > 0) | (F.col("n") == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    pieces = items.select("doc_id", F.posexplode(sizes).alias("piece", "n_tokens"))
    # at most capacity + 1 rows
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    # One row for each group of equal containers and length: bounded by the number of lengths, not of items.
    slots = spark.createDataFrame(plan_slots(histogram, capacity), SLOT)
    ranked = ranks_within(pieces, "n_tokens", "doc_id", "piece")
    at = F.col("rank") - F.col("lo")
    inside = F.pmod(at, F.col("per"))
    return ranked.join(F.broadcast(slots), (F.col("n_tokens") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "piece", (F.col("first") + F.floor(at / F.col("per"))).cast("long").alias("container"), (F.col("place") + inside).cast("long").alias("place"),
        (F.col("start") + inside * F.col("n_tokens")).cast("long").alias("start"), "n_tokens",
    )
