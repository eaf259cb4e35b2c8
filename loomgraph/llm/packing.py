"""Filling containers of fixed capacity: histogram packing by non-negative least squares.

Only the histogram of item lengths matters for the plan, and it has at most ``capacity`` entries whatever the
number of items. Shallow patterns (up to DEPTH different lengths, each repeated no more than there are items) whose
total lies in the window just below the capacity are enumerated; non-negative least squares, solved to convergence, finds
how often to use each so that the histogram is met; the counts are rounded with the residue carried to the next pattern,
and the same is done again with what is left while that fills containers. The rest is packed greedily, longest first,
again as patterns with repeat counts. The items are then numbered within each length by distributed prefix sums and look up their
container in the plan.

Defined results
 * An item longer than the capacity is cut into full pieces, each in a container of its own, and a remainder that
   is packed like any item; no other item is cut. piece_no counts from 0.
 * Items of no tokens (null or empty texts) take no space and go to container 0.
 * Capacities below 1 or null are left out. Repeated rows are items of their own; ids may repeat.
 * An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import prefix_sums
from ..session import cut

DEPTH = 6
#: Patterns fill the capacity up to this share of it; the solver stops when no repeat count moves by more than this part of
#: the largest count.
WINDOW, MOVED = 0.001, 1e-3


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Shallow patterns ((length, repeats), ...) in the window below the capacity, longest length first: each length, once
    or as often as it goes, with several partners, and then the longest that fit until the window is reached."""
    lengths = sorted(histogram)
    slack = max(1, int(capacity * WINDOW))
    common = sorted(lengths, key=lambda x: -histogram[x] * x)
    found: dict[tuple, None] = {}

    def largest(space: int, head: dict[int, int]) -> int:
        i = bisect_right(lengths, space)
        while i and lengths[i - 1] in head:
            i -= 1
        return lengths[i - 1] if i else 0

    for k, a in enumerate(lengths):
        most = min(histogram[a], capacity // a)
        for times in {1, (most + 1) // 2, most}:
            rest = capacity - times * a
            for b in {0, largest(rest, {a: 1}), largest(rest // 2, {a: 1}), common[k % len(common)], common[(7 * k + 3) % len(common)]}:
                head, space = {a: times}, rest
                if b == a or b > rest:
                    continue
                if b:
                    head[b] = min(histogram[b], rest // b)
                    space -= head[b] * b
                while space > slack and len(head) < DEPTH and (c := largest(space, head)):
                    head[c] = min(histogram[c], space // c)
                    space -= head[c] * c
                if space <= slack:
                    found[tuple(sorted(head.items(), reverse=True))] = None
    return list(found)


def solve(columns: list[tuple[tuple[int, int], ...]], histogram: dict[int, int]) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeat counts x >= 0 that bring the patterns' lengths
    closest to the histogram, each length weighted by its tokens. Every step lowers a convex sum, so it converges."""
    index = {length: i for i, length in enumerate(histogram)}
    left = [float(n) for n in histogram.values()]
    cells = [[(index[a], float(n), a * float(n)) for a, n in p] for p in columns]
    norms = [sum(n * w for _, n, w in c) for c in cells]
    x = [0.0] * len(columns)
    moved, least = 1.0, MOVED * max(left, default=1.0)
    while moved >= least:
        moved = 0.0
        for k, c in enumerate(cells):
            step = max(-x[k], sum(w * left[i] for i, _, w in c) / norms[k])
            if step:
                x[k] += step
                for i, n, _ in c:
                    left[i] -= step * n
                moved = max(moved, abs(step))
    return np.array(x)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(pattern, containers) pairs that use every item of the histogram exactly once. Lengths from 1 to capacity."""
    left = {length: n for length, n in sorted(histogram.items(), reverse=True) if n > 0}
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if not left:
        return out

    def use(pattern, times) -> int:
        times = min([times, *[left[a] // n for a, n in pattern]])
        if times > 0:
            out.append((pattern, times))
            for a, n in pattern:
                left[a] -= n * times
        return max(times, 0)

    filled = 1
    while filled:
        filled, carried = 0, 0.0
        there = {a: n for a, n in left.items() if n}
        columns = patterns(there, capacity) if there else []
        x = solve(columns, there)
        for k in np.argsort(-x, kind="stable"):
            wanted = x[k] + carried
            times = use(columns[k], int(wanted + 1e-9))
            carried, filled = wanted - times, filled + times
    lengths = sorted(a for a, n in left.items() if n)
    while lengths:  # greedy: the longest item, then always the longest that still fits
        pattern, space, at = [], capacity, len(lengths)
        while (at := min(at, bisect_right(lengths, space))) > 0:
            at -= 1
            a = lengths[at]
            n = min(space // a, left[a])
            pattern.append((a, n))
            space -= n * a
        use(tuple(pattern), min(left[a] // n for a, n in pattern))
        for a, _ in pattern:
            if not left[a]:
                del lengths[bisect_left(lengths, a)]
    return out


def lookup(histogram: dict[int, int], capacity: int, first: int = 0) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """({length: [(first item number, first container, items a container)]}, containers). Bounded by the plan, whose
    patterns are at most the solver's columns and one greedy pattern for each length that runs out."""
    at: dict[int, int] = defaultdict(int)
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    container = first
    for pattern, times in plan(histogram, capacity):
        for a, n in pattern:
            table[a].append((at[a], container, n))
            at[a] += n * times
        container += times
    return dict(table), container


PACKED = "container_kind string, container_id long, doc_id long, piece_no int, n_tokens long"


def pack(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """sized: (doc_id, n_tokens); limits: (container_kind, capacity_tokens), a fixed table of a few rows that is brought back whole. Returns PACKED: every
    item, or piece of an oversized one, with its container."""
    kinds = {r[0]: int(r[1]) for r in limits.select("container_kind", "capacity_tokens").distinct().collect() if r[0] is not None and r[1] and r[1] >= 1}
    if not kinds:
        return sized.sparkSession.createDataFrame([], PACKED)
    sized = cut(sized.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long")))
    capacity = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    items = sized.withColumn("container_kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("cap", capacity[F.col("container_kind")].cast("long"))
    cap, n = F.col("cap"), F.col("n_tokens")
    whole = F.when(n > cap, F.expr("n_tokens div cap")).otherwise(F.lit(0)).cast("int")  # full pieces
    rest = n - whole * cap
    groups = items.select("container_kind", "doc_id", "cap", whole.alias("whole"), rest.alias("rest"), n.alias("size"))
    # one histogram row for each (kind, length), at most the sum of the capacities
    counted = groups.groupBy("container_kind", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("w")).collect()
    histograms: dict[str, dict[int, int]] = {k: {} for k in kinds}
    fulls: dict[str, int] = dict.fromkeys(kinds, 0)
    for r in counted:
        fulls[r["container_kind"]] += r["w"]
        if r["rest"] > 0:
            histograms[r["container_kind"]][r["rest"]] = r["n"]
    tables, used = {}, {}
    for k in sorted(kinds):
        tables[k], used[k] = lookup(histograms[k], kinds[k])
    held = sized.sparkSession.sparkContext.broadcast(tables)  # bounded by the capacities
    keyed = groups.withColumn("bin", F.concat_ws(":", "container_kind", F.lpad(F.col("rest").cast("string"), 12, "0")))
    placed = prefix_sums(keyed.withColumn("h", F.xxhash64("doc_id")), "bin", ["h", "doc_id"], "rest")

    def run(batches):
        schema = pa.schema([("container_kind", pa.string()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_tokens", pa.int64())])
        known: dict = {}
        for b in batches:
            kinds, (whole, rest_, row) = b.column(0).to_pylist(), (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            container, kept = np.zeros(len(kinds), np.int64), np.ones(len(kinds), bool)
            ends = np.append(np.flatnonzero((rest_[1:] != rest_[:-1]) | np.array([x != y for x, y in zip(kinds[1:], kinds)], bool)) + 1, len(kinds))
            at = 0
            for end in ends if len(kinds) else ():  # rows of one kind and length lie together
                here, key = slice(at, int(end)), (kinds[at], int(rest_[at]))
                at = int(end)
                if not key[1]:
                    kept[here] = whole[here] == 0
                    continue
                if key not in known:
                    known[key] = np.array(held.value[key[0]][key[1]]).T
                first, base, each = known[key]
                k = np.searchsorted(first, row[here], side="right") - 1
                container[here] = base[k] + (row[here] - first[k]) // each[k]
            columns = [b.column(0), pa.array(container), b.column(1), pa.array(whole, pa.int32()), b.column(3)]
            yield pa.record_batch(columns, schema=schema).filter(pa.array(kept))

    packed = placed.select("container_kind", "doc_id", "whole", "rest", "_row").mapInArrow(run, PACKED)
    if not any(fulls.values()):
        return packed
    over = groups.where("whole > 0").withColumn("id", F.xxhash64("doc_id"))
    numbered = prefix_sums(over, "container_kind", ["id", "doc_id"], "whole")
    base = F.create_map(*[F.lit(v) for pair in used.items() for v in pair])
    pieces = numbered.select("container_kind", "doc_id", "cap", "_before", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece_no"))
    full = pieces.select("container_kind", (base[F.col("container_kind")] + F.col("_before") + F.col("piece_no")).cast("long").alias("container_id"), "doc_id", "piece_no", F.col("cap").alias("n_tokens"))
    return packed.unionByName(full)


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per kind: items, containers, the least number any packing needs, and the share of the space that is used."""
    tokens, cap = F.sum("n_tokens"), F.max("capacity_tokens")
    kinds = limits.select("container_kind", "capacity_tokens").distinct()
    # containers are numbered without gaps, so their number needs no distinct
    return packed.join(kinds, "container_kind").groupBy("container_kind", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_items"), (F.max("container_id") + 1).alias("n_containers"), F.ceil(tokens / cap).alias("least_containers"),
        F.round(tokens / (cap * (F.max("container_id") + 1)), 6).alias("used_share"),
    )
