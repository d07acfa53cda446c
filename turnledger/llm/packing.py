"""Items of varying length in containers of fixed capacity.

One histogram of item lengths over all groups gives, by dynamic programming, the length buckets that would be padded
least. Inside each bucket, longest first, batches form up to the container's token budget, and what a batch leaves
free is filled from the shorter lengths by an exact subset sum. Planning works on the histogram of a group (lengths
and counts), never on its items, so it takes as long for a group of a third of all rows as for a small one; one plan
row places a whole range of equal items. Plans with more and more buckets are made until one needs no more containers
than any packing must, and the best is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import written

#: Numbers of buckets that are tried, in this order.
BUCKETS = (12, 24, 48, 96, 192, 384)
#: Ranks of equal items whose plan rows are looked up together.
BLOCK = 4096
#: Equal items of one group that are numbered in one task.
RANKED = 500_000


def length_buckets(lengths: list[int], counts: list[int], k: int) -> tuple[list[int], int]:
    """Upper bounds of at most k buckets over ascending lengths, and the least padding they allow.

    The padded size of a bucket is its bound times its items, so a layer is a lower envelope of lines over ascending
    lengths: O(k * lengths).
    """
    n = len(lengths)
    if not n:
        return [], 0
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    infinite = float("inf")
    best: list[float] = [0] + [infinite] * n
    choice: list[list[int]] = []
    for _ in range(min(k, n)):
        now, made = [infinite] * (n + 1), [0] * (n + 1)
        now[0] = 0
        hull: list[int] = []
        head = 0

        def above(a: int, b: int, c: int, best=best) -> bool:
            """Line b nowhere lies under both a and c (slopes fall)."""
            return (best[c] - best[a]) * (before[b] - before[a]) <= (best[b] - best[a]) * (before[c] - before[a])

        for j in range(1, n + 1):
            i = j - 1
            if best[i] < infinite:
                while len(hull) - head >= 2 and above(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and best[hull[head + 1]] - x * before[hull[head + 1]] <= best[hull[head]] - x * before[hull[head]]:
                head += 1
            if len(hull) > head:
                i = hull[head]
                now[j], made[j] = best[i] + x * (before[j] - before[i]), i
        choice.append(made)
        best = now
        # fewer buckets are never better, so the last layer holds the least
    bounds, j = [], n
    for made in reversed(choice):
        if j:
            bounds.append(lengths[j - 1])
            j = made[j]
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    return bounds[::-1], int(best[n] - total)


def _fill(free: int, left: dict[int, int], order: list[int]) -> list[tuple[int, int]]:
    """(length, how many) from what is left, to fill the free space as far as it can be; order: lengths, longest first."""
    usable = [x for x in order if x <= free and left[x]]
    if not usable:
        return []
    limit = (1 << (free + 1)) - 1
    reach, steps = 1, []
    for x in usable:
        n, step = min(free // x, left[x]), 1
        while n:
            take = min(step, n)
            steps.append((x, take, reach))
            reach |= (reach << (x * take)) & limit
            n -= take
            step *= 2
        if reach >> free:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for x, take, was in reversed(steps):
        if not (was >> at) & 1:
            at -= x * take
            used[x] = used.get(x, 0) + take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int, bounds: list[int] | None) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan rows and the number of containers. bounds: the buckets; None for one per length.

    Row (length, first rank, items, items per container, first container, offset): the item of rank r lies in container
    first + (r - first rank) // per container at offset + (r - first rank) % per container * length.
    """
    left = dict(sorted(histogram.items(), reverse=True))
    order = list(left)
    used = dict.fromkeys(order, 0)
    buckets: list[list[int]] = []
    cuts = sorted(bounds, reverse=True) if bounds else order
    for i, bound in enumerate(cuts):
        low = cuts[i + 1] if i + 1 < len(cuts) else 0
        buckets.append([x for x in order if low < x <= bound])
    rows, containers = [], 0
    for bucket in buckets:
        while any(left[x] for x in bucket):
            batch: list[tuple[int, int]] = []
            free = capacity
            for x in bucket:
                n = min(left[x], free // x)
                if n:
                    batch.append((x, n))
                    free -= n * x
            for x, n in batch:
                left[x] -= n
            more = _fill(free, left, order)
            for x, n in batch:
                left[x] += n
            both: dict[int, int] = {}
            for x, n in [*batch, *more]:
                both[x] = both.get(x, 0) + n
            times = min(left[x] // n for x, n in both.items())
            offset = 0
            for x, n in both.items():
                rows.append((x, used[x], n * times, n, containers, offset))
                left[x] -= n * times
                used[x] += n * times
                offset += n * x
            containers += times
        order = [x for x in order if left[x]]
    return rows, containers


def least_containers(histogram: dict[int, int], capacity: int) -> int:
    """A bound no packing can beat: by tokens, and by items of which no two (or no two of a longer and a shorter kind) fit
    together. For each k: items over capacity - k stand alone, those from there down to over half too (but may take
    smaller ones in), and the rest from k up needs what room these leave, or more."""
    x = np.array(sorted(histogram), dtype=np.int64)
    n = np.array([histogram[v] for v in x.tolist()], dtype=np.int64)
    items, tokens = (np.concatenate([[0], np.cumsum(v)]) for v in (n, n * x))
    best = -(-int(tokens[-1]) // capacity)
    half = int(np.searchsorted(x, capacity // 2, "right"))  # from here on over half
    k = np.append(x[:half], 0)
    top = np.maximum(half, np.searchsorted(x, capacity - k, "right"))  # from here on over capacity - k
    room = capacity * (items[top] - items[half]) - (tokens[top] - tokens[half])
    small = tokens[half] - tokens[np.searchsorted(x[:half], k, "left")]
    bounds = items[-1] - items[half] + np.maximum(0, -((room - small) // capacity))
    return max(best, int(bounds.max()))


def _planner(boundaries: dict[int, list[int]]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["capacity"].iloc[0])
        histogram = dict(zip(rows["length"].tolist(), rows["n"].tolist(), strict=True))
        least, best = least_containers(histogram, capacity), None
        for k in BUCKETS:
            made = plan(histogram, capacity, sorted({min(b, capacity) for b in boundaries[k]} | {capacity}))
            if best is None or made[1] < best[1]:
                best = made
            if best[1] <= least:
                break
        out = pd.DataFrame(best[0], columns=["length", "rank", "items", "per", "container", "offset"])
        out.insert(0, "group", rows["group"].iloc[0])
        return out

    return run


def pieces_of(df: DataFrame) -> DataFrame:
    """(group, item, size, capacity) to pieces: whole items, or full containers and a rest for those above the capacity."""
    count = F.ceil(F.col("size") / F.col("capacity")).cast("int")
    cut = df.select("group", "item", "size", "capacity", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * F.col("capacity")
    return cut.select("group", "item", "capacity", "piece", start.alias("start"), F.least(F.col("capacity"), F.col("size") - start).cast("bigint").alias("length"))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that takes null for a value, without the right side's keys."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, same, how).drop(*(f"__{c}" for c in on))


def pack(items: DataFrame) -> DataFrame:
    """items (group, item, size, capacity) to group, container, offset, item, piece, start, length.

    Containers count from 0 in each group; start is where the piece begins in its item. Items of null size or no
    token, and groups without a capacity of at least 1, take no part (they cannot be placed); items longer than the
    capacity are cut, others never. A null group is a group of its own.
    Items must be distinct in their group; equal lengths are told apart by item, then
    piece. An empty table gives no rows.
    """
    spark = items.sparkSession
    usable = items.where((F.col("size") > 0) & (F.col("capacity") > 0)).select("group", "item", F.col("size").cast("bigint").alias("size"), F.col("capacity").cast("bigint").alias("capacity"))
    pieces = written(pieces_of(usable), "pieces")
    histogram = written(pieces.groupBy("group", "length").agg(F.max("capacity").alias("capacity"), F.count("*").alias("n")), "lengths")
    # one row per length over all groups: at most as many as the largest capacity
    total = sorted((r["length"], r["n"]) for r in histogram.groupBy("length").agg(F.sum("n").alias("n")).collect())
    boundaries = {k: length_buckets([x for x, _ in total], [n for _, n in total], k)[0] for k in BUCKETS}
    kind = histogram.schema["group"].dataType.simpleString()
    # planning is work for the processor, not for the size of its input: as many tasks as a shuffle has partitions
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plans = histogram.repartition(tasks, "group").groupBy("group").applyInPandas(
        _planner(boundaries), f"group {kind}, length bigint, rank bigint, items bigint, per bigint, container bigint, offset bigint"
    )
    # items are ranked first; only then do they meet their plan rows, a block of ranks at a time, so that neither a
    # frequent length nor its many plan rows come together in one place
    salts = histogram.select("group", "length", F.ceil(F.col("n") / RANKED).alias("salts"))
    salted = _joined(pieces, salts, ["group", "length"], "inner").withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.col("salts")))
    rank = F.row_number().over(Window.partitionBy("group", "length", "salt").orderBy("item", "piece")) - 1
    ranked = salted.withColumn("r", rank.cast("bigint"))
    if salts.where(F.col("salts") > 1).limit(1).count():
        # where a salt's ranks begin; only lengths with more than RANKED items have several salts
        counts = salted.where(F.col("salts") > 1).groupBy("group", "length", "salt").agg(F.count("*").alias("c"))
        begin = counts.withColumn("begin", F.sum("c").over(Window.partitionBy("group", "length").orderBy("salt")) - F.col("c")).drop("c")
        ranked = _joined(ranked, begin, ["group", "length", "salt"], "left").withColumn("r", F.col("r") + F.coalesce("begin", F.lit(0)))
    block = lambda c: F.expr(f"({c}) div {BLOCK}")
    rows = plans.withColumn("block", F.explode(F.sequence(block("rank"), block("rank + items - 1"))))
    rows = rows.groupBy("group", "length", "block").agg(F.collect_list(F.struct("rank", "items", "per", "container", "offset")).alias("plan"))
    met = _joined(ranked.withColumn("block", block("r")), rows, ["group", "length", "block"], "inner")
    own = F.element_at(F.filter("plan", lambda p: (p["rank"] <= F.col("r")) & (F.col("r") < p["rank"] + p["items"])), 1)
    placed = met.select("group", "item", "piece", "start", "length", "r", own.alias("p"))
    at = F.col("r") - F.col("p.rank")
    return placed.select(
        "group", (F.col("p.container") + F.floor(at / F.col("p.per"))).cast("bigint").alias("container"),
        (F.col("p.offset") + at % F.col("p.per") * F.col("length")).cast("bigint").alias("offset"), "item", "piece", "start", "length",
    )
