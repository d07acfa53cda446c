import itertools
import random

import pytest

from turnledger.llm import packing as P

SCHEMA = "group string, item bigint, size int, capacity int, length string, plan string"


def check(rows, got):
    want = {(g, i): (n, c) for g, i, n, c, *_ in rows if n and n > 0 and c and c > 0}
    pieces, loads = {}, {}
    for r in got:
        n, c = want[r["group"], r["item"]]
        pieces.setdefault((r["group"], r["item"]), []).append((r["start"], r["length"]))
        loads.setdefault((r["group"], r["container"]), []).append((r["offset"], r["length"]))
        assert r["length"] == n if n <= c else r["length"] <= c
        assert 0 <= r["offset"] and r["offset"] + r["length"] <= c
    assert set(pieces) == set(want)
    for k, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == want[k][0]
    for parts in loads.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset >= at
            at = offset + length
    for g in {x for x, _ in loads}:
        used = {c for h, c in loads if h == g}
        assert used == set(range(len(used)))
    return {g: len({c for h, c in loads if h == g}) for g, _ in loads}


@pytest.mark.parametrize("ranked", [500_000, 7])
def test_packing_is_whole_and_tight(spark, monkeypatch, ranked):
    monkeypatch.setattr(P, "RANKED", ranked)
    rng = random.Random(3)
    rows = [(f"r{i % 5}", i, rng.choice([rng.randrange(1, 60), 25, 100, rng.randrange(90, 400)]), [64, 100, 37, 256, 1][i % 5], "x", "y") for i in range(400)]
    rows += [("r0", 900, 0, 64, "", ""), ("r0", 901, None, 64, "", ""), ("none", 902, 5, None, "", ""), ("none", 903, 5, 0, "", ""), (None, 904, 70, 30, "", "")]
    n = check(rows, P.pack(spark.createDataFrame(rows, SCHEMA)).collect())
    for g, found in n.items():
        c = next(r[3] for r in rows if r[0] == g and r[3])
        lengths = [x for r in rows if r[0] == g and r[2] and r[2] > 0 for x in [c] * (r[2] // c) + [r[2] % c] * (r[2] % c > 0)]
        least = P.least_containers({x: lengths.count(x) for x in set(lengths)}, c)
        assert least <= found <= least + 1
    assert P.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def test_plans_against_optimum():
    rng, more = random.Random(8), 0
    for _ in range(60):
        c = rng.randrange(10, 40)
        items = [rng.randrange(1, c + 1) for _ in range(rng.randrange(1, 10))]
        histogram = {x: items.count(x) for x in set(items)}
        best = optimum(items, c)
        assert P.least_containers(histogram, c) <= best
        more += min(P.plan(histogram, c, b)[1] for b in (None, [c // 2, c], [c // 3, c // 2, c])) - best
    assert more <= 1


def test_buckets_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 50), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        for k in (1, 2, 3, 12):
            best = min(
                sum((min(b for b in [*cut, lengths[-1]] if b >= x) - x) * n for x, n in zip(lengths, counts))
                for m in range(min(k, len(lengths)))
                for cut in itertools.combinations(lengths[:-1], m)
            )
            bounds, padding = P.length_buckets(lengths, counts, k)
            assert padding == best == sum((min(b for b in bounds if b >= x) - x) * n for x, n in zip(lengths, counts)) and len(bounds) <= k
    assert P.length_buckets([], [], 3) == ([], 0)


def test_a_hot_length_costs_no_more_than_a_rare_one():
    rows, n = P.plan({300: 10**9, 200: 10**9, 12: 5}, 512, None)
    assert n == 10**9 + (0 if any(r[0] == 12 and r[4] < 10**9 for r in rows) else 1) and len(rows) < 10


def test_dynamic_program_decides_the_batches(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("g", i, rng.choice([rng.randrange(300, 420), rng.randrange(1, 80), 512]), 1024, "", "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = lambda: sorted(map(tuple, P.pack(df).collect()))
    own = placed()
    monkeypatch.setattr(P, "length_buckets", lambda lengths, counts, k: ([lengths[-1]], 0))
    assert placed() != own


@pytest.mark.parametrize("capacity", [5000, 40_000])
def test_wide_containers_are_filled_exactly(capacity):
    rng = random.Random(capacity)
    lengths = sorted(min(capacity, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000))
    histogram = {x: lengths.count(x) for x in set(lengths)}
    counts = [histogram[x] for x in sorted(histogram)]
    found = min(P.plan(histogram, capacity, sorted({*P.length_buckets(sorted(histogram), counts, k)[0], capacity}))[1] for k in P.BUCKETS[:2])
    assert found <= P.least_containers(histogram, capacity) + 1
