import random

import pytest
from pyspark.sql import functions as F

from turnledger.operators.hierarchy import hierarchies
from turnledger.operators.orphans import orphan_counts, orphan_references

SCHEMA = "s string, id string, up string, n bigint, day string, __key string"


def orphans(df):
    return orphan_references(df, df, scope=["s"], parent_key="id", child_key="up", parent_order="n", child_order="n", keep=["day"])


def test_orphans_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice("uvwxyz"), rng.choice(["u", "v", "w", "q", None]), rng.choice([*range(9), None]), rng.choice(["d1", None]), "x") for _ in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {
        (s, up, n, d)
        for s, _, up, n, d, _ in rows
        if up is not None and not any(p[0] == s and p[1] == up and p[3] is not None and n is not None and p[3] < n for p in rows)
    }
    got = [tuple(r) for r in orphans(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = orphan_counts(orphans(df), table="rows", key="up", period=F.col("day")).collect()
    assert sum(r["n_orphans"] for r in counts) == len(want) and {r["period"] for r in counts} == {d for *_, d in want}


def test_orphans_of_empty_tables_and_without_order(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("a", "u", "v", 1, None, ""), ("a", "u", "v", 1, None, "")], SCHEMA)
    assert orphans(none).count() == 0
    assert orphan_references(none, some, scope=["s"], parent_key="id", child_key="up").count() == 1
    parents = spark.createDataFrame([("a", "v", None, 9, None, "")], SCHEMA)
    assert orphan_references(parents, some, scope=["s"], parent_key="id", child_key="up").count() == 0


def brute(rows):
    best = {}
    for s, i, up, n, *_ in rows:
        if i is not None and ((s, i) not in best or (n is None, n or 0, up is not None, up or "") < best[s, i][0]):
            best[s, i] = ((n is None, n or 0, up is not None, up or ""), up)
    parent = {k: (k[0], v[1]) if (k[0], v[1]) in best else None for k, v in best.items()}
    out = {}
    for k in parent:
        path = [k]
        while parent[path[-1]] and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        up = parent[path[-1]]
        if up:
            out[k] = (min(i for _, i in path[path.index(up) :]), -1, None)
        else:
            out[k] = (path[-1][1], len(path) - 1, [i for _, i in reversed(path)])
    below = {k: sorted(j[1] for j, v in out.items() if v[2] and j[0] == k[0] and k[1] in v[2][:-1]) if out[k][2] else None for k in out}
    return {k: (*v, below[k]) for k, v in out.items()}


@pytest.mark.parametrize("most", [10_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchies_against_brute_force(spark, seed, most):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(25)] + ["", "é", "Z"]
    rows = [(rng.choice(["a", "b", None]), rng.choice([*names, None]), rng.choice([*names[:12], None, "gone"]), rng.choice([1, 2, 3, None]), None, "") for _ in range(70)]
    rows += [("c", "r", "r", 1, None, ""), ("c", "k", "r", 1, None, ""), ("d", "only", None, 5, None, "")]
    got = hierarchies(spark.createDataFrame(rows, SCHEMA), scope=["s"], node="id", parent="up", order="n", lists=True, max_group_rows=most).collect()
    assert {(r["s"], r["id"]): (r["root_id"], r["depth"], r["path"], r["descendants"]) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_hierarchy_of_one_long_chain_and_of_nothing(spark):
    chain = [("a", f"{i:05}", f"{i - 1:05}" if i else None, i, None, "") for i in range(600)]
    for most in (10_000, 100):
        got = hierarchies(spark.createDataFrame(chain, SCHEMA), scope=["s"], node="id", parent="up", order="n", max_group_rows=most)
        assert sorted((r["id"], r["depth"], r["root_id"]) for r in got.collect()) == [(f"{i:05}", i, "00000") for i in range(600)]
    assert hierarchies(spark.createDataFrame([], SCHEMA), scope=["s"], node="id", parent="up", lists=True).count() == 0


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_lists_come_out_piece_by_piece(most):
    import numpy as np

    from turnledger.operators import hierarchy as H

    rng = random.Random(most)
    rows = [(0, f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None, 0, None, "") for i in range(200)] + [(0, "x", "y", 0, None, ""), (0, "y", "x", 0, None, ""), (0, "z", "y", 0, None, "")]
    node, parent = (np.array([r[k] for r in rows], dtype=object) for k in (1, 2))
    found = H.peel(np.zeros(len(rows), np.int64), node, parent)
    pieces = list(H._lists(found, node, most))
    assert [i for s, *_ in pieces for i in range(s.start, s.stop)] == list(range(len(rows))) and len(pieces) > 1 or most > 10**5
    got = {r[1]: (p, b) for r, p, b in zip(rows, [p for _, a, _ in pieces for p in a.to_pylist()], [b for *_, a in pieces for b in a.to_pylist()], strict=True)}
    assert got == {k[1]: v[2:] for k, v in brute(rows).items()}
