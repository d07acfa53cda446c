import random

import pytest

from turnledger.llm import crosssplit as C
from turnledger.llm.crosssplit import coverage, cross_split_counts, cross_split_pairs, prompts_of

SCHEMA = "index bigint, split string, tokens array<bigint>, response_length int, key string, head string"
NAMES = {"index": "index", "split": "split", "tokens": "tokens", "response_length": "response_length"}


def prompt(tokens, n):
    return tuple(tokens[: len(tokens) - n]) if tokens is not None and n is not None and n >= 0 and len(tokens) > n else None


def grams(p, n=4):
    return {p[i : i + n] for i in range(len(p) - n + 1)}


def rows_of(seed):
    rng = random.Random(seed)
    bases = [[rng.randrange(50) for _ in range(rng.randrange(3, 40))] for _ in range(8)]
    head = [900, 901, 902, 903, 904, 905]
    rows = []
    for i in range(160):
        p = head + list(rng.choice(bases)) if rng.random() < 0.7 else list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            p[rng.randrange(len(p))] = rng.randrange(50)
        r = [rng.randrange(50) for _ in range(rng.randrange(4))]
        rows.append((i, rng.choice(["train", "train", "eval", "test", None, "other"]), p + r, rng.choice([len(r)] * 9 + [None, -1, 999]), "clash", ""))
    rows += [(200, "eval", None, 0, "clash", ""), (201, "train", [], 0, "", ""), (202, "eval", [1, 2, 3], 0, "clash", ""), (203, "train", [1, 2, 3], 0, "clash", ""), rows[0], rows[1]]
    return rows + [(204, "train", [5] * 500, 0, "clash", ""), (205, "test", [5] * 4 + [6], 1, "clash", ""), (206, "eval", [5] * 300 + [6], 0, "clash", "")]


@pytest.mark.parametrize(("seed", "part", "shift"), [(1, 10_000, 0), (2, 300, 0), (3, 10_000, 2**40), (4, 100, -7)])
def test_pairs_and_coverage_against_brute_force(spark, monkeypatch, seed, part, shift):
    monkeypatch.setattr(C, "PART", part)
    rows = [(i, s, t and [x + shift for x in t], *more) for i, s, t, *more in rows_of(seed)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = cross_split_pairs(df, **NAMES).collect()
    ok = {i: (s, p) for i, s, t, n, *_ in rows if s in ("train", "eval", "test") and (p := prompt(t, n))}
    want = {}
    for a, (s, p) in ok.items():
        for b, (z, q) in ok.items():
            if s != "train" and z == "train" and (x := grams(p)) | (y := grams(q)) and len(x & y) / len(x | y) >= 0.6:
                want[a, b] = len(x & y) / len(x | y)
    assert {(r["held"], r["train"]): pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want) and want
    prompts = prompts_of(df, held_out=("eval", "test"), train="train", **NAMES)
    covered = {r["index"]: (r["n_tokens"], r["covered"], r["longest"]) for r in prompts.where("not side").select("index", "key").distinct().join(coverage(prompts), "key").collect()}
    lengths = [4 << k for k in range(8)]
    known = {n: {g for s, p in ok.values() if s == "train" for g in grams(p, n)} for n in lengths}
    every = {g for s, p in ok.values() if s == "train" for g in grams(p, 8)}
    for i, (s, p) in ok.items():
        if s != "train":
            longest = max([n for n in lengths if grams(p, n) & known[n]], default=0)
            assert covered[i] == (len(p), len({k for j in range(len(p) - 7) if p[j : j + 8] in every for k in range(j, j + 8)}), longest)
    counts = cross_split_counts(df, by=("split", "key"), **NAMES).collect()
    assert {r["split"]: (r["n_samples"], r["n_pairs"]) for r in counts} == {s: (len({a for a, _ in want if ok[a][0] == s}), sum(ok[a][0] == s for a, _ in want)) for s in ("eval", "test")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cross_split_pairs(none, **NAMES).count() == 0
    one = spark.createDataFrame([(1, "train", [1] * 9, 0, "", "")], SCHEMA)
    assert cross_split_pairs(one, **NAMES).count() == 0


def test_no_pair_without_the_array(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(7), SCHEMA)
    assert cross_split_pairs(df, **NAMES).count()
    monkeypatch.setattr(C, "suffix_spans", lambda sides: spark.createDataFrame([], "id bigint, side tinyint, at int, n_runs int, run bigint, tokens int"))
    assert cross_split_pairs(df, **NAMES).count() == 0


def test_a_template_in_most_prompts(spark):
    """Nine tenths of the prompts begin with one long template: pairs still depend on what follows it."""
    rng = random.Random(9)
    head = list(range(100, 140))
    rows = [(i, "train" if i % 2 else "eval", (head if i % 10 else []) + [rng.randrange(10**6) for _ in range(60)], 0, "", "") for i in range(400)]
    rows += [(1000, "eval", rows[1][2][:-2] + [7, 7], 0, "", "")]
    assert [(r["held"], r["train"]) for r in cross_split_pairs(spark.createDataFrame(rows, SCHEMA), **NAMES).collect()] == [(1000, 1)]
