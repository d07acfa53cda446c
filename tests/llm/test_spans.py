import random

import pytest

from turnledger.llm.spans import shared_spans

SCHEMA = "id bigint, k string, owner string, a array<bigint>, b array<bigint>, array_name string, mark bigint"


def brute(rows, span):
    runs, out = {}, set()
    for _, _, o, *arrays in rows:
        for v in arrays[:2]:
            for i in range(len(v or []) - span + 1):
                if None not in v[i : i + span]:
                    runs.setdefault(tuple(v[i : i + span]), set()).add(o)
    for d, k, _, *arrays in rows:
        for name, v in zip("ab", arrays[:2], strict=True):
            shared = sorted({p for i in range(len(v or []) - span + 1) if len(runs.get(tuple(v[i : i + span]), ())) > 1 for p in range(i, i + span)})
            for p in shared:
                if p - 1 not in shared:
                    end = p
                    while end in shared:
                        end += 1
                    out.add((d, k, name, p, end))
    return out


def rows_of(seed, vocabulary):
    rng = random.Random(seed)
    say = lambda n: [rng.randrange(vocabulary) for _ in range(n)]
    common = [say(40), say(11), [7] * 50, [1, 2] * 20]
    rows = []
    for d in range(60):
        arrays = []
        for _ in range(2):
            v = say(rng.randrange(30))
            for _ in range(rng.randrange(3)):
                c = rng.choice(common)
                x, y = sorted((rng.randrange(len(c) + 1), rng.randrange(len(c) + 1)))
                v += c[x:y] + say(rng.randrange(3))
            if v and rng.random() < 0.1:
                v[rng.randrange(len(v))] = None
            arrays.append(rng.choice([v, v, v, v, None, []]))
        rows.append((d, rng.choice(["x", None]), rng.choice(["o1", "o2", "o3", None]), *arrays, "clash", 5))
    return [*rows, rows[3], rows[4], (99, "x", "o1", say(3000) + common[0] + [-5, 2**62], None, "clash", 5), (98, "x", "o2", [-5, 2**62] * 9, common[0] + [-5, 2**62], "", 0)]


@pytest.mark.parametrize("sent", [10_000, 0])
@pytest.mark.parametrize(("seed", "vocabulary", "span", "hashes"), [(1, 40, 8, 1), (2, 2, 9, 1), (3, 5, 5, 3)])
def test_spans_against_brute_force(spark, seed, vocabulary, span, hashes, sent):
    rows = rows_of(seed, vocabulary)
    got = shared_spans(spark.createDataFrame(rows, SCHEMA), ids=["id", "k"], owner="owner", arrays=["a", "b"], span=span, hashes=hashes, sent=sent).collect()
    assert {tuple(r) for r in got} == brute(rows, span) and len(got) == len({tuple(r) for r in got})


def test_nothing_shared_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x", "o", list(range(100)), None, "", 0), (2, "x", "o", list(range(100)), [], "", 0)], SCHEMA)
    assert shared_spans(df, ids=["id"], owner="owner", arrays=["a", "b"]).count() == 0
    assert shared_spans(spark.createDataFrame([], SCHEMA), ids=["id"], owner="owner", arrays=["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, ids=["id"], owner="owner", arrays=["a"], span=1)
