import random
import re

import pytest

from turnledger.llm.leakage import MASKS, leaked_passages, overlap

DOC, ITEM = "doc_id bigint, text string, item string", "item_id bigint, text string, document string"


def words(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]


def brute(docs, items, n=12):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, a, *_ in docs for i, b, *_ in items if grams(a) & grams(b)}


def found(spark, docs, items, **how):
    df = leaked_passages(
        spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), document_id="doc_id", document_text="text", item_id="item_id", item_text="text", **how
    )
    return df.collect()


def tables(seed):
    rng = random.Random(seed)
    pool = [rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice(["", "é", "9", "x" * 90]) for _ in range(40)]
    say = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, " ".join(say(30)), "-") for i in range(12)]
    items += [(90, None, "-"), (91, "", "-"), (92, "too short", "-"), (3, items[3][1], "-"), (None, items[1][1], "-")]
    docs = []
    for k in range(60):
        text = say(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(12)][1].split(" ")
            a = rng.randrange(18)
            text[len(text) // 2 : len(text) // 2] = [x.upper() for x in w[a : a + rng.randrange(9, 15)]]
        docs.append((k, rng.choice([" ", "\n", ", "]).join(text), "-"))
    docs += [(100, None, "-"), (101, "", "-"), (102, "、。", "-"), (1, docs[1][1], "-"), (103, " ".join(x[1] for x in docs if x[1]) * 3, "-"), (None, items[0][1], "-")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("how", [{}, {"block_words": 40}])
def test_exact_runs_against_brute_force(spark, seed, how):
    docs, items = tables(seed)
    got = found(spark, docs, items, **how)
    assert {(r["document"], r["item"]) for r in got if r["exact_words"] >= 12} == brute(docs, items)
    assert len(got) == len({(r["document"], r["item"]) for r in got})
    text = {d: words(t) for d, t, _ in docs}
    for r in got:
        assert r["overlap_words"] >= 12 and r["start_word"] + r["overlap_words"] <= len(text[r["document"]])


def test_substitutions_are_tolerated_where_a_mask_ignores_them(spark):
    item = [f"w{i}" for i in range(40)]
    doc = list(item)
    for i, used in enumerate(MASKS[0]):
        if used == "0":
            doc[10 + i] = "other"
    got = found(spark, [(1, " ".join(doc[10:22]), "")], [(2, " ".join(item), "")])
    assert [(r["document"], r["item"], r["overlap_words"]) for r in got] == []  # the stretch alone is shorter than the span
    got = found(spark, [(1, " ".join(doc), "")], [(2, " ".join(item), "")])
    assert [(r["document"], r["overlap_words"], r["substitutions"], r["exact_words"]) for r in got] == [(1, 40, MASKS[0].count("0"), 21)]


def test_overlap_of_nothing_and_empty_tables(spark):
    assert overlap([b"a"], [b"b"], 0) == (0, 0, 0, 0)
    assert found(spark, [], [(1, "a " * 20, "")]) == [] and found(spark, [(1, "a " * 20, "")], []) == []
    with pytest.raises(ValueError):
        found(spark, [], [], masks=("101", "11"))


def test_substitutions_anywhere_against_brute_force_alignment(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60)), "") for i in range(8)]
    docs = []
    for k in range(96):
        w = items[k % 8][1].split(" ")[20:40] if k % 2 else items[k % 8][1].split(" ")
        rate, kind = (0.1, 0.15, 0.2)[k % 3], k // 3 % 4
        at = [i for i in range(len(w)) if (rng.random() < rate, i % 6 == 5, i % 12 in (10, 11), i % 4 == 3)[kind]]
        for i in at:
            w[i] = f"other{rng.randrange(10**6)}"
        docs.append((k, " ".join(["before"] * rng.randrange(5) + w), ""))
    want = set()
    for d, a, _ in docs:
        for i, b, _ in items:
            x, y = ([w.encode() for w in words(t)] for t in (a, b))
            if any(overlap(x, y, s)[2] >= 12 for s in range(-len(y) + 1, len(x))):
                want.add((d, i))
    got = {(r["document"], r["item"]) for r in found(spark, docs, items)}
    assert got == want and len(want) > 40
    assert len(want & {(r["document"], r["item"]) for r in found(spark, docs, items, masks=MASKS)}) < 0.9 * len(want)


@pytest.mark.parametrize("masks", [None, MASKS])
def test_repeated_words_on_both_sides(spark, monkeypatch, masks):
    """Documents and items of few distinct words, whose seeds meet at nearly all places."""
    from turnledger.llm import leakage as L

    monkeypatch.setattr(L, "HITS", 500)
    rng = random.Random(3)
    mixed = lambda n: " ".join(rng.choice("ab") if rng.random() < 0.2 else "a" for _ in range(n))
    docs = [(1, "a " * 700, ""), (2, "a b " * 200, ""), (3, mixed(300), ""), (4, "b " * 13 + mixed(90), "")]
    items = [(1, "a " * 60, ""), (2, "b a " * 20, ""), (3, mixed(80), ""), (4, "b " * 15, "")]
    want = {}
    for d, a, _ in docs:
        for i, b, _ in items:
            x, y = ([w.encode() for w in words(t)] for t in (a, b))
            every = [o for s in range(-len(y) + 1, len(x)) if (o := overlap(x, y, s))[2] >= 12]
            if every:
                n, subs, at = max((o[2] - o[3], o[2], o[3], o[1]) for o in every)[1:4]
                want[d, i] = (max(o[0] for o in every), at, n, subs)
    got = {(r["document"], r["item"]): (r["exact_words"], r["start_word"], r["overlap_words"], r["substitutions"]) for r in found(spark, docs, items, **({"masks": masks} if masks else {}))}
    if masks:  # masks promise the exact runs
        assert {k for k, v in want.items() if v[0] >= 12} <= set(got)
    else:
        assert got == want and len(want) > 7
