import itertools
import random

import numpy as np
import pytest

from turnledger.llm import mojibake as M

SAYINGS = {
    "fr": ["L’équipe a déjà relancé le modèle {}", "Où est passée la clé n° {} ?", "Ça dépend du gabarit, à côté de l’été {}"],
    "de": ["Der Prüfer fügt {} Schlüssel hinzu", "Größere Stapel führen zu Lücken: {}", "Das Gerät hört später auf ({})"],
    "es": ["¿Por qué se perdió la posición {}?", "Mañana se revisará el código, ¡atención!", "El año pasado midió {} más"],
    "ru": ["Проверка отбрасывает историю сессии {}", "Кто знает, зачем ещё ответ {}?", "Награда посчитана дважды: {}"],
    "pl": ["Każda próbka ma własną długość {}", "Wczoraj zgubił {} żądań, więc wynik był błędny"],
    "ja": ["収集器は{}番目のターンを書き換えました。", "なぜ同じサンプルが{}回も現れるのですか？"],
    "en": ["Plain text of turn {} with nothing else", "My guess — and it’s only a guess — is “turn {}”", "wait… {}"],
    "x": ["┌──┬──┐ │ a │ b │ {}", "√2 ≈ 1.41 Åse {}", "Ω Θ(n log n) ≥ {} ±0.5 25 °C", "NÃO REPETIR A VERIFICAÇÃO {} ÂNGULO", "नमस्ते {} שלום 👩‍💻", "a b ½ × ¼ № {}"],
}


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lines = rng.choice(list(SAYINGS.values()))
        out.append("\n".join(rng.choice(lines if rng.random() < 0.9 else SAYINGS["x"]).format(rng.randrange(9999)) for _ in range(rng.randrange(2, 8))))
    return out


def sloppy(raw, codec):
    return "".join(M.high_table(codec)[b - 128] if b > 127 else chr(b) for b in raw)


READINGS = {
    "cp1252<utf-8": (["fr", "de", "es", "ru", "pl", "ja", "en"], lambda t: sloppy(t.encode(), "cp1252")),
    "latin-1<utf-8": (["fr", "es", "ru"], lambda t: t.encode().decode("latin-1")),
    "mac-roman<utf-8": (["fr", "de", "ru", "pl"], lambda t: t.encode().decode("mac-roman")),
    "cp437<utf-8": (["de", "es", "ja"], lambda t: t.encode().decode("cp437")),
    "cp1251<utf-8": (["fr", "ru", "de"], lambda t: sloppy(t.encode(), "cp1251")),
    "twice": (["fr", "es", "ru", "en"], lambda t: sloppy(sloppy(t.encode(), "cp1252").encode(), "cp1252")),
    "cp1252<cp437": (["es", "de"], lambda t: sloppy(t.encode("cp437", "ignore"), "cp1252")),
    "mac-roman<latin-1": (["es", "de"], lambda t: t.encode("latin-1", "ignore").decode("mac-roman")),
    "cp1252<cp1251": (["ru"], lambda t: sloppy(t.encode("cp1251"), "cp1252")),
    "koi8-r<cp1251": (["ru"], lambda t: t.encode("cp1251").decode("koi8-r")),
    "cp1252<iso8859-2": (["pl"], lambda t: sloppy(t.encode("iso8859-2", "ignore"), "cp1252")),
    "latin-1<euc_jp": (["ja"], lambda t: t.encode("euc_jp").decode("latin-1")),
    "lossy": (["fr", "ru"], lambda t: t.encode("latin-1" if "é" in t or t.isascii() else "cp1251", "ignore").decode("utf-8", "replace")),
}


@pytest.fixture(scope="module")
def cases():
    rng, texts, kinds, truth = random.Random(4), corpus(), [], []
    kinds = [None] * len(texts)
    truth = list(texts)
    for name, (langs, read) in READINGS.items():
        for lang, whole in itertools.product(langs, (True, False)):
            for _ in range(2):
                lines = [s.format(rng.randrange(9999)) for s in SAYINGS[lang] * 2]
                bad = [read(s) if whole or i % 2 else s for i, s in enumerate(lines)]
                if bad != lines:
                    texts.append("\n".join(bad))
                    kinds.append(name)
                    truth.append("\n".join(lines))
    return texts, kinds, truth


@pytest.fixture(scope="module")
def restorer(cases):
    sketch, texts = np.zeros(2 << M.SKETCH_BITS, np.float32), cases[0]
    for t in texts:
        for b in M._buckets(M.distinct_pairs(t)):
            np.add.at(sketch, b, 1)
    return M.Restorer(M.PairModel(sketch, len(texts)))


def test_all_readings_are_found_and_correct_text_is_not(cases, restorer):
    texts, kinds, truth = cases
    missed, wrong, undone = [], [], 0
    for text, kind, right in zip(texts, kinds, truth, strict=True):
        new, found, _ = restorer.restore(text)
        hit = bool(found) or "�" in text
        if kind and not hit:
            missed.append((kind, text))
        if not kind and hit:
            wrong.append((found, text))
        undone += kind is not None and new == right
    assert not wrong and not missed
    assert undone > 0.6 * sum(k is not None for k in kinds)


def test_exact_restoration_of_utf8(restorer):
    text = "L’équipe a déjà relancé le modèle 7. Où est passée la clé ?"
    for codec in ("cp1252", "mac-roman", "cp1250", "cp850"):
        assert restorer.restore(sloppy(text.encode(), codec))[0] == text


def best_segments_brute(scores):
    """Ruzzo and Tompa by definition: the best segment, then both sides of it."""
    best, where = 0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > best or (s == best and where and b - a < where[1] - where[0]):
                best, where = s, (a, b)
    if not where:
        return []
    a, b = where
    return [*best_segments_brute(scores[:a]), where, *((x + b, y + b) for x, y in best_segments_brute(scores[b:]))]


def test_segments_against_definition():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.randrange(-50, 51) + rng.random() for _ in range(rng.randrange(12))]
        assert M.best_segments(scores) == best_segments_brute(scores)


def test_table(spark, cases, restorer):
    texts, kinds, _ = cases
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (-2, "", "x"), (-3, "plain", "x"), (len(texts) - 1, texts[-1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string").repartition(3)
    got = M.garbled_texts(df, key="doc_id", text="text").collect()
    assert sorted(r["key"] for r in got) == sorted([i for i, k in enumerate(kinds) if k] + [len(texts) - 1])
    for r in got:
        new, found, _ = restorer.restore(texts[r["key"]])
        assert bool(r["readings"]) == bool(found) and r["lossy"] == ("�" in r["restored"])
    assert M.garbled_texts(spark.createDataFrame([], df.schema), key="doc_id", text="text").count() == 0


def test_single_pairs_cost_what_arrays_of_pairs_cost(restorer):
    text = "aé9é7—“Ω”\t北京 Ã© x�y 👩"
    assert restorer.model.costs(text) == pytest.approx(restorer.model.array(text).tolist())


def test_frequent_garbling_does_not_hide_itself(spark):
    texts = corpus(600)
    copied = sloppy("L’été dernier, la clé était cachée à côté du modèle".encode(), "cp1252")
    rng = random.Random(7)
    source = [sloppy("\n".join(rng.choice(SAYINGS["fr"] + SAYINGS["ru"]).format(rng.randrange(10**6)) for _ in range(3)).encode(), "cp1252") for _ in range(400)]
    for garbled in ([copied] * 400, source):
        df = spark.createDataFrame(list(enumerate(texts + garbled)), "doc_id bigint, text string")
        got = {r["key"] for r in M.garbled_texts(df, key="doc_id", text="text").collect()}
        assert got == set(range(600, 1000))


def test_words_garbled_within_a_sentence(cases, restorer):
    right = "Кто знает, зачем Проверка отбрасывает историю сессии Награда посчитана дважды ещё ответ"
    words = right.split(" ")
    for reading in ("koi8-r<cp1251", "cp1252<cp1251", "cp1252<utf-8"):
        read = READINGS[reading][1]
        text = " ".join([*words[:3], read(" ".join(words[3:6])), *words[6:]])
        new, found, _ = restorer.restore(text)
        assert found and new == right, (reading, new, found)
    assert restorer.restore(right)[1] == []


def test_stretches_lie_within_their_island_at_borders_of_runs(cases, restorer):
    for text in cases[0]:
        for (a, b), stretches in restorer.segments(text):
            at = a
            for low, high in stretches:
                assert at <= low < high <= b
                assert not text[low].isascii() and not text[high - 1].isascii()
                assert (low == a or text[low - 1].isascii()) and (high == b or text[high].isascii())
                at = high
            assert stretches


def test_nothing_within_a_sentence_without_the_segments(cases, restorer, monkeypatch):
    """The bounds of the maximum-scoring segments decide where mappings are tried."""
    words = "Кто знает, зачем Проверка отбрасывает историю сессии Награда посчитана дважды ещё ответ".split(" ")
    text = " ".join([*words[:3], READINGS["koi8-r<cp1251"][1](" ".join(words[3:6])), *words[6:]])
    assert restorer.restore(text)[0] == " ".join(words)
    monkeypatch.setattr(M, "best_segments", lambda scores: [(0, len(scores))])
    restorer.tried.clear()
    assert restorer.restore(text)[0] != " ".join(words)
    monkeypatch.setattr(M, "best_segments", lambda scores: [])
    assert all(restorer.restore(t)[1] == [] for t in cases[0])


def test_thorough_finds_and_restores_the_same(cases, restorer):
    thorough = M.Restorer(restorer.model, thorough=True)
    for text in cases[0][::5]:
        assert thorough.restore(text)[0] == restorer.restore(text)[0]


def test_noise_of_a_full_sketch_hides_nothing(cases, restorer):
    """Four times the pairs of the whole corpus, smeared over all buckets."""
    noise = 4 * restorer.model.sketch.sum() / 2 / (1 << M.SKETCH_BITS)
    noisy = M.Restorer(M.PairModel(restorer.model.sketch + np.float32(noise), restorer.model.documents))
    for text in cases[0][::5]:
        assert bool(noisy.restore(text)[1]) == bool(restorer.restore(text)[1])
