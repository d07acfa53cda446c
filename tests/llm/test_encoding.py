import random

import pytest
from pyspark.sql import types as T

from turnledger.llm import encoding as E

TEXTS = [
    None, "", " ", "  \n\t x", "Hello world, it's 12345 o'clock", "<|endoftext|> is ordinary", "naïve café — 北京市 👩‍💻", "\r\n\r\nmixed\rends\n",
    "=" * 3000, "ab" * 2000, "x" * 5000 + " tail", "Ünïcödé" * 300, "\x00\x01�​", "שלום नमस्ते", "1" * 777, "'s 'll 've I'd",
]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(E.vocabulary_file("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def noise(rng):
    return "".join(rng.choice(["the ", " token", "ing", "é", "北", "  ", "\n", "12", "'s", "--", "Zx", "q", "👩", " "]) for _ in range(rng.randrange(60)))


def test_encoder_equals_public_library(public):
    own, rng = E.encoder("byte_bpe_50k.tiktoken"), random.Random(3)
    for text in [*TEXTS, *(noise(rng) for _ in range(300))]:
        assert own.encode(text) == (public(text) if text else [])


def test_multilingual_vocabulary_equals_tiktoken():
    import tiktoken

    own = E.encoder("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in TEXTS:
        assert own.encode(text) == (other.encode_ordinary(text) if text else [])


def test_prefix_table_continues_and_gives_every_prefix(public):
    own = E.encoder("byte_bpe_50k.tiktoken")
    piece = b" antidisestablishmentarianism"
    table = own.last_tokens(piece)
    assert own.last_tokens(piece, own.last_tokens(piece[:9])) == table
    for i in range(1, len(piece) + 1):
        assert own.read(piece[:i], table[: i + 1]) == public(piece[:i].decode())


def test_edits_and_appends_are_exact():
    own, rng = E.encoder("byte_bpe_50k.tiktoken"), random.Random(5)
    held = E.EditableEncoding(own, "It's  a   start\n")
    for _ in range(200):
        a = rng.randrange(len(held.text) + 1)
        b = min(len(held.text), a + rng.randrange(6))
        if rng.random() < 0.3:
            held.append(noise(rng)[:12])
        else:
            held.replace(a, b, noise(rng)[:9])
        assert held.ids == own.encode(held.text)


def test_table_keeps_rows_and_other_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("piece", T.StringType())])
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(0, None, "k"), (None, "a b", None)]
    got = E.encode_texts(spark.createDataFrame(rows, schema), text="text").collect()
    own = E.encoder("byte_bpe_50k.tiktoken")
    assert sorted((r["doc_id"] is None, r["doc_id"], r["piece"], r["ids"]) for r in got if r["doc_id"] is not None) == sorted(
        (False, i, p, own.encode(t)) for i, t, p in rows if i is not None
    )
    assert [r["ids"] for r in got if r["doc_id"] is None] == [own.encode("a b")]
    assert E.encode_texts(spark.createDataFrame([], schema), text="text").count() == 0
    with pytest.raises(ValueError):
        E.encode_texts(spark.createDataFrame(rows, schema), text="text", ids="piece")
