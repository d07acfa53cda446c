"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each distinct piece is encoded once per worker by prefix dynamic
programming. For every byte prefix of a piece there is exactly one token with which the prefix's encoding can end:
the token t before which the encoding of the shorter prefix ends in a token u such that (u, t) is stable, that is,
encoding the bytes of u and t again gives (u, t). Storing that token per prefix makes the encoding linear in the
length, makes an append exact without touching what is there, and lets an edit re-encode only what follows it.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split pattern published with the byte-level rank files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie if no folder is given and the package that carries them cannot be imported.
FOLDER = "/opt/tokenizers"
#: Entries a worker remembers before it starts anew; bounds its memory, never the result.
MEMORY = 300_000


def vocabulary_file(name: str, folder: str | None = None) -> str:
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = FOLDER
    return os.path.join(folder, name)


class PrefixEncoder:
    """Byte pieces to token ids of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # lengths of the tokens that end in these two bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, piece: bytes) -> list[bytes]:
        """The plain definition: merge the adjacent pair of least rank until none is left. Only for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stable(self, left: bytes, right: bytes, pair: tuple[int, int]) -> bool:
        if len(self.stable) > 4 * MEMORY:
            self.stable.clear()
        self.stable[pair] = known = self.merged(left + right) == [left, right]
        return known

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix length (from 0, where it is -1) the last token of its encoding. known: the list of a prefix
        of piece, which is continued."""
        last = list(known) if known else [-1]
        ranks, ends, stable = self.ranks, self.ends, self.stable
        for i in range(len(last), len(piece) + 1):
            found = -1
            for length in itertools.chain(ends.get(piece[max(0, i - 2) : i], ()), (1,)):
                if length > i:
                    continue
                start = i - length
                token = piece[start:i]
                rank = ranks.get(token)
                if rank is None:
                    continue
                if not start:
                    if length == 1 or self.merged(token) == [token]:
                        found = rank
                        break
                    continue
                pair = (last[start], rank)
                ok = stable.get(pair)
                if ok is None:
                    ok = self._stable(self.tokens[pair[0]], token, pair)
                if ok:
                    found = rank
                    break
            last.append(found)
        return last

    def read(self, piece: bytes, last: list[int]) -> list[int]:
        out, i = [], len(piece)
        while i:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None and self.merged(raw) == [raw]:
            return (whole,)
        return tuple(self.read(raw, self.last_tokens(raw)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text has none. Strings that look like special tokens are ordinary text."""
        if not text:
            return []
        pieces = self.pieces
        if len(pieces) > MEMORY:
            pieces.clear()
        out: list[int] = []
        for piece in splitter().findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    pieces[piece] = ids
            out += ids
        return out


class EditableEncoding:
    """A text with its ids, kept exact under appends and edits by encoding only the pieces that can have changed."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.pieces: list[tuple[int, ...]] = []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return list(itertools.chain.from_iterable(self.pieces))

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """text[start:end] becomes new. Pieces are cut anew from two pieces before the one touched (an apostrophe and a
        letter can become one piece by what follows) until the cuts fall where they fell before."""
        import bisect

        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect.bisect_right(self.starts, start) - 3)
        at = self.starts[first] if first < len(self.starts) else 0
        old = {p: k for k, p in enumerate(self.starts)}
        starts, pieces = self.starts[:first], self.pieces[:first]
        rest: int | None = None
        for found in splitter().finditer(text, at):
            was = old.get(found.start() - shift)
            if found.start() >= start + len(new) and was is not None and found.start() - shift >= end:
                rest = was
                break
            starts.append(found.start())
            pieces.append(self.encoder.encode_piece(found.group()))
        if rest is not None:
            starts += [p + shift for p in self.starts[rest:]]
            pieces += self.pieces[rest:]
        self.text, self.starts, self.pieces = text, starts, pieces


_SPLITTER = None
_ENCODERS: dict[str, PrefixEncoder] = {}


def splitter():
    global _SPLITTER
    if _SPLITTER is None:
        import regex

        _SPLITTER = regex.compile(PATTERN)
    return _SPLITTER


def encoder(name: str, folder: str | None = None) -> PrefixEncoder:
    """The encoder of a rank file, loaded once per worker process."""
    path = vocabulary_file(name, folder)
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder.load(path)
    return _ENCODERS[path]


def encode_texts(df: DataFrame, *, text: str, ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """df with a column of token ids (array<int>) in place of text; no shuffle, whole texts, one row per row.

    Null and empty texts give an empty list; repeated rows are each encoded; very long texts take time in proportion
    to their length; an empty table gives none. The column ids must not exist already (ValueError).
    """
    kept = [c for c in df.columns if c != text]
    if ids in kept:
        raise ValueError(f"column {ids} exists already")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, folder)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            found = [own.encode(x) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*kept, ids])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`")).mapInArrow(run, schema)
