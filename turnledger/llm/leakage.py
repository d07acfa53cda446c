"""Held-out texts inside a corpus, found by spaced seeds.

Words are hashed straight from the UTF-8 buffers of the Arrow batches. A mask picks some of ``span`` consecutive words
and ignores the rest; equal masked hashes of a held-out text and a document mark a diagonal on which the two are laid
over one another, and the overlap is verified on the words themselves: its longest exact run, and the best stretch
that tolerates substitutions. Such a stretch begins and ends with more equal words than a substitution costs (a
shorter run would not be worth its substitution), so seeds of ENDS consecutive words, two of them on one diagonal as far
apart as a stretch is long at least, miss none, wherever the substitutions stand. Masks are for exact runs: any run of
``span`` equal words hits under every mask, with fewer diagonals to verify; substitutions are then met only where a mask
ignores them.

The held-out side is a stated query set: it is indexed in blocks of at most ``block_words`` words, and each block is
sent to the tasks and held against all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words used (1) and ignored (0) by each mask; all of one span.
MASKS = ("111011010111", "110111101011")
#: Words of held-out text that one block may hold: about 40 bytes each in a task, 80 MB in all.
BLOCK_WORDS = 2_000_000
#: A stretch gains 1 for an equal word and loses this much for a substituted one.
SUBSTITUTION = 3
#: Hits of seeds that are held at a time (40 bytes each), and shifts of a document and an item verified word by word.
HITS, FEW = 1_000_000, 8
#: Words of an overlap, and equal words at both its ends, at least.
LEAST, ENDS = 12, "1" * (SUBSTITUTION + 1)

_RNG = np.random.default_rng(20_310_301)
_PLACE = _RNG.integers(1, 2**63, size=(64, 256), dtype=np.uint64) | np.uint64(1)
_STEP = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
_FOLD = np.zeros(256, dtype=np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _FOLD[ord(chr(_c).upper())] = _c


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of ASCII letters and digits, case ignored) of a string column: the folded bytes, each word's
    start and end in them, its hash, and each text's first word (one more at the end)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    raw = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    folded = _FOLD[raw]
    inside = folded > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[offsets < len(raw)]
    starts[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(starts)
    if not len(first):
        return folded, first, first, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    compact = np.searchsorted(at, first) if len(first) < len(at) // 8 else np.flatnonzero(starts[at])
    lengths = np.diff(np.append(compact, len(at)))
    place = np.arange(len(at)) - np.repeat(compact, lengths)
    terms = _PLACE[place & 63, folded[at]]
    if lengths.max() > 64:
        terms = terms * _STEP[(place >> 6) & 63]
    hashes = np.add.reduceat(terms, compact) + lengths.astype(np.uint64)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    return folded, first, first + lengths, hashes, np.searchsorted(first, offsets)


def seeds_of(hashes: np.ndarray, bounds: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masked hashes of all places where the mask lies inside one text, with the text and the word's index."""
    span = len(mask)
    if len(hashes) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.full(len(hashes) - span + 1, salt, dtype=np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            total += hashes[k : k + len(total)] * _STEP[k]
    total ^= total >> np.uint64(31)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[: len(total)] == text[span - 1 :])
    return total[at], text[at], at


class SeedIndex:
    """Held-out texts as sorted seeds with their words. Plain arrays and lists, sent to the tasks."""

    def __init__(self, ids: list, texts: list[str], masks: Sequence[str]):
        self.masks, self.ids = tuple(masks), ids
        folded, start, end, hashes, bounds = words_of(pa.array(texts, pa.string()))
        raw = folded.tobytes()
        self.words = [[raw[a:b] for a, b in zip(start[i:j], end[i:j], strict=True)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        self.hashes = [hashes[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        self.seeds, self.text, self.at, self.bits = [], [], [], []
        for k, mask in enumerate(self.masks):
            seed, text, at = seeds_of(hashes, bounds, mask, k + 1)
            order = np.argsort(seed, kind="stable")
            self.seeds.append(seed[order])
            self.text.append(text[order])
            self.at.append((at - bounds[text])[order])
            bits = np.zeros(1 << 22, dtype=bool)
            bits[seed >> np.uint64(42)] = True
            self.bits.append(np.packbits(bits))

    def diagonals(self, hashes: np.ndarray, bounds: np.ndarray, apart: int = 0) -> np.ndarray:
        """Distinct (document, item, word of the document minus word of the item) that some mask hits, first and last
        at least ``apart`` words from one another. Hits are reduced to diagonals HITS at a time, so a word that is
        repeated on both sides takes time, not memory."""
        found = np.zeros((0, 5), np.int64)  # document, item, shift, first and last place
        for k, mask in enumerate(self.masks):
            seed, text, at = seeds_of(hashes, bounds, mask, k + 1)
            slot = seed >> np.uint64(42)
            maybe = np.flatnonzero((self.bits[k][slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1)
            low = np.searchsorted(self.seeds[k], seed[maybe], "left")
            n = np.searchsorted(self.seeds[k], seed[maybe], "right") - low
            maybe, low, n = maybe[n > 0], low[n > 0], n[n > 0]
            total = np.cumsum(n)
            done = 0
            while done < len(n):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + HITS, "right")))
                part = slice(done, upto)
                hit = np.repeat(maybe[part], n[part])
                own = np.repeat(low[part], n[part]) + np.arange(len(hit)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                place = at[hit] - bounds[text[hit]]
                found = _spans(np.concatenate([found, np.stack([text[hit], self.text[k][own], place - self.at[k][own], place, place], axis=1)]), len(self.ids))
                done = upto
        return found[found[:, 4] - found[:, 3] >= apart, :3]


def _spans(rows: np.ndarray, items: int) -> np.ndarray:
    """(document, item, shift, first, last), each diagonal once."""
    if not len(rows):
        return rows
    shift = rows[:, 2] - rows[:, 2].min()
    pair = rows[:, 0] * items + rows[:, 1]
    order = np.argsort(pair * (int(shift.max()) + 1) + shift, kind="stable") if int(pair.max() + 1) * int(shift.max() + 1) < 2**62 else np.lexsort((shift, pair))
    rows = rows[order]
    first = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
    rows[first, 3] = np.minimum.reduceat(rows[:, 3], first)
    rows[first, 4] = np.maximum.reduceat(rows[:, 4], first)
    return rows[first]


def overlap(document: list[bytes], item: list[bytes], shift: int) -> tuple[int, int, int, int]:
    """Two texts laid over one another: longest exact run, and start (in the document), length and substitutions of the
    best stretch, which never begins or ends with a substituted word."""
    low, high = max(0, shift), min(len(document), shift + len(item))
    run = longest = score = best = subs = 0
    start, found = low, (low, 0, 0)
    for i in range(low, high):
        if document[i] == item[i - shift]:
            run += 1
            longest = max(longest, run)
            score += 1
            if score > best:
                best, found = score, (start, i + 1 - start, subs)
        else:
            run = 0
            score -= SUBSTITUTION
            subs += 1
            if score <= 0:
                score, subs, start = 0, 0, i + 1
    return longest, *found


def overlaps(document: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """overlap for many shifts of two texts at once, by word hashes: a step of all shifts per word of the item."""
    n, gone = len(shifts), len(document)
    run, longest, score, best, subs = (np.zeros(n, dtype=np.int32) for _ in range(5))
    start = np.maximum(0, shifts).astype(np.int64)
    found = np.stack([start, np.zeros(n, np.int64), np.zeros(n, np.int64)], axis=1)
    for j, word in enumerate(item):
        at = shifts + j
        inside = (at >= 0) & (at < gone)
        same = inside & (document[np.clip(at, 0, gone - 1)] == word)
        other = inside & ~same
        run = np.where(same, run + 1, 0)
        np.maximum(longest, run, out=longest)
        score = score + same - SUBSTITUTION * other
        subs = subs + other
        better = np.flatnonzero(same & (score > best))
        best[better] = score[better]
        found[better] = np.stack([start[better], at[better] + 1 - start[better], subs[better]], axis=1)
        lost = other & (score <= 0)
        score[lost] = 0
        subs[lost] = 0
        start[lost] = at[lost] + 1
    return np.concatenate([longest[:, None], found], axis=1)


def _matches(index, id_type: pa.DataType, least: int, apart: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: SeedIndex = index.value
        for batch in batches:
            folded, start, end, hashes, bounds = words_of(batch.column(1))
            rows: dict[tuple[int, int], tuple] = {}
            current, words = -1, []
            found = own.diagonals(hashes, bounds, apart)
            cuts = np.append(np.flatnonzero(np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))), len(found)) if len(found) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                text, item = (int(x) for x in found[a, :2])
                shifts = found[a:b, 2]
                if len(shifts) > FEW:  # of many shifts only the best by hashes are laid word over word
                    scored = overlaps(hashes[bounds[text] : bounds[text + 1]], own.hashes[item], shifts)
                    long = scored[:, 2] >= least
                    shifts, scored = shifts[long], scored[long]
                    if not len(shifts):
                        continue
                    best = np.lexsort((scored[:, 1], scored[:, 3], scored[:, 2], scored[:, 2] - scored[:, 3]))[-1]
                    shifts = shifts[sorted({int(best), int(np.argmax(scored[:, 0]))})]
                if text != current:
                    i, j = bounds[text], bounds[text + 1]
                    raw = folded[start[i] : end[j - 1]].tobytes()
                    current, words = text, [raw[a:b] for a, b in zip((start[i:j] - start[i]).tolist(), (end[i:j] - start[i]).tolist(), strict=True)]
                for shift in shifts.tolist():
                    exact, at, length, subs = overlap(words, own.words[item], shift)
                    if length >= least:
                        was = rows.get((text, item), (0, 0, 0, 0))
                        best = max((length - subs, length, subs, at), (was[2] - was[3], was[2], was[3], was[1]))
                        rows[text, item] = (max(exact, was[0]), best[3], best[1], best[2])
            if rows:
                at = pa.array([t for t, _ in rows], pa.int64())
                values = np.array(list(rows.values()), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([own.ids[i] for _, i in rows], id_type), *(pa.array(values[:, k]) for k in range(4))],
                    ["document", "item", "exact_words", "start_word", "overlap_words", "substitutions"],
                )

    return run


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    *,
    document_id: str,
    document_text: str,
    item_id: str,
    item_text: str,
    masks: Sequence[str] | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and item whose texts overlap in at least LEAST words, or a mask's span: document, item,
    exact_words (longest run of equal words), and start_word, overlap_words and substitutions of the best stretch.

    All are found if no masks are given; with masks, all that have a common run of span words. Nulls: null and empty texts contain nothing;
    null ids are kept as they are. Repeated rows of either side count once. Texts of any length are read whole; ties
    between stretches go to the one with more equal words, then the longer, then the later. Empty tables give no rows;
    further columns are ignored.
    """
    least, apart = (LEAST, LEAST - len(ENDS)) if masks is None else (len(masks[0]), 0)
    masks = (ENDS,) if masks is None else masks
    span = len(masks[0])
    if any(len(m) != span or set(m) - {"0", "1"} or "1" not in m for m in masks):
        raise ValueError("masks must be of one length, of 0 and 1")
    spark = documents.sparkSession
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    # two characters at least to a word and its gap
    chars = asked.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // (2 * block_words)))
    texts = documents.where(F.col(document_text).isNotNull()).select(F.col(document_id).alias("document"), F.col(document_text).alias("text"))
    schema = T.StructType(
        [T.StructField("document", texts.schema["document"].dataType), T.StructField("item", asked.schema["item"].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("exact_words", "start_word", "overlap_words", "substitutions")]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(asked.schema["item"].dataType)
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(SeedIndex([r["item"] for r in rows], [r["text"] for r in rows], masks))
        part = texts.mapInArrow(_matches(index, id_type, least, apart), schema)
        found = part if found is None else found.unionByName(part)
    # a row per pair, also where an id stands in several rows
    return found.groupBy("document", "item").agg(
        F.max(F.struct(F.col("overlap_words") - F.col("substitutions"), "overlap_words", "start_word", "substitutions")).alias("b"), F.max("exact_words").alias("exact_words")
    ).select("document", "item", "exact_words", *(F.col(f"b.{c}").alias(c) for c in ("start_word", "overlap_words", "substitutions")))
