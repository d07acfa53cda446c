"""Text that was read in a wrong character encoding: found, and restored where it can be.

All documents together give, per pair of adjacent characters, the number of documents that have it. A pair's surprisal
(its mutual information and the rarity of its two characters, -log2 of the joint frequency) is high wherever bytes
were read in another encoding than their own. Maximum-scoring segments of surprisal less a threshold isolate such
stretches, widened to whole runs of characters beyond ASCII, and only there the inverse mappings are tried, and on the
island of runs about them if that gains more: encode in the encoding it was read in, decode in another,
once or repeatedly. A mapping counts if it makes the segments of a document so much more probable under the corpus
that chance cannot explain it. Characters that only a lossy reading leaves (U+FFFD) mark a document as affected too.

Every distinct text counts once, so copies do not make their own garbling typical. Neither does a source that is
garbled throughout: a second count leaves out the runs that are well-formed UTF-8 under some encoding, and a UTF-8
mapping may be judged by that one alone, if each stretch by itself then gains enough.

The pair counts go into tables of fixed size (count-min sketches of two rows), so what the tasks get does not grow
with the corpus. Nor does their noise: what all other pairs leave in a bucket is the pairs a text has, over the buckets,
as a share of the texts, whatever their number; at 500 such pairs a text an unseen pair still has 12 bits.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Log2 of the buckets of each of a sketch's two rows; two sketches of 2 * 4 * 2**21 bytes = 32 MB whatever the corpus.
SKETCH_BITS = 21
#: Surprisal (bits) from which a pair speaks for a segment; pairs in fewer than one document in 2**TYPICAL.
TYPICAL = 5.0
#: Bits that a document's segments must gain, in all and per changed character, for a mapping to count.
GAIN, GAIN_PER_CHAR = 9.0, 2.0
#: Bits for a mapping between single-byte encodings, which any text survives; and what a segment that it makes less
#: probable counts against it at most.
GAIN_SINGLE, LOSS = 24.0, 4.0
#: Share of a character's documents in which it stands outside runs that decode as UTF-8, at most, to belong to these.
ELSEWHERE = 0.25
#: Times that text may have been read wrongly one after the other.
ROUNDS = 4
#: Share of a segment's bits that a UTF-8 mapping must gain to be the only explanation tried, unless asked to be thorough.
ENOUGH = 0.5
#: Bits of a pair with U+FFFD, whatever the corpus: nothing is gained by losing characters.
GONE = 24.0
#: Segments a worker remembers before it starts anew.
MEMORY = 200_000

#: Encodings in which text is read by mistake (fixed values; Python codec names).
READ_AS = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "cp1254", "iso8859-15", "cp1253", "mac-cyrillic", "cp852", "iso8859-5")
#: Single-byte encodings text may have been written in (fixed values).
WRITTEN_IN = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp852", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "mac-cyrillic", "mac-latin2", "cp1253", "cp1254", "iso8859-15")
#: Multi-byte encodings, as which UTF-8 is read or as which text was written (fixed values).
WIDE = ("gbk", "shift_jis", "euc_jp", "big5", "euc_kr")

_ALL = (1 << 64) - 1
_GAP = frozenset(" \t\n\r\u00a0")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_ISLAND = re.compile(r"[^\x00-\x7f]+(?:[\x20-\x7e][^\x00-\x7f]+)*")


def high_table(codec: str) -> list[str | None]:
    """Characters of the bytes 0x80 to 0xff; undefined bytes are read as the C1 control of that number."""
    out: list[str | None] = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _byte_maps() -> dict[str, dict[str, int]]:
    maps = {}
    for codec in READ_AS:
        maps[codec] = {c: i + 128 for i, c in reversed(list(enumerate(high_table(codec))))}
        for b in range(128, 160):  # bytes that some readers pass on as controls
            maps[codec].setdefault(chr(b), b)
    return maps


def _single_byte_maps() -> dict[str, list[tuple[str, dict[int, str | None], frozenset[str]]]]:
    """read as, to written in, its translation (None where the byte means nothing in the encoding it was written in), and
    the characters without one."""
    out: dict[str, list] = {}
    seen = set()
    for read in READ_AS:
        for written in WRITTEN_IN:
            table: dict[int, str | None] = {}
            for i, c in enumerate(high_table(read)):
                try:
                    table[ord(c)] = bytes([i + 128]).decode(written)
                except UnicodeDecodeError:
                    table[ord(c)] = None
            if all(t == chr(c) for c, t in table.items()) or (key := tuple(sorted(table.items()))) in seen:
                continue
            seen.add(key)
            out.setdefault(read, []).append((written, table, frozenset(chr(c) for c, t in table.items() if t is None)))
    return out


def _utf8_runs() -> re.Pattern:
    """Runs that are well-formed UTF-8 from end to end under one of READ_AS, as characters."""
    ranges = [((0xC2, 0xDF), (0x80, 0xBF)), ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)), ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)), ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)), ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
              ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)), ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)), ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF))]
    codecs = []
    for table in _BYTES.values():
        of = lambda low, high, t=table: "".join(re.escape(c) for c, b in t.items() if low <= b <= high)
        parts = [[of(*r) for r in sequence] for sequence in ranges]
        codecs.append("(?:" + "|".join("".join(f"[{c}]" for c in part) for part in parts if all(part)) + ")+")
    return re.compile("|".join(codecs))


_BYTES = _byte_maps()
_SINGLE = _single_byte_maps()
_DECODES = _utf8_runs()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << SKETCH_BITS) - 1)
    return (keys & low).astype(np.int64), ((keys >> np.uint64(32)) & low).astype(np.int64) + (1 << SKETCH_BITS)


def distinct_pairs(text: str, left_out: list[tuple[int, int]] = ()) -> np.ndarray:
    """Keys of the distinct adjacent pairs with a character beyond ASCII, and of those characters by themselves (with 0);
    the text's ends count as line ends. Pairs and characters that touch a stretch left out do not count."""
    if text.isascii():
        return np.zeros(0, np.uint64)
    codes = codes_of("\n" + text + "\n")
    use = (codes[:-1] > 127) | (codes[1:] > 127)
    own = codes > 127
    for a, b in left_out:
        use[a : b + 1] = False
        own[a + 1 : b + 1] = False
    at = np.flatnonzero(use)
    own = np.unique(codes[own])
    return np.unique(np.concatenate([_pair_keys(_fold(codes[at]), _fold(codes[at + 1])), _pair_keys(own, np.zeros_like(own))]))


def decodable_runs(text: str) -> list[tuple[int, int]]:
    """Runs beyond ASCII that are well-formed UTF-8 from end to end under one of READ_AS or WIDE."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if _DECODES.fullmatch(run) or (max(run) > "\u2e7f" and any(_wide_read_as(run, read) != run for read in WIDE)):
            out.append(m.span())
    return out


def _fold(codes: np.ndarray) -> np.ndarray:
    """Digits are one character: which one says nothing about an encoding."""
    return np.where((codes >= 48) & (codes <= 57), 48, codes)


class PairModel:
    """Surprisal of adjacent characters from sketched document frequencies. ``other`` is the model of the same texts
    without the runs that decode as UTF-8, if there is one."""

    def __init__(self, sketch: np.ndarray, documents: int, other: PairModel | None = None):
        self.sketch, self.documents, self.other = sketch, max(1, documents), other or self
        self.known: dict[str, float] = {}

    def cost(self, pair: str) -> float:
        """Bits of one adjacent pair; half a document stands for those never seen."""
        got = self.known.get(pair)
        if got is None:
            if pair.isascii():
                got = 0.5
            elif "\ufffd" in pair:
                got = GONE
            else:
                x, y = (48 if 48 <= c <= 57 else c for c in map(ord, pair))
                got = math.log2((self.documents + 1) / (self.seen(x, y) + 0.5))
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known[pair] = got
        return got

    def seen(self, x: int, y: int) -> float:
        """Documents with the pair x, y, or with the character x if y is 0."""
        x = ((x << 32) | y) * 0x9E3779B97F4A7C15 & _ALL
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _ALL  # as _pair_keys
        x ^= x >> 32
        low = (1 << SKETCH_BITS) - 1
        return min(float(self.sketch[x & low]), float(self.sketch[((x >> 32) & low) + low + 1]))

    def decodes(self, segment: str) -> bool:
        """Whether some character of the segment is at home in runs that decode as UTF-8, and seldom elsewhere."""
        return any(self.other.seen(c, 0) <= ELSEWHERE * self.seen(c, 0) for c in {ord(c) for c in segment if c > "\x7f"})

    def costs(self, text: str) -> list[float]:
        cost = self.cost
        return [cost(text[i : i + 2]) for i in range(len(text) - 1)]

    def array(self, text: str) -> np.ndarray:
        """costs, for long texts."""
        codes = codes_of(text)
        left, right = codes[:-1], codes[1:]
        at = np.flatnonzero((left > 127) | (right > 127))
        codes = _fold(codes)
        a, b = _buckets(_pair_keys(codes[at], codes[at + 1]))
        out = np.full(len(left), 0.5)
        out[at] = np.log2((self.documents + 1) / (np.minimum(self.sketch[a], self.sketch[b]) + 0.5))
        out[(left == 0xFFFD) | (right == 0xFFFD)] = GONE
        return out

    def total(self, text: str) -> float:
        return float(self.array(text).sum()) if len(text) > 48 else sum(self.costs(text))


def best_segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (start, end) of a list of scores, in linear time."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, total before it, total at its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = i, before, total
        while kept:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((start, i + 1, left, right))
    return [(a, b) for a, b, *_ in kept]


def _utf8_read_as(text: str, read: str) -> str:
    """text with every well-formed UTF-8 sequence put right among the characters that have a byte in ``read``."""
    table = _BYTES[read]
    out, i, n = [], 0, len(text)
    if not any(c in table and 0xC2 <= table[c] <= 0xF4 for c in text):
        return text
    while i < n:
        if text[i] not in table:
            out.append(text[i])
            i += 1
            continue
        j = i
        while j < n and text[j] in table:
            j += 1
        raw = bytes(table[c] for c in text[i:j])
        at = 0
        for m in _UTF8.finditer(raw):
            out += [text[i + at : i + m.start()], m.group().decode("utf-8")]
            at = m.end()
        out.append(text[i + at : j])
        i = j
    return "".join(out)


def _wide_read_as(text: str, read: str) -> str:
    """text with UTF-8 that was read as a multi-byte encoding put right; odd bytes at the end may be lost."""
    try:
        raw = text.encode(read)
    except UnicodeEncodeError:
        return text
    for cut in range(3):
        try:
            return raw[: len(raw) - cut].decode("utf-8") + "�" * (cut > 0)
        except UnicodeDecodeError:
            continue
    return text


def _wide_written_in(text: str, read: str, written: str) -> str:
    table = _BYTES[read]
    try:
        raw = bytes(ord(c) if c < "\x80" else table[c] for c in text)
        return raw.decode(written)
    except (KeyError, UnicodeDecodeError):
        return text


def utf8_mappings(segment: str) -> Iterator[tuple[tuple[str, str], str]]:
    """((read as, "utf-8"), restored) of the mappings that change a segment."""
    for read in READ_AS:
        new = _utf8_read_as(segment, read)
        if new != segment:
            yield (read, "utf-8"), new
    for read in WIDE:
        new = _wide_read_as(segment, read)
        if new != segment:
            yield (read, "utf-8"), new


def other_mappings(segment: str) -> Iterator[tuple[tuple[str, str], str]]:
    """((read as, written in), restored) of the mappings from other encodings that change a segment."""
    own = {c for c in segment if c > "\x7f"}
    if max(own) < "\u2300":
        for read in ("latin-1", "cp1252"):
            if own <= _BYTES[read].keys():
                for written in WIDE:
                    new = _wide_written_in(segment, read, written)
                    if new != segment:
                        yield (read, written), new
    for read, tables in _SINGLE.items():
        if own.isdisjoint(_BYTES[read]):
            continue
        for written, table, nothing in tables:
            if own.isdisjoint(nothing) and (new := segment.translate(table)) != segment:
                yield (read, written), new


class Restorer:
    """Finds and undoes wrong readings under a pair model."""

    def __init__(self, model: PairModel, thorough: bool = False):
        self.model, self.enough = model, math.inf if thorough else ENOUGH
        self.typical = min(TYPICAL, 0.5 * float(np.log2(model.documents + 1)))
        self.tried: dict[str, list] = {}

    def segments(self, text: str) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
        """Islands of characters beyond ASCII (single ASCII characters between two of them belong to the island) with
        their improbable stretches, widened to whole runs, for a character is more than one byte in many encodings.
        What decodes as UTF-8 does not make itself probable."""
        scores = self.model.other.array("\n" + text + "\n") - self.typical
        rare = np.flatnonzero(scores > 0)
        if not len(rare):
            return []
        out = []
        for m in _ISLAND.finditer(text):
            a, b = m.start(), m.end() + 1  # pairs a to b of the framed text touch the island
            k = int(np.searchsorted(rare, a))
            if k == len(rare) or rare[k] >= b:
                continue
            runs = [x.span() for x in _BEYOND.finditer(text, a, b - 1)]
            stretches: list[tuple[int, int]] = []
            for i, j in best_segments(scores[a:b].tolist()):
                # pair i joins the characters before and at i: those whose pairs are all improbable, or a border's run
                low, high = a + i, max(a + i + 1, a + j - 1)
                touched = [r for r in runs if r[0] < high and r[1] > low] or [r for r in runs if r[0] <= high and r[1] >= low]
                if stretches and touched[0][0] < stretches[-1][1]:
                    stretches[-1] = stretches[-1][0], max(stretches[-1][1], touched[-1][1])
                else:
                    stretches.append((touched[0][0], touched[-1][1]))
            if stretches:
                out.append((m.span(), stretches))
        return out

    def _gains(self, before: str, segment: str, after: str) -> tuple[list, dict]:
        """Mappings that make the segment more probable, as (mapping, gain, restored), and what others cost."""
        key = before + segment + after
        if before.isdigit() or after.isdigit():  # all digits cost the same
            key = ("0" if before.isdigit() else before) + segment + ("0" if after.isdigit() else after)
        got = self.tried.get(key)
        if got is None:
            total, other = self.model.total, self.model.other
            base = total(key)
            got = [(pair, base - total(before + new + after), new) for pair, new in utf8_mappings(segment)]
            if other is not self.model and got:
                most = other.total(key)
                # frequent garbling is judged without itself; a little gain is chance there
                if most > base and self.model.decodes(segment):
                    alone = [most - other.total(before + new + after) for _, _, new in got]
                    got = [(pair, max(gain, g) if g >= GAIN else gain, new) for (pair, gain, new), g in zip(got, alone, strict=True)]
            # what is well-formed UTF-8 nearly throughout needs no other explanation; spaces of any kind say nothing about
            # other encodings, and a symbol that stands by itself only something about one in which it is a symbol too
            rare = other is self.model or any(x > self.typical for x in self.model.costs(key))
            if rare and segment.strip() and max((g for _, g, _ in got), default=0.0) < self.enough * max(base, 1e-9):
                alone = before in _GAP and after in _GAP and all(c in _GAP or unicodedata.category(c)[0] in "SZC" for c in segment)
                for pair, new in other_mappings(segment):
                    if not alone or all(c < "\x80" or unicodedata.category(c)[0] in "SN" for c in new):
                        got.append((pair, base - total(before + new + after), new))
            least = 0.5 * GAIN_PER_CHAR
            got = [x for x in got if x[1] > least], {pair: max(gain, -LOSS) for pair, gain, _ in got if gain <= least}
            if len(self.tried) > MEMORY:
                self.tried.clear()
            if len(key) < 200:
                self.tried[key] = got
        return got

    def _tried(self, text: str, stretches: list[tuple[int, int]]) -> tuple[dict, list[dict]]:
        """Per mapping what it gains and the places it changes; and per stretch what other mappings cost."""
        gained: dict[tuple[str, str], list] = {}
        lost = []
        for a, b in stretches:
            before, after = text[a - 1] if a else "\n", text[b] if b < len(text) else "\n"
            gains, costs = self._gains(before, text[a:b], after)
            lost.append(costs)
            for pair, gain, new in gains:
                own = gained.setdefault(pair, [0.0, []])
                own[0] += gain
                own[1].append((a, b, new))
        return gained, lost

    def once(self, text: str) -> tuple[str, tuple[str, str] | None, float]:
        """The text with the mapping undone that gains most, that mapping, and the gain."""
        found: dict[tuple[str, str], _Evidence] = {}
        against: list[tuple[dict, list[dict], dict]] = []
        for island, stretches in self.segments(text):
            gains, costs = self._tried(text, stretches)
            more: list[dict] = []
            if stretches != [island]:
                whole, more = self._tried(text, [island])
                for pair, own in whole.items():
                    if pair not in gains or own[0] > gains[pair][0] + sum(c.get(pair, 0.0) for c in costs):
                        gains[pair] = [*own, True]
            against.append((gains, costs, more))
            for pair, own in gains.items():
                e = found.get(pair)
                if e is None:
                    e = found[pair] = _Evidence()
                e.gain += own[0]
                e.islands += 1
                e.places += own[1]
        good = {p: e for p, e in found.items() if e.holds(p, text)}
        if not good:
            return text, None, 0.0

        def cost(pair: tuple[str, str], gains: dict, costs: list[dict], more: list[dict]) -> float:
            """What a mapping costs in the stretches of an island that it does not explain, or in the island."""
            if pair in gains and len(gains[pair]) > 2:
                return 0.0
            own = [c[pair] for c in costs if pair in c]
            return sum(own) if own or pair in gains else sum(c.get(pair, 0.0) for c in more)

        pair = max(good, key=lambda p: good[p].gain + sum(cost(p, *island) for island in against))
        out, at = [], 0
        for a, b, new in good[pair].places:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), pair, good[pair].gain

    def restore(self, text: str) -> tuple[str, list[tuple[str, str]], float]:
        """The restored text, the mappings undone in turn, and their gain in bits."""
        found, total = [], 0.0
        for _ in range(2 * ROUNDS):
            text, pair, gain = self.once(text)
            if pair is None:
                break
            found.append(pair)
            total += gain
        return text, found, total


class _Evidence:
    """The segments of a text that one mapping makes more probable."""

    def __init__(self) -> None:
        self.gain = 0.0
        self.islands = 0
        self.places: list[tuple[int, int, str]] = []

    def holds(self, pair: tuple[str, str], text: str) -> bool:
        if pair[1] not in WRITTEN_IN:
            return self.gain >= GAIN
        if self.gain < GAIN_SINGLE:
            return False
        changed = [c for a, b, _ in self.places for c in text[a:b] if c > "\x7f" and not c.isspace()]
        return self.gain >= GAIN_PER_CHAR * len(changed) and (len(set(changed)) > 1 or self.islands > 2)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts (null: one in plain ASCII) to (bucket, documents), the buckets of both sketches one after the
    other; bucket -1 counts the documents themselves."""
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        found = [np.zeros(0, np.int64)]
        for t in texts:
            runs = decodable_runs(t)
            keys = distinct_pairs(t)
            found += _buckets(keys)
            found += (x + (2 << SKETCH_BITS) for x in _buckets(distinct_pairs(t, runs) if runs else keys))
        where, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(where, -1).astype(np.int32)), pa.array(np.append(n, batch.num_rows).astype(np.int64))], ["bucket", "n"]
        )


def pair_model(texts: DataFrame, text: str) -> PairModel:
    """The pair model of all distinct texts. At most 2**(SKETCH_BITS + 2) counts reach the driver, whatever the corpus."""
    # texts in plain ASCII only count, so their hash travels for them
    plain = F.length(text) == F.octet_length(text)
    once = texts.select(F.when(~plain, F.col(text)).alias("t"), F.when(plain, F.md5(text)).alias("h")).distinct()
    counts = once.select("t").mapInArrow(_counter, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(4 << SKETCH_BITS, dtype=np.float32)
    where, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    sketch[where[where >= 0]] = n[where >= 0]
    documents = int(n[where < 0].sum())
    return PairModel(sketch[: 2 << SKETCH_BITS], documents, PairModel(sketch[2 << SKETCH_BITS :], documents))


def garbled_texts(df: DataFrame, *, key: str, text: str, thorough: bool = False) -> DataFrame:
    """key, restored, readings, gain and lossy of the rows whose text was read in a wrong encoding, wholly or in places.

    restored is the text with all readings undone that could be; readings names them in the order of undoing ("as X, in
    fact Y"; empty if none could); gain is the evidence in bits; lossy marks characters that are gone (U+FFFD). Null and
    empty texts are never affected; repeated rows each come out; a text of any length is read whole. The statistics
    need a corpus: the fewer the texts, the less is taken for improbable, and under some dozens nothing is. An empty
    table gives no rows; other columns are ignored. thorough: other encodings are tried even where UTF-8 explains enough.
    """
    spark = df.sparkSession
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(pair_model(rows, "text"))
    schema = T.StructType(
        [T.StructField("key", rows.schema["key"].dataType), T.StructField("restored", T.StringType()), T.StructField("readings", T.StringType()),
         T.StructField("gain", T.DoubleType()), T.StructField("lossy", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value, thorough)
        for batch in batches:
            at, new, readings, gains, lossy = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t.isascii():
                    continue
                restored, found, gain = restorer.restore(t)
                if found or "\ufffd" in t:
                    at.append(i)
                    new.append(restored)
                    readings.append("; ".join(f"as {a}, in fact {b}" for a, b in found))
                    gains.append(gain)
                    lossy.append("\ufffd" in restored)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(new, pa.string()), pa.array(readings, pa.string()), pa.array(gains, pa.float64()), pa.array(lossy, pa.bool_())],
                schema.names,
            )

    return rows.mapInArrow(run, schema)
