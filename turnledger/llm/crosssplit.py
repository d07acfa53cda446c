"""Same or nearly the same prompts across splits.

The suffixes of all distinct prompts are sorted over range partitions: a partitioned suffix array. A suffix is compared by
its first RUN tokens and then by names of its prefixes of twice as many tokens again and again (prefix doubling, with
hashes for names, so that no round needs the ranks of the one before and one sort is enough, whatever the length).
Neighbours of both sides show, for every suffix, how far it is shared; these spans merged give a prompt's coverage.

For pairs, a prompt too few of whose distinct runs are covered cannot reach the similarity and is left out. The rest
meet inside stretches of the array, that is among suffixes with a common prefix of RUN tokens: in the rarest stretches of
each prompt only (as many as it takes not to miss a pair), among prompts of similar size only, and never in all pairs of
a frequent stretch. What is left is compared by all its runs, and then token by token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.tokens import CHUNK, chunks, flat, run_hashes, whole_runs
from turnledger.session import written

#: Tokens of a run; the least span that is looked at.
RUN = 4
SIMILARITY = 0.6
#: Suffixes of one partition of the array, about 100 bytes each in a task.
PART = 500_000


def prompts_of(samples: DataFrame, *, index: str, split: str, tokens: str, response_length: str, held_out: tuple[str, ...], train: str) -> DataFrame:
    """index, side (true for train), prompt and key (128 bits of the prompt) of the samples that take part: those of the
    named splits with tokens, a response length of at least 0, and a prompt left. Repeated samples stay repeated."""
    size = F.size(tokens) - F.col(response_length)
    usable = samples.where(
        F.col(split).isin(train, *held_out) & F.col(tokens).isNotNull() & (F.col(response_length) >= 0) & (size > 0)
    )
    prompt = F.slice(F.col(tokens), F.lit(1), size)
    return usable.select(
        F.col(index).alias("index"), (F.col(split) == train).alias("side"), prompt.alias("prompt"),
        F.unhex(F.md5(F.array_join(prompt.cast("array<string>"), ",", "-"))).alias("key"),
    )


def _ends(own: np.ndarray, row: np.ndarray, nulls: np.ndarray | None, size: int) -> np.ndarray:
    """Where the tokens that follow each place end: at the prompt's end or the next null."""
    end = own[1:][row]
    if nulls is None:
        return end
    at = np.flatnonzero(nulls)
    following = np.append(at, size)[np.searchsorted(at, np.arange(size), "left")]
    return np.minimum(end, following)


def _suffixes(width: int):
    """(id, side, prompt) to a row per suffix of at least RUN tokens: id, side, at, n_runs (distinct runs of its prompt), run
    (hash of its first RUN tokens) and key: these tokens in width bytes each, then the names of longer prefixes."""
    exact = RUN * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, offsets, nulls = flat(batch.column(2))
            for low, high in chunks(offsets, CHUNK // 8):
                a, b = offsets[low], offsets[high]
                own, part, gone = offsets[low : high + 1] - a, x[a:b], None if nulls is None else nulls[a:b]
                at, row = whole_runs(own, RUN, gone)
                if not len(at):
                    continue
                mark = run_hashes(part, RUN)[at]
                order = np.lexsort((mark, row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (mark[order][1:] != mark[order][:-1]) | (row[order][1:] != row[order][:-1])
                count = np.bincount(row[order][new], minlength=high - low).astype(np.int32)
                whole = np.repeat(np.arange(high - low), np.diff(own))
                names = np.log2((_ends(own, whole, gone, len(part))[at] - at) // RUN).astype(np.int64)
                keys = np.zeros((len(at), exact + 8 * names.max()), dtype=np.uint8)
                tokens = np.stack([part[at + k] for k in range(RUN)], axis=1)
                keys[:, :exact] = (tokens if width == 4 else tokens + np.uint64(1 << 63)).astype(f">u{width}").view(np.uint8).reshape(len(at), exact)
                for k in range(names.max()):
                    long = np.flatnonzero(names > k)
                    named = run_hashes(part, RUN << (k + 1), k + 1)[at[long]]
                    keys[long, exact + 8 * k : exact + 8 * k + 8] = named.astype(">u8").view(np.uint8).reshape(len(long), 8)
                size = exact + 8 * names
                raw = keys[np.arange(keys.shape[1]) < size[:, None]]
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                rows = pa.array(row.astype(np.int64) + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - own[row]).astype(np.int32)), pa.array(count[row]), pa.array(mark.view(np.int64)),
                     pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])],
                    ["id", "side", "at", "n_runs", "run", "key"],
                )

    return run


class _Keys:
    """Keys of suffixes as a matrix: the exact tokens, then the names, and how many columns each row has."""

    def __init__(self, column: pa.Array, width: int):
        self.exact = RUN * width // 8
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        values = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(">u8").astype(np.uint64)
        self.size = np.diff(offsets) // 8
        self.columns = np.arange(self.size.max())
        self.values = np.zeros((len(column), len(self.columns)), dtype=np.uint64)
        self.values[self.columns < self.size[:, None]] = values

    def shared(self, rows: np.ndarray, other: _Keys, others: np.ndarray) -> np.ndarray:
        """Tokens that rows and others have in common at their start, as far as the names tell: 0 or RUN, 2 RUN, 4 RUN, ..."""
        n = min(len(self.columns), len(other.columns))
        same = self.values[rows, :n] == other.values[others, :n]
        same &= self.columns[:n] < np.minimum(self.size[rows], other.size[others])[:, None]
        equal = np.where(same.all(axis=1), n, np.argmin(same, axis=1))
        return np.where(equal >= self.exact, RUN << np.maximum(equal - self.exact, 0), 0)


def _neighbours(width: int):
    """One sorted partition of the array to the suffixes that are shared with the other side, and how far. Only those in the
    first and the last stretch can have nearer neighbours in other partitions: they keep their keys. Rows without an id
    are the partition's first and last suffix of each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows).combine_chunks()
        column = {c: whole.column(c).combine_chunks() for c in whole.column_names}
        column = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in column.items()}
        keys, side = _Keys(column["key"], width), column["side"].to_numpy()
        n, step = len(side), np.arange(len(side))
        far = np.zeros(n, dtype=np.int64)
        edges = []
        for own, other in ((1, 2), (2, 1)):
            marks = np.flatnonzero(side & other)
            edges += [(other, end, int(at)) for end, at in zip((0, 1), marks[[0, -1]])] if len(marks) else []
            mine = np.flatnonzero(side & own)
            if not len(marks) or not len(mine):
                continue
            place = np.searchsorted(marks, mine, "right")
            for near, there in ((marks[np.maximum(place - 1, 0)], place > 0), (marks[np.minimum(np.searchsorted(marks, mine), len(marks) - 1)], np.searchsorted(marks, mine) < len(marks))):
                far[mine] = np.maximum(far[mine], np.where(there, keys.shared(mine, keys, near), 0))
        exact = keys.values[:, : keys.exact]
        open_ = (exact == exact[0]).all(axis=1) | (exact == exact[-1]).all(axis=1)
        keep = np.flatnonzero(open_ | (far > 0))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keep), part, dtype=np.int32)), *(column[c].take(pa.array(keep)) for c in ("id", "side", "at", "n_runs", "run")), pa.array(far[keep].astype(np.int32)),
             column["key"].take(pa.array(np.where(open_[keep], keep, -1), mask=~open_[keep]))],
            ["part", "id", "side", "at", "n_runs", "run", "tokens", "key"],
        )
        none = lambda t: pa.nulls(len(edges), t)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(edges), pa.int32()), none(pa.int64()), pa.array([e[0] for e in edges], pa.int8()), pa.array([e[1] for e in edges], pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int32()),
             column["key"].take(pa.array([e[2] for e in edges], pa.int64()))],
            ["part", "id", "side", "at", "n_runs", "run", "tokens", "key"],
        )

    return run


def _across(width: int, outside):
    """Rows of _neighbours with the neighbours of other partitions taken in."""
    names = ["id", "side", "at", "n_runs", "run", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, part, side = (batch.column(k).to_numpy().copy() for k in (6, 0, 2))
            at = np.flatnonzero(batch.column(7).is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                keys = _Keys(batch.column(7).take(pa.array(at)), width)
                for p in np.unique(part[at]):
                    for own, other in ((1, 2), (2, 1)):
                        mine = np.flatnonzero((part[at] == p) & (side[at] & own > 0))
                        for key in outside.value.get((int(p), other), ()) if len(mine) else ():
                            edge = _Keys(pa.array([key], pa.binary()), width)
                            far[at[mine]] = np.maximum(far[at[mine]], keys.shared(mine, edge, np.zeros(len(mine), np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, 6)), pa.array(far.astype(np.int32))], names).filter(pa.array(far > 0))

    return run


def suffix_spans(sides: DataFrame) -> DataFrame:
    """id, side, at, n_runs, run and tokens: the suffixes of distinct prompts (what _sides gave) that the other side shares,
    each with the number of tokens it shares at least (the largest RUN, 2 RUN, 4 RUN, ... that fits)."""
    spark = sides.sparkSession
    size = sides.agg(F.max(F.array_max("prompt")).alias("hi"), F.min(F.array_min("prompt")).alias("lo"), F.sum(F.size("prompt")).alias("n")).first()
    width = 4 if size["hi"] is None or (size["hi"] < 1 << 32 and size["lo"] >= 0) else 8
    suffixes = sides.select("id", "side", "prompt").mapInArrow(_suffixes(width), "id bigint, side tinyint, at int, n_runs int, run bigint, key binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["n"] or 0) // PART))
    # ids take part in the ranges, so a stretch of a third of all suffixes spreads over partitions
    array = suffixes.repartitionByRange(parts, "key", "id", "at").sortWithinPartitions("key")
    found = written(array.mapInArrow(_neighbours(width), "part int, id bigint, side tinyint, at int, n_runs int, run bigint, tokens int, key binary"), "suffix-array")
    # four keys a partition reach the driver
    edges = sorted(found.where(F.col("id").isNull()).select("part", "side", "at", "key").collect(), key=lambda r: (bytes(r["key"]), r["at"]))
    order = list(dict.fromkeys(r["part"] for r in edges))
    outside: dict[tuple[int, int], list[bytes]] = {}
    for other in (1, 2):
        for end, parts_in_order in ((1, order), (0, order[::-1])):
            own = {r["part"]: bytes(r["key"]) for r in edges if r["side"] == other and r["at"] == end}
            seen = None
            for p in parts_in_order:
                if seen is not None:
                    outside.setdefault((p, other), []).append(seen)
                seen = own.get(p, seen)
    shared = spark.sparkContext.broadcast(outside)
    return found.where(F.col("id").isNotNull()).mapInArrow(_across(width, shared), "id bigint, side tinyint, at int, n_runs int, run bigint, tokens int")


def _sides(prompts: DataFrame) -> DataFrame:
    """The distinct prompts, numbered, with the sides they stand on (1 train, 2 held out, 3 both)."""
    sides = prompts.groupBy("key").agg(F.bit_or(F.when(F.col("side"), 1).otherwise(2)).cast("tinyint").alias("side"), F.first("prompt").alias("prompt"))
    return written(sides.withColumn("id", F.monotonically_increasing_id()), "prompts")


def coverage(prompts: DataFrame, *, least: int = 2 * RUN) -> DataFrame:
    """Per distinct prompt: key, side (1 train, 2 held out, 3 both), n_tokens, covered: the tokens in spans of at least
    ``least`` tokens (RUN, 2 RUN, 4 RUN, ...) that also stand in a prompt of the other side, and longest: the longest shared
    span, rounded down to such a number (0 if none is shared).

    A longer span shows at each of its suffixes, so spans rounded down cover the same tokens."""
    if least < RUN or least & (least - 1) or RUN & (RUN - 1):
        raise ValueError("least must be RUN times a power of two")
    sides = _sides(prompts)
    span = F.struct("at", (F.col("at") + F.col("tokens")).alias("end"))
    by_prompt = suffix_spans(sides).groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("tokens") >= least, span))).alias("spans"), F.max("tokens").alias("longest"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    merged = F.aggregate(
        "spans", start, lambda z, x: F.struct((z["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], z["end"]))).alias("n"), F.greatest(z["end"], x["end"]).alias("end")), lambda z: z["n"]
    )
    found = by_prompt.select("id", merged.alias("covered"), "longest")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sides.join(found, "id", "left").select("key", "side", F.size("prompt").alias("n_tokens"), none("covered"), none("longest"))


def _grams(prompt: Column) -> Column:
    """The distinct runs of RUN tokens of a prompt, token by token; those with a null are none."""
    at = F.when(F.size(prompt) >= RUN, F.sequence(F.lit(0), F.size(prompt) - RUN)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(at, lambda i: F.slice(prompt, i + 1, RUN))
    return F.array_distinct(F.filter(runs, lambda r: ~F.exists(r, lambda t: t.isNull())))


def similar_prompts(sides: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """(held, train, similarity) of the prompt keys of both sides of which at least that share of the distinct runs of
    RUN tokens is common. Prompts of fewer tokens have no run and are similar to none. sides: what _sides gave."""
    spans = written(suffix_spans(sides), "spans")
    # how many suffixes share a stretch decides the common order in which prompts are tried: the rarest first
    often = spans.groupBy("run").agg(F.count("*").alias("often"))
    own = spans.join(often, "run").groupBy("id").agg(
        F.first("side").alias("side"), F.first("n_runs").alias("n_runs"), F.transform(F.sort_array(F.collect_set(F.struct("often", "run"))), lambda r: r["run"]).alias("runs")
    )
    # a pair shares at least need of each prompt's runs: a prompt with fewer covered has no partner, and without one
    # among the first (covered - need + 1) of both, in one common order, a pair cannot be one
    need = F.ceil(F.lit(similarity) * F.col("n_runs") - F.lit(1e-9)).cast("int")
    reach = written(own.where(F.size("runs") >= need).withColumn("first", F.size("runs") - need + 1), "reach")
    # sizes of a pair differ by a factor of 1 / similarity at most, so bands of that width are equal or next to each other
    band = F.floor(F.log(F.col("n_runs").cast("double")) / math.log(1 / similarity)).cast("int")

    def side(bit: int, p: str, bands: Column) -> DataFrame:
        rows = reach.where(F.col("side").bitwiseAND(bit) > 0).select(F.col("id").alias(f"{p}_id"), F.col("n_runs").alias(f"{p}_n"), F.size("runs").alias("c"), F.explode(bands).alias("band"), F.slice("runs", F.lit(1), F.col("first")).alias("p"))
        return rows.select(f"{p}_id", f"{p}_n", "band", "c", F.posexplode("p").alias("place", "probe")).withColumn(f"{p}_left", F.col("c") - F.col("place")).drop("c", "place")

    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    # nothing before the first probe that both have is common, so no more than the rest of the shorter list can be
    enough = F.least("a_left", "b_left") >= F.lit(similarity / (1 + similarity)) * (F.col("a_n") + F.col("b_n")) - F.lit(1e-9)
    met = side(2, "a", F.array(band - 1, band, band + 1)).join(side(1, "b", F.array(band)), ["probe", "band"])
    met = met.where((low >= F.lit(similarity) * high - F.lit(1e-9)) & enough).select("a_id", "b_id").distinct()
    runs_of = lambda p: reach.select(F.col("id").alias(f"{p}_id"), F.col("n_runs").alias(f"{p}_n"), F.col("runs").alias(f"{p}_runs"))
    pairs = met.join(runs_of("a"), "a_id").join(runs_of("b"), "b_id").withColumn("common", F.size(F.array_intersect("a_runs", "b_runs")))
    likely = pairs.where(F.col("common") >= similarity * (F.col("a_n") + F.col("b_n") - F.col("common")) - 1e-9).select("a_id", "b_id")
    # hashes found them; their tokens decide
    text = lambda p, name: sides.select(F.col("id").alias(f"{p}_id"), F.col("key").alias(name), F.col("prompt").alias(f"{p}_prompt"))
    both = likely.join(text("a", "held"), "a_id").join(text("b", "train"), "b_id").withColumns({f"{p}_grams": _grams(F.col(f"{p}_prompt")) for p in "ab"})
    both = both.withColumn("common", F.size(F.array_intersect("a_grams", "b_grams")))
    share = F.col("common") / (F.size("a_grams") + F.size("b_grams") - F.col("common"))
    return both.select("held", "train", share.alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)


def _members(prompts: DataFrame, train: bool, *columns: str) -> DataFrame:
    return prompts.where("side" if train else "not side").select("index", "key", *columns).distinct()


def cross_split_pairs(samples: DataFrame, *, index: str, split: str, tokens: str, response_length: str, held_out: tuple[str, ...] = ("eval", "test"), train: str = "train", similarity: float = SIMILARITY) -> DataFrame:
    """(held, train, similarity): indexes of a held-out and a training sample with similar prompts.

    Samples with null split, tokens or response length, a negative length, or no prompt left take no part; null tokens
    inside a prompt end a run. Repeated rows count once; equal prompts are compared once and written out per sample at
    the end. Empty tables give no rows; further columns are ignored.
    """
    prompts = prompts_of(samples, index=index, split=split, tokens=tokens, response_length=response_length, held_out=held_out, train=train)
    pairs = written(similar_prompts(_sides(prompts), similarity=similarity), "similar")
    name = lambda side: _members(prompts, side == "train").withColumnsRenamed({"key": side, "index": f"{side}_index"})
    return pairs.join(name("held"), "held").join(name("train"), "train").select(F.col("held_index").alias("held"), F.col("train_index").alias("train"), "similarity").distinct()


def cross_split_counts(samples: DataFrame, *, index: str, split: str, tokens: str, response_length: str, by: tuple[str, ...], held_out: tuple[str, ...] = ("eval", "test"), train: str = "train", similarity: float = SIMILARITY) -> DataFrame:
    """Per ``by`` (columns of the held-out samples): n_samples with a training counterpart, and n_pairs, as
    cross_split_pairs has them. Pairs are counted from the sizes of classes of equal prompts, never listed."""
    names = {"index": index, "split": split, "tokens": tokens, "response_length": response_length, "held_out": held_out, "train": train}
    prompts = prompts_of(samples, **names)
    pairs = written(similar_prompts(_sides(prompts), similarity=similarity), "similar")
    size = _members(prompts, True).groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "train")
    partners = pairs.join(size, "train").groupBy("held").agg(F.sum("n").alias("n"))
    own = samples.select(F.col(index).alias("index"), *by).distinct()
    held = _members(prompts, False).withColumnRenamed("key", "held").join(partners, "held").join(own, "index")
    return held.groupBy(*by).agg(F.count("*").alias("n_samples"), F.sum("n").alias("n_pairs"))
