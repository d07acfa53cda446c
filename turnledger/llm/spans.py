"""Long exact spans that records of different owners share.

Under each of several hash functions every run of ``span`` tokens has a least hash of the token q-grams in it. Neighbouring
runs mostly have the same one: they form a compact window, a node of the Cartesian tree over the q-gram hashes whose
subtree is at least one run wide. The windows of all functions are laid over one another (an interval join within the
record), and each piece has the least hashes of all of them as its signature. Equal runs lie in pieces of equal
signature, so a pass over all records that sends one row per piece finds the signatures met with two owners. Where those stand, records are cut to the stretches around them, and
only the runs of these stretches are compared, by two independent hashes of all their tokens (128 bits). Windows and
runs are grouped, never paired.

The tree is not built by recursion, which degenerates on repetitive arrays: the windows at least a run wide are
exactly the stretches of equal running minimum, and these take log2(span) passes whatever the ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.llm.tokens import chunks, flat, mixed, run_hashes, run_minima, whole_runs
from turnledger.session import written

SPAN = 32
#: Independent hash functions that make up a signature: more hashes, fewer accidental meetings, more windows.
HASHES = 3
#: Parts into which the rows of one signature or run are split where these are joined.
SALTS = 16
#: Shared signatures (8 bytes) or runs (16 bytes) up to which every task gets them all; beyond, they are joined.
SENT = 2_000_000


def signatures(x: np.ndarray, span: int, hashes: int) -> np.ndarray:
    """The signature of the run of span values at each start."""
    q = max(1, span // 2)
    out = None
    for k in range(hashes):
        least = run_minima(run_hashes(x, q, 2 * k), span - q + 1)
        out = least if out is None else mixed(out, k) + least
    return out


def _each_array(batch: pa.RecordBatch, first: int, span: int):
    """(array number, rows low, values, offsets, starts, row of each start) for the list columns from column first on."""
    for k in range(first, batch.num_columns):
        x, offsets, nulls = flat(batch.column(k))
        for low, high in chunks(offsets):
            a, b = offsets[low], offsets[high]
            if b - a < span:
                continue
            own = offsets[low : high + 1] - a
            at, row = whole_runs(own, span, None if nulls is None else nulls[a:b])
            if len(at):
                yield k - first, low, x[a:b], own, at, row


def _windows(span: int, hashes: int):
    """(owner, arrays...) to the distinct (signature, owner) of the windows of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column(0).to_numpy()
            for _, low, x, _, at, row in _each_array(batch, 1, span):
                mark, own = signatures(x, span, hashes)[at], owner[low:][row]
                keep = np.ones(len(at), dtype=bool)
                keep[1:] = (mark[1:] != mark[:-1]) | (own[1:] != own[:-1])
                mark, own = mark[keep], own[keep]
                order = np.lexsort((own, mark))
                mark, own = mark[order], own[order]
                keep = np.ones(len(mark), dtype=bool)
                keep[1:] = (mark[1:] != mark[:-1]) | (own[1:] != own[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(mark[keep].view(np.int64)), pa.array(own[keep])], ["mark", "owner"])

    return run


def _window_rows(span: int, hashes: int, names: Sequence[str], ids: Sequence[str]):
    """(ids..., owner, arrays...) to one row per window: ids, array_name, mark, first and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, low, x, own, at, row in _each_array(batch, len(ids) + 1, span):
                mark = signatures(x, span, hashes)[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (mark[1:] != mark[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                rows = pa.array(row[first].astype(np.int64) + low)
                start = own[row[first]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(rows) for i in range(len(ids))), pa.array([names[k]] * len(first)), pa.array(mark[first].view(np.int64)),
                     pa.array((at[first] - start).astype(np.int32)), pa.array((at[last] - start).astype(np.int32))],
                    [*ids, "array_name", "mark", "low", "high"],
                )

    return run


def _merged(row: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal stretches covered by runs at ascending starts."""
    if not len(at):
        return row, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + span)
    first = np.flatnonzero(new)
    return row[first], at[first], at[np.append(first[1:], len(at)) - 1] + span


def _member(values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Membership in a sorted array of unsigned integers, behind a bitmap."""
    bits = np.zeros(1 << 22, dtype=bool)
    bits[values >> np.uint64(42)] = True

    def test(x: np.ndarray) -> np.ndarray:
        out = bits[x >> np.uint64(42)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            found = np.searchsorted(values, x[maybe])
            found[found == len(values)] = 0
            out[maybe] = values[found] == x[maybe]
        return out

    return test


def _stretches(span: int, hashes: int, names: Sequence[str], n_ids: int, shared):
    """(ids..., owner, arrays...) to the stretches around shared signatures, with their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _member(shared.value)
        for batch in batches:
            for k, low, x, own, at, row in _each_array(batch, n_ids + 1, span):
                hit = known(signatures(x, span, hashes)[at])
                rows, start, end = _merged(row[hit], at[hit], span)
                if not len(rows):
                    continue
                index = np.repeat(start - np.concatenate([[0], np.cumsum(end - start)[:-1]]), end - start) + np.arange((end - start).sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)), pa.array(x[index].view(np.int64)))
                taken = pa.array(rows.astype(np.int64) + low)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(taken) for i in range(n_ids + 1)), pa.array([names[k]] * len(rows)), pa.array((start - own[rows]).astype(np.int32)), lists],
                    [f"c{i}" for i in range(n_ids + 4)],
                )

    return run


def _runs(span: int):
    """(owner, tokens) to distinct (run, check, least and greatest owner) per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column(0).to_numpy()
            for _, low, x, _, at, row in _each_array(batch, 1, span):
                a, b, own = run_hashes(x, span, 11)[at], run_hashes(x, span, 13)[at], owner[low:][row]
                order = np.lexsort((own, b, a))
                a, b, own = a[order], b[order], own[order]
                new = np.ones(len(a), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(a)) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(own[first]), pa.array(own[last])], ["run", "check", "low", "high"]
                )

    return run


def _run_rows(span: int, n_ids: int):
    """(ids..., array_name, start, tokens) to a row per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset = batch.column(n_ids + 1).to_numpy()
            for _, low, x, own, at, row in _each_array(batch, n_ids + 2, span):
                rows = pa.array(row.astype(np.int64) + low)
                place = offset[low:][row] + at - own[row]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(rows) for i in range(n_ids + 1)), pa.array(place.astype(np.int32)),
                     pa.array(run_hashes(x, span, 11)[at].view(np.int64)), pa.array(run_hashes(x, span, 13)[at].view(np.int64))],
                    [f"c{i}" for i in range(n_ids + 4)],
                )

    return run


def _marked(span: int, n_ids: int, shared):
    """(ids..., array_name, start, tokens) to the maximal stretches of shared runs, with all shared runs at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, checks = shared.value
        known = _member(runs)
        for batch in batches:
            offset = batch.column(n_ids + 1).to_numpy()
            for _, low, x, own, at, row in _each_array(batch, n_ids + 2, span):
                a = run_hashes(x, span, 11)[at]
                hit = np.flatnonzero(known(a))
                if not len(hit):
                    continue
                b = run_hashes(x, span, 13)[at[hit]]
                left, right = np.searchsorted(runs, a[hit], "left"), np.searchsorted(runs, a[hit], "right")
                same = checks[left] == b
                for i in np.flatnonzero(~same & (right - left > 1)):  # equal first hashes of different runs
                    same[i] = (checks[left[i] : right[i]] == b[i]).any()
                hit = hit[same]
                rows, start, end = _merged(row[hit], at[hit], span)
                base = offset[low:][rows] - own[rows]
                taken = pa.array(rows.astype(np.int64) + low)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(taken) for i in range(n_ids + 1)), pa.array((base + start).astype(np.int32)), pa.array((base + end).astype(np.int32))],
                    [f"c{i}" for i in range(n_ids + 3)],
                )

    return run


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in column.chunks)]).view(np.uint64)


def _renamed(run, names: Sequence[str]):
    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, list(names))

    return renamed


def shared_spans(df: DataFrame, *, ids: Sequence[str], owner: str, arrays: Sequence[str], span: int = SPAN, hashes: int = HASHES, sent: int = SENT) -> DataFrame:
    """ids, array_name, span_start, span_end of every maximal stretch of positions that lie in a run of at least ``span``
    tokens which also stands in some array of a record of another owner. Starts count from 0, ends are exclusive.

    Nulls: null arrays have no runs, a null token ends a run, null owners are one owner of their own. Repeated rows
    count once. Short and empty arrays give no rows, nor does an empty table; arrays of any length are read whole.
    Columns beyond the named ones are ignored.
    """
    if span < 2:
        raise ValueError("a span has at least two tokens")
    ids, arrays = list(ids), list(arrays)
    spark, n = df.sparkSession, len(ids)
    rows = df.select(*ids, F.xxhash64(owner).alias("__owner"), *(F.col(a).cast("array<bigint>").alias(a) for a in arrays))
    fields = [T.StructField(c, rows.schema[c].dataType) for c in ids] + [T.StructField("array_name", T.StringType())]
    whole = lambda *more: T.StructType(fields + [T.StructField(c, t) for c, t in more])
    long, int_ = T.LongType(), T.IntegerType()

    marks = rows.select("__owner", *arrays).mapInArrow(_windows(span, hashes), "mark bigint, owner bigint")
    met = marks.groupBy("mark").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where(F.col("a") != F.col("b")).select("mark")
    met = written(met, "signatures")
    stretch = T.StructType([*fields[:n], T.StructField("__owner", long), *fields[n:], T.StructField("start", int_), T.StructField("tokens", T.ArrayType(long))])
    if met.count() <= sent:
        known = np.sort(_longs(met.toArrow().column(0)))
        cut = rows.mapInArrow(_renamed(_stretches(span, hashes, arrays, n, spark.sparkContext.broadcast(known)), stretch.names), stretch)
    else:
        cut = _cut_by_join(rows, met, ids, arrays, span, hashes, whole(("mark", long), ("low", int_), ("high", int_))).select(*stretch.names)
    cut = written(cut.where(F.size("tokens") >= span), "stretches")

    runs = cut.select("__owner", "tokens").mapInArrow(_runs(span), "run bigint, check bigint, low bigint, high bigint")
    runs = runs.groupBy("run", "check").agg(F.min("low").alias("a"), F.max("high").alias("b")).where(F.col("a") != F.col("b")).select("run", "check")
    runs = written(runs, "runs")
    parts = cut.select(*ids, "array_name", "start", "tokens")
    if runs.count() <= sent:
        pairs = np.stack([_longs(c) for c in runs.toArrow().columns], axis=1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        shape = whole(("span_start", int_), ("span_end", int_))
        both = spark.sparkContext.broadcast((np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])))
        return parts.mapInArrow(_renamed(_marked(span, n, both), shape.names), shape).distinct()
    shape = whole(("at", int_), ("run", long), ("check", long))
    at = _met(parts.mapInArrow(_renamed(_run_rows(span, n), shape.names), shape), runs, ["run", "check"], [*ids, "at"])
    return _spans_of(at.groupBy(*ids, "array_name").agg(F.sort_array(F.collect_set("at")).alias("at")), ids, span)


def _met(rows: DataFrame, keys: DataFrame, on: list[str], by: Sequence[str]) -> DataFrame:
    """Rows whose key is among the keys (each there once). What a third of all records share is one key with a third of the
    rows, so every key's rows are split by a hash of ``by``, and the keys repeated for each part."""
    parts = keys.select(*on, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__part"))
    return rows.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(parts, [*on, "__part"], "left_semi").drop("__part")


def _spans_of(df: DataFrame, ids: Sequence[str], span: int) -> DataFrame:
    """(ids, array_name, at: ascending starts of runs) to maximal stretches."""
    new = F.filter("at", lambda x, i: (i == 0) | (x > F.get("at", i - 1) + span))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > x + span))
    return df.select(*ids, "array_name", F.explode(F.arrays_zip(new.alias("s"), last.alias("e"))).alias("z")).select(
        *ids, "array_name", F.col("z.s").cast("int").alias("span_start"), (F.col("z.e") + span).cast("int").alias("span_end")
    )


def _cut_by_join(rows: DataFrame, met: DataFrame, ids: Sequence[str], arrays: Sequence[str], span: int, hashes: int, shape: T.StructType) -> DataFrame:
    """The stretches around shared signatures when there are too many signatures to send."""
    windows = _met(rows.mapInArrow(_window_rows(span, hashes, arrays, ids), shape), met, ["mark"], [*ids, "low"])
    at = windows.select(*ids, "array_name", F.explode(F.sequence("low", "high")).alias("at"))
    pieces = _spans_of(at.groupBy(*ids, "array_name").agg(F.sort_array(F.collect_set("at")).alias("at")), ids, span)
    one = rows.select(*ids, "__owner", F.explode(F.array(*(F.struct(F.lit(a).alias("n"), F.col(a).alias("v")) for a in arrays))).alias("z")).select(
        *ids, "__owner", F.col("z.n").alias("array_name"), F.col("z.v").alias("values")
    )
    same = F.col("p.array_name") == F.col("r.array_name")
    for c in ids:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}"))
    return one.alias("r").join(pieces.alias("p"), same).select(
        *(F.col(f"r.{c}").alias(c) for c in ids), "__owner", F.col("r.array_name").alias("array_name"), F.col("span_start").alias("start"),
        F.slice("values", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("tokens"),
    )
