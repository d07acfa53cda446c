"""Parent-child links to full hierarchies.

Groups (the scope columns) up to ``max_group_rows`` nodes are laid out one after another in the tasks of one shuffle
and resolved there by leaf peeling: leaves hand descendant lists and subtree sizes to their parents until nothing but
cycles is left, and the reverse of that order hands paths, depths and roots down. Larger groups never meet in one
task: their nodes follow pointers that double in length every round, log2(depth) joins instead of one per level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.session import written

#: Nodes of one group that one task may hold (about 200 bytes each while it is resolved; lists come out piece by piece).
MAX_GROUP_ROWS = 400_000
_CHUNK = 150_000
#: Entries of paths and descendants that are held at a time.
_ENTRIES = 2_000_000


def first_parents(df: DataFrame, *, scope: Sequence[str], node: str, parent: str, order: str | None) -> DataFrame:
    """One row per (scope, node): the parent that its row of smallest order names. Rows without a node are left out;
    null orders come last; rows equal in order give the least parent (null, a root, before any)."""
    rank = [F.col(order).isNull().alias("a"), F.col(order).alias("b")] if order else []
    return (
        df.where(F.col(node).isNotNull())
        .groupBy(*scope, node)
        .agg(F.min(F.struct(*rank, F.col(parent).alias("p"))).alias("__m"))
        .select(*scope, node, F.col("__m.p").alias(parent))
    )


def peel(group: np.ndarray, node: np.ndarray, parent: np.ndarray) -> dict[str, np.ndarray | list]:
    """Resolves whole groups held in arrays. node and parent are strings (parent may be None).

    Returns parent positions (-1 for roots), the peel order, the cycle nodes, depth and root.
    """
    n = len(node)
    codes, names = pd.factorize(np.concatenate([node, parent]), use_na_sentinel=True)
    width = len(names) + 1
    own = group.astype(np.int64) * width + codes[:n]
    wanted = np.where(codes[n:] < 0, -1, group.astype(np.int64) * width + codes[n:])
    by_key = np.argsort(own, kind="stable")
    at = np.searchsorted(own[by_key], wanted)
    at[at == n] = 0
    up = np.where((wanted >= 0) & (own[by_key[at]] == wanted), by_key[at], -1)
    waiting = np.bincount(up[up >= 0], minlength=n)
    size = np.ones(n, dtype=np.int64)
    order, frontier = [], np.flatnonzero(waiting == 0)
    left = waiting.copy()
    left[frontier] = -1
    while len(frontier):
        order.append(frontier)
        sent = frontier[up[frontier] >= 0]
        to = up[sent]
        np.add.at(size, to, size[sent])
        np.subtract.at(left, to, 1)
        to = np.unique(to)
        frontier = to[left[to] == 0]
        left[frontier] = -1
    cyclic = np.flatnonzero(left > 0)
    least = np.arange(n)
    if len(cyclic):
        # the least node name on each cycle, by doubling along the cycle
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(np.asarray(names, dtype=object), kind="stable")] = np.arange(len(names))
        best, step = least.copy(), up.copy()
        for _ in range(int(len(cyclic)).bit_length()):
            other = best[step[cyclic]]
            worse = rank[codes[:n][other]] < rank[codes[:n][best[cyclic]]]
            best[cyclic] = np.where(worse, other, best[cyclic])
            step[cyclic] = step[step[cyclic]]
        least = best
    depth = np.full(n, -1, dtype=np.int32)
    root = least.copy()
    size[cyclic] = 0
    for level in reversed(order):
        tops = level[up[level] < 0]
        depth[tops], root[tops] = 0, tops
        rest = level[up[level] >= 0]
        above = depth[up[rest]]
        depth[rest] = np.where(above < 0, -1, above + 1)
        root[rest] = root[up[rest]]
    return {"up": up, "order": order, "cyclic": cyclic, "depth": depth, "root": root, "size": size}


def _enter(found: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers such that the descendants of node i are those numbered enter[i] + 1 to enter[i] + size[i] - 1, and the nodes in
    that order. Nodes that reach no root come last, without an order."""
    up, depth, size = found["up"], found["depth"], found["size"]
    by_depth = np.lexsort((up, depth))
    by_depth = by_depth[np.searchsorted(depth[by_depth], 0) :]
    levels = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=-1) + 2))
    enter = np.full(len(up), len(up), dtype=np.int64)
    for k, (a, b) in enumerate(zip(levels[:-1], levels[1:], strict=True)):
        level = by_depth[a:b]
        before = np.cumsum(size[level]) - size[level]
        if k == 0:
            enter[level] = before
            continue
        first = np.flatnonzero(np.append(True, up[level][1:] != up[level][:-1]))
        start = np.repeat(before[first], np.diff(np.append(first, len(level))))
        enter[level] = enter[up[level]] + 1 + before - start
    return enter, np.argsort(enter, kind="stable")


def _lists(found: dict, node: np.ndarray, most: int) -> Iterator[tuple[slice, pa.Array, pa.Array]]:
    """Paths from the root and descendants in byte order, null for nodes that never reach a root, a slice of nodes at a time
    whose lists have ``most`` entries together, or one node: a deep tree has far more entries than nodes."""
    up, depth, size = found["up"], found["depth"], found["size"]
    enter, order = _enter(found)
    codes, names = pd.factorize(node)
    by_name = np.argsort(names, kind="stable")
    rank = np.empty(len(names), dtype=np.int64)
    rank[by_name] = np.arange(len(names))
    rank, names = rank[codes], pa.array(names[by_name], pa.string())
    good = depth >= 0
    n_path, n_below = np.where(good, depth + 1, 0).astype(np.int64), np.where(good, size - 1, 0)
    total = np.cumsum(n_path + n_below)
    low = 0

    def lists(counts: np.ndarray, values: np.ndarray, rows: slice) -> pa.Array:
        cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), names.take(pa.array(values)), mask=pa.array(~good[rows]))

    while low < len(node):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        rows = slice(low, high)
        ends = np.cumsum(n_path[rows])
        path = np.zeros(ends[-1], dtype=np.int64)
        at, who = ends - 1, np.arange(low, high)
        at, who = at[good[rows]], who[good[rows]]
        while len(who):
            path[at] = rank[who]
            on = up[who] >= 0
            at, who = at[on] - 1, up[who[on]]
        below = [np.sort(rank[order[enter[i] + 1 : enter[i] + size[i]]]) for i in range(low, high) if n_below[i]]
        yield rows, lists(n_path[rows], path, rows), lists(n_below[rows], np.concatenate([np.zeros(0, np.int64), *below]), rows)
        low = high


def _resolver(n_scope: int, lists: bool):
    """mapInArrow function over rows of (scope..., node, parent) that are sorted by scope."""

    def resolve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        frame = [rows.column(i).combine_chunks() for i in range(n_scope)]
        group = np.zeros(rows.num_rows, dtype=np.int64)
        for column in frame:
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            group[1:] |= code[1:] != code[:-1]
        group = np.cumsum(group)
        node = rows.column(n_scope).to_numpy()
        found = peel(group, node, rows.column(n_scope + 1).to_numpy())
        out = [*frame, rows.column(n_scope).combine_chunks(), pa.array(node[found["root"]], pa.string()), pa.array(found["depth"], pa.int32())]
        whole = pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))])
        if not lists:
            yield whole
            return
        for rows, paths, below in _lists(found, node, _ENTRIES):
            part = whole.slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays([*part.columns, paths, below], [*part.schema.names, "path", "below"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < _CHUNK:
                continue
            # all groups but the last, which may go on in the next batch
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.zeros(count, dtype=bool)
            for i in range(n_scope):
                code = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                last[1:] |= code[1:] != code[:-1]
            cut = int(np.flatnonzero(last)[-1]) if last.any() else 0
            if cut:
                yield from resolve(table.slice(0, cut).to_batches())
                held = table.slice(cut).to_batches()
                count -= cut
        if count:
            yield from resolve(held)

    return run


def _doubled(nodes: DataFrame, scope: list[str], node: str, parent: str, lists: bool, most: int) -> DataFrame:
    """The same result for groups too large for a task, by pointer doubling over all their nodes."""
    a, b = nodes.alias("a"), nodes.alias("b")
    here = F.lit(True)
    for c in scope:
        here = here & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    found = F.col(f"b.{node}")
    state = a.join(b, here & (F.col(f"a.{parent}") == found), "left").select(
        *(F.col(f"a.{c}").alias(c) for c in scope),
        F.col(f"a.{node}").alias("id"),
        F.coalesce(found, F.col(f"a.{node}")).alias("up"),
        F.when(found.isNull(), 0).otherwise(1).alias("steps"),
        found.isNull().alias("ended"),
        F.col(f"a.{node}").alias("least"),
        (F.when(found.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(f"a.{node}"))) if lists else F.lit(None).cast("array<string>")).alias("way"),
    )
    state = written(state, "hierarchy")
    # nodes that have arrived are looked up, but never sent on their way again: they all stand at few roots
    arrived, state, reach = state.where("ended"), state.where(~F.col("ended")), 1
    while reach <= 2 * most and not state.isEmpty():
        x, y = state.alias("a"), state.unionByName(arrived).alias("b")
        on_root = F.col("b.ended") & (F.col("b.up") == F.col("b.id"))
        moved = written(
            x.join(y, here & (F.col("a.up") == F.col("b.id")), "inner").select(
                *(F.col(f"a.{c}").alias(c) for c in scope),
                F.col("a.id").alias("id"),
                F.col("b.up").alias("up"),
                (F.col("a.steps") + F.when(on_root, 0).otherwise(F.col("b.steps"))).cast("int").alias("steps"),
                F.col("b.ended").alias("ended"),
                F.least("a.least", "b.least").alias("least"),
                (F.concat("a.way", "b.way") if lists else F.lit(None).cast("array<string>")).alias("way"),
            ),
            "hierarchy",
        )
        arrived, state = arrived.unionByName(moved.where("ended")), moved.where(~F.col("ended"))
        reach *= 2
    # those still under way stand on a cycle after more steps than there are nodes; its least name is the least seen there
    x, y = state.alias("a"), state.alias("b")
    looping = x.join(y, here & (F.col("a.up") == F.col("b.id")), "inner").select(
        *(F.col(f"a.{c}").alias(c) for c in scope), F.col("a.id").alias(node), F.col("b.least").alias(f"root_{node}"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path")
    )
    ended = arrived.select(
        *scope, F.col("id").alias(node), F.col("up").alias(f"root_{node}"), F.col("steps").cast("int").alias("depth"),
        F.when(F.size("way") == 0, F.array("id")).otherwise(F.reverse(F.concat("way", F.array("up")))).alias("path"),
    )
    both = ended.unionByName(looping)
    if not lists:
        return both.drop("path")
    above = ended.select(*scope, F.col(node).alias("__d"), F.explode(F.slice("path", 1, F.size("path") - 1)).alias("__a")) if lists else None
    below = above.groupBy(*scope, F.col("__a")).agg(F.sort_array(F.collect_list("__d")).alias("descendants"))
    same = F.lit(True)
    for c in scope:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = both.alias("a").join(below.alias("b"), same & (F.col(f"a.{node}") == F.col("b.__a")), "left")
    return joined.select(
        *(F.col(f"a.{c}").alias(c) for c in scope), F.col(f"a.{node}").alias(node), F.col(f"a.root_{node}").alias(f"root_{node}"), F.col("a.depth").alias("depth"), F.col("a.path").alias("path"),
        F.when(F.col("a.depth") >= 0, F.coalesce("b.descendants", F.array().cast("array<string>"))).alias("descendants"),
    )


def hierarchies(
    df: DataFrame,
    *,
    scope: Sequence[str],
    node: str,
    parent: str,
    order: str | None = None,
    lists: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """One row per distinct (scope, node): scope, node, root_<node>, depth; with lists also path and descendants.

    The parent is the node of that name in the same scope; without one the node is a root of depth 0. A walk that never
    ends gives depth -1, the least node name (byte order) of its cycle as root, and null lists. Nulls: rows without a
    node are left out, null scopes form a scope of their own. Repeated rows count once; of several rows for a node the
    one of smallest order names the parent. An empty table gives no rows; other columns are ignored.
    """
    scope = list(scope)
    spark = df.sparkSession
    rows = df.select(*scope, node, parent, *([order] if order else []))
    sizes = rows.where(F.col(node).isNotNull()).groupBy(*scope).agg(F.count("*").alias("__n")).where(F.col("__n") > max_group_rows)
    # a group of more rows than one task may hold: there are at most rows / max_group_rows of them
    large = sizes.collect()
    kept = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType(
        [T.StructField(c, kept[c]) for c in scope]
        + [T.StructField(node, T.StringType()), T.StructField(f"root_{node}", T.StringType()), T.StructField("depth", T.IntegerType())]
        + ([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("descendants", T.ArrayType(T.StringType()))] if lists else [])
    )
    split = None
    if large:
        marks = spark.createDataFrame([tuple(r)[:-1] for r in large], T.StructType([T.StructField(c, kept[c]) for c in scope]))
        same = F.lit(True)
        for c in scope:
            same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
        split = rows.alias("r").join(F.broadcast(marks.alias("m")), same, "left_semi")
        rows = rows.alias("r").join(F.broadcast(marks.alias("m")), same, "left_anti")
    # hashed by scope alone, so that the grouping by (scope, node) needs no further shuffle
    placed = first_parents(rows.repartition(*scope), scope=scope, node=node, parent=parent, order=order)
    small = placed.sortWithinPartitions(*scope).mapInArrow(_named(_resolver(len(scope), lists), schema.names), schema)
    if split is None:
        return small
    nodes = written(first_parents(split, scope=scope, node=node, parent=parent, order=order), "hierarchy-nodes")
    most = max(r["__n"] for r in large)
    return small.unionByName(_doubled(nodes, scope, node, parent, lists, most))


def _named(run, names: list[str]):
    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return renamed
