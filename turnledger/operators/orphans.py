"""References to records that do not exist.

Parent keys and child keys go into one long table, tagged with their side; one grouping by key tells which keys lack
a usable parent. Only the children of those keys are looked up again, so the cost is one partially aggregated shuffle
of keys, whatever the number of references a single parent has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY, _ORDER = "__key", "__order"


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def orphan_references(
    parents: DataFrame,
    children: DataFrame,
    *,
    scope: Sequence[str],
    parent_key: str,
    child_key: str,
    parent_order: str | None = None,
    child_order: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Distinct child rows (scope, child_key, child_order, keep) whose key names no usable parent of the same scope.

    With orders given, a parent is usable if its order is smaller than the child's. Nulls: a child without a key refers
    to nothing and is no orphan; a parent without a key is no parent; scope columns compare null-safely; a parent with
    a null order is never usable, a child with a null order always an orphan. Repeated rows count once. Empty tables
    give an empty result (children without any parents are all orphans). Columns beyond the named ones are ignored.
    """
    scope = list(scope)
    ordered = parent_order is not None and child_order is not None
    kept = list(dict.fromkeys([*scope, child_key, *([child_order] if child_order else []), *keep]))

    def side(df: DataFrame, key: str, order: str | None, is_parent: bool) -> DataFrame:
        position = F.col(order) if ordered and order else F.lit(0)
        return df.where(F.col(key).isNotNull()).select(
            *scope, F.col(key).alias(_KEY), position.cast("bigint").alias(_ORDER), F.lit(is_parent).alias("__parent")
        )

    long = side(parents, parent_key, parent_order, True).unionByName(side(children, child_key, child_order, False))
    first_child = F.coalesce(F.col(_ORDER), F.lit(-(2**63)))
    lacking = (
        long.groupBy(*scope, _KEY)
        .agg(
            F.min(F.when(F.col("__parent"), F.col(_ORDER))).alias("__first_parent"),
            F.min(F.when(~F.col("__parent"), first_child)).alias("__first_child"),
        )
        .where(F.col("__first_child").isNotNull())
    )
    if ordered:
        lacking = lacking.where(F.col("__first_parent").isNull() | (F.col("__first_child") <= F.col("__first_parent")))
    else:
        lacking = lacking.where(F.col("__first_parent").isNull())
    rows = children.where(F.col(child_key).isNotNull()).select(*kept)
    found = rows.alias("c").join(
        lacking.alias("l"), _same("c", "l", scope) & (F.col(f"c.{child_key}") == F.col(f"l.{_KEY}")), "inner"
    )
    if ordered:
        late = F.col("l.__first_parent").isNull() | F.col(f"c.{child_order}").isNull()
        found = found.where(late | (F.col(f"c.{child_order}") <= F.col("l.__first_parent")))
    return found.select(*(F.col(f"c.{c}").alias(c) for c in kept)).distinct()


def orphan_counts(orphans: DataFrame, *, table: str | Column, key: str, period: Column) -> DataFrame:
    """Orphan rows and distinct missing keys per table and period; a null period keeps its own row."""
    by_key = orphans.groupBy(
        (F.lit(table) if isinstance(table, str) else table).alias("table_name"), period.alias("period"), F.col(key).alias(_KEY)
    ).agg(F.count("*").alias("n"))
    return by_key.groupBy("table_name", "period").agg(
        F.sum("n").cast("bigint").alias("n_orphans"), F.count("*").alias("n_missing_keys")
    )
