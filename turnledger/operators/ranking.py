"""Positions within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import written


def ranked(df: DataFrame, *, within: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """df with each row's position from 0 in its group, by order (which should be total: ties fall as they come).

    Rows are laid out by range over (within, order), so that a large group spreads over many tasks; each piece is
    numbered by itself and pieces are shifted by the counts of those before them. Null groups are groups.
    """
    placed = written(df.repartitionByRange(*within, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    own = F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*order)) - 1
    pieces = placed.groupBy(*within, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy("__part")) - F.col("__n")
    shifts = pieces.select(*within, "__part", before.alias("__before"))
    on = F.col("a.__part") == F.col("b.__part")
    for c in within:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    numbered = placed.withColumn("__own", own).alias("a").join(shifts.alias("b"), on)
    return numbered.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a.__own") + F.col("b.__before")).cast("bigint").alias(name))
