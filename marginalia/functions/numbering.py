"""Numbers of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: str, order: str, ties: str | None = None, span: int = 1024, name: str = "pos") -> DataFrame:
    """rows with their number (long, from 0) in their group by a numeric column, then ties.

    Rows are counted within ranges of `span` values of the order, and only the sizes of the ranges are summed along a group, so no
    task holds the rows of a whole group; the order is expected to number them, or ranges hold as many rows as
    repeat. Nulls of the order come first, and a null group is a group.
    """
    own = rows.withColumn("_range", F.floor(F.col(f"`{order}`") / span))
    sizes = own.groupBy(F.col(f"`{group}`").alias("_group"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_group", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_range").orderBy(*([order] if ties is None else [order, ties]))
    placed = own.withColumn("_in", F.row_number().over(inside) - 1)
    same = F.col(f"`{group}`").eqNullSafe(F.col("_group")) & F.col("_range").eqNullSafe(F.col("_r"))
    return placed.join(starts, same).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_start") + F.col("_in")).alias(name))
