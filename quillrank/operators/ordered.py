"""Ordered work inside groups that stays safe when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_point(value: Column, digits: int) -> Column:
    """A number in whole units of its last digit: such terms sum to the same in any order.

    Doubles do not, and rows would tie in one run and not in the next. Half a unit is added before
    ``floor``, as Spark's ``round`` of a double goes by way of a decimal for every row.
    """
    return F.floor(value * F.lit(float(10**digits)) + F.lit(0.5))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank.

    The filter on ``row_number`` becomes a limit per group on the map side, so a hot group sends at
    most ``k`` rows from each task. That rule covers ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000 by default); raise it for larger ``k``.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[tuple[str, bool]],
    fine: Sequence[Column],
    rank: str = "rank",
) -> DataFrame:
    """The 1-based rank of every row of a group, without gathering the group in one task.

    ``coarse`` holds (column, descending) pairs with few distinct values, such as counts. Their
    histogram gives how many rows lie ahead; only rows that tie on all of them are sorted together.
    """
    names = [name for name, _ in coarse]
    order = [F.col(name).desc() if descending else F.col(name).asc() for name, descending in coarse]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        df.groupBy(*keys, *names)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_ahead", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    tie = Window.partitionBy(*keys, *names).orderBy(*fine)
    return (
        df.join(ahead, [*keys, *names])
        .withColumn(rank, (F.col("_ahead") + F.row_number().over(tie)).cast("long"))
        .drop("_ahead")
    )


def running_before(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str, block: int = 4096
) -> DataFrame:
    """The sum of ``value`` over the rows of the group before each row.

    ``position`` is a dense 0-based place in the group. The group is cut into blocks of that many
    places: block totals give each block's start, and only a block's rows are summed in one task.
    """
    cut = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(position) / F.lit(block)))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(starts, [*keys, "_block"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_block", "_start")
    )
