"""Places of rows in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelode.session import cut

_PART, _AT, _BEFORE = "_rank_part", "_rank_at", "_rank_before"


def ranked(rows: DataFrame, group: list[str], order: list[Column], into: str) -> DataFrame:
    """rows with the place (from 1) of each in its group, by order, which must tell all rows of a group apart.

    Rows are dealt out by ranges of group and order, so a group of any size fills as many tasks as it needs. A row's
    place is its place in its task and the rows of its group in the tasks before; these counts, one a task and group that
    has rows there, are all that is brought together. Null groups are one group; nulls come first in the order.
    """
    keys = [*(F.col(c) for c in group), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Ranges are drawn from a sample, so they are drawn once and written.
    dealt = cut(dealt.withColumns({_PART: F.spark_partition_id(), _AT: F.monotonically_increasing_id()}))
    names = {c: f"_rank_group_{i}" for i, c in enumerate([*group, _PART])}
    parts = dealt.groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg(F.count(F.lit(1)).alias("_n"), F.min(_AT).alias("_first"))
    before = Window.partitionBy(*(names[c] for c in group)).orderBy(names[_PART]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(_BEFORE, F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    place = (F.col(_AT) + F.col(_BEFORE) + 1).cast("int").alias(into)
    return dealt.join(parts, same).select(*rows.columns, place)


__all__ = ["ranked"]
