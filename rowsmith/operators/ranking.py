"""Ranks, slices and comparisons with the row before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.sources.shared import written


def top_and_bottom(df: DataFrame, order_by: Sequence, reverse: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows by each of two orders, with the side that they are from; two limits, no whole sort."""
    return df.orderBy(*order_by).limit(k).withColumn("side", F.lit("top")).union(df.orderBy(*reverse).limit(k).withColumn("side", F.lit("bottom")))


def top_per_group(df: DataFrame, groups: Sequence[str], order_by: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank ``rn``; Spark cuts groups to ``k`` before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order_by))).filter(F.col("rn") <= k)


def numbered(df: DataFrame, group: str, order_by: Sequence[str], into: str = "rn") -> DataFrame:
    """Each row's place in its group from 1, by an order without ties.

    No group meets in one task: rows are dealt by ranges of (group, order) and written, counted for each range and group,
    and numbered within these; the counts of the ranges before, a row for each range and group, are added.
    """
    dealt = df.repartitionByRange(group, *order_by).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), before.alias("__before"))
    place = F.row_number().over(W.partitionBy(group, "__range").orderBy(*order_by))
    rows = dealt.withColumn("__place", place)
    rows = rows.join(sizes, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__of")))
    return rows.select(*df.columns, (F.col("__place") + F.col("__before")).alias(into))


def with_previous(df: DataFrame, group: str, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row beside the values of the row before it in its group."""
    rows = numbered(df, group, order_by)
    before = rows.select(F.col(group).alias("__group"), (F.col("rn") + 1).alias("__rn"), *(F.col(c).alias(f"previous_{c}") for c in columns))
    joined = rows.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("rn") == F.col("__rn")), "left")
    return joined.select(*df.columns, *(f"previous_{c}" for c in columns))


def halves(df: DataFrame, group: str, order_by: Sequence[str]) -> DataFrame:
    """Each row's half of its group: the first has floor(n / 2) rows."""
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    rows = numbered(df, group, order_by).join(sizes, F.col(group).eqNullSafe(F.col("__group")))
    return rows.select(*df.columns, F.when(F.col("rn") <= F.floor(F.col("__n") / 2), "first").otherwise("second").alias("half"))


def batches(df: DataFrame, group: str, order_by: Sequence[str], size: int) -> DataFrame:
    """Each row's batch of ``size`` rows in its group, from 0."""
    return numbered(df, group, order_by).select(*df.columns, F.floor((F.col("rn") - 1) / size).cast("long").alias("batch"))


def running(df: DataFrame, group: str, order_by: Sequence[str], value: str) -> DataFrame:
    """Each row's place ``rn`` in its group and the ``total`` of ``value`` up to it, by an order without ties; no group meets in one task, as in ``numbered``."""
    dealt = written(df.repartitionByRange(group, *order_by).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(group, "__range").agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    earlier = W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    none = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), none("__n").alias("__rows"), none("__s").alias("__before"))
    own = W.partitionBy(group, "__range").orderBy(*order_by)
    rows = dealt.withColumn("__place", F.row_number().over(own)).withColumn("__sum", F.sum(value).over(own.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(sums, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__of")))
    return rows.select(*df.columns, (F.col("__place") + F.col("__rows")).alias("rn"), (F.coalesce("__sum", F.lit(0)) + F.col("__before")).alias("total"))
