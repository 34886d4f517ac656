"""Rows to rows of another shape."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; a column that a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def explode_list(df: DataFrame, column: str, into: str, separator: str = r"[,;]\s*", keep_empty: bool = False) -> DataFrame:
    """A row for each part of a delimited cell, blanks left out; a cell without parts gives no row, or a null one."""
    parts = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), separator), F.trim), lambda p: p != "")
    return df.withColumn(into, (F.explode_outer if keep_empty else F.explode)(parts))


def cell_status(parts: Column) -> Column:
    """What a cell of addresses holds: none, one, or several that were split."""
    n = F.size(parts)
    return F.when(n == 0, "no_valid_email").when(n == 1, "single_email").otherwise("multi_email_split")


def aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with exactly ``columns`` (name to type), those that it lacks null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def overflow(df: DataFrame, keep: Sequence[str], into: str = "extra") -> DataFrame:
    """Columns besides ``keep`` as one map of those that are not blank."""
    rest = [c for c in df.columns if c not in keep]
    cells = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest)))
    return df.select(*keep, F.map_filter(cells, lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False))).alias(into))


def grid(df: DataFrame, lat: str, lng: str, span: float, steps: int) -> DataFrame:
    """Search points of a square of ``span`` degrees around each row, ``steps`` to a side."""
    at = F.sequence(F.lit(0), F.lit(steps - 1))
    move = lambda c, i: F.round(F.col(c) - span / 2 + F.col(i) * (span / max(steps - 1, 1)), 6)
    return df.withColumn("i", F.explode(at)).withColumn("j", F.explode(at)).withColumn("point_lat", move(lat, "i")).withColumn("point_lng", move(lng, "j"))


def unpivot_counts(df: DataFrame) -> DataFrame:
    """A row for each column: its name, rows, nulls (null of no rows) and distinct values.

    A column at a time: its values are counted, then the counts, so that no row is expanded once per column and a scan
    reads one column only.
    """

    def one(name: str) -> DataFrame:
        values = df.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count("*").alias("n"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        sums = values.agg(zero(F.sum("n")).alias("n_rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.count("v").alias("n_distinct"))
        return sums.select(F.lit(name).alias("column"), "n_rows", "n_null", "n_distinct")

    return reduce(DataFrame.union, map(one, df.columns))


def update_cells(df: DataFrame, key: str, column: str, updates: DataFrame) -> DataFrame:
    """``column`` set to the ``value`` of ``updates`` (key, value) in the rows that these name, null included; made where ``df`` lacks it."""
    old = F.col(column) if column in df.columns else F.lit(None)
    new = updates.select(F.col(key).alias("__key"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    joined = df.join(new, F.col(key) == F.col("__key"), "left")
    cell = F.when(F.col("__hit"), F.col("__value")).otherwise(old).alias(column)
    return joined.select(*(cell if c == column else F.col(c) for c in df.columns), *([] if column in df.columns else [cell]))


def with_all(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows in which none of ``fields`` is null, an empty text, zero or false."""
    nothing = {"string": "", "boolean": False}
    kinds = dict(df.dtypes)
    for f in fields:
        df = df.filter(F.col(f).isNotNull() & (F.col(f) != F.lit(nothing.get(kinds[f], 0))))
    return df
