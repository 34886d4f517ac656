"""Deduplication with an explicit order: which row stays never depends on how rows are stored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import graph, ranking
from rowsmith.operators.rules import count_if
from rowsmith.sources.shared import written


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], drop_null_keys: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that comes first by ``order_by``, or some ``columns`` of it; nulls are last. Null keys are one group unless dropped.

    An aggregate with a map-side part, not a window: a key with very many rows is reduced before the shuffle.
    """
    return _pick(df, keys, order_by, F.min_by, drop_null_keys, columns)


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], drop_null_keys: bool = False) -> DataFrame:
    """The row of each key that comes last by ``order_by``; nulls are first."""
    return _pick(df, keys, order_by, F.max_by, drop_null_keys, None)


def _pick(df, keys, order_by, by, drop_null_keys, columns):
    df = df.na.drop(subset=list(keys)) if drop_null_keys else df
    null_side = [x for c in order_by for x in ((F.col(c).isNull() if by is F.min_by else F.col(c).isNotNull()), F.col(c))]
    ranks = F.struct(*(x.alias(f"o{i}") for i, x in enumerate(null_side)))
    row = by(F.struct(*(columns or df.columns)), ranks).alias("__row")
    return df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(row).select("__row.*")


def with_provenance(df: DataFrame, key: str, sources: dict[str, str], separator: str = ", ", hashed: bool = False) -> DataFrame:
    """One row for each key with its number of rows and, for each source column, its distinct values sorted and joined.

    With ``hashed``, for keys that are long texts, rows are grouped by 128 bits of the key.
    """
    joined = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), separator).alias(name) for c, name in sources.items()]
    if not hashed:
        return df.groupBy(key).agg(F.count("*").alias("n_rows"), *joined)
    by = df.groupBy(F.md5(F.col(key).cast("binary")).alias("__hash")).agg(F.first(key).alias(key), F.count("*").alias("n_rows"), *joined)
    return by.drop("__hash")


def first_nonnull(df: DataFrame, key: str, columns: Sequence[str], order_by: Sequence) -> DataFrame:
    """For each key the first value that is not null of each column, by ``order_by``; rows with a null key are left out."""
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order_by)))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*first)


def in_sequence(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows kept, key after key, if no earlier kept row has that key: chained ``keep_first``.

    A null key is no duplicate. Differs from a pass over rows that looks at all keys at once, which cannot be split.
    """
    for k in keys:
        known = keep_first(df.filter(F.col(k).isNotNull()), [k], order_by)
        df = known.unionByName(df.filter(F.col(k).isNull()))
    return df


#: Rounds of local decisions, and memberships that a task passes over.
ROUNDS, MOST = 2, 200_000


def _pass_task(table: pa.Table) -> pa.Table:
    """applyInArrow of the memberships (r, k) of whole components: the rows that one pass keeps."""
    rows: dict[int, list[str]] = {}
    for r, k in zip(table.column("r").to_pylist(), table.column("k").to_pylist(), strict=True):
        rows.setdefault(r, []).append(k)
    seen: set[str] = set()
    kept = []
    for r in sorted(rows):
        if seen.isdisjoint(rows[r]):
            kept.append(r)
            seen.update(rows[r])
    return pa.table({"r": pa.array(kept, pa.int64())})


def in_order(df: DataFrame, keys: Sequence[str], row_id: str, rounds: int = ROUNDS, most: int = MOST) -> DataFrame:
    """Rows kept by one pass in the order of ``row_id`` (unique, long): a row goes if an earlier kept row has one of its keys.

    A row that goes registers none of its keys; null keys are no keys. First, in a few rounds over (key, row)
    memberships, a row that comes first for all of its keys stays, and all that share a key with it go: keys of very many rows are
    settled then. What is left falls into components of shared keys, as rows depend only on earlier ones of their own
    component, and a task passes over each. Of a component of more than ``most`` memberships a task passes over the first
    ``most``; what shares a key with those kept goes, and the rest falls into components again. So the rounds are bounded by
    the logarithm of the longest chain and the largest component over ``most``.
    """
    most = max(most, len(keys))
    pairs = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}/"), F.col(k).cast("string"))) for i, k in enumerate(keys))))
    open_ = written(df.select(F.col(row_id).cast("long").alias("r"), F.explode(pairs).alias("k")), "memberships")
    stay = [df.filter(F.size(pairs) == 0).select(F.col(row_id).cast("long").alias("r"))]

    def settle(open_: DataFrame, kept: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        """What is still open: without rows that share a key with those kept, and without those passed over."""
        taken = open_.join(kept, "r", "left_semi").select("k").distinct()
        gone = open_.join(taken, "k", "left_semi").select("r")
        gone = (gone.union(seen) if seen is not None else gone).distinct()
        return written(open_.join(gone, "r", "left_anti"), "memberships")

    for _ in range(rounds):
        if open_.isEmpty():
            break
        first = open_.groupBy("k").agg(F.min("r").alias("m"))
        stay.append(written(open_.join(first, "k").groupBy("r").agg(F.min(F.col("r") == F.col("m")).alias("keep")).filter("keep").select("r"), "kept"))
        open_ = settle(open_, stay[-1])
    while not open_.isEmpty():
        tied = written(open_.join(graph.of_shared_keys(open_), "r"), "tied")
        sizes = written(tied.groupBy("component").agg(F.count("*").alias("n")), "sizes")
        small = tied.join(sizes.filter(F.col("n") <= most), "component", "left_semi").select(*tied.columns)
        large = tied.join(sizes.filter(F.col("n") > most), "component", "left_semi")
        turn = small
        if not sizes.filter(F.col("n") > most).isEmpty():
            last = ranking.numbered(large, "component", ["r", "k"]).filter(F.col("rn") == most + 1).select("component", F.col("r").alias("last"))
            # Whole rows: that of the membership one too many waits.
            turn = small.union(large.join(written(last, "last"), "component").filter("r < last").select(*tied.columns))
        turn = written(turn, "turn")
        stay.append(written(turn.groupBy(graph.bucket(turn, "component", most)).applyInArrow(_pass_task, "r long"), "kept"))
        open_ = settle(open_, stay[-1], turn.select("r"))
    kept = reduce(DataFrame.union, stay)
    return df.join(kept, F.col(row_id) == F.col("r"), "left_semi")


def profile(df: DataFrame, column: str) -> DataFrame:
    """Rows, distinct values, surplus rows and empty rows of a column."""
    c = F.col(column)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(c).alias("n_distinct"),
        (F.count(c) - F.countDistinct(c)).alias("n_surplus"),
        count_if(c.isNull()).alias("n_null"),
    )
