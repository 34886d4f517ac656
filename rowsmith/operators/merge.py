"""Keyed merges with explicit rules for conflicts. Null keys match nothing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.operators.dedupe import keep_last


def enrich(left: DataFrame, right: DataFrame, key: str, prefer: str = "new", dedupe_right: bool = False) -> DataFrame:
    """``left`` with the columns of ``right`` joined on ``key``; rows of ``right`` with other keys are left out.

    A column of both is ``coalesce(new, old)`` or, with ``prefer="old"``, the reverse. Repeated keys in ``right`` repeat
    rows of ``left`` unless ``dedupe_right`` keeps one row of each, the one with the largest values.
    """
    if prefer not in ("new", "old"):
        raise ValueError("prefer is new or old")
    others = [c for c in right.columns if c != key]
    if dedupe_right:
        right = keep_last(right, [key], others)
    renamed = right.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in others))
    joined = left.join(renamed, left[key] == F.col("__key"), "left")
    pick = lambda c: F.coalesce(f"__{c}", c) if prefer == "new" else F.coalesce(c, f"__{c}")
    old = [pick(c).alias(c) if c in others else F.col(c) for c in left.columns]
    return joined.select(*old, *(F.col(f"__{c}").alias(c) for c in others if c not in left.columns))


def merge_all(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer merge of any number of tables on ``key``: the last table with a value gives it. One shuffle, no joins.

    Rows with a null key are left out. Each table is reduced to one row for each key first, its largest values last.
    """
    columns = list(dict.fromkeys(c for f in frames for c in f.columns if c != key))
    tagged = [f.filter(F.col(key).isNotNull()).withColumn("__source", F.lit(i)) for i, f in enumerate(frames)]
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("__source", c)))[c].alias(c) for c in columns]
    return all_rows.groupBy(key).agg(*last)


def merge(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner", keys: dict[str, Column] | None = None, suffixes: tuple[str, str] = ("_left", "_right"), where: Column | None = None) -> DataFrame:
    """Left, right, inner or outer merge on the columns of ``on`` (left name to right name).

    ``where`` filters the left side first. Columns of both sides get the suffixes. Keys are compared as they are;
    normalise them beforehand.
    """
    if how not in ("left", "right", "inner", "outer"):
        raise ValueError("how is left, right, inner or outer")
    left = left if where is None else left.filter(where)
    both = set(left.columns) & set(right.columns)
    a = left.select(*(F.col(c).alias(c + suffixes[0] if c in both else c) for c in left.columns))
    b = right.select(*(F.col(c).alias(c + suffixes[1] if c in both else c) for c in right.columns))
    name = lambda c, i: c + suffixes[i] if c in both else c
    condition = reduce(lambda x, y: x & y, (a[name(l, 0)] == b[name(r, 1)] for l, r in on.items()))
    return a.join(b, condition, how)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, into: str, order_by: Sequence[str] = ()) -> DataFrame:
    """``into`` filled from ``table`` by ``key`` where it is null; of repeated keys the last by ``order_by`` counts."""
    newest = F.max_by(value, F.struct(*order_by, value)) if order_by else F.max(value)
    small = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(newest.alias("__value"))
    filled = F.coalesce(into, "__value") if into in df.columns else F.col("__value")
    return df.join(small, df[key] == F.col("__key"), "left").withColumn(into, filled).drop("__key", "__value")


def longer(a: Column, b: Column) -> Column:
    """The longer of two texts, the first of equals; the other one where one is null."""
    return F.when(a.isNull() | (F.length(b) > F.length(a)), F.coalesce(b, a)).otherwise(a)


def upsert(old: DataFrame, new: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """Rows of both by ``key``, one row each; of each text column the longer value stays."""
    n = new.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in texts))
    joined = old.select(key, *texts).join(n, old[key] == F.col("__key"), "full")
    return joined.select(F.coalesce(key, "__key").alias(key), *(longer(F.col(c), F.col(f"__{c}")).alias(c) for c in texts))


def waterfall(df: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """``value`` from the first source that has one, with the source's name beside it."""
    for name, source in sources:
        one = source.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias(f"__k_{name}")).agg(F.min(value).alias(f"__v_{name}"))
        df = df.join(one, df[key] == F.col(f"__k_{name}"), "left")
    values = [F.col(f"__v_{name}") for name, _ in sources]
    found = reduce(lambda c, x: F.when(x[1].isNotNull(), x[0]).otherwise(c), reversed([(F.lit(n), v) for (n, _), v in zip(sources, values, strict=True)]), F.lit(None).cast("string"))
    return df.withColumn(value, F.coalesce(*values)).withColumn(f"{value}_source", found).drop(*(f"__{x}_{n}" for n, _ in sources for x in "kv"))


def changes(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """How many keys went from each status to each other one."""
    b = after.select(F.col(key).alias("__key"), F.col(status).alias("status_after"))
    joined = before.select(F.col(key), F.col(status).alias("status_before")).join(b, F.col(key) == F.col("__key"))
    return joined.filter("status_before <> status_after").groupBy("status_before", "status_after").agg(F.count("*").alias("n"))


def not_in(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is NOT IN ``listed``, as SQL has it: where the list is empty all rows; else none with a null key, and none at all where the list has a null.

    An anti join by the key and one row of facts about the list, so that the list may be of any size.
    """
    facts = listed.agg(F.count("*").alias("__n"), F.count_if(F.col(key).isNull()).alias("__nulls"))  # one row
    kept = df.join(listed.select(F.col(key).alias("__key")).filter("__key is not null").distinct(), F.col(key) == F.col("__key"), "left_anti")
    fine = (F.col("__n") == 0) | (F.col("__nulls") == 0) & F.col(key).isNotNull()
    return kept.join(F.broadcast(facts)).filter(fine).select(*df.columns)
