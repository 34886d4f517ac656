"""Upserts in order: each new row merges into what it finds among the rows before it, those of its own batch included."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import graph
from rowsmith.operators.ranking import top_per_group
from rowsmith.sources.shared import written

#: New rows of a tied group that a task takes in one turn.
MOST = 200_000


def richer(new: str | None, old: str | None) -> bool:
    """Whether a new text replaces the old one: where that is missing, or shorter."""
    return not old or bool(new) and len(new) > len(old)


class Held:
    """Records by their present keys, each list in the order of the records."""

    def __init__(self):
        self.records: list[list] = []  # lead, first key, second key
        self.by: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})

    def add(self, lead: str, *values: str | None) -> None:
        self.records.append([lead, None, None])
        for k, v in enumerate(values):
            self.put(len(self.records) - 1, k, v)

    def put(self, at: int, k: int, value: str | None) -> None:
        old = self.records[at][k + 1]
        if old:
            self.by[k][old].discard(at)
        self.records[at][k + 1] = value
        if value:
            self.by[k].setdefault(value, set()).add(at)

    def find(self, *values: str | None) -> int | None:
        """The first record with the first value, else the first with the second."""
        for k, v in enumerate(values):
            if v and (found := self.by[k].get(v)):
                return min(found)
        return None


STEP = pa.schema([("kind", pa.int32()), ("pos", pa.int64()), ("lead", pa.string()), ("first", pa.string()), ("second", pa.string())])
STEP_DDL = "kind int, pos long, lead string, first string, second string"


def _assign_task(table: pa.Table) -> pa.Table:
    """applyInArrow of whole tied groups: known leads (kind 0, in order of pos) and new rows (kind 1), to leads as they are then (0) and each row's lead (1)."""
    held, out, place = Held(), [], {}
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "pos", "lead", "first", "second")), strict=True), key=lambda r: (r[0], (r[2] or "").startswith("new"), r[1]))
    for kind, pos, lead, first, second in rows:
        if kind == 0:
            place[len(held.records)] = pos
            held.add(lead, first, second)
            continue
        at = held.find(first, second)
        if at is None:
            at = len(held.records)
            place[at] = pos
            held.add(f"new{pos}", first, second)
        else:
            for k, v in enumerate((first, second)):
                if richer(v, held.records[at][k + 1]):
                    held.put(at, k, v)
        out.append((1, pos, held.records[at][0], None, None))
    out += [(0, place[at], *r) for at, r in enumerate(held.records)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), STEP, strict=True)], schema=STEP)


def assign(base: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """(pos, lead) of each row of ``new``: ``old<id>`` of the base row or ``new<pos>`` of the new row whose record it joins.

    ``base`` has (id, first, second), ``new`` (pos, first, second): longs unique in each, and two keys, where null and blank are no keys.
    In the order of ``pos`` a row looks for a record with its first key, else with its second; of several the base row with the
    smallest id counts, then the earliest new one. A record takes over keys that are longer than its own, and is found by
    these from then on. A row that finds nothing is a new record.

    Rows that share keys, directly or through others, are tied; a record is only ever found by rows it is tied with. Tied groups
    are dealt to tasks as wholes. Where a group has more than ``most`` new rows, these go in turns, in order, each with the
    records that share a key with them at that time: of each key the first ``most`` + 1, as each row makes at most one record
    leave a key. No task holds a whole group of any size.
    """
    key = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c)
    old = base.select(F.lit(0).alias("kind"), F.col("id").cast("long").alias("pos"), F.concat(F.lit("old"), F.col("id").cast("string")).alias("lead"), key("first"), key("second"))
    rows = old.union(new.select(F.lit(1), F.col("pos").cast("long"), F.lit(None).cast("string"), key("first"), key("second")))
    rows = written(rows.withColumn("r", F.xxhash64("kind", "pos")), "rows")
    pairs = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c))) for c in ("first", "second"))))
    # Equal hashes of different keys or rows tie groups together that need not be, and change nothing else.
    tied = graph.of_shared_keys(written(rows.select("r", F.explode(pairs).alias("k")).distinct(), "memberships"))
    rows = written(rows.join(tied, "r", "left").withColumn("component", F.coalesce("component", "r")).drop("r"), "tied")
    sizes = written(rows.filter("kind = 1").groupBy("component").agg(F.count("*").alias("n")), "sizes")  # groups that nothing new touches stay as they are
    small = rows.join(sizes.filter(F.col("n") <= most).select("component"), "component")

    def step(part: DataFrame) -> DataFrame:
        part = written(part, "part")
        return written(part.groupBy(graph.bucket(part, "component", most)).applyInArrow(_assign_task, STEP_DDL), "step")

    said = step(small).filter("kind = 1").select("pos", "lead")
    large = rows.join(sizes.filter(F.col("n") > most).select("component"), "component")
    waiting, known = written(large.filter("kind = 1").drop("kind", "lead", "component"), "waiting"), written(large.filter("kind = 0").select(*STEP.names), "known")
    n = waiting.count()
    if n:
        turns = -(-n // most)
        cuts = sorted(set(waiting.approxQuantile("pos", [k / turns for k in range(1, turns)], 0.1 / turns))) if turns > 1 else []
        for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
            own = waiting.filter((F.col("pos") > low) & (F.col("pos") <= high))
            early = (F.col("lead").startswith("new"), F.col("pos"))
            met = [top_per_group(known.join(own.select(c).distinct(), c, "left_semi"), [c], early, most + 1).select(*STEP.names) for c in ("first", "second")]
            met = written(met[0].union(met[1]).distinct(), "met")
            both = met.union(own.select(F.lit(1).alias("kind"), "pos", F.lit(None).cast("string").alias("lead"), "first", "second"))
            done = step(both.withColumn("component", F.lit(0)))  # tied, so that one task has them all: a turn's rows
            said = said.union(done.filter("kind = 1").select("pos", "lead"))
            rest = known.join(met.select("lead"), "lead", "left_anti").select(*STEP.names)
            known = written(rest.union(done.filter("kind = 0")), "known")
    return said


def merged(base: DataFrame, new: DataFrame, texts: Sequence[str]) -> DataFrame:
    """A row for each record (key): the longest of each text, the earliest of equally long ones, and fields united, the last value of each.

    ``base`` has (id, texts, field, value), ``new`` (ord, lead, texts, field, value). Summed up within tasks: a record of very many rows gives each a row.
    """
    columns = [*texts, "field", "value"]
    every = base.select(F.concat(F.lit("old"), F.col("id").cast("string")).alias("key"), F.lit(-1).cast("long").alias("ord"), *columns).union(new.select("lead", F.col("ord").cast("long"), *columns))
    longest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col("ord")))).alias(c) for c in texts]
    found = every.groupBy("key").agg(*longest, F.count_if(F.col("ord") >= 0).alias("n_merged"))
    fields = every.filter("field is not null").groupBy("key", "field").agg(F.max_by("value", "ord").alias("value"))
    extra = fields.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit("="), "value"))), ",").alias("extra"))
    return found.join(extra, "key", "left").withColumn("extra", F.coalesce("extra", F.lit("")))
