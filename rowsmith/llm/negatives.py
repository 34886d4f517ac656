"""Hard negatives by a vertical scan of columnar blocks (BOND), with exact integer inner products.

All rows lie in blocks of bounded bytes that hold one array for each dimension and the least and largest value in it. A
block's rows are the candidates of an anchor. The anchor reads the dimensions in descending order of its own magnitudes;
what the unread ones can still add lies between the sums of its components times the block's least and largest values.
A candidate whose reach of scores no longer meets what is looked for leaves the bitmap; what stays when all
dimensions are read has its exact score. First each anchor's best rows of its own label are looked for (the positives):
candidates leave when they can't reach the k-th best lower bound. Then, for each positive's score, the window of scores that
its negatives must have: candidates leave when they can't be in any window, or not among its k best.

Anchors are packed too, and every pack meets every block, in as many groups of blocks as tasks are wanted; what a task
has found in earlier blocks bounds what it looks for in later ones. A task returns at most k rows for each anchor and window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import written

#: Bytes of a block's columns, rows of a block, anchors of a pack, and dimensions that are read between two looks at the bitmap.
BLOCK_BYTES, BLOCK_ROWS, PACK, STEP = 1 << 18, 2048, 512, 8

BLOCKS = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("wide", pa.int32()), ("columns", pa.list_(pa.binary()))])
BLOCKS_DDL = "block long, dims int, ids binary, labels array<string>, wide int, columns array<binary>"


def narrow(values: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as they need."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def block_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: rows (vec_id, label, vector) to columnar blocks, one number of dimensions in each."""
    held: dict[int, list[tuple[int, str, np.ndarray]]] = {}

    def block_of(dims: int, rows: list) -> pa.RecordBatch:
        ids, labels, vectors = zip(*rows, strict=True)
        x = narrow(np.stack(vectors))
        ids = np.array(ids, np.int64)
        return pa.record_batch([pa.array([int(ids[0])]), pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([labels], pa.list_(pa.string())), pa.array([x.itemsize], pa.int32()), pa.array([[c.tobytes() for c in x.T.copy()]], pa.list_(pa.binary()))], schema=BLOCKS)

    for batch in batches:
        for vec_id, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector"), strict=True):
            x = v.values.to_numpy(zero_copy_only=False)
            rows = held.setdefault(len(x), [])
            rows.append((vec_id, label, x))
            if len(rows) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (2 * len(x)))):
                yield block_of(len(x), held.pop(len(x)))
    for dims, rows in held.items():
        yield block_of(dims, rows)


def pack_task(key: tuple, table: pa.Table) -> pa.Table:
    """applyInArrow: anchors of one pack, in order of their number in it."""
    vectors = [np.array(v.as_py(), np.int64) for v in table.column("vector")]
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    return pa.table({"pack": pa.array([key[0].as_py()], pa.int64()), "a_ids": pa.array([ids.tobytes()], pa.binary()), "a_labels": pa.array([table.column("label").to_pylist()], pa.list_(pa.string())), "a_values": pa.array([np.stack(vectors).tobytes()], pa.binary())})


PACKS_DDL = "pack long, a_ids binary, a_labels array<string>, a_values binary"


class Block:
    """A block's columns, in double precision where all sums stay exact in it, else as integers."""

    def __init__(self, row: dict, largest: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["wide"]]
        columns = np.stack([np.frombuffer(c, kind) for c in row["columns"]])
        self.low, self.high = columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)
        most = max(-int(self.low.min()), int(self.high.max()), 1)
        self.exact = np.float64 if most * max(largest, 1) * len(columns) < 1 << 53 else np.int64
        self.columns = columns.astype(self.exact)
        names, self.label = np.unique(np.array(row["labels"], dtype=object), return_inverse=True)
        self.code = {name: k for k, name in enumerate(names.tolist())}


def scan(a: np.ndarray, block: Block, at: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of ``at`` that ``keep(least, most)`` has left in, and their scores, all dimensions read.

    ``keep`` gets the bounds of the scores and says which candidates stay.
    """
    order = np.argsort(-np.abs(a), kind="stable")
    a = a.astype(block.exact)[order]
    ends = np.stack([a * block.low[order].astype(block.exact), a * block.high[order].astype(block.exact)])
    rest = [np.concatenate([np.cumsum(f(axis=0)[::-1])[::-1], np.zeros(1, block.exact)]) for f in (ends.min, ends.max)]
    score = np.zeros(len(at), block.exact)
    for k in range(0, len(a), STEP):
        dims = order[k : k + STEP]
        score = score + a[k : k + STEP] @ (block.columns[dims] if len(at) == block.columns.shape[1] else block.columns[dims[:, None], at])
        stay = keep(score + rest[0][min(k + STEP, len(a))], score + rest[1][min(k + STEP, len(a))])
        if not stay.all():
            at, score = at[stay], score[stay]
        if not len(at):
            break
    return at, score.astype(np.int64)


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -math.inf


def best(held: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k first of (score descending, id)."""
    if len(scores) > 4 * k:
        some = scores >= kth(scores, k)
        scores, ids = scores[some], ids[some]
    return nsmallest(k, [*held, *zip((-scores).tolist(), ids.tolist(), strict=True)])


class Pack:
    """A pack's anchors, what has been found for them, and their windows: (positive score, least, most, found)."""

    def __init__(self, row: dict, low: int, high: int):
        self.ids = np.frombuffer(row["a_ids"], np.int64)
        self.values = np.frombuffer(row["a_values"], np.int64).reshape(len(self.ids), -1)
        self.labels = row["a_labels"]
        self.largest = int(np.abs(self.values).max())
        spans = {w["i"]: [(of, -(-low * of // 100), high * of // 100) for of in w["scores"]] for w in row.get("windows") or ()}
        self.windows = {i: [(*x, []) for x in own if x[1] <= x[2]] for i, own in spans.items()}
        self.held: list[list[tuple[int, int]]] = [[] for _ in self.ids]


FOUND = pa.schema([("pack", pa.int64()), ("i", pa.int32()), ("anchor_id", pa.int64()), ("of", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "pack long, i int, anchor_id long, of long, id long, score long"


def _packs_and_blocks(batches: Iterator[pa.RecordBatch], packs: dict[int, Pack], low: int = 0, high: int = 0) -> Iterator[tuple[Pack, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            p = packs.get(row["pack"])
            if p is None:
                p = packs[row["pack"]] = Pack(row, low, high)
            yield p, Block(row, p.largest)


def _sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)


def positive_task(k: int):
    """mapInArrow over (pack, block): the k best rows of each anchor's label, other than the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, Pack] = {}
        for p, block in _packs_and_blocks(batches, packs):
            own = {c: np.flatnonzero(block.label == c) for c in range(len(block.code))}
            for i, (a_id, label) in enumerate(zip(p.ids.tolist(), p.labels, strict=True)):
                at = own.get(block.code.get(label), block.label[:0])
                at = at[block.ids[at] != a_id]
                if len(at):
                    floor = -p.held[i][-1][0] if len(p.held[i]) == k else -math.inf
                    at, score = scan(p.values[i], block, at, lambda least, most: most >= max(floor, kth(least, k)))  # noqa: B023
                    p.held[i] = best(p.held[i], score, block.ids[at], k)
        for number, p in packs.items():
            yield from _sent([(number, i, int(p.ids[i]), 0, vec_id, -s) for i, rows in enumerate(p.held) for s, vec_id in rows])

    return run


def negative_task(k: int, low: int, high: int):
    """mapInArrow over (pack, block): for each window of an anchor its k best rows of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, Pack] = {}
        for p, block in _packs_and_blocks(batches, packs, low, high):
            others = {c: np.flatnonzero(block.label != c) for c in range(len(block.code))}
            others[None] = np.arange(len(block.ids))
            for i, windows in p.windows.items():
                bounds = [[lo if len(rows) < k else max(lo, -rows[-1][0]), lo, hi] for _, lo, hi, rows in windows]

                def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
                    stay = np.zeros(len(least), bool)
                    for b in bounds:  # noqa: B023
                        b[0] = max(b[0], kth(least[(least >= b[1]) & (most <= b[2])], k))
                        stay |= (most >= b[0]) & (least <= b[2])
                    return stay

                at, score = scan(p.values[i], block, others[block.code.get(p.labels[i])], keep)
                for w, (of, lo, hi, rows) in enumerate(windows):
                    if (inside := (score >= lo) & (score <= hi)).any():
                        windows[w] = (of, lo, hi, best(rows, score[inside], block.ids[at[inside]], k))
        for number, p in packs.items():
            yield from _sent([(number, i, int(p.ids[i]), of, vec_id, -s) for i, windows in p.windows.items() for of, _, _, rows in windows for s, vec_id in rows])

    return run


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector) of the distinct rows that take part, components times ``scale`` rounded down."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("vector")).distinct()


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, groups: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    ``vectors`` has (vec_id, label, embedding); ``anchors`` says by ``vec_id`` and ``label`` which rows are anchors. Scores are inner products of the
    components times ``scale``, rounded down, and must fit in 64 bits. An anchor's positives are its best rows of equal
    label and another id; for each, the best rows of other labels with low * positive <= 100 * negative <= high *
    positive. Of equal scores the smaller id comes first. Rows with a null id or label, without components, or with a null or
    non-finite one take no part, and rows of another number of dimensions than the anchor's aren't compared with it. Rows repeated whole are one row; other
    columns are not read. Without positives, or without rows in the window, an anchor has no rows. Work is
    anchors times rows, as asked; a task holds a pack, a block and what it has found.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, scale), "vectors")
    blocks = written(rows.mapInArrow(block_task, BLOCKS_DDL), "blocks")
    own = rows.filter(anchors)
    n = max(1, -(-own.count() // PACK))
    pack = lambda dims, k: F.shiftleft(dims.cast("long"), 32) + k
    number = pack(F.size("vector"), F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(n)))
    packs = written(own.groupBy(number.alias("pack")).applyInArrow(pack_task, PACKS_DDL), "packs")

    tasks = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = groups or max(1, -(-tasks // n))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("k", each(n)).withColumn("pack", pack(F.col("dims"), F.col("k"))).drop("k")

    def met(side: DataFrame) -> DataFrame:
        return dealt.join(side.withColumn("group", each(groups)), ["pack", "group"])

    order = (F.desc("score"), F.col("id"))
    found = met(packs).mapInArrow(positive_task(positives), FOUND_DDL)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("pack", "i").orderBy(*order))).filter(F.col("n") <= positives)
    found = written(found.select("pack", "i", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = found.groupBy("pack", "i").agg(F.collect_set("positive_score").alias("scores"))  # at most ``positives``
    windows = scores.groupBy("pack").agg(F.collect_list(F.struct("i", "scores")).alias("windows"))  # at most the anchors of a pack
    hard = met(packs.join(windows, "pack")).mapInArrow(negative_task(negatives, low, high), FOUND_DDL)
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("pack", "i", "of").orderBy(*order))).filter(F.col("rank") <= negatives)
    hard = hard.select("pack", "i", F.col("of").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(hard, ["pack", "i", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS anchor, * FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT a.anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM a JOIN v b ON len(a.v) = len(b.v) AND (a.vec_id <> b.vec_id OR a.label <> b.label)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
