"""Cosine similarity of stored vectors: of one query in the JVM, of many in blocks inside tasks, all blocks or only those that may hold a neighbour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.operators.ranking import top_per_group
from rowsmith.sources.shared import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def most_similar(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding, ...) most like the one row of ``queries`` (query_vector)."""
    scored = vectors.join(F.broadcast(queries.limit(1))).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("query_vector")), 6))
    return scored.drop("query_vector").orderBy(F.desc("similarity"), "vec_id").limit(k)


#: Queries and vectors in a block.
QUERIES, VECTORS = 1024, 4096


def _best_of_block(k: int):
    def matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        ids, by_length = table.column("vec_id").to_numpy(), {}
        for i, v in enumerate(table.column("embedding").to_pylist()):
            if v and None not in v:
                by_length.setdefault(len(v), []).append((i, v))
        out = {}
        for n, rows in by_length.items():
            at, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
            norm = np.sqrt((m * m).sum(axis=1))
            usable = np.isfinite(norm) & (norm > 0)
            out[n] = ids[at[usable]], m[usable] / norm[usable, None]
        return out

    def task(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        queries, vectors = (matrix(table.filter(pa.array(side == x))) for x in (0, 1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for n in set(queries) & set(vectors):
            (own, q), (ids, v) = queries[n], vectors[n]
            order = np.argsort(ids, kind="stable")
            similarity = np.round(q @ v[order].T, 6)
            # Stable, so that equal ones stand by vec_id.
            best = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(own, best.shape[1]), ids[order][best].reshape(-1), np.take_along_axis(similarity, best, axis=1).reshape(-1)))
        return pa.table(dict(zip(("query_id", "vec_id", "similarity"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return task


def most_similar_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rn) of the ``k`` of ``vectors`` most like each of ``queries``; both (vec_id, embedding).

    Ids are unique. A block of queries meets a block of vectors in a task, which returns the ``k`` best for each query.
    Vectors that are null, zero, not finite or of another length are no neighbours.
    """
    parts = [max(1, -(-df.count() // n)) for df, n in ((queries, QUERIES), (vectors, VECTORS))]
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    left = queries.select(*row, F.lit(0).alias("side"), own(parts[0]).alias("i"), each(parts[1]).alias("j"))
    right = vectors.select(*row, F.lit(1).alias("side"), each(parts[0]).alias("i"), own(parts[1]).alias("j"))
    scored = left.union(right).groupBy("i", "j").applyInArrow(_best_of_block(k), "query_id long, vec_id long, similarity double")
    return top_per_group(scored, ["query_id"], [F.desc("similarity"), "vec_id"], k)


#: Pivots of a search, the vectors with the least hashes of their ids.
PIVOTS = 256


def _by_length(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each number of dimensions the rows of vectors that have an angle, and these at length one."""
    found: dict[int, tuple[list, list]] = {}
    for k, v in enumerate(column.to_pylist()):
        if v and None not in v:
            rows, own = found.setdefault(len(v), ([], []))
            rows.append(k)
            own.append(v)
    out = {}
    for n, (rows, own) in found.items():
        x = np.array(own, np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        out[n] = np.array(rows)[fine], x[fine] / norm[fine, None]
    return out


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _assign_task(pivots: dict[int, np.ndarray]):
    """mapInArrow: vectors with their number of dimensions, nearest pivot and the angle to it."""

    def run(batches):
        for batch in batches:
            for n, (rows, x) in _by_length(batch.column("embedding")).items():
                angle = _angles(x, pivots[n]) if n in pivots else np.zeros((len(x), 1))
                near = angle.argmin(axis=1)
                own = batch.take(pa.array(rows))
                yield pa.record_batch([*own.columns, pa.array(np.full(len(rows), n, np.int32)), pa.array(near.astype(np.int32)), pa.array(angle[np.arange(len(rows)), near])], names=["vec_id", "embedding", "dims", "pivot", "angle"])

    return run


def _plan_task(pivots: dict[int, np.ndarray], blocks: dict[int, list[tuple]], k: int, rest: bool):
    """mapInArrow: each query with the blocks that it meets: first the nearest that hold ``k`` vectors, then all others that may hold one as near as the k-th found."""

    def run(batches):
        for batch in batches:
            found = []
            for n, (rows, x) in _by_length(batch.column("embedding")).items():
                if n not in blocks:
                    continue
                number, size, low, high = (np.array(c) for c in zip(*blocks[n], strict=True))
                angle = _angles(x, pivots[n])[:, number] if n in pivots else np.zeros((len(x), len(number)))
                # A vector between the angles low and high from a pivot is no nearer to the query than this, by the triangle inequality.
                least = np.maximum(0, np.maximum(angle - high, low - angle))
                order = np.argsort(least, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                first = np.zeros(least.shape, bool)
                np.put_along_axis(first, order, held - size[order] < k, axis=1)
                pick = first
                if rest:
                    bound = batch.column("kth").to_numpy(zero_copy_only=False)[rows]
                    pick = ~first & (np.cos(least) >= bound[:, None] - 1e-6)
                at, block = np.nonzero(pick)
                found.append(pa.table({"vec_id": batch.column("vec_id").take(pa.array(rows[at])), "embedding": batch.column("embedding").take(pa.array(rows[at])), "dims": pa.array(np.full(len(at), n, np.int32)), "pivot": pa.array(number[block].astype(np.int32))}))
            for table in found:
                yield from table.to_batches()

    return run


def scan_plan(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(best of the blocks met, met (dims, pivot, queries), blocks (dims, pivot, n, low, high)) of ``most_similar_pruned``."""
    row = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    vectors, queries = vectors.select(*row), queries.select(*row)
    sample = vectors.filter(F.size("embedding") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toArrow()  # bounded
    pivots = {n: x for n, (_, x) in _by_length(sample.column("embedding")).items()}
    kind = "vec_id long, embedding array<double>, dims int, pivot int"
    assigned = written(vectors.mapInArrow(_assign_task(pivots), kind + ", angle double"), "assigned")
    blocks = written(assigned.groupBy("dims", "pivot").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")), "blocks")
    held: dict[int, list[tuple]] = {}
    for b in blocks.collect():  # one for each pivot
        held.setdefault(b.dims, []).append((b.pivot, b.n, b.low, b.high))

    def meet(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
        plan = written(plan, "plan")
        asked = written(plan.groupBy("dims", "pivot").agg(F.count("*").alias("queries")), "asked")
        sizes = asked.join(blocks, ["dims", "pivot"]).select("dims", "pivot", F.ceil(F.col("n") / VECTORS).cast("int").alias("parts"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("turns"))
        own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ("dims", "pivot", "vec_id", "embedding")
        left = plan.join(sizes, ["dims", "pivot"]).select(*columns, F.lit(0).alias("side"), own("turns").alias("i"), each("parts").alias("j"))
        right = assigned.join(sizes, ["dims", "pivot"]).select(*columns, F.lit(1).alias("side"), each("turns").alias("i"), own("parts").alias("j"))
        best = left.union(right).groupBy("dims", "pivot", "i", "j").applyInArrow(_best_of_block(k), "query_id long, vec_id long, similarity double")
        return written(best, "best"), asked

    first, asked = meet(queries.mapInArrow(_plan_task(pivots, held, k, False), kind))
    bound = top_per_group(first, ["query_id"], [F.desc("similarity"), "vec_id"], k).groupBy("query_id").agg(F.min("similarity").alias("s"), F.count("*").alias("n"))
    bound = queries.join(bound, F.col("query_id") == F.col("vec_id"), "left").select("vec_id", "embedding", F.when(F.col("n") >= k, F.col("s")).otherwise(-2.0).alias("kth"))
    second, more = meet(bound.mapInArrow(_plan_task(pivots, held, k, True), kind))
    return first.union(second), asked.union(more), blocks


def most_similar_pruned(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``most_similar_each``, exactly, but a query meets only the blocks that may hold one of its ``k`` best.

    Each vector belongs to the nearest of some pivots, a block to each pivot, with the least and largest angle in it. A query
    meets the nearest blocks first; what it finds there bounds the angle, and by the triangle inequality blocks that lie
    beyond the bound hold nothing nearer. A block of very many vectors or queries is met in parts. How many blocks remain depends
    on how the vectors lie: of points spread evenly in many dimensions nearly all.
    """
    best, _, _ = scan_plan(vectors, queries, k)
    return top_per_group(best, ["query_id"], [F.desc("similarity"), "vec_id"], k)


def share_met(met: DataFrame, blocks: DataFrame, n_queries: int) -> DataFrame:
    """One row: pairs of a query and a vector that met, all such pairs, and the share."""
    pairs = met.join(blocks, ["dims", "pivot"]).agg(F.coalesce(F.sum(F.col("queries") * F.col("n")), F.lit(0)).alias("met"))
    every = blocks.agg((F.sum("n") * n_queries).alias("every"))
    return pairs.join(F.broadcast(every)).select("met", "every", (F.col("met") / F.col("every")).alias("share"))
