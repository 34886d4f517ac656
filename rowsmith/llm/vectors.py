"""Near-duplicate vectors of equal label: subspace pigeonhole join, then exact cosine.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. After a fixed random rotation the dimensions
are split into blocks, and the budget of squared distance among the blocks in proportion to their dimensions:
two vectors within the whole budget are within the budget of at least one block. A range join in each block finds
these pairs: a grid over the block's first dimensions with cells of twice the radius, in which each vector is at
home in one cell and also goes to the cells that its ball reaches. The union of the blocks' pairs is verified with
the vectors as given, in double precision.

Equal vectors of one label are one class from the start and are never paired with one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import U64, components, mix, written

THRESHOLD, BLOCKS, GRID = 0.98, 8, 4
#: Coordinates of a block that the join compares; a block of more is compared by the first ones, which loses no pair.
PROBES = [f"p{k}" for k in range(8)]


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """The same orthogonal matrix on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def class_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each vector: a hash of label and components; null for one that links with nothing."""
    for batch in batches:
        nodes = []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
            v = v.values
            usable = label is not None and v is not None and len(v) and not v.null_count
            x = v.to_numpy(zero_copy_only=False) + 0.0 if usable else None
            usable = usable and np.isfinite(x).all() and x.any()
            nodes.append(hashlib.blake2b(repr(label).encode() + b"\0" + x.tobytes(), digest_size=16).digest() if usable else None)
        yield pa.record_batch([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, "node"])


PLACES = pa.schema([("node", pa.binary()), ("bucket", pa.int64()), ("home", pa.bool_()), ("budget", pa.float64()), *((p, pa.float32()) for p in PROBES)])


def place_task(threshold: float, blocks: int, grid: int):
    """The cells of each class in each block."""

    def places(label: str, nodes: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        dims = x.shape[1]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(dims)
        seed = int.from_bytes(hashlib.blake2b(f"{label}/{dims}".encode(), digest_size=8).digest(), "little")
        for b, part in enumerate(np.array_split(np.arange(dims), min(blocks, dims))):
            budget = (2 - 2 * threshold) * len(part) / dims + 1e-9
            radius = np.sqrt(budget)
            own = x[:, part[:grid]] / (2 * radius)
            cell = np.floor(own).astype(np.int64)
            inner = own - cell  # 0 to 1: a side is as far as this share of two radii
            step = np.where(inner < 0.5, -1, 1)
            gap = (np.where(inner < 0.5, inner, 1 - inner) * 2) ** 2  # in squared radii
            probes = np.zeros((len(x), len(PROBES)), np.float32)
            probes[:, : min(len(part), len(PROBES))] = x[:, part[: len(PROBES)]]
            for mask in range(1 << own.shape[1]):
                bits = np.array([(mask >> k) & 1 for k in range(own.shape[1])])
                at = np.flatnonzero((gap * bits).sum(axis=1) <= 1 + 1e-6)
                key = np.full(len(at), (seed + b) % 2**64, dtype=U64)
                for c in (cell[at] + step[at] * bits).T:
                    key = mix(key * U64(0x9E3779B97F4A7C15) + c.astype(U64))
                if len(at):
                    yield pa.record_batch([pa.array(nodes[at].tolist(), pa.binary()), pa.array(key.view(np.int64)), pa.array(np.full(len(at), mask == 0)), pa.array(np.full(len(at), budget)), *(pa.array(c) for c in probes[at].T.copy())], schema=PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), dtype=object)
            nodes = np.array(batch.column("node").to_pylist(), dtype=object)
            column = batch.column("embedding")
            sizes = np.array([len(v.values) for v in column])
            for label, dims in sorted(set(zip(labels.tolist(), sizes.tolist(), strict=True)), key=repr):
                at = np.flatnonzero((labels == label) & (sizes == dims))
                for run_of in np.array_split(at, -(-len(at) // 2000)):
                    flat = column.take(pa.array(run_of)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    yield from places(str(label), nodes[run_of], flat.reshape(len(run_of), dims))

    return run


def verify_task(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("va"), batch.column("vb")
            sizes = pa.compute.list_value_length(u).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for dims in np.unique(sizes):  # one, unless a label has vectors of several lengths
                at = np.flatnonzero(sizes == dims)
                x, y = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1) for c in (u, v))
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                keep[at] = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))) >= threshold
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def groups(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, grid: int = GRID) -> DataFrame:
    """A row for each row of ``vectors``: how many others it is linked with, and the smallest id that links reach.

    Links are pairs with equal label, equal number of dimensions and a cosine of ``threshold`` or more. A vector that
    is null, empty or zero, has a null or non-finite component or a null label is linked with nothing. Repeated rows
    are linked with each other. A null ``vec_id`` is larger than any. Columns besides ``vec_id``, ``embedding``
    and ``label`` are not read.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = plain.mapInArrow(class_task, "vec_id long, embedding array<double>, label string, node binary")
    rows = written(rows, "vectors")
    ids = rows.select("vec_id", "node")
    sums = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = written(sums, "classes")
    whole = written(rows.filter("node is not null").select("node", "label", "embedding").dropDuplicates(["node"]), "whole")
    places = written(whole.mapInArrow(place_task(threshold, blocks, grid), "node binary, bucket long, home boolean, budget double, " + ", ".join(f"{p} float" for p in PROBES)), "places")
    near = sum(((F.col(p) - F.col(f"{p}b")) * (F.col(p) - F.col(f"{p}b")) for p in PROBES), F.lit(0.0)) <= F.col("budget") + 1e-6
    homes = places.filter("home").select("bucket", F.col("node").alias("a"), "budget", *PROBES)
    others = places.select("bucket", F.col("node").alias("b"), *(F.col(p).alias(f"{p}b") for p in PROBES))
    found = homes.join(others, "bucket").filter(near & (F.col("a") != F.col("b")))
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    side = lambda x: whole.select(F.col("node").alias(x), F.col("embedding").alias(f"v{x}"))
    links = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(verify_task(threshold), "a binary, b binary"), "links")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    degree = written(degree, "degree")
    labels = classes.join(components(links), F.col("node") == F.col("id"), "left").join(degree, "node", "left")
    labels = written(labels.select("node", "first_id", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "labels")
    smallest = written(labels.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    labels = written(labels.join(smallest, "component").select("node", "n_links", "component_id"), "labels")
    out = ids.join(labels, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = f"""
WITH RECURSIVE u AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM u
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {THRESHOLD}),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.vec_id, e.b FROM reach r JOIN e ON r.other = e.a),
low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
links AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT u.vec_id, coalesce(n_links, 0) AS n_links, component_id, u.vec_id = component_id AS kept
FROM u LEFT JOIN low USING (vec_id) LEFT JOIN links USING (vec_id)
"""
