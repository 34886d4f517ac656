"""What the operators of this subpackage share: the shared folder, word hashing and linked groups."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# --- the folder that driver and executors share ---------------------------------------------


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder in ``spark.checkpoint.dir``; tests that set none get a folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there and outlives executors. ``paths`` notes where, for ``dropped``."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``written`` that nothing reads any more, and let Spark delete the shuffle files of finished jobs.

    It does that when the driver's JVM collects garbage, which a driver with little to do hardly ever does.
    """
    jvm = spark.sparkContext._jvm
    for uri in paths:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()
    jvm.System.gc()


def shared_store(uri: str):
    """(pyarrow file system, path) of a place in the shared folder; works on executors as on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put_array(uri: str, array: np.ndarray) -> None:
    """Store an array as ``.npy``; a task that runs twice leaves the same file, never half of one."""
    store, path = shared_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        np.save(out, array)
    store.move(part, path)


def map_array(uri: str) -> np.ndarray:
    """Memory-map an array of ``put_array``. A store without local paths is copied once into the task's own folder."""
    store, path = shared_store(uri)
    if store.type_name != "local":
        from pyarrow import fs

        local = os.path.join(tempfile.gettempdir(), uri.rstrip("/").replace("/", "_").replace(":", "_"))
        if not os.path.exists(local):
            fs.copy_files(path, f"{local}.{os.getpid()}", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            os.replace(f"{local}.{os.getpid()}", local)
        path = local
    return np.load(path, mmap_mode="r")


# --- memory of Python workers -------------------------------------------------------------------


def released() -> None:
    """Give memory that nothing uses any more back to the system: what Arrow and the C library keep for later, they keep in each worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for mapInArrow, leaving no unused memory in its worker, which Spark keeps for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            released()

    return run


# --- texts as numpy bytes ----------------------------------------------------------------------

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, dtype=U64)
        k, p = 1, base
        while k < size:  # doubling: out[k:2k] = out[:k] * base**k
            out[k : 2 * k] = out[:k] * U64(p)
            k, p = 2 * k, p * p % 2**64
        if n <= 1 << 23:
            _powers[base] = out
        have = out
    return have[:n]


def byte_table(separators: bytes) -> np.ndarray:
    """For ``words_of``: 0 for a separator, else one more than the byte with A-Z in lower case."""
    table = np.arange(1, 257, dtype=U64)
    table[65:91] += U64(32)
    table[list(separators)] = 0
    return table


#: Words between white space, and words of letters, digits and non-ASCII characters; A-Z in lower case.
SPACED = byte_table(b" \t\n\v\f\r")
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, bounds) of a text column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, a longer text alone: what numpy holds at once stays small."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to


def words_of(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words per row), no word crossing the bounds of a row."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(bounds) - 1, np.int64)
    values = table[data]
    word = values != 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * _powers_of(BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _powers_of(_BASE_INVERSE, n)[start])
    return hashes, np.diff(np.searchsorted(start, bounds))


# --- rows of documents ------------------------------------------------------------------------------


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a document's id and text; null differs from empty."""
    id_ = F.coalesce(doc_id.cast("long").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(id_, F.when(text.isNull(), "/").otherwise(F.concat(F.lit("="), text.cast("string"))))))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(key, row): each row's key and all its columns as one struct, so that no name of theirs clashes with another."""
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


# --- groups of linked rows -------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b) but the components themselves: the smallest ids reachable.

    Alternating large-star and small-star rounds: each node's neighbours hang from the smallest of them, so that
    the number of rounds grows with the logarithm of a path. An edge table is at most as long as the input in each
    round and is written to the shared folder. Minima are pre-aggregated, so that a node with very many neighbours
    needs no more than a row per task.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # Written, so that the join below deals both sides anew and Spark can split the rows of a hub.
        low = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name, old)
        tied = pairs.join(low, "u").filter("v > u" if large else "v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return tied if large else tied.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))

    spark, old, at = edges.sparkSession, [], []
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), name, at)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = written(star(both, True).filter("a <> b").distinct(), name, old)
        edges = written(star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False).filter("a <> b").distinct(), name, at)
        old.append(at.pop(0))
        dropped(spark, old)
        # Done when each node hangs from one other, and none from a node that hangs itself.
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("hangs").alias("n"), F.max("holds").alias("holds")).filter("n > 1 or n = 1 and holds = 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


#: Nodes of a side of a block in which all pairs are compared.
BLOCK = 256


def linked(members: DataFrame, prepare: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], verify_block: Callable[[pa.Table, pa.Table], tuple], name: str, block: int = BLOCK, bytes_of: Column | None = None) -> DataFrame:
    """(id, component) of the nodes that verified links connect; only nodes that share a bucket need be compared.

    ``members`` has (bucket, node) without repeats; buckets of the same nodes count once. ``prepare`` gives a row (node, ...) of what verifying needs for each
    node that has company. First a bucket's nodes are compared with its leader, the node with most company: ``verify``
    keeps those of the pairs (a, b) that are linked. Nodes linked with the same node are one group. What then lies
    outside its bucket's main group is attached to that group, and all that is attached is compared with one another and
    with what such buckets hold of the group, in blocks: ``verify_block`` gives of two tables of facts the rows that may be linked, as (i, j,
    check), and ``check`` decides on some of them. Pairs that are connected by then are not compared, and only as many links
    are returned as connect the block. So all pairs of a bucket are compared or known to be
    connected, no pair is a row but those with a leader, and a block is all that a task holds. With ``bytes_of``, the bytes of
    a node's facts, a task takes many small blocks, of about ``TOGETHER`` rows and bytes in all, and decides on their pairs side by side.
    """
    spark, old = members.sparkSession, []
    # Buckets that hold the same nodes, by number and 128 bits of these, are one bucket.
    kinds = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    sizes = written(kinds.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), name, old)
    shared = written(members.join(sizes, "bucket").select("bucket", "node", "n"), name, old)
    degree = written(shared.groupBy("node").agg(F.sum("n").alias("degree")), name, old)
    facts = prepare(degree.select("node"))
    dropped(spark, [])
    shared = written(shared.join(degree, "node").select("bucket", "node", "degree"), name, old)
    lead = written(shared.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("m")).select("bucket", F.col("m.node").alias("other")), name, old)
    pairs = shared.join(lead, "bucket").filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = written(verify(written(pairs, name, old), facts).select("a", "b").distinct(), name, old)
    dropped(spark, [])

    near = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    best = near.join(degree.select(F.col("node").alias("other"), F.col("degree").alias("of")), "other").groupBy("node").agg(F.max(F.struct(F.col("of").alias("degree"), F.col("other").alias("node"))).alias("best"))
    best = written(best, name, old)
    state = shared.join(best, "node", "left").select("bucket", "node", F.greatest(F.struct("degree", "node"), "best")["node"].alias("label"))
    state = written(state, name, old)
    main = state.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("labels"))
    # A bucket of two has been compared, and one with a single label is connected.
    main = written(main.filter("n > 2 and labels > 1").select("bucket", F.col("m.label").alias("main")), name, old)
    state = written(state.join(main, "bucket").select(F.col("main").alias("cluster"), "node", "label").distinct(), name, old)
    apart = state.filter("label <> cluster").select("cluster", "node").distinct()
    if not apart.isEmpty():
        links = links.union(written(_linked_in_blocks(apart, state, facts, verify_block, name, block, bytes_of), name, old))
    found = components(links, name)
    dropped(spark, old)
    return found


#: Pairs that are compared before it is seen again which ones are connected; rows and bytes of blocks that a task takes together.
TURN, TOGETHER = 16384, (16384, 16 << 20)


class Check:
    """Decides on pairs (i, j) of a block, alone or side by side with pairs of others: ``decide`` on what ``facts`` gives of them."""

    def __init__(self, facts: Callable[[np.ndarray, np.ndarray], tuple], decide: Callable[..., np.ndarray]):
        self.facts, self.decide = facts, decide

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.decide(*self.facts(i, j))


class _Block:
    """One block: its pairs that may be linked, and which of its nodes are connected by now."""

    def __init__(self, table: pa.Table, verify_block):
        side = table.column("side").to_numpy()
        parts = [table.filter(pa.array(side == k)) for k in (0, 1)]
        self.names = [p.column("node").to_pylist() for p in parts]
        places = {x: k for k, x in enumerate(dict.fromkeys(self.names[0] + self.names[1]))}
        self.at = [np.array([places[x] for x in own], np.int64) for own in self.names]
        # Nodes of one label are connected from the start.
        self.group = np.arange(len(places))
        first: dict = {}
        for own, p in zip(self.at, parts, strict=True):
            for k, label in zip(own.tolist(), p.column("label").to_pylist(), strict=True):
                self.group[k] = first.setdefault(label, k)
        i, j, self.check = verify_block(*parts)
        order = np.random.default_rng(len(i)).permutation(len(i))
        self.i, self.j, self.found = i[order], j[order], []

    def turn(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The next ``n`` pairs that are not connected."""
        open_ = self.group[self.at[0][self.i]] != self.group[self.at[1][self.j]]
        self.i, self.j = self.i[open_], self.j[open_]
        i, j = self.i[:n], self.j[:n]
        self.i, self.j = self.i[n:], self.j[n:]
        return i, j

    def settle(self, i: np.ndarray, j: np.ndarray, yes: np.ndarray) -> None:
        for a, b in zip(i[yes].tolist(), j[yes].tolist(), strict=True):
            x, y = self.group[self.at[0][a]], self.group[self.at[1][b]]
            if x != y:
                self.group[self.group == max(x, y)] = min(x, y)
                self.found.append((min(self.names[0][a], self.names[1][b]), max(self.names[0][a], self.names[1][b])))


def _decided(blocks: list[_Block]) -> None:
    """All links of the blocks that connect nodes, a turn of each block's pairs after the other."""
    while blocks:
        share = max(1, TURN // len(blocks))
        turns = [(b, *b.turn(share)) for b in blocks]
        turns = [t for t in turns if len(t[1])]
        if not turns:
            return
        if all(isinstance(b.check, Check) for b, _, _ in turns):
            facts = [b.check.facts(i, j) for b, i, j in turns]
            joined = (np.concatenate(x) if isinstance(x[0], np.ndarray) else [y for part in x for y in part] for x in zip(*facts, strict=True))
            yes = turns[0][0].check.decide(*joined)
            cuts = np.cumsum([len(i) for _, i, _ in turns])[:-1]
            for (b, i, j), own in zip(turns, np.split(yes, cuts), strict=True):
                b.settle(i, j, own)
        else:
            for b, i, j in turns:
                b.settle(i, j, b.check(i, j))
        blocks = [b for b, _, _ in turns if len(b.i)]


def _linked_in_blocks(apart: DataFrame, state: DataFrame, facts: DataFrame, verify_block, name: str, block: int, bytes_of: Column | None) -> DataFrame:
    """Links of the attached nodes (cluster, node) with one another and with the others of ``state`` (cluster, node, label)."""
    whole = state.groupBy("cluster", "node").agg(F.min("label").alias("label"))
    apart = apart.join(whole, ["cluster", "node"])
    blocks = lambda df, n: df.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias(n), F.count("*").alias(f"{n}_rows"))
    sizes = written(blocks(apart, "left_n").join(blocks(whole, "right_n"), "cluster"), name)
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = apart.join(sizes, "cluster").select("cluster", "node", "label", F.lit(0).alias("side"), own("left_n").alias("i"), each("right_n").alias("j"))
    right = whole.join(sizes, "cluster").select("cluster", "node", "label", F.lit(1).alias("side"), each("left_n").alias("i"), own("right_n").alias("j"))
    rows = left.union(right).join(facts, "node")
    kind = facts.schema["node"].dataType.simpleString()

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = [table.column("cluster").combine_chunks().dictionary_encode(), *(table.column(c) for c in "ij")]
        keys = [keys[0].indices.to_numpy(), *(k.to_numpy() for k in keys[1:])]
        order = np.lexsort(keys)
        new = np.flatnonzero(np.concatenate([[True], np.any([np.diff(k[order]) != 0 for k in keys], axis=0)]))
        parts = [_Block(table.take(pa.array(rows)), verify_block) for rows in np.split(order, new[1:])]
        _decided(parts)
        found = [x for b in parts for x in b.found]
        del parts
        released()
        types = table.schema.field("node").type
        return pa.table({"a": pa.array([x[0] for x in found], types), "b": pa.array([x[1] for x in found], types)})

    by: list = ["cluster", "i", "j"]
    if bytes_of is not None:
        n = sizes.agg(F.sum(F.col("left_n_rows") * F.col("right_n") + F.col("right_n_rows") * F.col("left_n"))).first()[0] or 0
        mean = facts.agg(F.avg(bytes_of)).first()[0] or 0
        groups = 1 + int(max(n // TOGETHER[0], n * mean // TOGETHER[1]))
        by = [F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(groups)).alias("g")]
    return rows.groupBy(*by).applyInArrow(task, f"a {kind}, b {kind}").distinct()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
