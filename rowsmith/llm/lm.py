"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, memory-mapped for scoring.

Tokens are the words between white space (A-Z in lower case) of a text and one end mark; before a text stand start marks.
Each task counts the n-grams of its own texts and sends one packed run of them for each shard of hashes. From the highest order
down, a shard's task merges the runs of one order, stores it as arrays in the shared folder, and sends runs of the order
below: how many n-grams end in each shorter one (behind a start mark, how often), and what follows each context. A shard
is a range of hashes, and the n-grams of one context lie in up to 16 parts, so that a frequent context does not fill a shard.
Scoring tasks map the arrays and look the sorted hashes of a batch up in them. Memory holds one batch and one shard,
whatever the input; raise ``shards`` with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import SPACED, U64, map_array, mix, put_array, shared_path, slices, text_bytes, words_of

#: Hashes of the mark that ends a text and of the mark before its first token.
END, START = U64(0x5EED0000000E2D01), U64(0x5EED00000057A127)
#: Longest n-gram unless another is asked for. Each order more stores about all its distinct n-grams: see the README for
#: what 3 takes.
ORDER = 2
#: Tokens that a counting task holds before it sends its runs.
FLUSH = 4_000_000
#: Parts that the n-grams of one context may lie in: a context of a third of all tokens does not fill one shard.
SALTS = 16
#: Bits of a hash that its context and part decide, so that a context's n-grams meet in a shard.
NEAR = 16
#: What a stored n-gram has beside its hash: its count (raw in the highest order, else of n-grams that end in it), and as a
#: context the sum of such counts behind it and how many of these are 1, 2 and more. Words also have their raw count.
COUNTS = ("adjusted", "total", "n1", "n2", "n3", "raw")


# --- n-grams and their hashes ---------------------------------------------------------------------


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end mark for each row, tokens per row)."""
    words, n = words_of(data, bounds, SPACED)
    tokens = np.full(len(words) + len(n), END, dtype=U64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[np.cumsum(n + 1) - 1] = False
    tokens[inner] = words
    return tokens, n + 1


def with_contexts(tokens: np.ndarray, n: np.ndarray, order: int, start) -> list[np.ndarray]:
    """Columns of the n-gram that ends in each token, the token last; ``start`` stands before each row."""
    columns, first = [tokens], np.cumsum(n) - n
    for _ in range(order - 1):
        before = np.empty_like(tokens)
        before[1:] = columns[0][:-1]
        before[first] = start
        columns.insert(0, before)
    return columns


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * U64(0x9E3779B97F4A7C15) + c)
    return h


def gram_hash(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    near = mix(context * U64(0x9E3779B97F4A7C15) + (token & U64(SALTS - 1)))
    return (near >> U64(64 - NEAR) << U64(64 - NEAR)) | (mix(context * U64(0xD6E8FEB86659FD93) + token) >> U64(NEAR))


def hash_of(columns: list[np.ndarray]) -> np.ndarray:
    """A word is its own hash."""
    return gram_hash(context_hash(columns[:-1]), columns[-1]) if len(columns) > 1 else columns[0]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, so that shards in order are sorted as a whole."""
    return ((h >> U64(32)) * U64(shards)) >> U64(32)


def within_shard(h: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """The first 40 bits of a hash's place in its shard's range."""
    width = (2**64 // shards).bit_length() + 1
    return (h - (U64(-(-(shard << 32) // shards)) << U64(32))) >> U64(max(0, min(width, 64) - 40))


def first_of_each(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place of the first of each distinct key, in order of keys, and the sums of its values)."""
    order = np.argsort(keys)
    at = first_of_each(keys[order])
    return order[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


# --- runs: rows of packed n-grams --------------------------------------------------------------------

RUN = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("kind", pa.string()), ("run", pa.list_(pa.binary()))])
RUN_DDL = "level int, shard int, kind string, run array<binary>"


def packed(numbers: np.ndarray) -> bytes:
    """Byte planes of non-negative integers, compressed: small numbers take little more than their entropy."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def runs(kind: str, shards: int, words: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each shard: its words, most frequent first, then its n-grams as places in them, a context once for all that follow it, and values."""
    columns = [words[c] for c in ids]
    h, context = hash_of(columns), mix(context_hash(columns[:-1])) if len(columns) > 1 else columns[0]
    shard = shard_of(h, shards)
    order = np.argsort((shard << U64(48)) | (context >> U64(16)))
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    local, rows = np.zeros(len(words), np.int64), []
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            part = order[cuts[s] : cuts[s + 1]]
            own = [c[part] for c in ids]
            # A shard's words stand by how often they occur, so that most places are small numbers.
            uses = sum(np.bincount(c, minlength=len(words)) for c in own)
            there = np.flatnonzero(uses)
            there = there[np.argsort(-uses[there], kind="stable")]
            local[there] = np.arange(len(there))
            at = first_of_each(*own[:-1]) if len(own) > 1 else np.arange(len(part))
            lengths = np.diff(np.append(at, len(part)))
            rows.append((s, [words[there].tobytes(), packed(lengths), *(packed(local[c[at]]) for c in own[:-1]), packed(local[own[-1]]), *(packed(v[part]) for v in values)]))
    level = len(ids)
    return pa.record_batch([pa.array([level] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], schema=RUN)


def read_runs(rows: list[tuple[str, list]], level: int, kinds: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(words, places in them of each n-gram, columns of COUNTS); ``kinds`` says which of these a kind's values are."""
    words = [np.frombuffer(run[0], U64) for _, run in rows]
    all_words = np.unique(np.concatenate(words)) if words else np.zeros(0, U64)
    ids: list[list] = [[] for _ in range(level)]
    values: list[list] = [[] for _ in COUNTS]
    for own, (kind, run) in zip(words, rows, strict=True):
        place = np.searchsorted(all_words, own).astype(np.int32)
        lengths = unpacked(run[1])
        for k in range(level - 1):
            ids[k].append(np.repeat(place[unpacked(run[2 + k])], lengths))
        ids[-1].append(place[unpacked(run[1 + level])])
        for k in range(len(COUNTS)):
            there = kinds[kind].index(k) if k in kinds[kind] else None
            values[k].append(unpacked(run[2 + level + there]) if there is not None else np.zeros(len(ids[-1][-1]), np.int64))
    joined = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    return all_words, [joined(c, np.int32) for c in ids], [joined(c, np.int64) for c in values]


#: Which of COUNTS the values of a run are: n-grams, contexts, words as they occur.
KINDS = {"gram": (0,), "context": (1, 2, 3, 4), "raw": (5,)}


def count_task(shards: int, order: int):
    """mapInArrow: texts to runs of n-gram counts."""

    def flush(tokens: list, sizes: list) -> Iterator[pa.RecordBatch]:
        t, n = np.concatenate(tokens), np.concatenate(sizes)
        tokens.clear()
        sizes.clear()
        words, ids = np.unique(np.append(t, START), return_inverse=True)
        start, ids = np.int32(ids[-1]), ids[:-1].astype(np.int32)
        yield runs("raw", shards, words, [np.flatnonzero(np.bincount(ids, minlength=len(words))).astype(np.int32)], [c[c > 0] for c in [np.bincount(ids, minlength=len(words))]])
        columns = with_contexts(ids, n, order, start)
        first, count = grouped(hash_of([words[c] for c in columns]), np.ones(len(ids), np.int64))
        yield runs("gram", shards, words, [c[first] for c in columns], [count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, held = [], [], 0
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for i, j in slices(bounds):
                t, n = tokens_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                tokens.append(t)
                sizes.append(n)
                held += len(t)
                if held >= FLUSH:
                    yield from flush(tokens, sizes)
                    held = 0
        if held:
            yield from flush(tokens, sizes)

    return run


def put_counts(uri: str, values: np.ndarray) -> None:
    """A byte for each count; those of 255 and more are listed with their places."""
    many = np.flatnonzero(values >= 255)
    put_array(f"{uri}.npy", np.minimum(values, 255).astype(np.uint8))
    put_array(f"{uri}-many.npy", np.stack([many, values[many]]))


def level_task(uri: str, shards: int, order: int, level: int):
    """applyInArrow of one shard: store the n-grams of one order, send on what the order below needs to know of them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() != level:
            return table
        shard = key[1].as_py()
        words, ids, values = read_runs(list(zip(table.column("kind").to_pylist(), table.column("run").to_pylist(), strict=True)), level, KINDS)
        h = hash_of([words[c] for c in ids])
        first, *values = grouped(h, *values)
        h, ids = h[first], [c[first] for c in ids]
        adjusted = values[0]
        if level == 1:
            put_array(f"{uri}/1-{shard}-key.npy", h)
        else:
            near = within_shard(h, shard, shards)
            put_array(f"{uri}/{level}-{shard}-key.npy", (near >> U64(8)).astype(np.uint32))
            put_array(f"{uri}/{level}-{shard}-low.npy", near.astype(np.uint8))
        for name, v in zip(COUNTS, values, strict=True):
            if level == 1 or name == "adjusted" or (level < order and name != "raw"):
                put_counts(f"{uri}/{level}-{shard}-{name}", v)
        sums = [*((adjusted == k).sum() for k in (1, 2, 3, 4)), adjusted.sum(), (adjusted > 2).sum(), values[5].sum(), (values[5] > 0).sum()]
        out = [pa.record_batch([pa.array([0], pa.int32()), pa.array([shard], pa.int32()), pa.array([str(level)]), pa.array([[np.array(sums, np.int64).tobytes()]], pa.list_(pa.binary()))], schema=RUN)]
        if level > 1:
            some = np.flatnonzero(adjusted)  # contexts alone are no n-grams
            ids, adjusted = [c[some] for c in ids], adjusted[some]
            u, *stats = grouped(context_hash([words[c] for c in ids[:-1]]), adjusted, *((adjusted == k).astype(np.int64) for k in (1, 2)), (adjusted > 2).astype(np.int64))
            out.append(runs("context", shards, words, [c[u] for c in ids[:-1]], stats))
            # Nothing stands before a start mark: there an n-gram counts as often as it occurs.
            behind = words[ids[1]] == START if level > 2 else np.zeros(len(some), bool)
            v, share = grouped(hash_of([words[c] for c in ids[1:]]), np.where(behind, adjusted, 1))
            out.append(runs("gram", shards, words, [c[v] for c in ids[1:]], [share]))
        return pa.Table.from_batches(out, RUN)

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and over 2, from how many n-grams have a count of one to four; 0.5, 1 and 1.5 where too few do."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not min(n1, n2, n3, n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


def fit(texts: DataFrame, shards: int | None = None, order: int = ORDER) -> dict:
    """Count ``text`` of ``texts`` into a model of n-grams of up to ``order`` tokens in the shared folder.

    Null and empty texts hold the end mark only; repeated rows count again. Of no rows, a model that gives every
    token the same probability. ``shards`` defaults to the session's number of shuffle partitions.
    """
    if order < 2:
        raise ValueError("an n-gram has a context: order is 2 or more")
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = shared_path(spark, "ngrams")
    rows = texts.select("text").mapInArrow(count_task(shards, order), RUN_DDL)
    for level in range(order, 0, -1):
        rows = rows.groupBy("level", "shard").applyInArrow(level_task(uri, shards, order, level), RUN_DDL)
    sums, stored = {k: np.zeros(8, np.int64) for k in range(1, order + 1)}, {k: [] for k in range(1, order + 1)}
    for row in rows.collect():  # a short row for each shard and level
        sums[int(row.kind)] += np.frombuffer(row.run[0], np.int64)
        stored[int(row.kind)].append(row.shard)
    return {
        "uri": uri,
        "shards": shards,
        "order": order,
        "stored": stored,
        "discounts": {k: discounts(s[:4]) for k, s in sums.items()},
        "low_n": sums[1][[0, 1, 5]].tolist(),
        "low_total": int(sums[1][4]),
        "tokens": int(sums[1][6]),
        "kinds": int(sums[1][7]),
    }


# --- look-up and scores -------------------------------------------------------------------------------


class Arrays:
    """The arrays of one order: COUNTS of hashes, 0 for those that are not there."""

    def __init__(self, model: dict, level: int):
        self.level, self.model = level, model
        self.names = COUNTS if level == 1 else COUNTS[:5] if level < model["order"] else COUNTS[:1]
        self.there, self.opened = set(model["stored"][level]), {}

    def _open(self, shard: int) -> tuple:
        if shard not in self.opened:
            at = f"{self.model['uri']}/{self.level}-{shard}"
            low = map_array(f"{at}-low.npy") if self.level > 1 else None
            self.opened[shard] = map_array(f"{at}-key.npy"), low, [(map_array(f"{at}-{x}.npy"), map_array(f"{at}-{x}-many.npy")) for x in self.names]
        return self.opened[shard]

    def look_up(self, h: np.ndarray) -> list[np.ndarray]:
        """``h`` sorted: neighbours in the query are neighbours on disk."""
        out = [np.zeros(len(h), np.int64) for _ in self.names]
        shards = self.model["shards"]
        cuts = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
        for shard in range(shards):
            i, j = cuts[shard], cuts[shard + 1]
            if i < j and shard in self.there:
                keys, low, columns = self._open(shard)
                if low is None:
                    at = np.searchsorted(keys, h[i:j])
                    own = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h[i:j])
                else:
                    near = within_shard(h[i:j], shard, shards)
                    high, near = (near >> U64(8)).astype(np.uint32), near.astype(np.uint8)
                    at = np.searchsorted(keys, high)
                    left = np.arange(len(at))
                    while len(left):  # keys with the same 32 bits are told apart by 8 more
                        left = left[at[left] < len(keys)]
                        left = left[(keys[at[left]] == high[left]) & (low[at[left]] < near[left])]
                        at[left] += 1
                    last = np.minimum(at, len(keys) - 1)
                    own = np.flatnonzero((keys[last] == high) & (low[last] == near))
                for o, (few, many) in zip(out, columns, strict=True):
                    found = few[at[own]].astype(np.int64)
                    large = np.flatnonzero(found == 255)
                    found[large] = many[1][np.searchsorted(many[0], at[own][large])]
                    o[i + own] = found
        return out


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])


def score_task(model: dict):
    order, cut = model["order"], model["discounts"]
    seen_before = max(model["low_total"], 1)
    gamma = sum(cut[1][i + 1] * n for i, n in enumerate(model["low_n"])) / seen_before if model["low_total"] else 1.0
    uniform = 1.0 / (model["kinds"] + 1)

    def chances(columns: list[np.ndarray], arrays: dict[int, Arrays]) -> tuple[np.ndarray, np.ndarray]:
        """(count of each token, probability of each token after its context)."""
        count = p = total = rest = None
        for level in range(1, order + 1):
            own = columns[order - level :]
            seen, back = np.unique(np.concatenate([hash_of(own), hash_of(columns[order - 1 - level : -1])] if level < order else [hash_of(own)]), return_inverse=True)
            found = arrays[level].look_up(seen)
            c = found[0][back[: len(own[0])]]
            taken = c - cut[level][np.minimum(c, 3)]
            if level == 1:
                count = found[5][back[: len(own[0])]]
                p = taken / seen_before + gamma * uniform
            else:
                p = taken / np.maximum(total, 1) + rest * p
            if level < order:
                # The context of the next order is an n-gram of this one.
                as_context = [x[back[len(own[0]) :]] for x in found[1:5]]
                total, higher = as_context[0], cut[level + 1]
                rest = np.where(total > 0, sum(higher[k] * as_context[k] for k in (1, 2, 3)) / np.maximum(total, 1), 1.0)
        return count, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {level: Arrays(model, level) for level in range(1, order + 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = text_bytes(batch.column("text"))
            found = []
            for i, j in slices(bounds, 1 << 22):
                tokens, n = tokens_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                count, p = chances(with_contexts(tokens, n, order, START), arrays)
                at = np.cumsum(n) - n
                base = np.log10((count + 1) / (model["tokens"] + model["kinds"] + 1))
                found.append((n, np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)))
            n, known, base, score = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model["tokens"])), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))], schema=OUT)

    return run


def is_held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """log10 probability of each row's whole text under ``model``, beside the add-one base of the same counts.

    ``perplexity`` is that of the text's tokens, the end included.
    """
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(score_task(model), ddl)


def score_held_out(docs: DataFrame, shards: int | None = None, order: int = ORDER) -> DataFrame:
    """Learn from the rows that are not held out and score all rows.

    One row per row of ``docs``. A null text is empty: its one token is the end mark. A null ``doc_id`` is not held
    out. Repeated rows are learnt from and scored each. With nothing to learn from, all tokens are equally likely.
    Only ``doc_id`` and ``text`` are read; other columns may have any names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", is_held_out(F.col("doc_id")))
    return score(docs, fit(docs.filter("not held_out"), shards, order))
