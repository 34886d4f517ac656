"""Near-duplicate documents by ProbMinHash, banding and verification.

A document's weighted set has its shingles of five words (A-Z in lower case, words of letters, digits and non-ASCII
characters), each with the number of times that it occurs; a document of fewer words is one shingle. Each shingle
sends arrivals of a Poisson process, with its weight as the rate, to random registers, and a register keeps the
shingle that arrives first, so that two documents agree in a register with probability J_P, their probability
Jaccard similarity. Arrivals are drawn up to a horizon of time; once every register has one, later ones cannot win
and are never drawn. Documents that agree in a band of registers are candidates, and J_P of their whole sets,
computed exactly, decides.

Documents with the same words are one class from the start and are never paired with one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import ALNUM, U64, linked, mix, row_key, slices, text_bytes, tidy, whole_rows, words_of, written

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4


def shingles(words: np.ndarray, n: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle; a row of fewer words, but not none, has one shingle of them all."""
    ends = np.cumsum(n)
    row_of_word = np.repeat(np.arange(len(n)), n)
    left = ends[row_of_word] - np.arange(len(words))  # words from here to the row's end
    first = left == n[row_of_word]
    whole = np.flatnonzero((left >= size) | first)
    h = np.zeros(len(whole), U64)
    for k in range(size):
        inside = left[whole] > k
        at = np.minimum(whole + k, max(len(words) - 1, 0))
        h = np.where(inside, mix(h * U64(0x9E3779B97F4A7C15) + words[at]), h)
    return row_of_word[whole], h


def weighted(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash), in order, and how often each occurs."""
    bits = U64(max(1, int(rows).bit_length()))
    key = (row.astype(U64) << (U64(64) - bits)) | (h >> bits)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return row[order[at]], h[order[at]], np.diff(np.append(at, len(key)))


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """For each row and register, the hash of the shingle that arrives first; 0 in rows without shingles."""
    total = np.bincount(row, weight, rows)
    horizon = registers * (np.log(registers) + 3) / np.maximum(total, 1e-300)
    first, winner = np.full(rows * registers, np.inf), np.zeros(rows * registers, U64)
    live = np.arange(len(row))
    while len(live):
        arrivals = []
        at, t, turn = live, np.zeros(len(live)), 0
        while len(at):
            turn += 1
            r = mix(h[at] + U64(turn * 0xA0761D6478BD642F % 2**64))
            t = t - np.log(((r >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[at]
            in_time = t <= horizon[row[at]]
            at, t, r = at[in_time], t[in_time], r[in_time]
            place = row[at] * registers + (((mix(r) >> U64(32)) * U64(registers)) >> U64(32)).astype(np.int64)
            np.minimum.at(first, place, t)
            arrivals.append((place, t, at))
        for place, t, at in arrivals:
            won = t == first[place]
            winner[place[won]] = h[at[won]]
        # A row with a register that nothing has reached is drawn again, up to a horizon twice as far.
        short = np.isinf(first.reshape(rows, registers)).any(axis=1)
        horizon[short] *= 2
        live = live[short[row[live]]]
        first.reshape(rows, registers)[short] = np.inf
    return winner.reshape(rows, registers)


def band_keys(signature: np.ndarray, bands: int, width: int) -> np.ndarray:
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, width)
    for k in range(width):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """For runs of rows: (first row, rows, row, hash and count of each distinct shingle, key of each row's words)."""
    data, bounds = text_bytes(column)
    for i, j in slices(bounds):
        words, n = words_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], ALNUM)
        ends = np.cumsum(n)
        keys = [hashlib.blake2b(words[e - k : e].tobytes(), digest_size=16).digest() if k else None for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        yield i, j - i, *weighted(*shingles(words, n), j - i), keys


SIGNED = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sign_task(bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for at, rows, row, h, n, nodes in _sets(batch.column("text")):
                    keys = band_keys(signatures(row, h, n.astype(np.float64), rows, bands * width), bands, width)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).reshape(-1)))
                    yield pa.record_batch([batch.column("doc_id").slice(at, rows), batch.column("row_key").slice(at, rows), pa.array(nodes, pa.binary()), lists], schema=SIGNED)

    return run


SETS = pa.schema([("node", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])


def set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted shingles of each text and, where some occur more than once, their counts."""
    for batch in batches:
        if batch.num_rows:
            for _, rows, row, h, n, nodes in _sets(batch.column("text")):
                cuts = np.searchsorted(row, np.arange(rows + 1))
                parts = [(h[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes() if n[i:j].max(initial=1) > 1 else b"") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], schema=SETS)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray | None, hb: np.ndarray, wb: np.ndarray | None) -> float:
    """Sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i); hashes in order, no weights: all 1."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    union = len(ha) + len(hb) - len(common)
    if wa is None and wb is None:
        return len(common) / union if union else 0.0
    a = np.ones(len(ha)) if wa is None else wa.astype(np.float64)
    b = np.ones(len(hb)) if wb is None else wb.astype(np.float64)
    x, y = a[ia], b[ib]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # Where b_j / a_j is at most the ratio of i, a_j / a_i is the larger: sums up to the last of equal ratios.
    to = np.searchsorted(ratio, ratio, side="right")
    below = np.concatenate([[0], np.cumsum(x)])[to] + a.sum() - x.sum()
    above = y.sum() - np.concatenate([[0], np.cumsum(y)])[to] + b.sum() - y.sum()
    return float((1 / (below / x + above / y)).sum())


def verify_task(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, ca, hb, cb = ([np.frombuffer(x, t) if x else None for x in batch.column(c).to_pylist()] for c, t in (("ha", U64), ("ca", np.uint32), ("hb", U64), ("cb", np.uint32)))
            keep = np.array([probability_jaccard(*x) >= threshold for x in zip(ha, ca, hb, cb, strict=True)], dtype=bool)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def linked_block(threshold: float):
    """Pairs of two tables of sets that may be linked by shares of common weight, from matrix products; J_P decides.

    J_P is at most the share of either's weight that is common, so that a pair with less than the threshold is out.
    """

    def run(left: pa.Table, right: pa.Table) -> tuple:
        sides = []
        for table in (left, right):
            h = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
            w = [np.frombuffer(x, np.uint32) if x else None for x in table.column("counts").to_pylist()]
            sides.append((h, w, table.column("node").to_pylist()))
        kinds = [np.unique(np.concatenate(h)) if h else np.zeros(0, U64) for h, _, _ in sides]
        common = np.intersect1d(*kinds, assume_unique=True)
        shares = np.zeros((2, len(sides[0][0]), len(sides[1][0])))
        for at in range(0, len(common), 8192):  # so many columns at once
            part = common[at : at + 8192]
            there, share = [], []
            for h, w, _ in sides:
                one, weight = np.zeros((len(h), len(part)), np.float32), np.zeros((len(h), len(part)), np.float32)
                for k, x in enumerate(h):
                    where = np.minimum(np.searchsorted(part, x), len(part) - 1)
                    hit = part[where] == x
                    counts = np.ones(len(x), np.float32) if w[k] is None else w[k].astype(np.float32)
                    one[k, where[hit]] = 1
                    weight[k, where[hit]] = counts[hit] / counts.sum(dtype=np.float64)
                there.append(one)
                share.append(weight)
            shares[0] += share[0] @ there[1].T
            shares[1] += there[0] @ share[1].T
        near = shares.min(axis=0) >= threshold - 1e-3
        near &= np.array(sides[0][2], object)[:, None] != np.array(sides[1][2], object)[None, :]
        similar = lambda i, j: probability_jaccard(sides[0][0][i], sides[0][1][i], sides[1][0][j], sides[1][1][j]) >= threshold
        return *np.nonzero(near), lambda i, j: np.array([similar(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)

    return run


def labelled(docs: DataFrame, threshold: float, bands: int, width: int) -> DataFrame:
    """(doc_id, row_key, component_id, kept_key, group_size) of each row; null where a text has no words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    signed = written(docs.select("doc_id", "row_key", "text").mapInArrow(tidy(sign_task(bands, width)), "doc_id long, row_key binary, node binary, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    classes = signed.filter("node is not null").groupBy("node").agg(first.alias("first"), F.count("*").alias("n"))
    classes = written(classes, "classes")
    one = signed.filter("node is not null").join(classes.select("node", F.col("first.row_key").alias("row_key")), ["node", "row_key"], "left_semi")
    members = one.select("node", F.explode("bands").alias("bucket")).distinct()

    def prepare(nodes: DataFrame) -> DataFrame:
        wanted = written(classes.join(nodes, "node", "left_semi").select("first.row_key"), "wanted")
        # Keys of the documents with company grow with the input: the same plan at every size, no broadcast of them.
        texts = docs.select("row_key", "text").join(wanted.hint("merge"), "row_key", "left_semi").dropDuplicates(["row_key"])
        return written(texts.select("text").mapInArrow(tidy(set_task), "node binary, hashes binary, counts binary"), "sets")

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"), F.col("counts").alias(f"c{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(verify_task(threshold)), "a binary, b binary")

    found = linked(members, prepare, verify, linked_block(threshold), "minhash")
    labels = classes.join(found, classes.node == found.id, "left").select("node", "first", "n", F.coalesce("component", "node").alias("component"))
    labels = written(labels, "labels")
    sums = written(labels.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("group_size")), "groups")
    labels = labels.select("node", "component").join(sums, "component")
    labels = written(labels.select("node", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("kept_key"), "group_size"), "labels")
    return signed.select("doc_id", "row_key", "node").join(labels, "node", "left").drop("node")


def groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """A row for each row of ``docs``: its group, the size of the group, and whether it is the one that stays.

    ``component_id`` is the smallest ``doc_id`` among the rows linked, directly or through others, by a similarity of
    ``threshold`` or more, and the row with it stays. A text that is null or has no words is linked with nothing
    and stays. A null ``doc_id`` is larger than any. Rows repeated with the same id and text are the same document
    and get the same answer. Columns besides ``doc_id`` and ``text`` are not read. At the threshold a pair shares a
    band with probability 1 - (1 - 0.8**4)**20 = 0.99997.
    """
    rows = labelled(docs, threshold, bands, width)
    alone = F.col("kept_key").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row_key") == F.col("kept_key"))).alias("kept"),
    )


def dedup(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that ``groups`` keeps, with all their columns; of rows repeated whole, one stays.

    Texts that are null or have no words stay, repeated or not. Columns may have any names. Of an empty table none.
    """
    rows = written(labelled(docs, threshold, bands, width).filter("kept_key is not null").select("row_key", "kept_key"), "row-labels")
    gone = rows.filter("row_key <> kept_key").select(F.col("row_key").alias("key")).distinct()
    again = written(rows.filter("row_key = kept_key").groupBy(F.col("row_key").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated")
    stay = whole_rows(docs).join(gone, "key", "left_anti")
    if not again.isEmpty():
        whole = stay.join(again, "key", "left_semi").dropDuplicates(["key"])
        stay = stay.join(again, "key", "left_anti").union(whole)
    return stay.select("row.*")
