"""Secret scans: fixed rules, and a character convolutional network over every candidate with its surroundings.

Each text is read once. The rules give the base findings; candidates are their values and all other runs of the characters
that secrets are written in, of ``LEAST`` or more, that hold a digit or change from lower to upper case three times. Of a
candidate a window of fixed length is kept: what stands before it, its first and last characters, and what stands behind.
The network is trained on labelled findings, by default those of the rules against all other candidates, from all distinct
windows: in each pass tasks go over shards of them, from the same weights, and what they come to is averaged. In every other
training window what stands before is blanked, so that the value's own shape has to be learned too. Logits are calibrated on
a fold that training has not seen. For each shape of value the threshold is the one with the fewest false findings among
those that keep ``RECALL`` of this fold's findings. Calibration and thresholds count the whole fold in Spark.
Candidates that reach the threshold outside base findings become findings of kind ``learned``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import text_bytes, written

# Kinds in order, their rules and least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "learned")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Words of which a text needs one for ``ASSIGN``.
GATES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Least length of a candidate, and the runs that may be one.
LEAST = 8
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
DIGIT, FLIP = re.compile(rb"[0-9]"), re.compile(rb"[a-z][A-Z]")
ONLY_HEX = re.compile(rb"[0-9a-fA-F]+")

#: Bytes of a window before the value, of its head and tail, and behind it.
BEFORE, HEAD, TAIL, BEHIND = 24, 40, 16, 8
INSIDE = HEAD + TAIL
WIDTH = BEFORE + INSIDE + BEHIND
#: Windows of a sample for fits on the driver, half of them findings; share of findings that thresholds keep.
SAMPLE, RECALL = 12_000, 0.95
#: Distinct windows of a shard, about; parts of one in which tasks add up weights, so that their order changes nothing.
SHARD, UNIT = 16_384, 1 << 32
CLASSES, CHANNELS, FILTERS, REACH, EPOCHS, BATCH = 129, 8, 24, 5, 8, 256


# --- findings and candidates -----------------------------------------------------------------------------


def base_findings(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start and end of the value) of UTF-8 bytes, in order of start and kind."""
    found = []
    low = raw.lower()
    if any(g in low for g in GATES):
        found += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(raw)]
    return sorted(found)


def window(raw: bytes, start: int, end: int) -> bytes:
    """``WIDTH`` bytes: before, head and tail of the value, behind; zeros where there is nothing."""
    value = raw[start:end] if end - start <= INSIDE else raw[start : start + HEAD] + raw[end - TAIL : end]
    return raw[max(0, start - BEFORE) : start].rjust(BEFORE, b"\0") + value.ljust(INSIDE, b"\0") + raw[end : end + BEHIND].ljust(BEHIND, b"\0")


def candidates(raw: bytes, base: list[tuple]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is in a base finding): base values, and runs apart from base findings."""
    out = [(s, e, True) for s, e in sorted({f[3:] for f in base})]
    spans = sorted((f[0], f[2]) for f in base)
    at = 0
    reach = 0  # the end of all findings that begin before the run's end
    for m in RUN.finditer(raw):
        s, e = m.span()
        while s < e and raw[s] in b".-":
            s += 1
        while e > s and raw[e - 1] in b".-":
            e -= 1
        while at < len(spans) and spans[at][0] < e:
            reach = max(reach, spans[at][1])
            at += 1
        value = raw[s:e]
        if reach <= s and len(value) >= LEAST and (DIGIT.search(value) or len(FLIP.findall(value)) >= 3):
            out.append((s, e, False))
    return out


def shape_of(raw: bytes) -> int:
    """0 for hexadecimal digits only, else 1."""
    return 0 if ONLY_HEX.fullmatch(raw) else 1


FINDING = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("based", pa.bool_()), ("shape", pa.int32()), ("size", pa.int64()), ("window", pa.binary())])
ROWS = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(FINDING)), ("candidates", pa.list_(CANDIDATE))])
ROWS_DDL = "doc_id long, base array<struct<start: long, kind: int, end: long>>, candidates array<struct<start: long, end: long, based: boolean, shape: int, size: long, window: binary>>"


def find_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: texts to base findings and candidates, in code points."""
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for at in range(0, batch.num_rows, 256):
            base_rows, candidate_rows = [], []
            for i in range(at, min(at + 256, batch.num_rows)):
                part = data[bounds[i] : bounds[i + 1]]
                raw = part.tobytes()
                base = base_findings(raw)
                found = candidates(raw, base)
                place = lambda x: x
                if found and not raw.isascii():
                    before = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    place = lambda x: int(before[x])  # noqa: B023, E731
                base_rows.append([{"start": place(s), "kind": k, "end": place(e)} for s, k, e, _, _ in base])
                candidate_rows.append([{"start": place(s), "end": place(e), "based": based, "shape": shape_of(raw[s:e]), "size": e - s, "window": window(raw, s, e)} for s, e, based in found])
            yield pa.record_batch([ids.slice(at, len(base_rows)), pa.array(base_rows, ROWS.field("base").type), pa.array(candidate_rows, ROWS.field("candidates").type)], schema=ROWS)


# --- the network -------------------------------------------------------------------------------------------


class Model(NamedTuple):
    weights: dict  # embedding, filters, their bias, output, its bias
    scale: tuple  # slope and offset of the calibration
    thresholds: tuple  # for each shape
    held_out: dict  # recall, precision and number of findings of the fold not trained on


def coded(windows: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes of the bytes, the logarithm of the value's length)."""
    raw = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), WIDTH)
    return np.minimum(raw, CLASSES - 1).astype(np.int64), (np.log(np.maximum(sizes, 1)) - 3).astype(np.float32)[:, None]


REGIONS = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, WIDTH))


def forward(w: dict, codes: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(logits, what the gradient needs): embedding, convolution, and the largest of each region with the mean inside."""
    n = len(codes)
    x = np.zeros((n, WIDTH + REACH - 1, CHANNELS), np.float32)
    x[:, REACH // 2 : REACH // 2 + WIDTH] = w["embedding"][codes]
    columns = np.concatenate([x[:, k : k + WIDTH] for k in range(REACH)], axis=2)
    there = (codes > 0).astype(np.float32)[:, :, None]
    h = np.maximum(columns @ w["filters"] + w["bias"], 0) * there
    tops = [h[:, a:b].argmax(axis=1) + a for a, b in REGIONS]
    peaks = [np.take_along_axis(h, t[:, None], 1)[:, 0] for t in tops]
    inside = there[:, BEFORE : BEFORE + INSIDE].sum(axis=1)
    mean = h[:, BEFORE : BEFORE + INSIDE].sum(axis=1) / np.maximum(inside, 1)
    features = np.concatenate([*peaks, mean, extra], axis=1)
    return features @ w["out"] + w["offset"], (columns, there, h, tops, inside, features)


def gradient(w: dict, codes: np.ndarray, kept: tuple, g: np.ndarray) -> dict:
    """Derivatives by the weights, from those by the logits."""
    columns, there, h, tops, inside, features = kept
    back = g[:, None] * w["out"]
    dh = np.zeros_like(h)
    for k, t in enumerate(tops):
        np.put_along_axis(dh, t[:, None], np.take_along_axis(dh, t[:, None], 1) + back[:, None, k * FILTERS : (k + 1) * FILTERS], 1)
    dh[:, BEFORE : BEFORE + INSIDE] += (back[:, 3 * FILTERS : 4 * FILTERS] / np.maximum(inside, 1))[:, None]
    dh *= (h > 0) * there
    flat = dh.reshape(-1, FILTERS)
    dx = (dh @ w["filters"].T).reshape(len(codes), WIDTH, REACH, CHANNELS)
    at = np.zeros((len(codes), WIDTH + REACH - 1, CHANNELS), np.float32)
    for k in range(REACH):
        at[:, k : k + WIDTH] += dx[:, :, k]
    one = np.zeros((codes.size, CLASSES), np.float32)
    one[np.arange(codes.size), codes.ravel()] = 1
    embedding = one.T @ at[:, REACH // 2 : REACH // 2 + WIDTH].reshape(-1, CHANNELS)
    return {"embedding": embedding, "filters": columns.reshape(-1, REACH * CHANNELS).T @ flat, "bias": flat.sum(axis=0), "out": features.T @ g, "offset": g.sum(keepdims=True)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def begun(rng: np.random.Generator) -> tuple[dict, dict, dict]:
    """(weights, first and second moments of their gradients) before training."""
    draw = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
    w = {"embedding": draw(CLASSES, CHANNELS, by=2), "filters": draw(REACH * CHANNELS, FILTERS, by=REACH * CHANNELS), "bias": np.zeros(FILTERS, np.float32), "out": draw(4 * FILTERS + 1, by=4 * FILTERS), "offset": np.zeros(1, np.float32)}
    return w, *({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))


def one_pass(w: dict, first: dict, second: dict, step: int, codes: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> int:
    """A pass of Adam over the windows, which changes weights and moments; steps taken by then."""
    order = rng.permutation(len(y))
    for k in range(0, len(y), BATCH):
        own = order[k : k + BATCH]
        c = codes[own].copy()
        c[rng.random(len(own)) < 0.5, :BEFORE] = 0
        logits, kept = forward(w, c, extra[own])
        g = ((sigmoid(logits) - y[own]) * weight[own] / len(own)).astype(np.float32)
        step += 1
        for name, d in gradient(w, c, kept, g).items():
            first[name] = 0.9 * first[name] + 0.1 * d
            second[name] = 0.999 * second[name] + 0.001 * d * d
            w[name] = w[name] - (0.003 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return step


def weights_of(y: np.ndarray, up: int, down: int) -> np.ndarray:
    """Weights of windows among ``up`` findings and ``down`` others: both labels have the same in all."""
    return np.where(y == 1, 0.5 / max(1, up), 0.5 / max(1, down)).astype(np.float32) * (up + down)


def train(codes: np.ndarray, extra: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Weights after ``EPOCHS`` passes of Adam over the windows, both labels with equal weight in all."""
    rng = np.random.default_rng(seed)
    w, first, second = begun(rng)
    weight = weights_of(y, int((y == 1).sum()), int((y == 0).sum()))
    step = 0
    for _ in range(EPOCHS):
        step = one_pass(w, first, second, step, codes, extra, y, weight, rng)
    return w


def platt(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """Slope and offset by Newton steps; ``sums`` gives gradient and Hessian of the logistic loss at a slope and offset."""
    a = np.array([1.0, 0.0])
    for _ in range(50):
        g, h = sums(a)
        step = np.linalg.solve(h + 1e-3 * np.eye(2), g + 1e-3 * (a - [1.0, 0.0]))
        a = a - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a[0]), 1e-3), float(a[1])


def calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by logistic regression on logits, with targets drawn in by one row of each label (Platt)."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64)

    def sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(x @ a)
        return x.T @ (p - target), (x * (p * (1 - p))[:, None]).T @ x

    return platt(sums)


def threshold(p: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The middle between the largest threshold that keeps ``recall`` of the findings and the next other candidate below."""
    found = np.sort(p[y == 1])
    top = found[int(np.floor((1 - recall) * len(found)))]
    below = p[(y == 0) & (p < top)]
    return float((top + (below.max() if len(below) else 0.0)) / 2)


def held_out(windows: list[bytes]) -> np.ndarray:
    """The fifth of all windows, by their digest, that training does not see."""
    return np.array([hashlib.blake2b(x, digest_size=1).digest()[0] % 5 == 0 for x in windows], bool)


def fit(windows: list[bytes], sizes: np.ndarray, shapes: np.ndarray, y: np.ndarray, recall: float = RECALL) -> Model | None:
    """Trains on four of five windows (by their digest), calibrates and sets thresholds on the fifth; None without both labels in both."""
    fold = held_out(windows)
    if any(len(np.unique(y[part])) < 2 for part in (fold, ~fold)):
        return None
    codes, extra = coded(windows, sizes)
    w = train(codes[~fold], extra[~fold], y[~fold].astype(np.float32))
    logits = np.concatenate([forward(w, codes[fold][k : k + 1024], extra[fold][k : k + 1024])[0] for k in range(0, fold.sum(), 1024)])
    scale = calibrated(logits, y[fold])
    p = sigmoid(scale[0] * logits.astype(np.float64) + scale[1])
    yes, shape = y[fold], shapes[fold]
    whole = threshold(p, yes, recall)
    limits = tuple(threshold(p[own], yes[own], recall) if (own := shape == s).any() and yes[own].sum() >= 20 else whole for s in (0, 1))
    said = p >= np.array(limits)[shape]
    return Model(w, scale, limits, {"recall": float(said[yes == 1].mean()), "precision": float(yes[said].mean()), "findings": int(yes.sum())})


def probabilities(model: Model, windows: list[bytes], sizes: np.ndarray) -> np.ndarray:
    out = []
    for k in range(0, len(windows), 512):
        codes, extra = coded(windows[k : k + 512], sizes[k : k + 512])
        out.append(sigmoid(model.scale[0] * forward(model.weights, codes, extra)[0].astype(np.float64) + model.scale[1]))
    return np.concatenate(out) if out else np.zeros(0)


# --- jobs -----------------------------------------------------------------------------------------------------


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base findings, candidates) of each row, written once: texts are not read again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(find_task, ROWS_DDL), "candidates")


def labelled_windows(found: DataFrame) -> DataFrame:
    """(window, y, size, shape) of all distinct windows, written; one that is a base finding anywhere has ``y`` 1. Copies are summed up within tasks."""
    each = found.select(F.explode("candidates").alias("c")).select("c.window", "c.size", "c.shape", F.col("c.based").cast("int").alias("y"))
    return written(each.groupBy("window").agg(F.max("y").alias("y"), F.max("size").alias("size"), F.max("shape").alias("shape")), "windows")


def labelled_sample(found: DataFrame, size: int = SAMPLE) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(windows, sizes, shapes, labels) of at most ``size`` distinct windows, at most half of each label: those with the least digests.

    Only the sample is collected, to try out ``fit`` on the driver; ``scan`` learns from all windows.
    """
    each = labelled_windows(found)
    n = {r.y: r.n for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, 0.5 * size / max(1, n.get(1, 0)))).otherwise(min(1.0, 0.5 * size / max(1, n.get(0, 0))))
    rows = each.filter(F.pmod(F.xxhash64("window"), F.lit(1 << 40)) < share * (1 << 40)).collect()  # about ``size`` rows
    rows = sorted(rows, key=lambda r: hashlib.blake2b(bytes(r.window), digest_size=8).digest())
    rows = [r for y in (0, 1) for r in [r for r in rows if r.y == y][: size // 2]]
    return [bytes(r.window) for r in rows], np.array([r.size for r in rows], np.int64), np.array([r.shape for r in rows], np.int64), np.array([r.y for r in rows], np.int64)


# --- the fit over all windows ----------------------------------------------------------------------------------

PACKED_DDL = "shard int, held_out boolean, up long, down long, windows binary, sizes binary, shapes binary, labels binary"


def pack_task(table: pa.Table) -> pa.Table:
    """applyInArrow of one shard: a row of all windows to train on and one of those held out, in order."""
    table = table.sort_by("window")
    fold = held_out(table.column("window").to_pylist())
    rows = []
    for out in (False, True):
        own = table.filter(pa.array(fold == out))
        y = own.column("y").to_numpy().astype(np.int8)
        up = int(y.sum())
        packed = (b"".join(own.column("window").to_pylist()), own.column("size").to_numpy().tobytes(), own.column("shape").to_numpy().astype(np.int8).tobytes(), y.tobytes())
        rows.append((table.column("shard")[0].as_py(), out, up, len(y) - up, *packed))
    types = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in PACKED_DDL.split(", ")])


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, extra, shapes, labels) of a row of ``pack_task``."""
    raw = row["windows"]
    codes, extra = coded([raw[k : k + WIDTH] for k in range(0, len(raw), WIDTH)], np.frombuffer(row["sizes"], np.int64))
    return codes, extra, np.frombuffer(row["shapes"], np.int8), np.frombuffer(row["labels"], np.int8)


def flat(*parts: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for part in parts for v in part.values()]).astype(np.float64)


def unflat(numbers: np.ndarray, like: dict) -> list[dict]:
    """Parts of the shapes of ``like``, one after the other."""
    out, at = [], 0
    while at < len(numbers):
        out.append({})
        for name, v in like.items():
            out[-1][name] = numbers[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
    return out


def pass_task(state: tuple, step: int, up: int, down: int, turn: int):
    """mapInArrow: a pass over each shard from the same state, and the sum of what they come to, each times its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                codes, extra, _, y = unpacked(row)
                w, first, second = (dict(part) for part in state)
                one_pass(w, first, second, step, codes, extra, y.astype(np.float32), weights_of(y, up, down), np.random.default_rng([7, turn, row["shard"]]))
                # Roots of second moments, as these are too small for the unit.
                own = np.rint(flat(w, first, {k: np.sqrt(v) for k, v in second.items()}) * UNIT).astype(np.int64) * len(y)
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


def logit_task(w: dict):
    """mapInArrow: (label, shape, logit, an integer that is in order as the logit is) of the windows of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, extra, shapes, y = unpacked(row)
                for k in range(0, len(y), 1024):
                    z = forward(w, codes[k : k + 1024], extra[k : k + 1024])[0].astype(np.float32) + np.float32(0)  # no -0
                    bits = z.view(np.uint32)
                    place = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.int64)
                    yield pa.record_batch([pa.array(y[k : k + 1024].astype(np.int32)), pa.array(shapes[k : k + 1024].astype(np.int32)), pa.array(z.astype(np.float64)), pa.array(place)], names=["y", "shape", "z", "place"])

    return run


def ranked(rows: DataFrame, rank: int) -> float:
    """The logit with ``rank`` others below or beside it: counts by the upper 16 bits of the place, then by all of those in that range."""
    at = None
    for key in (F.shiftright("place", 16), F.col("place")):
        own = rows if at is None else rows.filter(F.shiftright("place", 16) == at)
        counts = sorted((r.k, r.n) for r in own.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect())  # at most 65,536
        for at, n in counts:
            if rank < n:
                break
            rank -= n
    bits = at ^ (1 << 31) if at >> 31 else ~at & 0xFFFFFFFF
    return float(np.array([bits], np.uint32).view(np.float32)[0])


def fit_all(found: DataFrame, recall: float = RECALL) -> Model | None:
    """``fit`` on all distinct windows of ``found``, in Spark; None without both labels in both folds.

    Windows are dealt by a hash into shards of about ``SHARD``, each packed into a row once. In a pass each shard goes on from the
    same weights and moments, and their mean over all windows is where the next pass begins; what a task returns is
    as large as the weights. Sums of calibration, and the places of thresholds among all findings held out, are counted in Spark.
    """
    each = labelled_windows(found)
    shards = max(1, -(-each.count() // SHARD))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("window", F.lit(1)), F.lit(shards)).cast("int")).repartition(shards, "shard")
    packed = written(dealt.groupBy("shard").applyInArrow(pack_task, PACKED_DDL), "packed-windows")
    n = {r.held_out: (r.up, r.down) for r in packed.groupBy("held_out").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).collect()}
    if not all(n.get(out) and min(n[out]) for out in (False, True)):
        return None

    state, step, (up, down) = begun(np.random.default_rng(7)), 0, n[False]
    training = packed.filter("not held_out and up + down > 0")
    for turn in range(EPOCHS):
        rows = training.mapInArrow(pass_task(state, step, up, down, turn), "total binary").collect()
        mean = sum(np.frombuffer(r.total, np.int64) for r in rows) / (UNIT * (up + down))
        w, first, root = unflat(mean, state[0])
        state = (w, first, {k: v * v for k, v in root.items()})
        step += -(-(up + down) // (shards * BATCH))

    held = written(packed.filter("held_out").mapInArrow(logit_task(w), "y int, shape int, z double, place long"), "held-out")
    up, down = n[True]
    target = F.when(F.col("y") == 1, (up + 1) / (up + 2)).otherwise(1 / (down + 2))

    def sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = chance(a)
        r = held.select("z", (p - target).alias("g"), (p * (1 - p)).alias("h")).selectExpr("sum(g * z) gz", "sum(g) g", "sum(h * z * z) hzz", "sum(h * z) hz", "sum(h) h").first()
        return np.array([r.gz, r.g]), np.array([[r.hzz, r.hz], [r.hz, r.h]])

    chance = lambda a: 0.5 * (1 + F.tanh(0.5 * (float(a[0]) * F.col("z") + float(a[1]))))
    scale = platt(sums)

    def limit(rows: DataFrame, findings: int) -> float:
        top = ranked(rows.filter("y = 1"), int(np.floor((1 - recall) * findings)))
        below = rows.filter((F.col("y") == 0) & (F.col("z") < top)).agg(F.max("z")).first()[0]
        p = [float(sigmoid(scale[0] * z + scale[1])) if z is not None else 0.0 for z in (top, below)]
        return (p[0] + p[1]) / 2

    findings = {r["shape"]: r["count"] for r in held.filter("y = 1").groupBy("shape").count().collect()}
    whole = limit(held, up)
    limits = tuple(limit(held.filter(F.col("shape") == s), findings[s]) if findings.get(s, 0) >= 20 else whole for s in (0, 1))
    said = chance(scale) >= F.when(F.col("shape") == 0, limits[0]).otherwise(limits[1])
    r = held.filter(said).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("up")).first()
    return Model(w, scale, limits, {"recall": r.up / up, "precision": r.up / max(1, r.n), "findings": up})


SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
SPANS_DDL = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"


def score_task(model: Model | None):
    """mapInArrow: findings of the rules and of the network, by start and kind; a base finding has the score 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                rows = [[(f["start"], f["kind"], f["end"], 1.0) for f in base] for base in own.column("base").to_pylist()]
                if model:
                    some = [(k, c) for k, found in enumerate(own.column("candidates").to_pylist()) for c in found if not c["based"]]
                    p = probabilities(model, [c["window"] for _, c in some], np.array([c["size"] for _, c in some], np.int64))
                    for (k, c), x in zip(some, p.tolist(), strict=True):
                        if x >= model.thresholds[c["shape"]]:
                            rows[k].append((c["start"], len(KINDS) - 1, c["end"], x))
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in sorted(row)] for row in rows]
                yield pa.record_batch([own.column("doc_id"), pa.array(spans, SPANS.field("spans").type)], schema=SPANS)

    return run


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans of kind, start, end and score) of each row's whole text, in code points, ends exclusive.

    Without ``model`` one is fitted on all of the rules' own findings in ``docs``; where these lack findings or other candidates,
    the rules stand alone. A null text is empty. Repeated rows and null ids give a row each; columns other than
    ``doc_id`` and ``text`` are not read. Nothing but distinct windows, and numbers that sum them up, is shuffled.
    """
    found = find(docs)
    return found.mapInArrow(score_task(model or fit_all(found)), SPANS_DDL)


def digests(scanned: DataFrame) -> DataFrame:
    """Numbers of base findings, their digest, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), count(KINDS[-1]))
