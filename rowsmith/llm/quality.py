"""Quality grades by ordinal regression: a cumulative-link model over hashed features of the text.

A text's features are its distinct words (A-Z in lower case) and levels of its shape: how large a share of it each
punctuation mark, capitals, digits, repeated words and the most frequent word are. All are hashed to 2**30 places. One
weight for each place gives a score s, and ordered thresholds give P(grade <= k) = logistic(threshold_k - s), so that
all grades share the weights. The expected grade ranks documents; the probability of the top grade selects them.

The model is fitted on the driver to a sample of at most ``sample`` labelled rows with at most ``most_places`` features,
the first by a hash of id and text, and holds weights only for places that at least ``least_docs`` rows of the sample have:
its size is bounded whatever the input. Tasks send features of the sample, not its texts. Everything else runs over all rows, and scoring shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import ALNUM, U64, mix, released, row_key, slices, text_bytes, tidy, words_of, written
from rowsmith.llm.minhash import weighted

#: Labelled rows that the fit may use at most, and rows of it that must have a feature.
SAMPLE, LEAST_DOCS = 16_000, 3
#: Features that the rows of the fit may have together.
MOST_PLACES = 16_000_000
PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def _level(share: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(share * 1000 + 1)).astype(np.int64)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each feature of each row; rows in order."""
    rows = len(bounds) - 1
    words, n = words_of(data, bounds, ALNUM)
    row, h, count = weighted(np.repeat(np.arange(rows), n), words, rows)
    distinct = np.bincount(row, minlength=rows)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row, count)
    of_bytes = np.stack([np.bincount(data[i:j], minlength=256) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]) if rows else np.zeros((0, 256), np.int64)
    size = np.maximum(np.diff(bounds), 1)[:, None]
    capitals, digits = of_bytes[:, 65:91].sum(axis=1, keepdims=True), of_bytes[:, 48:58].sum(axis=1, keepdims=True)
    shares = np.concatenate([of_bytes[:, PUNCTUATION], capitals, digits], axis=1) / size
    words_n = np.maximum(n, 1)
    levels = np.concatenate([_level(shares), np.floor(10 * distinct / words_n).astype(np.int64)[:, None], np.floor(10 * most / words_n).astype(np.int64)[:, None], np.minimum(n, 1)[:, None]], axis=1)
    which = np.arange(levels.shape[1], dtype=U64)
    shape = mix(which[None, :] * U64(1 << 32) + levels.astype(U64) + U64(0xC0FFEE << 20))
    return np.concatenate([row, np.repeat(np.arange(rows), shape.shape[1])]), np.concatenate([h, shape.reshape(-1)]) >> U64(34)


def feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        for i, j in slices(bounds):
            row, place = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(j - i + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(place[order].astype(np.int64)))
            yield pa.record_batch([batch.column("rank").slice(i, j - i), batch.column("grade").slice(i, j - i), lists], names=["rank", "grade", "places"])


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def loss_and_gradient(theta: np.ndarray, doc: np.ndarray, column: np.ndarray, y: np.ndarray, places: int, grades: int, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with a penalty on weights, and its gradient.

    ``theta`` holds the weights of ``places`` features, the first threshold and the logarithms of the gaps to the next,
    so that thresholds stay in order; ``doc`` and ``column`` name the features of each row of ``y``.
    """
    weights, cuts = theta[:places], thresholds_of(theta[places:])
    s = np.bincount(doc, weights[column], len(y))
    below = np.concatenate([np.zeros((len(y), 1)), logistic(cuts[None, :] - s[:, None]), np.ones((len(y), 1))], axis=1)
    slope = below * (1 - below)
    each = np.arange(len(y))
    p = np.maximum(below[each, y + 1] - below[each, y], 1e-12)
    of_s = (slope[each, y + 1] - slope[each, y]) / p / len(y)
    of_cut = np.zeros((len(y), grades + 1))
    of_cut[each, y + 1] -= slope[each, y + 1] / p / len(y)
    of_cut[each, y] += slope[each, y] / p / len(y)
    of_gap = of_cut[:, 1:-1].sum(axis=0)[::-1].cumsum()[::-1]
    gradient = np.concatenate([np.bincount(column, of_s[doc], places) + decay * weights, of_gap[:1], of_gap[1:] * np.exp(theta[places:][1:])])
    return float(-np.log(p).mean() + decay / 2 * (weights**2).sum()), gradient


def thresholds_of(theta: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def fit(labelled: DataFrame, grades: int = 3, sample: int = SAMPLE, least_docs: int = LEAST_DOCS, steps: int = 200, decay: float = 2e-4, most_places: int = MOST_PLACES) -> dict:
    """Weights and thresholds from ``labelled`` (text, grade from 0 to ``grades`` - 1, and doc_id, where there is one).

    The fit sees the first ``sample`` rows by a hash of id and text and, of these, the first whose features are at most
    ``most_places`` together; of rows repeated with the same id and text all count. Rows with a null grade are left
    out, null texts are empty. With no rows, every text gets the same, highest probability of the top grade.
    """
    doc_id = F.col("doc_id") if "doc_id" in labelled.columns else F.lit(None)
    rows = labelled.filter("grade is not null").select(row_key(doc_id, F.col("text")).alias("rank"), F.col("text").cast("string").alias("text"), F.col("grade").cast("int").alias("grade"))
    chosen = written(rows.mapInArrow(tidy(feature_task), "rank binary, grade int, places array<long>"), "labelled")
    sizes = chosen.select("rank", "grade", F.size("places").alias("n")).orderBy("rank", "grade").limit(sample).collect()  # bounded by sample
    total = np.cumsum([r.n for r in sizes])
    inside = int(np.searchsorted(total, most_places, side="right"))
    if inside:
        # Rows of one rank have the same features: of the last rank as many as there is room for, those before it all.
        last = bytes(sizes[inside - 1].rank)
        room = sum(bytes(r.rank) == last for r in sizes[:inside])
        ends = chosen.filter(F.col("rank") == F.lit(last)).orderBy("grade").limit(room)
        held = chosen.filter(F.col("rank") < F.lit(last)).union(ends).toArrow()  # bounded by sample and most_places
    else:
        held = chosen.limit(0).toArrow()
    del sizes
    held = held.sort_by([("rank", "ascending"), ("grade", "ascending")]).select(["grade", "places"])
    y = held.column("grade").to_numpy().astype(np.int64)
    lists = held.column("places").combine_chunks() if len(y) else pa.array([], pa.list_(pa.int64()))
    del held
    place = lists.flatten().to_numpy().astype(np.int32)  # places are below 2**30
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy())) if len(y) else place
    del lists
    known, docs_with = np.unique(place, return_counts=True)
    known = known[docs_with >= least_docs]
    # By runs of features, so that what is held besides them stays small.
    column = np.zeros(len(place), np.int32)
    often = np.zeros(len(place), bool)
    for i in range(0, len(place) if len(known) else 0, 1 << 20):
        part = slice(i, i + (1 << 20))
        column[part] = np.minimum(np.searchsorted(known, place[part]), len(known) - 1)
        often[part] = known[column[part]] == place[part]
    del place
    doc, column, known = doc[often], column[often], known.astype(np.int64)
    released()
    if not len(y):
        return {"known": known, "weights": np.zeros(0), "thresholds": np.full(grades - 1, -50.0) + np.arange(grades - 1), "grades": grades}
    share = np.array([np.clip((y <= k).mean(), 0.01, 0.99) for k in range(grades - 1)])
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(len(known)), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, gradient = loss_and_gradient(theta, doc, column, y, len(known), grades, decay)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    del doc, column, often, m, v
    released()
    return {"known": known, "weights": theta[: len(known)].copy(), "thresholds": thresholds_of(theta[len(known) :]), "grades": grades}


def predict(model: dict, row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
    """Probability of each grade, a row for each text."""
    s = np.zeros(rows)
    if len(model["known"]):
        at = np.minimum(np.searchsorted(model["known"], place.astype(np.int64)), len(model["known"]) - 1)
        hit = model["known"][at] == place.astype(np.int64)
        s = np.bincount(row[hit], model["weights"][at[hit]], rows)
    below = np.concatenate([np.zeros((rows, 1)), logistic(model["thresholds"][None, :] - s[:, None]), np.ones((rows, 1))], axis=1)
    return np.diff(below, axis=1)


def score_task(model: dict, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = text_bytes(batch.column("text"))
            found = []
            for i, j in slices(bounds):
                row, place = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                found.append(predict(model, row, place, j - i))
            p = np.concatenate(found)
            kept = [batch.column(k) for k in range(batch.num_columns)]
            names = list(batch.schema.names)
            top = p[:, -1]
            yield pa.record_batch([*kept, pa.array(p @ np.arange(p.shape[1])), pa.array(top), pa.array(top >= least)], names=[*names, "expected_grade", "p_top_grade", "kept"])

    return run


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for low quality, 2 for good; null where either label is."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic != 0, 0).when(quality == 0, 1).otherwise(2)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of the documents with the first ``sample`` labels by a hash of the id.

    A document labelled more than once, or repeated, comes once for each; without an id or a whole label it has none.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade is not null and doc_id is not null")
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")


def score(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """Expected grade, probability of the top grade, and whether that is at least ``least``, for each row of ``docs``.

    Null and empty texts have shape features only. Rows repeated and null ids are scored each. Columns besides
    ``doc_id`` and ``text`` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(score_task(model, least)), "doc_id long, text string, expected_grade double, p_top_grade double, kept boolean").drop("text")


def select(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns, which may have any names.

    Null and empty texts are judged by their shape; repeated rows stay or go together; an empty table stays empty.
    """
    task = score_task(model, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = pa.record_batch([batch.column(batch.schema.names.index("text"))], names=["text"])
                for scored in task(iter([texts])):
                    yield batch.filter(scored.column("kept"))

    return docs.mapInArrow(tidy(run), docs.schema)
