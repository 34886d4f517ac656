"""Hard negatives against all scores in plain Python, and against SQL."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsmith.llm import negatives
from rowsmith.llm.queries import op11_hard_negatives
from tests.conftest import assert_same

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, is_anchor, positives=5, k=5, low=80, high=100):
    v = {}
    for vec_id, label, x in rows:
        if vec_id is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v[vec_id, label, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = True
    out = []
    for a_id, a_label, a in v:
        if not is_anchor(a_id):
            continue
        by = defaultdict(list)
        for b_id, label, b in v:
            if len(a) == len(b) and not (label == a_label and b_id == a_id):
                by[label == a_label].append((-sum(x * y for x, y in zip(a, b, strict=True)), b_id))
        for s, p_id in sorted(by[True])[:positives]:
            fit = [(n, i) for n, i in sorted(by[False]) if low * -s <= 100 * -n <= high * -s]
            out += [(a_id, p_id, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit[:k])]
    return sorted(out)


def made(rng, n, dims, clusters=4, scale=1.0):
    centres = rng.normal(size=(clusters, dims))
    of = rng.integers(0, clusters, n)
    x = (centres[of] + 0.4 * rng.normal(size=(n, dims))) * scale
    return [(i, int(rng.integers(0, 3)), x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed, dims, block, pack, scale", [(1, 20, 16, 4, 0.1), (2, 7, 5, 2, 1.0), (3, 33, 64, 100, 40.0)])
def test_equals_all_scores(spark, monkeypatch, seed, dims, block, pack, scale):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "PACK", pack)
    rng = np.random.default_rng(seed)
    rows = made(rng, 220, dims, scale=scale)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("group", F.lit("x")).withColumn("pack", F.lit(1))
    got = negatives.mine(df, F.col("vec_id") % 9 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 9 == 0)
    got = negatives.mine(df, F.col("vec_id") % 9 == 0, positives=2, negatives=3, low=33, high=97)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 9 == 0, 2, 3, 33, 97)


def test_odd_rows(spark):
    """Ties, repeats, nulls, other dimensions, values beyond exact doubles, repeated ids."""
    one, two = [0.5, 0.25, 1.0], [0.5, 0.25, 0.9]
    rows = [(i, i % 2, one) for i in range(30)] + [(i, 1, two) for i in range(30, 60)] + [(0, 0, one), (0, 1, two)]
    rows += [(60, None, one), (70, 0, None), (80, 0, []), (90, 0, [1.0, None, 1.0]), (100, 0, [1.0, float("nan"), 1.0]), (110, 0, [1.0, float("inf"), 0.0]), (None, 0, one)]
    rows += [(120, 0, [1.0, 2.0]), (121, 0, [1.0, 2.0]), (122, 1, [1.0, 1.9]), (130, 0, [-1.0, 0.0, 0.0]), (140, 7, [1.0] * 5)]
    rows += [(150, 5, [3e5, 1.0, -2e5, 1.0]), (151, 5, [2.5e5, 1.0, -2e5, 0.0]), (152, 6, [2.4e5, 0.0, -2e5, 7.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0).collect())) == plain(rows, lambda i: i % 10 == 0)
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(df, F.col("vec_id") == 999).collect() == []


def test_bounds_hold_and_prune():
    """Scores of the candidates left are exact, none that the bounds must keep is gone, and most leave before the last dimension."""
    rng = np.random.default_rng(5)
    dims = 64
    x = (rng.normal(size=(500, dims)) * np.linspace(200, 1, dims)).astype(np.int64)
    row = {"ids": np.arange(500).tobytes(), "labels": ["a"] * 500, "wide": 2, "columns": [c.astype(np.int16).tobytes() for c in x.T]}
    a = (rng.normal(size=dims) * np.linspace(200, 1, dims)).astype(np.int64)
    exact, seen = x @ a, []

    def keep(least, most):
        seen.append(len(least))
        return most >= negatives.kth(least, 5)

    at, score = negatives.scan(a, negatives.Block(row, int(np.abs(a).max())), np.arange(500), keep)
    assert (score == exact[at]).all()
    assert set(np.argsort(-exact, kind="stable")[:5].tolist()) <= set(at.tolist())
    assert seen[-1] < 100 and len(seen) == dims // negatives.STEP


def test_query_equals_sql(spark, data, duck):
    assert_same(op11_hard_negatives(spark, data), duck, negatives.SQL)
