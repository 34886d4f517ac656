import math
import zlib
from collections import Counter

import pytest

from rowsmith.llm import lm
from tests.llm.helpers import DOCS, LOWER, documents, empty

SPACE = " \t\n\v\f\r"


def tokens(text):
    out, word = [], ""
    for c in (text or "").translate(LOWER):
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else []) + [None]


def discounts(counts):
    n = [sum(v == k for v in counts) for k in (1, 2, 3, 4)]
    if not min(n):
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *(min(max(x, 0.01), k) for k, x in enumerate(d[1:], 1))]


def brute(rows, order=lm.ORDER):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    grams = lambda t: zip(*([*["<s>"] * k, *t][: len(t)] for k in range(order - 1, -1, -1)), strict=True)
    level, raw = {order: Counter()}, Counter()
    for i, text, *_ in rows:
        if not held(i):
            t = tokens(text)
            raw.update(t)
            level[order].update(grams(t))
    for k in range(order, 1, -1):
        level[k - 1] = Counter()
        for g, c in level[k].items():
            level[k - 1][g[1:]] += c if k > 2 and g[1] == "<s>" else 1
    cut = {k: discounts(list(c.values())) for k, c in level.items()}
    follow = {}
    for k in range(2, order + 1):
        for g, c in level[k].items():
            follow.setdefault(g[:-1], []).append(c)
    n, kinds, total = sum(raw.values()), len(raw), sum(level[1].values())
    gamma = sum(cut[1][min(c, 3)] for c in level[1].values()) / total if total else 1.0

    def p(*g):
        c = level[len(g)][g]
        if len(g) == 1:
            return (c - cut[1][min(c, 3)]) / max(total, 1) + gamma / (kinds + 1)
        own = follow.get(g[:-1])
        if not own:
            return p(*g[1:])
        d = cut[len(g)]
        return (c - d[min(c, 3)]) / sum(own) + sum(d[min(x, 3)] for x in own) / sum(own) * p(*g[1:])

    out = []
    for i, text, *_ in rows:
        t = tokens(text)
        base = sum(math.log10((raw[v] + 1) / (n + kinds + 1)) for v in t)
        score = sum(math.log10(p(*g)) for g in grams(t))
        out.append((i, held(i), len(t), sum(raw[v] > 0 for v in t), n, base, score))
    return out, p, [*raw]


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9)
        assert a[7] == pytest.approx(10 ** (-b[6] / b[2]), rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_brute_force(spark, data, order):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want, *_ = brute(rows, order)
    compare(lm.score_held_out(spark.read.parquet(f"{data}/documents.parquet"), 3, order).collect(), want)


def test_edge_cases_and_frequent_pairs(spark):
    rows = [*DOCS, *((100 + i, "on and on " * 400, None) for i in range(3))]
    compare(lm.score_held_out(documents(spark, rows)).collect(), brute(rows)[0])


def test_probabilities_sum_to_one(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    _, p, known = brute(rows, 3)
    for context in (("<s>", "<s>"), ("<s>", known[0]), (known[5], known[6]), ("never", "seen"), (known[5],)):
        assert sum(p(*context, v) for v in known) + p(*context, "never seen") == pytest.approx(1)


def test_model_beats_base_on_held_out_text(spark):
    df = lm.score_held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    r = df.selectExpr("sum(score) s", "sum(base_score) b").head()
    assert r.s > r.b


def test_empty_table(spark):
    assert lm.score_held_out(empty(spark)).count() == 0
    model = lm.fit(empty(spark))
    got = lm.score(documents(spark).selectExpr("doc_id", "text", "false as held_out"), model).collect()
    assert all(r.score == 0.0 and r.n_known == 0 for r in got)
