"""Ordered passes over rows that share keys, against plain loops; long chains in a bounded number of rounds."""

import random

import pytest

from rowsmith.operators import dedupe, graph, resolve


def frame(spark, schema, rows):
    return spark.createDataFrame(list(rows), schema).repartition(3)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200 + i, 201 + i) for i in range(300)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(frame(spark, "a long, b long", edges)).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


def one_pass(rows):
    seen, kept = set(), []
    for i, *keys in sorted(rows):
        own = {(k, v) for k, v in enumerate(keys) if v is not None}
        if not own & seen:
            seen |= own
            kept.append(i)
    return kept


@pytest.mark.parametrize("most", [60, 10_000])
def test_one_pass_in_turns(spark, most):
    """Random keys, a chain that rounds of local decisions settle two rows at a time, and a key that a third of all rows have."""
    rng = random.Random(most)
    rows = [(i, rng.choice([None, *"abcdefghijklm"]), rng.choice([None, *range(30)])) for i in range(90)]
    rows += [(500 + i, f"c{i // 2}", 1000 + (i + 1) // 2) for i in range(60)]
    rows += [(700 + i, "hot", 2000 + i // 2) for i in range(40)]
    got = dedupe.in_order(frame(spark, "id long, a string, b long", rows), ["a", "b"], "id", rounds=1, most=most)
    assert sorted(r.id for r in got.collect()) == one_pass(rows)


def test_chain_of_100_000_rows_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    tables = []
    plain = dedupe.written
    monkeypatch.setattr(dedupe, "written", lambda df, name: tables.append(name) or plain(df, name))
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or plain(df, name))
    rows = spark.range(n).selectExpr("id", "concat('c', id div 2) as a", "(id + 1) div 2 as b")
    got = dedupe.in_order(rows, ["a", "b"], "id")
    assert got.count() == n // 2 and got.filter("id % 2 = 1").isEmpty()
    assert len(tables) < 100  # by rounds of local decisions alone it would be some 50,000


def upsert(base, new):
    records = [[f"old{i}", a or None, b or None] for i, a, b in sorted(base)]
    out = []
    for pos, *values in sorted(new):
        values = [v if v and v.strip() else None for v in values]
        hit = next((r for k in (0, 1) if values[k] for r in records if r[k + 1] == values[k]), None)
        if hit is None:
            hit = [f"new{pos}", *values]
            records.append(hit)
        else:
            for k, v in enumerate(values):
                if v and (not hit[k + 1] or len(v) > len(hit[k + 1])):
                    hit[k + 1] = v
        out.append((pos, hit[0]))
    return sorted(out)


@pytest.mark.parametrize("seed, most", [(1, 10_000), (2, 35)])
def test_upsert_in_order(spark, seed, most):
    """Repeats in the base and in the batch, keys that grow, null and blank keys, one phone of a third of all rows."""
    rng = random.Random(seed)
    mail = lambda: rng.choice([None, " ", *(f"{c}@{'x' * k}.com" for c in "abcdefg" for k in (1, 2, 3))])
    phone = lambda: rng.choice([None, "", "0", "0", "0", *(str(10**k) for k in range(1, 7)), *(f"{k}{k}" for k in range(20))])
    base = [(i, m if (m := mail()) != " " else None, phone() or None) for i in range(40)]
    new = [(1000 + 3 * i, mail(), phone()) for i in range(90)]
    got = resolve.assign(frame(spark, "id long, first string, second string", base), frame(spark, "pos long, first string, second string", new), most)
    assert sorted(map(tuple, got.collect())) == upsert(base, new)


def test_upsert_of_nothing(spark):
    none = spark.createDataFrame([], "id long, first string, second string")
    new = frame(spark, "pos long, first string, second string", [(1, None, None), (2, None, " "), (3, "a", None), (4, "a", "b")])
    assert sorted(map(tuple, resolve.assign(none, new).collect())) == [(1, "new1"), (2, "new2"), (3, "new3"), (4, "new3")]
    assert resolve.assign(none, none.withColumnRenamed("id", "pos")).collect() == []
