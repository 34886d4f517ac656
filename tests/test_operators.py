import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.operators import dedupe, merge, ranking, reshape, rules, similarity
from rowsmith.sources import project, readers
from rowsmith.streaming import resume


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_enrich_keeps_rows_and_prefers(spark):
    left = frame(spark, "k int, v string", (1, "a"), (2, None), (None, "z"))
    right = frame(spark, "k int, v string, w int", (1, "b", 5), (1, "c", 6), (3, "x", 7), (None, "n", 8))
    assert rows(merge.enrich(left, right, "k", dedupe_right=True)) == [(1, "c", 6), (2, None, None), (None, "z", None)]
    assert rows(merge.enrich(left, right, "k", "old", True)) == [(1, "a", 6), (2, None, None), (None, "z", None)]
    assert merge.enrich(left, right, "k").count() == 4
    with pytest.raises(ValueError):
        merge.enrich(left, right, "k", "both")


def test_merge_all_takes_the_last_value(spark):
    a, b = frame(spark, "k int, v string", (1, "a"), (2, "b")), frame(spark, "k int, v string, w int", (2, None, 9), (3, "c", None), (None, "q", 1))
    assert rows(merge.merge_all([a, b], "k")) == [(1, "a", None), (2, "b", 9), (3, "c", None)]


def test_upsert_and_waterfall(spark):
    a, b = frame(spark, "k int, t string", (1, "long text"), (2, None)), frame(spark, "k int, t string", (1, "short"), (2, "x"), (3, "y"))
    assert rows(merge.upsert(a, b, "k", ["t"])) == [(1, "long text"), (2, "x"), (3, "y")]
    got = merge.waterfall(frame(spark, "k int", (1,), (2,), (3,)), [("p", frame(spark, "k int, v string", (1, "a"), (2, None))), ("q", frame(spark, "k int, v string", (1, "z"), (2, "b")))], "k", "v")
    assert rows(got) == [(1, "a", "p"), (2, "b", "q"), (3, None, None)]


def test_lookup_fills_only_nulls(spark):
    df = frame(spark, "k int, v string", (1, None), (2, "own"), (3, None))
    table = frame(spark, "id int, name string, at int", (1, "old", 1), (1, "new", 2), (2, "x", 1))
    got = merge.lookup(df.withColumnRenamed("k", "id"), table, "id", "name", "v", ["at"])
    assert rows(got) == [(1, "new"), (2, "own"), (3, None)]


def test_dedupe_orders_nulls_last_and_counts_keys(spark):
    df = frame(spark, "k string, o int, v string", ("a", None, "n"), ("a", 2, "two"), ("a", 1, "one"), (None, 1, "x"), (None, 2, "y"))
    assert rows(dedupe.keep_first(df, ["k"], ["o"])) == [("a", 1, "one"), (None, 1, "x")]
    assert rows(dedupe.keep_last(df, ["k"], ["o"])) == [("a", 2, "two"), (None, 2, "y")]
    assert rows(dedupe.keep_first(df, ["k"], ["o"], drop_null_keys=True)) == [("a", 1, "one")]
    assert dedupe.keep_first(df.limit(0), ["k"], ["o"]).count() == 0


def test_first_nonnull_is_for_each_column(spark):
    df = frame(spark, "k int, p int, a string, b string", (1, 9, None, "b9"), (1, 5, "a5", "b5"), (None, 1, "x", "y"))
    assert rows(dedupe.first_nonnull(df, "k", ["a", "b"], [-F.col("p")])) == [(1, "a5", "b9")]


def test_split_buckets_cover_the_input(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    bucket = rules.first_match([(F.col("o_orderstatus") == "F", "a"), (F.col("o_totalprice") > 1e5, "b")], "c")
    assert orders.groupBy(bucket).count().agg(F.sum("count")).head()[0] == orders.count()


def test_filters_skip_unknown_columns(spark):
    df = frame(spark, "a int, b string", (1, "x"), (5, "x"), (5, None))
    assert rows(rules.apply_filters(df, {"a": ">=2", "b": "x", "c": ">9"})) == [(5, "x")]
    assert rules.apply_filters(df, {}).count() == 3


@pytest.mark.parametrize(("n", "points"), [(50, 20), (20, 20), (19, 18), (14, 15), (9, 10), (4, 0), (None, 0)])
def test_employee_points(spark, n, points):
    assert frame(spark, "n int", (n,)).select(rules.employee_points(F.col("n"))).head()[0] == points


@pytest.mark.parametrize(("n", "band"), [(None, "Unknown"), (0, "Unknown"), (10, "Micro"), (50, "Small"), (51, "Enterprise")])
def test_size_band(spark, n, band):
    assert frame(spark, "n int", (n,)).select(rules.size_band(F.col("n"))).head()[0] == band


def test_explode_and_halves(spark):
    df = frame(spark, "k int, c string", (1, "a, b;c"), (2, ""), (3, None))
    assert rows(reshape.explode_list(df, "c", "p").select("k", "p")) == [(1, "a"), (1, "b"), (1, "c")]
    assert rows(reshape.explode_list(df, "c", "p", keep_empty=True).select("k", "p"))[-2:] == [(2, None), (3, None)]
    odd = frame(spark, "g int, k int", *((1, i) for i in range(5)))
    assert [r.half for r in ranking.halves(odd, "g", ["k"]).orderBy("k").collect()] == ["first"] * 2 + ["second"] * 3


def test_csv_header_and_fields(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Business Name, E-Mail ,Web Site\n"A, ""x""\nline",a@b.com,a.com\n', encoding="utf-8")
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["business_name", "e-mail", "web_site"]
    assert df.head()[0] == 'A, "x"\nline'
    assert readers.resolve(df.columns) == {"email": "e-mail", "name": "business_name"}
    assert readers.read_csv(spark, str(path), columns=["e-mail", "none"]).columns == ["e-mail"]


def test_places_fall_back_to_unfiltered(spark, tmp_path):
    place = lambda i: {"place_id": str(i), "name": "n", "phone": "" if i else "1", "rating": 4.5}
    doc = {"metadata": {"state": "TX", "niche": "hvac"}, "results_by_city": [{"city": "A", "filtered_places": [place(0)], "places": [place(0), place(9)]}, {"city": "B", "filtered_places": [], "places": [place(1)]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    got = readers.read_places(spark, str(tmp_path / "p.json")).select("place_id", "state", "city", "has_phone", "has_contact")
    assert rows(got) == [("0", "TX", "A", True, True), ("1", "TX", "B", False, False)]


def test_project_table_saves_over_itself(spark, tmp_path):
    table = project.ProjectTable(spark, str(tmp_path), "p")
    assert not table.exists()
    table.save(frame(spark, "k int, v string", (1, "a"), (2, "b")))
    table.add_columns(frame(spark, "k int, v string, w int", (2, "c", 7), (3, "d", 8)), "k")
    assert rows(table.load()) == [(1, "a", None), (2, "c", 7)]
    table.add_columns(frame(spark, "k int, v string, w int", (2, "c", 7), (3, "d", 8)), "k")
    assert rows(table.load()) == [(1, "a", None), (2, "c", 7)]
    table.export(str(tmp_path / "out"), {"w": ">=7"}, ["k"])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == [("2",)]
    assert {r["column"]: r.n_null for r in table.profile().collect()} == {"k": 0, "v": 0, "w": 1}


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    run = lambda: resume.process_new_files(spark, src, schema, lambda d: d.withColumn("v", F.col("k") * 2), out, mark)
    spark.range(5).toDF("k").write.mode("append").parquet(src)
    run()
    run()
    spark.range(5, 8).toDF("k").write.mode("append").parquet(src)
    run()
    assert rows(spark.read.parquet(out)) == [(i, 2 * i) for i in range(8)]
    seen = []
    resume.upsert_stream(spark, src, schema, str(tmp_path / "mark2"), lambda b: seen.append(b.count()))
    assert sum(seen) == 8


def test_each_query_has_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERIES", 2)
    monkeypatch.setattr(similarity, "VECTORS", 3)
    vectors = [(i, [float(i % 7), float(i % 5 + 1), 1.0]) for i in range(20)]
    df = frame(spark, "vec_id long, embedding array<float>", *vectors, (50, [0.0, 0.0, 0.0]), (51, None), (52, [1.0]))
    got = [r[:3] for r in rows(similarity.most_similar_each(df, df.filter("vec_id % 4 = 0"), 3).select("query_id", "rn", "vec_id"))]
    size = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / size(a) / size(b), 6)
    want = [(q, n + 1, i) for q, a in vectors if q % 4 == 0 for n, (_, i) in enumerate(sorted((-cos(a, b), i) for i, b in vectors)[:3])]
    assert got == sorted([*want, (52, 1, 52)], key=str)


def test_one_pass_over_several_keys(spark):
    import random

    rng = random.Random(6)
    data = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(12)]), rng.choice([None, "x", "y", "z", "w"])) for i in range(40)]
    data += [(100 + i, f"c{i // 2}", i + 1 - (i + 1) % 2 + 50, None) for i in range(30)]
    seen, want = set(), []
    for i, *keys in data:
        own = {(k, v) for k, v in enumerate(keys) if v is not None}
        if not own & seen:
            seen |= own
            want.append(i)
    got = dedupe.in_order(frame(spark, "id int, a string, b int, c string", *data).repartition(3), ["a", "b", "c"], "id")
    assert sorted(r.id for r in got.collect()) == want


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_pruned_search_finds_the_same(spark, monkeypatch, spread):
    """Clusters that pruning parts, and a cloud that it can't; ties, repeats, zero, null and other lengths among them."""
    import random

    monkeypatch.setattr(similarity, "PIVOTS", 12)
    monkeypatch.setattr(similarity, "QUERIES", 5)
    monkeypatch.setattr(similarity, "VECTORS", 17)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    vectors = [(i, [c + spread * rng.gauss(0, 1) for c in centres[i % 8]]) for i in range(240)]
    vectors += [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(400, [0.0] * 6), (404, None), (408, [1.0, None] + [0.0] * 4), (412, [1.0, 2.0]), (413, [2.0, 4.0]), (416, []), (420, [float("nan")] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    queries = df.filter("vec_id % 4 = 0")
    want = rows(similarity.most_similar_each(df, queries, 5).select("query_id", "rn", "vec_id", "similarity"))
    assert rows(similarity.most_similar_pruned(df, queries, 5).select("query_id", "rn", "vec_id", "similarity")) == want
    _, met, blocks = similarity.scan_plan(df, queries, 5)
    share = similarity.share_met(met, blocks, queries.count()).head().share
    assert share < 0.4 if spread < 1 else share <= 1
    none = df.filter("false")
    assert similarity.most_similar_pruned(none, none, 5).collect() == []
