import json

import pytest
from pyspark.sql import functions as F

from rowsmith.sources import project, readers


def test_encodings_are_tried_in_order(spark, tmp_path):
    for name, text, enc in (("a", "name,city\nJosé,München\n", "utf-8"), ("b", "name,city\nИван,Москва\n", "cp1251")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(enc))
    assert readers.encoding_of(spark, str(tmp_path / "a.csv")) == "UTF-8"
    assert readers.encoding_of(spark, str(tmp_path / "b.csv")) == "windows-1251"
    assert readers.encoding_of(spark, str(tmp_path / "b.csv"), ("UTF-8", "ISO-8859-1")) == "ISO-8859-1"
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "b.csv"), None).collect()] == [("Иван", "Москва")]
    with pytest.warns(UserWarning, match="street"):
        assert readers.read_csv(spark, str(tmp_path / "a.csv"), columns=["city", "street"]).columns == ["city"]


def test_each_file_has_its_own_encoding(spark, tmp_path):
    """Four encodings in one folder, read right in one call; bytes, quotes and line breaks inside fields included."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    rows = {
        "utf-8": [("José", "München"), ("Иван", "Москва, \"центр\"\nулица")],
        "utf-8-sig": [("Zoë", "Łódź")],
        "cp1251": [("Ольга", "Санкт-Петербург"), ("plain", "ascii only")],
        "latin-1": [("François", "Besançon"), ("Jürgen", "Köln")],
    }
    for enc, values in rows.items():
        quoted = lambda v: '"' + v.replace('"', '""') + '"'
        (folder / f"{enc}.csv").write_bytes(("Name,City\n" + "".join(f"{quoted(a)},{quoted(b)}\n" for a, b in values)).encode(enc))
    judged = {r.file.rsplit("/", 1)[1]: r.encoding for r in readers.encodings_of(spark, str(folder)).collect()}
    assert judged == {"utf-8.csv": "UTF-8", "utf-8-sig.csv": "UTF-8", "cp1251.csv": "windows-1251", "latin-1.csv": "ISO-8859-1"}
    got = readers.read_csv(spark, str(folder), None)
    assert got.columns == ["name", "city"]
    assert sorted(map(tuple, got.collect())) == sorted(r for values in rows.values() for r in values)
    with pytest.raises(ValueError, match="several"):
        readers.encoding_of(spark, str(folder))


def test_bytes_that_no_encoding_has(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("name\nJos\u00e9\n".encode() + b"a\xffb\n")
    read = lambda errors: sorted(r.name for r in readers.read_csv(spark, str(tmp_path / "x.csv"), None, encodings=("UTF-8",), errors=errors).collect())
    assert read("replace") == ["Jos\u00e9", "a\ufffdb"] and read("ignore") == ["Jos\u00e9", "ab"]


def commits(table):
    return sorted(p.name for p in __import__("pathlib").Path(table.base, "commits").iterdir() if p.name.isdigit())


def test_a_save_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    table = project.ProjectTable(spark, str(tmp_path), "p")
    assert not table.exists() and table.last() is None
    table.save(spark.createDataFrame([(1, "a")], "k int, v string"))
    before = table.load()

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        table.save(spark.createDataFrame([(1, "b")], "k int, v string"))
    monkeypatch.undo()
    assert [tuple(r) for r in table.load().collect()] == [(1, "a")] and len(commits(table)) == 1
    table.save(table.load().withColumn("v", F.lit("c")))  # from a plan that reads it
    assert [tuple(r) for r in table.load().collect()] == [(1, "c")] and [tuple(r) for r in before.collect()] == [(1, "a")]
    assert project.projects(spark, str(tmp_path)) == ["p"]


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (project.ProjectTable(spark, str(tmp_path), "p") for _ in range(2))
    one.save(spark.createDataFrame([(1,), (2,)], "k int"))
    at = two.last()
    assert one.save(one.load().withColumn("a", F.lit(1)), after=at)
    assert not two.save(two.load().withColumn("b", F.lit(2)), after=at)  # made from the version before
    plain = project.enrich
    raced = []

    def meanwhile(*args):
        out = plain(*args)
        if not raced:  # another writer comes between reading and saving
            raced.append(one.save(one.load().withColumn("c", F.lit(3))))
        return out

    project.enrich = meanwhile
    try:
        two.add_columns(spark.createDataFrame([(1, "x"), (2, "y")], "k int, d string"), "k")
    finally:
        project.enrich = plain
    assert sorted(map(tuple, two.load(["k", "a", "c", "d"]).collect())) == [(1, 1, 3, "x"), (2, 1, 3, "y")]


def test_address_column_is_found_by_content(spark, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"{i},user{i}@x.com,ok{i},z\n" for i in range(12)))
    got = readers.read_headerless(spark, str(tmp_path / "x.csv"))
    assert got.count() == 12 and tuple(got.orderBy("email").head()) == ("user0@x.com", "ok0")
    (tmp_path / "y.csv").write_text("a,b\nc,d\n")
    with pytest.raises(ValueError):
        readers.read_headerless(spark, str(tmp_path / "y.csv"))


def test_latest_files(spark, tmp_path):
    for name in ("texas_20250101.json", "texas_20250301.json", "ohio_20250201.json", "notes.txt"):
        (tmp_path / name).write_text("{}")
    assert readers.latest(spark, f"{tmp_path}/*.json").endswith("texas_20250301.json")
    got = {r.key: r.path.rsplit("/", 1)[1] for r in readers.latest_of_each(spark, f"{tmp_path}/*", r"^([a-z]+)_\d{8}").collect()}
    assert got == {"texas": "texas_20250301.json", "ohio": "ohio_20250201.json"}


def test_places_take_state_and_niche_from_their_file(spark, tmp_path):
    place = {"place_id": "p", "name": "n"}
    for state, name in (("texas", "hvac_20250101.json"), ("ohio", "plumbers_20250101_summary.json")):
        (tmp_path / state).mkdir()
        (tmp_path / state / name).write_text(json.dumps({"metadata": {"timestamp": "t"}, "results_by_city": [{"city": "c", "places": [place]}]}))
    got = readers.read_places(spark, f"{tmp_path}/*/*.json", exclude=["summary"]).collect()
    assert [(r.state, r.niche, r.place_id) for r in got] == [("texas", "hvac", "p")]


def test_exports(spark, tmp_path):
    root = str(tmp_path)
    table = project.ProjectTable(spark, root, "one")
    table.save(spark.range(150).select("id", (F.col("id") % 3).alias("k")))
    project.ProjectTable(spark, root, "two").save(spark.range(1))
    assert project.projects(spark, root) == ["one", "two"]
    assert table.describe()["columns"] == {"id": "bigint", "k": "bigint"} and table.describe()["rows"] == 150
    assert table.export(f"{root}/out", {"id": ">=100"}, ["k"]) == 50
    assert spark.read.option("header", True).csv(f"{root}/out").columns == ["k"]
    stamped, last = project.export_stamped(table.load(), f"{root}/runs", "20250101")
    for path in (stamped, last):
        assert spark.read.option("header", True).csv(path).count() == 150
    assert project.export_sample(table.load(), f"{root}/sample", ["id"]) == 100
    project.export_outcomes(table.load(), f"{root}/outcomes", F.when(F.col("k") > 0, F.col("k") == 1))
    count = lambda name: spark.read.json(f"{root}/outcomes/{name}").count()
    assert (count("success"), count("failed"), count("combined")) == (50, 100, 150)
