"""Streams that are killed, go on and see batches again."""

import pytest
from pyspark.sql import functions as F

from rowsmith.sources.project import ProjectTable
from rowsmith.streaming import resume


def test_killed_between_batches_goes_on(spark, tmp_path):
    """The second of three batches fails after it has begun; the next run does it and the rest, and no row comes twice."""
    src, out, mark, stop = (str(tmp_path / x) for x in ("src", "out", "mark", "stop"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    open(stop, "w").close()

    @F.udf("long")
    def fragile(x):
        import os

        if os.path.exists(stop) and x >= 10 and x % 10 == 7:
            raise ValueError("killed")
        return x

    run = lambda: resume.process_new_files(spark, src, spark.read.parquet(src).schema, lambda d: d.select(fragile("id").alias("id")), out, mark, out_form="csv", files_per_batch=1, flush=4)
    with pytest.raises(Exception, match="killed"):
        run()
    read = lambda: sorted(r.id for r in spark.read.schema("id long").option("header", True).csv(out).collect())
    assert read() == list(range(10))  # the first batch, and nothing of the one that failed
    (tmp_path / "stop").unlink()
    run()
    assert read() == list(range(30))
    spark.range(30, 35).write.mode("append").parquet(src)
    run()
    assert read() == list(range(35))
    files = [p for p in (tmp_path / "out").glob("*.csv")]
    assert max(len(p.read_text().splitlines()) for p in files) <= 5  # a header and four rows


def rows(table):
    return sorted(map(tuple, table.load().select("k", "v", "synced_at").collect()))


def test_batch_that_comes_again_changes_nothing(spark, tmp_path):
    table = ProjectTable(spark, str(tmp_path), "t")
    batch = lambda *data: spark.createDataFrame(list(data), "k int, t int, v string")
    sync = lambda b, n: resume.sync_batch(table, b, n, ["k"], ["t"], F.lit(100 + n))
    assert sync(batch((1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")), 0)
    first = [(1, "b", 100), (2, "c", 100), (None, "n", 100)]
    assert sorted(map(str, rows_any(table))) == sorted(map(str, first))
    assert not sync(batch((1, 9, "x")), 0) and sorted(map(str, rows_any(table))) == sorted(map(str, first))  # replayed
    assert sync(batch((2, 0, "d"), (3, 1, "e"), (None, 2, "m")), 1)
    assert sorted(map(str, rows_any(table))) == sorted(map(str, [(1, "b", 100), (2, "d", 101), (3, "e", 101), (None, "m", 101)]))
    assert resume.sync_batch(table, batch((1, 1, "z")), 0, ["k"], ["t"], F.lit(7), stream="another") and table.notes(table.last()) == {"stream": 1, "another": 0}


def rows_any(table):
    return [tuple(r) for r in table.load().select("k", "v", "synced_at").collect()]


def test_killed_after_the_commit(spark, tmp_path):
    """The table has a batch whose checkpoint was never written: the next run sees it again and leaves it alone."""
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    spark.createDataFrame([(1, 1, "a")], "k int, t int, v string").write.parquet(src)
    table = ProjectTable(spark, str(tmp_path), "t")
    schema = spark.read.parquet(src).schema
    stream = lambda: resume.new_files(spark, src, schema)

    def dies(batch, number):
        resume.sync_batch(table, batch, number, ["k"], ["t"], F.lit(1))
        raise RuntimeError("killed behind the commit")

    query = stream().writeStream.foreachBatch(dies).option("checkpointLocation", mark).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed behind the commit"):
        query.awaitTermination()
    at = table.last()
    resume.sync_stream(stream(), mark, table, ["k"], ["t"], lambda n: F.lit(2))
    assert table.last() == at and rows(table) == [(1, "a", 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    table = ProjectTable(spark, str(tmp_path), "w")

    def land(*times):
        spark.createDataFrame([(t, "x", 1.0) for t in times], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(src)
        events = resume.new_files(spark, src, spark.read.parquet(src).schema)
        resume.sync_stream(resume.windowed_counts(events, late="1 day"), mark, table, ["window_start", "event_type"], ["n"], mode="update")

    land("2024-01-01 10:00:00", "2024-01-05 10:00:00")  # the watermark is then January 4th, 10 o'clock
    land("2024-01-01 11:00:00", "2024-01-03 23:00:00", "2024-01-04 09:00:00", "2024-01-05 11:00:00")
    got = {str(r.w)[:10]: r.n for r in table.load().select(F.col("window_start").cast("string").alias("w"), "n").collect()}
    assert got == {"2024-01-01": 1, "2024-01-04": 1, "2024-01-05": 2}
