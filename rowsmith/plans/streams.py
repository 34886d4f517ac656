"""Events as streams of files that land one part after another; each part is a run that goes on from the checkpoint of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.plans.tables import Book, Tables
from rowsmith.sources.project import ProjectTable
from rowsmith.sources.shared import shared_path
from rowsmith.streaming import resume

book = Book()

#: The part in which an event lands, as SQL that Spark and DuckDB read alike.
LANDING = "CASE WHEN event_id % 3 <> 0 THEN 0 ELSE 1 END"


def runs(t: Tables, name: str, run) -> str:
    """Land the parts of ``events`` in turn and call ``run(folder, base)`` after each; the folder of all this."""
    base = shared_path(t.spark, name)
    for part in (0, 1):
        t.events.filter(f"{LANDING} = {part}").write.mode("append").parquet(f"{base}/in")
        run(f"{base}/in", base)
    return base


@book.add("SELECT event_id, user_id, upper(event_type) AS kind, round(value * 2, 4) AS twice FROM events")
def stream_in_runs(t: Tables):
    """A stream of files that stops and goes on from its checkpoint, a new output file after every 1,000 rows; each event comes out once."""

    def step(rows: DataFrame) -> DataFrame:
        return rows.select("event_id", "user_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 2, 4).alias("twice"))

    run = lambda folder, base: resume.process_new_files(t.spark, folder, t.events.schema, step, f"{base}/out", f"{base}/mark", out_form="csv", files_per_batch=4, flush=1000)
    base = runs(t, "stream", run)
    return t.spark.read.schema("event_id long, user_id long, kind string, twice double").option("header", True).csv(f"{base}/out")


@book.add(f"""
WITH e AS (SELECT *, {LANDING} AS part FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part DESC, ts DESC, event_id DESC) AS n FROM e)
SELECT user_id, event_id, event_type, value, TIMESTAMP '2024-02-01 00:00:00' + to_days(part) AS synced_at FROM r WHERE n = 1""")
def raw_layer_sync(t: Tables):
    """Each batch of a stream upserted by unique id into a versioned table, once even if it comes again; rows keep the time of the batch that brought them."""
    base = shared_path(t.spark, "sync")
    table = ProjectTable(t.spark, base, "users")

    def run(folder: str, base: str) -> None:
        rows = resume.new_files(t.spark, folder, t.events.schema).select("user_id", "ts", "event_id", "event_type", "value")
        resume.sync_stream(rows, f"{base}/mark", table, ["user_id"], ["ts", "event_id"], lambda n: F.expr(f"timestamp_ntz '2024-02-01 00:00:00' + make_dt_interval({n})"))

    runs(t, "landed", run)
    return table.load().select("user_id", "event_id", "event_type", "value", "synced_at")


@book.add(f"""
WITH e AS (SELECT *, {LANDING} AS part, date_trunc('day', ts) AS window_start FROM events), w AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM e WHERE part = 0)
SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e CROSS JOIN w WHERE part = 0 OR window_start + INTERVAL 1 DAY > mark GROUP BY 1, 2""")
def late_events(t: Tables):
    """X11: events by day and type on a stream with a watermark of two days; what comes after its window has closed is dropped."""
    base = shared_path(t.spark, "windows")
    table = ProjectTable(t.spark, base, "windows")

    def run(folder: str, base: str) -> None:
        rows = resume.windowed_counts(resume.new_files(t.spark, folder, t.events.schema), late="2 days")
        resume.sync_stream(rows, f"{base}/mark", table, ["window_start", "event_type"], ["n"], mode="update")

    runs(t, "landed", run)
    return table.load().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
