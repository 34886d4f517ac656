"""Benchmark passages in documents by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ten consecutive words, or is one window if it is shorter. Containment of a
whole window needs each of its words, so that its prefix is its rarest word alone, by the number of times that the
documents use it. The documents' words are joined with the prefixes; a match gives the place where the window would
begin, which must lie in the document with the window's length behind it, and the document's words there must equal
the window's.

Windows are broadcast up to ``most_windows`` of them, which are counted first. Beyond that, words and prefixes are
joined by a shuffle, a document's candidates are gathered, and each document that has some is joined with them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.llm.common import ascii_lower, row_key, whole_rows, written

WINDOW = 10
#: Windows, of ten words each, that may be broadcast.
MOST_WINDOWS = 100_000
#: A word before A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case; null has none."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window key, words, length, item_id) of each window of each item, without repeats."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    k = F.least(F.size("w"), F.lit(size))
    cut = items.select("item_id", "w", k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("s"))
    cut = cut.select("item_id", "k", F.slice("w", F.col("s"), F.col("k")).alias("window"))
    return cut.withColumn("window_key", F.sha2(F.array_join("window", " "), 256)).distinct()


def matches(docs: DataFrame, windows: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(row_key, s, k, window_key) of each place where a window occurs; ``docs`` has (row_key, w), ``windows`` as above."""
    distinct = windows.select("window_key", "window", "k").dropDuplicates(["window_key"])
    small = windows.count() <= most_windows
    held = F.broadcast if small else lambda x: x
    vocabulary = distinct.select(F.explode("window").alias("word")).distinct()
    used = docs.select(F.explode("w").alias("word")).join(held(vocabulary), "word").groupBy("word").agg(F.count("*").alias("uses"))
    used = written(used, "uses")
    ranked = distinct.select("window_key", "window", "k", F.posexplode("window").alias("offset", "word")).join(held(used) if small else used, "word", "left")
    rarest = F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word", "offset")).alias("rare")
    prefix = ranked.groupBy("window_key").agg(F.first("window").alias("window"), F.first("k").alias("k"), rarest)
    # A prefix that no document uses needs no join.
    prefix = prefix.filter("rare.uses > 0").select("window_key", "window", "k", F.col("rare.word").alias("word"), F.col("rare.offset").alias("offset"))
    prefix = written(prefix, "prefixes")
    inside = "p - offset >= 0 and p - offset + k <= size(w) and slice(w, p - offset + 1, k) = window"
    if small:
        found = docs.select("row_key", "w", F.posexplode("w").alias("p", "word")).join(F.broadcast(prefix), "word").filter(inside)
        return found.select("row_key", (F.col("p") - F.col("offset")).alias("s"), "k", "window_key").distinct()
    places = docs.select("row_key", F.posexplode("w").alias("p", "word")).join(prefix.select("word", "window_key", "k", "offset"), "word").filter("p >= offset")
    places = places.groupBy("row_key").agg(F.collect_set(F.struct((F.col("p") - F.col("offset")).alias("s"), "k", "window_key")).alias("places"))
    there = lambda x: F.sha2(F.array_join(F.slice("w", x["s"] + 1, x["k"]), " "), 256) == x["window_key"]
    found = places.join(docs.dropDuplicates(["row_key"]), "row_key").select("row_key", F.explode(F.filter("places", there)).alias("x"))
    return found.select("row_key", "x.s", "x.k", "x.window_key")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """A row for each row of ``docs``: its words, those inside benchmark windows, and the items of these windows.

    A document or item that is null or has no word has no window. A null ``item_id`` counts as an empty one.
    Rows of documents repeated with the same id and text get the same row each. Columns besides ``doc_id``,
    ``item_id`` and ``text`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    windows = written(windows_of(benchmark, size), "windows")
    found = written(matches(docs.select("row_key", words(F.col("text")).alias("w")), windows, most_windows), "matches")
    before = F.max(F.col("s") + F.col("k")).over(W.partitionBy("row_key").orderBy("s", "k").rowsBetween(W.unboundedPreceding, -1))
    end = F.col("s") + F.col("k")
    hit = found.select("row_key", F.greatest(F.lit(0), end - F.greatest("s", F.coalesce(before, F.lit(0)))).alias("new")).groupBy("row_key").agg(F.sum("new").alias("n_hit"))
    items = found.select("row_key", "window_key").distinct().join(windows.select("window_key", "item_id"), "window_key").select("row_key", "item_id").distinct()
    items = items.groupBy("row_key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    marked = written(hit.join(items, "row_key"), "marked")
    out = docs.select("doc_id", "row_key", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")).join(marked, "row_key", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns, which may have any names.

    Rows whose text is null or has no words stay. Repeated rows stay or go together.
    """
    windows = written(windows_of(benchmark, size), "windows")
    rows = whole_rows(docs)
    keyed = rows.select(F.col("key").alias("row_key"), words(F.col("row.text").cast("string")).alias("w"))
    dirty = written(matches(keyed, windows, most_windows).select(F.col("row_key").alias("key")).distinct(), "dirty")
    return rows.join(dirty, "key", "left_anti").select("row.*")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS_SQL} AS w FROM benchmark),
cut AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM cut),
sizes AS (SELECT DISTINCT k FROM win),
place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k),
grams AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM place),
hit AS (SELECT * FROM grams WHERE g IN (SELECT g FROM win)),
covered AS (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM covered GROUP BY doc_id),
it AS (SELECT DISTINCT doc_id, item_id FROM hit JOIN win USING (g)),
li AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM it GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN li USING (doc_id)
"""
