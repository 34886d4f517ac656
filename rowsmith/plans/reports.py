"""Reports: single-pass aggregates, distributions, funnels and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsmith.operators import dedupe, ranking, reshape
from rowsmith.operators.rules import count_if, percent, recommendations
from rowsmith.plans.tables import Book, Tables

book = Book()


def pct(part, whole, digits=2):
    return F.round(F.try_divide(part * F.lit(100.0).cast("double"), whole), digits)


@book.add("""
SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities,
  round(avg(o_totalprice), 2) AS avg_price, round(count_if(o_totalprice > 200000) * 100.0::DOUBLE / count(*), 2) AS big_pct,
  round(count_if(o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 2) AS done_pct FROM orders""")
def overview_stats(t: Tables):
    """A1 A2: totals, distinct counts, average and coverage percentages in one pass."""
    n = F.count("*")
    # Columns of a few kinds: sets, which do not expand the rows as several distinct counts would.
    kinds = lambda c: F.size(F.collect_set(c)).cast("long")
    return t.orders.agg(
        n.alias("n_orders"), F.countDistinct("o_custkey").alias("customers"), kinds("o_orderstatus").alias("statuses"), kinds("o_orderpriority").alias("priorities"),
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"), pct(count_if(F.col("o_totalprice") > 200000), n).alias("big_pct"), pct(count_if(F.col("o_orderstatus") == "F"), n).alias("done_pct"),
    )


@book.add("""
SELECT n_name, count(*) AS total, count(DISTINCT c_custkey) AS customers, round(avg(o_totalprice), 2) AS avg_price,
  count_if(o_totalprice > 150000) AS big_orders, round(count_if(o_totalprice > 150000) * 100.0::DOUBLE / count(*), 2) AS big_pct
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def report_by_group(t: Tables):
    """A3: count, distinct customers, average and conditional share per nation."""
    big, n = count_if(F.col("o_totalprice") > 150000), F.count("*")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(n.alias("total"), F.countDistinct("c_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"), big.alias("big_orders"), pct(big, n).alias("big_pct")).orderBy(F.desc("total"), "n_name")


@book.add("""
SELECT c_mktsegment AS segment, count(*) AS total, round(avg(c_acctbal), 2) AS avg_balance, count_if(c_acctbal < 0) AS in_debt,
  round(count_if(c_acctbal < 0) * 100.0::DOUBLE / count(*), 2) AS in_debt_pct FROM customer GROUP BY 1""")
def report_by_segment(t: Tables):
    """A4: the same report by another key."""
    debt = count_if(F.col("c_acctbal") < 0)
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("total"), F.round(F.avg("c_acctbal"), 2).alias("avg_balance"), debt.alias("in_debt"), pct(debt, F.count("*")).alias("in_debt_pct"))


@book.add("""
SELECT n_name, c_mktsegment, count(*) AS total, round(avg(c_acctbal), 2) AS avg_balance FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2 ORDER BY total DESC, n_name, c_mktsegment LIMIT 20""")
def top_groups(t: Tables):
    """The twenty largest groups of two keys."""
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("total"), F.round(F.avg("c_acctbal"), 2).alias("avg_balance")).orderBy(F.desc("total"), "n_name", "c_mktsegment").limit(20)


@book.add("""
SELECT count_if(d AND b) AS both, count_if(d AND NOT b) AS done_only, count_if(NOT d AND b) AS big_only, count_if(NOT d AND NOT b) AS neither, round(count_if(d OR b) * 100.0::DOUBLE / count(*), 2) AS any_pct
FROM (SELECT o_orderstatus = 'F' AS d, o_totalprice > 150000 AS b FROM orders)""")
def quality_matrix(t: Tables):
    """Two presence flags against each other."""
    d, b = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000
    return t.orders.agg(count_if(d & b).alias("both"), count_if(d & ~b).alias("done_only"), count_if(~d & b).alias("big_only"), count_if(~d & ~b).alias("neither"), pct(count_if(d | b), F.count("*")).alias("any_pct"))


@book.add("""
SELECT CASE WHEN p_retailprice >= 975 THEN 'a: 975+' WHEN p_retailprice >= 950 THEN 'b: 950+' WHEN p_retailprice >= 925 THEN 'c: 925+' ELSE 'd: less' END AS bucket,
  count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 2) AS share FROM part GROUP BY 1""")
def bucket_distribution(t: Tables):
    """Values in buckets with their share of all; null goes to the last bucket."""
    p = F.col("p_retailprice")
    bucket = F.when(p >= 975, "a: 975+").when(p >= 950, "b: 950+").when(p >= 925, "c: 925+").otherwise("d: less")
    total = t.part.agg(F.count("*").alias("all"))
    return t.part.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("bucket", "n", pct(F.col("n"), F.col("all")).alias("share"))


@book.add("""
SELECT CAST(ts AS DATE) AS day, min(ts) AS first_at, count(*) AS n, count_if(event_type = 'purchase') AS purchases, count_if(event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def batch_history(t: Tables):
    """One row for each day's batch."""
    of = lambda k: count_if(F.col("event_type") == k)
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_at"), F.count("*").alias("n"), of("purchase").alias("purchases"), of("error").alias("errors"), F.countDistinct("user_id").alias("users"))


@book.add("""
SELECT c_custkey, count(o_orderkey) AS contacts, max(o_orderdate) AS last_at, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'O') AS open
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def contact_summary(t: Tables):
    """Contacts of each customer, also of those without any."""
    of = lambda s: count_if(F.col("o_orderstatus") == s)
    joined = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("contacts"), F.max("o_orderdate").alias("last_at"), of("F").alias("done"), of("O").alias("open"))


RATES = """
WITH c AS (SELECT user_id % 10 AS campaign, count_if(event_type = 'view') AS sent, count_if(event_type = 'click') AS opened, count_if(event_type = 'signup') AS clicked,
  count_if(event_type = 'purchase') AS replied, count_if(event_type = 'error') AS bounced FROM events GROUP BY 1),
r AS (SELECT *, CASE WHEN sent > 0 THEN round(opened * 100.0::DOUBLE / sent, 2) ELSE 0.0::DOUBLE END AS open_rate, CASE WHEN sent > 0 THEN round(clicked * 100.0::DOUBLE / sent, 2) ELSE 0.0::DOUBLE END AS click_rate,
  CASE WHEN sent > 0 THEN round(replied * 100.0::DOUBLE / sent, 2) ELSE 0.0::DOUBLE END AS reply_rate, CASE WHEN sent > 0 THEN round(bounced * 100.0::DOUBLE / sent, 2) ELSE 0.0::DOUBLE END AS bounce_rate FROM c)"""


def _rates(t: Tables):
    of = lambda k: count_if(F.col("event_type") == k)
    c = t.events.groupBy((F.col("user_id") % 10).alias("campaign")).agg(of("view").alias("sent"), of("click").alias("opened"), of("signup").alias("clicked"), of("purchase").alias("replied"), of("error").alias("bounced"))
    names = {"open_rate": "opened", "click_rate": "clicked", "reply_rate": "replied", "bounce_rate": "bounced"}
    return c.select("*", *(percent(F.col(x), F.col("sent")).alias(n) for n, x in names.items()))


@book.add(RATES + " SELECT * FROM r")
def campaign_performance(t: Tables):
    """Funnel counts and rates, 0 where nothing was sent."""
    return _rates(t)


@book.add(RATES + """
SELECT campaign, list_aggregate(list_filter([CASE WHEN open_rate < 20 THEN 'Subject Line Optimization' END, CASE WHEN click_rate < 2 THEN 'Content Optimization' END,
  CASE WHEN reply_rate < 1 THEN 'Personalization Enhancement' END, CASE WHEN bounce_rate > 5 THEN 'List Hygiene' END], lambda x: x IS NOT NULL), 'string_agg', ', ') AS advice FROM r""")
def campaign_recommendations(t: Tables):
    """Advice from rates; null where there is none."""
    advice = recommendations(F.col("open_rate"), F.col("click_rate"), F.col("reply_rate"), F.col("bounce_rate"))
    return _rates(t).select("campaign", F.nullif(F.array_join(advice, ", "), F.lit("")).alias("advice"))


@book.add(RATES + " SELECT campaign, open_rate, round(open_rate / (SELECT max(open_rate) FROM r), 4) AS bar FROM r")
def rate_bars(t: Tables):
    """Each rate as a share of the highest."""
    r = _rates(t).select("campaign", "open_rate")
    return r.join(F.broadcast(r.agg(F.max("open_rate").alias("most")))).select("campaign", "open_rate", F.round(F.col("open_rate") / F.col("most"), 4).alias("bar"))


@book.add("""
SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def value_counts_share(t: Tables):
    """Values with count and share; nulls are left out."""
    counts = t.events.filter(F.col("event_type").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("event_type", "n", pct(F.col("n"), F.col("all")).alias("share"))


@book.add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def value_counts_top(t: Tables):
    """The ten most frequent values."""
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@book.add("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total_size, round(avg(p_size), 4) AS mean_size, median(p_size) AS median_size, round(median(p_retailprice), 4) AS median_price FROM part GROUP BY 1")
def mean_median(t: Tables):
    """Sums, means and exact medians."""
    return t.part.groupBy("p_brand").agg(F.sum("p_size").alias("total_size"), F.round(F.avg("p_size"), 4).alias("mean_size"), F.median("p_size").alias("median_size"), F.round(F.median("p_retailprice"), 4).alias("median_price"))


@book.add("""
WITH p AS (SELECT p_brand, p_size % 6 AS rating, p_retailprice / 20 AS reviews FROM part)
SELECT p_brand, count(*) AS n, round(avg(rating), 4) AS avg_rating, round(count_if(rating >= 4) * 100.0::DOUBLE / count(*), 1) AS high_pct,
  round(avg(rating) / 5.0::DOUBLE * 40 + least(avg(reviews), 100.0::DOUBLE) / 100.0::DOUBLE * 30 + count_if(rating >= 4) * 30.0::DOUBLE / count(*), 1) AS quality_score FROM p GROUP BY 1""")
def keyword_quality(t: Tables):
    """Rating, capped reviews and the share of high ratings as one score."""
    p = t.part.select("p_brand", (F.col("p_size") % 6).alias("rating"), (F.col("p_retailprice") / 20).alias("reviews"))
    high, n = count_if(F.col("rating") >= 4), F.count("*")
    d = lambda x: F.lit(x).cast("double")
    score = F.avg("rating") / d(5) * 40 + F.least(F.avg("reviews"), d(100)) / d(100) * 30 + high * d(30) / n
    return p.groupBy("p_brand").agg(n.alias("n"), F.round(F.avg("rating"), 4).alias("avg_rating"), pct(high, n, 1).alias("high_pct"), F.round(score, 1).alias("quality_score"))


@book.add("""
SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""")
def session_rollup(t: Tables):
    """Totals of each user and the last event."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.max("ts").alias("last_at"), last.alias("last_type"))


@book.add("""
SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30""")
def daily_activity(t: Tables):
    """The last thirty days."""
    types = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), types.alias("types")).orderBy(F.desc("day")).limit(30)


@book.add(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count_if({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def column_profile(t: Tables):
    """Rows, nulls and distinct values of every column, from one scan."""
    return reshape.unpivot_counts(t.customer)


@book.add("""
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_distinct, count(l_orderkey) - count(DISTINCT l_orderkey) AS n_surplus, count_if(l_orderkey IS NULL) AS n_null FROM lineitem""")
def duplicate_profile(t: Tables):
    """Surplus rows of a key."""
    return dedupe.profile(t.lineitem, "l_orderkey")


@book.add("""
SELECT count(*) AS n, count_if(event_type <> 'error') AS ok, round(count_if(event_type <> 'error') * 100.0::DOUBLE / count(*), 2) AS ok_pct, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value,
  round(count(*) / (epoch(max(ts)) - epoch(min(ts)))::DOUBLE, 6) AS per_second FROM events""")
def run_statistics(t: Tables):
    """Success rate, value range and rate of a run."""
    ok, n = count_if(F.col("event_type") != "error"), F.count("*")
    at = F.col("ts").cast("timestamp").cast("double")
    return t.events.agg(n.alias("n"), ok.alias("ok"), pct(ok, n).alias("ok_pct"), F.round(F.avg("value"), 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(n / (F.floor(F.max(at)) - F.floor(F.min(at))), 6).alias("per_second"))


@book.add("""
WITH u AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1)
SELECT first_type, count_if(last_type = 'click') AS click, count_if(last_type = 'error') AS error, count_if(last_type = 'purchase') AS purchase, count_if(last_type = 'signup') AS signup, count_if(last_type = 'view') AS view FROM u GROUP BY 1""")
def transition_matrix(t: Tables):
    """First against last event type of each user."""
    order = F.struct("ts", "event_id")
    u = t.events.groupBy("user_id").agg(F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return u.groupBy("first_type").agg(*(count_if(F.col("last_type") == k).alias(k) for k in kinds))


@book.add("""
SELECT coalesce(c_mktsegment, 'TOTAL') AS segment, count(*) AS n, count_if(c_acctbal >= 0) AS usable FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def usable_rollup(t: Tables):
    """Groups and their total."""
    return t.customer.rollup("c_mktsegment").agg(F.count("*").alias("n"), count_if(F.col("c_acctbal") >= 0).alias("usable")).select(F.coalesce("c_mktsegment", F.lit("TOTAL")).alias("segment"), "n", "usable")


@book.add("""
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((1), (1, 2))""")
def daily_with_global_row(t: Tables):
    """Each day by type, and a row for the day with a null type."""
    e = t.events.select(F.to_date("ts").alias("day"), "event_type")
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n")).union(e.groupBy("day").agg(F.lit(None).cast("string"), F.count("*")).toDF("day", "event_type", "n"))


@book.add("""
WITH r AS (SELECT user_id, value, CASE WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'middle' ELSE 'low' END AS band FROM events)
SELECT band, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 3) AS mean FROM r GROUP BY 1""")
def relevance_bands(t: Tables):
    """Bands of a score."""
    v = F.col("value")
    return t.events.groupBy(F.when(v >= 70, "high").when(v >= 40, "middle").otherwise("low").alias("band")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 3).alias("mean"))


@book.add("""
SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p_type LIKE '%OM%' THEN 'om' END, CASE WHEN p_type LIKE 'S%' THEN 's' END, CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 950 THEN 'dear' END], lambda x: x IS NOT NULL)) AS kind FROM part) GROUP BY 1""")
def multi_label_counts(t: Tables):
    """Rows that may count for several labels."""
    labels = F.array_compact(F.array(F.when(F.col("p_type").contains("OM"), "om"), F.when(F.col("p_type").startswith("S"), "s"), F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 950, "dear")))
    return t.part.select(F.explode(labels).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@book.add("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1)
SELECT day, n, lag(n) OVER (ORDER BY day) AS previous_n, CAST(n - lag(n) OVER (ORDER BY day) AS BIGINT) AS change FROM d""")
def change_between_days(t: Tables):
    """Each day's count beside the day before it."""
    # A join on the day before, so that no window puts all days in one task.
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = d.select(F.date_add("day", 1).alias("day"), F.col("n").alias("previous_n"))
    return d.join(before, "day", "left").select("day", "n", "previous_n", (F.col("n") - F.col("previous_n")).alias("change"))


@book.add("""
WITH b AS (SELECT c_nationkey, c_custkey, c_acctbal, lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS previous_c_acctbal FROM customer)
SELECT c_nationkey, c_custkey, coalesce(c_acctbal < previous_c_acctbal * 0.5::DOUBLE, false) AS dropped FROM b""")
def latest_vs_previous(t: Tables):
    """Each row against the one before in its group."""
    b = ranking.with_previous(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", ["c_custkey"], ["c_acctbal"])
    return b.select("c_nationkey", "c_custkey", F.coalesce(F.col("c_acctbal") < F.col("previous_c_acctbal") * F.lit(0.5).cast("double"), F.lit(False)).alias("dropped"))
