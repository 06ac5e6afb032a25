"""Queries for windows, caps, rankings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.operators import evaluate, joins, limits, shaping, trends
from opinara.queries import tables as t
from opinara.queries.registry import dates_as_text, query, rounded


@query("f01_group_size", "SELECT doc_id, source, count(source) OVER (PARTITION BY source) AS community_size FROM documents")
def f01(spark, sf):
    return joins.with_group_size(t.table(spark, sf, "documents").select("doc_id", "source"), "source")


@query("f02_keep_first", "SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def f02(spark, sf):
    return shaping.keep_first(t.table(spark, sf, "documents").select("doc_id", "text", "lang"), ["text"], ["doc_id"])


@query("f03_trend", """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS m FROM orders GROUP BY 1),
  e AS (SELECT arg_min(m, year) AS a, arg_max(m, year) AS z, max(m) AS hi, min(m) AS lo FROM y)
  SELECT round(a, 4) AS first_mean, round(z, 4) AS last_mean, round(z - a, 4) AS change, CASE WHEN z > a THEN 'IMPROVING' ELSE 'DECLINING' END AS direction,
    (SELECT min(year) FROM y WHERE m = hi) AS best, round(hi, 4) AS best_mean, (SELECT min(year) FROM y WHERE m = lo) AS worst, round(lo, 4) AS worst_mean FROM e""")
def f03(spark, sf):
    o = t.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return rounded(trends.trend(o, "year", "o_totalprice"), 4)


@query("f04_videos_per_query", """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
  SELECT c_custkey, c_nationkey FROM customer JOIN n ON c_custkey = o_custkey WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5""")
def f04(spark, sf):
    """At most five eligible customers per nation, as videos per query."""
    n = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    eligible = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(n, "c_custkey").where("n >= 10").drop("n")
    return limits.cap_per_group(eligible, ["c_nationkey"], ["c_custkey"], 5)


@query("f05_comments_per_video", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 30")
def f05(spark, sf):
    return limits.cap_per_group(t.table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 30).drop("ts")


@query("f06_cumulative_cap", """WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
  r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
  SELECT l_orderkey, n, CAST(b AS BIGINT) AS collected_before FROM r WHERE b < 1000""")
def f06(spark, sf):
    posts = t.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return limits.cap_cumulative(posts, "l_orderkey", "n", 1000)


@query("f07_ranked_listing", "SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS rank FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def f07(spark, sf):
    return limits.top_values(t.table(spark, sf, "events"), "event_type", 10)


@query("g01_top_communities", "SELECT user_id, n, CAST(row_number() OVER (ORDER BY n DESC, user_id) AS INTEGER) AS rank FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 10")
def g01(spark, sf):
    return limits.top_values(t.table(spark, sf, "events"), "user_id", 10)


@query("g02_head", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 3")
def g02(spark, sf):
    return shaping.head(t.table(spark, sf, "events"), ["event_id", "event_type"], 3, ["event_id"])


_EXTREMES = """WITH m AS (SELECT lang AS class, source AS term, round(avg(n_chars), 6) AS value FROM documents GROUP BY 1, 2)
  SELECT class, term, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY value {0}, term) AS rank FROM m) WHERE rank <= 10"""


def _term_values(spark, sf):
    return rounded(t.table(spark, sf, "documents").groupBy(F.col("lang").alias("class"), F.col("source").alias("term")).agg(F.avg("n_chars").alias("value")))


@query("g03_largest_per_class", _EXTREMES.format("DESC"))
def g03(spark, sf):
    from opinara.operators.models import extreme_terms

    return extreme_terms(_term_values(spark, sf), 10)


@query("g03_smallest_per_class", _EXTREMES.format("ASC"))
def g03_small(spark, sf):
    from opinara.operators.models import extreme_terms

    return extreme_terms(_term_values(spark, sf), 10, largest=False)


@query("g04_top_importances", "SELECT p_name AS term, round(p_retailprice, 2) AS value FROM part ORDER BY p_retailprice DESC, p_name LIMIT 20")
def g04(spark, sf):
    from opinara.operators.models import top_importances

    return rounded(top_importances(t.table(spark, sf, "part").select(F.col("p_name").alias("term"), F.col("p_retailprice").alias("value"))), 2)


@query("g05_best_by_metric", "SELECT event_type AS model, round(avg(value), 6) AS accuracy FROM events GROUP BY 1 ORDER BY avg(value) DESC, model LIMIT 1")
def g05(spark, sf):
    scores = t.table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("accuracy"))
    return rounded(evaluate.best_model(scores))


@query("g06_newest_first", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events ORDER BY events.ts DESC, event_id LIMIT 100")
def g06(spark, sf):
    return dates_as_text(limits.newest(t.table(spark, sf, "events"), "ts", 100, "event_id").select("event_id", "ts"))


@query("g07_random_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':42') LIMIT 10")
def g07(spark, sf):
    return limits.sample_rows(t.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 10)


@query("g08_sorted_distinct", "SELECT DISTINCT lang FROM documents ORDER BY lang")
def g08(spark, sf):
    return t.table(spark, sf, "documents").select("lang").distinct().orderBy("lang")
