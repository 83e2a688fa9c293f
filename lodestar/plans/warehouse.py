"""Queries of aggregates, set operations, lake audits, streams and text."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as W
from lodestar.operators import reshape as S
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import panel_frame, query, table, tidy
from lodestar.session import shared_dir
from lodestar.sources import lake as L
from lodestar.streaming import events as N


@query("monthly_compounding", f"{P} SELECT entity, CAST(DATE_TRUNC('month', dt) AS DATE) AS month, ROUND(EXP(SUM(LN(1 + r))) - 1, 5) + 0.0 AS compounded, ROUND(SUM(r), 6) + 0.0 AS summed FROM p WHERE r IS NOT NULL GROUP BY 1, 2")
def monthly_compounding(spark, sf_dir):
    df = panel_frame(spark, sf_dir).where("r is not null")
    return tidy(df.groupBy("entity", F.trunc("dt", "month").alias("month")).agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("compounded"), F.sum("r").alias("summed")), compounded=5)


@query("conditional_flow", """SELECT CAST(l_shipdate AS DATE) AS dt, SUM(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a_volume, SUM(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r_volume, ROUND(SUM(l_quantity) FILTER (WHERE l_returnflag = 'A') / NULLIF(SUM(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0), 8) AS ratio, ROUND(AVG(l_tax) FILTER (WHERE l_discount > 0.05), 8) AS rich_tax, COUNT(DISTINCT l_suppkey) AS names FROM lineitem GROUP BY 1""")
def conditional_flow(spark, sf_dir):
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    of = lambda f: F.sum(F.when(flag == f, q))
    return tidy(table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("dt")).agg(of("A").alias("a_volume"), of("R").alias("r_volume"), F.try_divide(of("A"), F.nullif(of("R"), F.lit(0.0))).alias("ratio"), F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_tax"))).alias("rich_tax"), F.countDistinct("l_suppkey").alias("names")), 8)


@query("most_frequent_value", "SELECT o_custkey, o_orderpriority AS priority, n FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2) QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def most_frequent_value(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return S.dedupe(counts, ["o_custkey"], [F.desc("n"), F.col("priority")])


@query("largest_names", f"{P} SELECT entity, ROUND(AVG(value), 3) AS mean_value FROM p GROUP BY 1 ORDER BY ROUND(AVG(value), 3) DESC, entity LIMIT 20")
def largest_names(spark, sf_dir):
    df = panel_frame(spark, sf_dir).groupBy("entity").agg(F.round(F.avg("value"), 3).alias("mean_value"))
    return df.orderBy(F.desc("mean_value"), "entity").limit(20)


@query("top_orders_of_customers", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_orders_of_customers(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w)).where("i <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("last_event_of_key", "SELECT event_id, user_id, event_type FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_event_of_key(spark, sf_dir):
    return S.dedupe(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("set_operations", """SELECT 'both' AS kind, COUNT(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'only', COUNT(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'either', COUNT(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f, p = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n("both", f.intersect(p)).union(n("only", f.subtract(p))).union(n("either", f.union(p).distinct()))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS quantity, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_discount), 8) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("date"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("chain_of_maps", "SELECT r_name, n_name, COUNT(*) AS suppliers, ROUND(AVG(s_acctbal), 6) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def chain_of_maps(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return tidy(joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.avg("s_acctbal").alias("balance")))


@query("full_outer_years", """WITH a AS (SELECT YEAR(l_shipdate) AS y, COUNT(*) AS lines FROM lineitem GROUP BY 1), b AS (SELECT YEAR(o_orderdate) AS y, COUNT(*) AS orders FROM orders GROUP BY 1) SELECT CAST(COALESCE(a.y, b.y) AS INT) AS year, lines, orders, COALESCE(lines, 0) - COALESCE(orders, 0) AS diff FROM a FULL OUTER JOIN b ON a.y = b.y""")
def full_outer_years(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("lines"))
    b = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return a.join(b, "year", "full_outer").withColumn("diff", F.coalesce("lines", F.lit(0)) - F.coalesce("orders", F.lit(0)))


@query("year_audit", "SELECT CAST(YEAR(o_orderdate) AS INT) AS year, COUNT(*) AS n, MIN(o_orderdate) AS first, MAX(o_orderdate) AS last FROM orders GROUP BY 1")
def year_audit(spark, sf_dir):
    return L.audit(table(spark, sf_dir, "orders"), "o_orderdate")


@query("column_health", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, ROUND(1 - COUNT({c}) / COUNT(*)::DOUBLE, 8) AS missing, ROUND(AVG(CASE WHEN {c} <> 0 THEN 1.0 WHEN {c} = 0 THEN 0.0 END), 8) AS nonzero, ROUND(VAR_POP({c}), 6) AS variance, COALESCE(VAR_POP({c}) < 1e-16, TRUE) OR 1 - COUNT({c}) / COUNT(*)::DOUBLE > 0.95 AS dead FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")")
def column_health(spark, sf_dir):
    return tidy(L.health(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 8, variance=6)


_RAW = "r AS (SELECT o_orderkey, CASE o_orderkey % 50 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)"


@query("rejected_rows", f"WITH {_RAW} SELECT CASE WHEN d IS NULL OR TRIM(d) = '' THEN 'missing date' ELSE 'bad date' END AS reject_reason, COUNT(*) AS n FROM r WHERE TRY_CAST(d AS DATE) IS NULL GROUP BY 1")
def rejected_rows(spark, sf_dir):
    k = F.col("o_orderkey") % 50
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "n/a").when(k == 1, None).when(k == 2, " ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return L.split_rejects(raw, "d")[1].groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("lake_round_trip", "SELECT CAST(YEAR(o_orderdate) AS INT) AS year, CAST(MONTH(o_orderdate) AS INT) AS month, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders WHERE YEAR(o_orderdate) BETWEEN 1996 AND 1997 GROUP BY 1, 2")
def lake_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}"
    L.write_partitioned(table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date")), path, "date")
    df = L.scan(spark, path, years=(1996, 1997))
    return df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("vendor_overlay", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, MAX(c_acctbal) AS vendor_value FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey GROUP BY 1")
def vendor_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "orders").withColumn("vendor_value", F.lit(-1.0))
    extra = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("vendor_value"))
    return L.overlay(base, extra, ["o_custkey"], ["vendor_value"]).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("vendor_value").alias("vendor_value"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def event_windows(spark, sf_dir):
    return tidy(N.windowed(table(spark, sf_dir, "events")), 4)


@query("event_sessions", """WITH g AS (SELECT *, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, SUM(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g) SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS "end", COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return tidy(N.sessions(table(spark, sf_dir, "events")), 4)


@query("deduplicated_events", "SELECT event_type, COUNT(DISTINCT event_id) AS n FROM events GROUP BY 1")
def deduplicated_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return N.deduplicated(events.union(events.where("event_id % 7 = 0"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("text_features")
def text_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    from pyspark.ml.functions import vector_to_array

    made = W.tfidf(docs, "text").select("doc_id", vector_to_array("tfidf").alias("v"))
    return tidy(made.select("doc_id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.size(F.filter("v", lambda x: x > 0)).alias("terms")), 5)


@query("weighted_embedding", "SELECT label, ROUND(SUM(embedding[1]::DOUBLE * (vec_id % 5 + 1)) / SUM(vec_id % 5 + 1), 5) + 0.0 AS e0, ROUND(SUM(embedding[8]::DOUBLE * (vec_id % 5 + 1)) / SUM(vec_id % 5 + 1), 5) + 0.0 AS e7 FROM embeddings GROUP BY label")
def weighted_embedding(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 5 + 1).cast("double").alias("w"))
    made = W.weighted_embedding(df, "label", "v", "w", 8)
    return tidy(made.select("label", F.col("embedding")[0].alias("e0"), F.col("embedding")[7].alias("e7")), 5)
