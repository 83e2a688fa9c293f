"""Queries of typed frames, overlays and the texts of remote queries, run on the session's own tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import scalars as K
from lodestar.operators import reshape as S
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import panel_frame, query, table, tidy
from lodestar.sources import lake as L


@query("price_frame", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS close, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END::DOUBLE AS cfadj, ROUND(o_totalprice * COALESCE(NULLIF(o_custkey % 3, 0), 1), 2) AS adj_close FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30'")
def price_frame(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_totalprice").alias("close"), F.nullif(F.col("o_custkey") % 3, F.lit(0)).cast("string").alias("cfadj"))
    return tidy(L.price_frame(raw, start="1996-01-01", end="1997-06-30"), 2)


@query("returns_matrix", f"""{P}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'), e AS (SELECT * FROM (VALUES (1), (2), (7)) v(entity))
SELECT d.dt, e.entity::BIGINT AS entity, ROUND(p.r, 6) + 0.0 AS r, FALSE AS lead_in FROM d CROSS JOIN e LEFT JOIN p ON p.entity = e.entity AND p.dt = d.dt UNION ALL SELECT dt, entity, ROUND(r, 6) + 0.0, TRUE FROM p WHERE entity IN (1, 2, 7) AND dt < (SELECT MIN(dt) FROM d) AND dt >= (SELECT MIN(dt) FROM d) - 400""")
def returns_matrix(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("dt")).where("dt between '1997-01-01' and '1997-12-31'")
    return tidy(L.returns_matrix(panel_frame(spark, sf_dir), days, [1, 2, 7], "entity", "dt", "r"))


_ST = "st AS (SELECT CAST(o_orderdate AS DATE) AS date, ROUND(MAX(o_totalprice), 2) AS vix FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), di AS (SELECT CAST(l_shipdate AS DATE) AS date, ROUND(MAX(l_extendedprice), 2) AS disp, CASE WHEN YEAR(l_shipdate) > 1996 THEN MAX(l_quantity) END AS sofr FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 = 0 GROUP BY 1, YEAR(l_shipdate))"


@query("macro_frame", f"WITH {_ST}, j AS (SELECT date, vix, disp, sofr FROM st LEFT JOIN di USING (date)), f AS (SELECT date, vix, LAST_VALUE(disp IGNORE NULLS) OVER w AS disp, COALESCE(LAST_VALUE(sofr IGNORE NULLS) OVER w, 0) AS sofr FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT * FROM f WHERE disp IS NOT NULL")
def macro_frame(spark, sf_dir):
    state = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.max("o_totalprice"), 2).alias("vix"))
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_suppkey % 3 = 0").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    disp = l.agg(F.round(F.max("l_extendedprice"), 2).alias("disp"), F.max(F.when(F.year("l_shipdate") > 1996, F.col("l_quantity"))).alias("sofr"))
    return L.macro_frame(state, disp, ["sofr"])


@query("lagged_candidates", "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem), o AS (SELECT CAST(o_orderdate AS DATE) AS dt, ROUND(MAX(o_totalprice), 2) AS v FROM orders GROUP BY 1) SELECT dt, LAG(v) OVER (ORDER BY dt) AS term, NULL::DOUBLE AS oas FROM d LEFT JOIN o USING (dt)")
def lagged_candidates(spark, sf_dir):
    rates = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.max("o_totalprice"), 2).alias("T10Y2Y"))
    return L.lagged_candidates(rates, table(spark, sf_dir, "lineitem").select("l_shipdate"), {"term": ["t10y2y", "term_spread"], "oas": ["bamlh0a0hym2"]})


@query("decimal_factors", "SELECT CAST(o_orderdate AS DATE) AS date, ROUND(MAX(o_totalprice) / 100, 4) AS \"Mkt-RF\", ROUND(MIN(o_totalprice) / 100, 4) AS \"SMB\" FROM orders GROUP BY 1")
def decimal_factors(spark, sf_dir):
    ff = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("Mkt-RF"), F.min("o_totalprice").alias("SMB"))
    made = L.decimal_factors(ff, ["Mkt-RF", "SMB"])
    return made.select("date", F.round("`Mkt-RF`", 4).alias("Mkt-RF"), F.round("SMB", 4).alias("SMB"))


_RQ = "rq AS (SELECT CAST(l_shipdate AS DATE) AS date, CASE l_linenumber WHEN 1 THEN 'two' WHEN 2 THEN 'ten' ELSE 'sofr' END AS ric, MAX(l_quantity) AS y, CASE WHEN l_linenumber = 3 AND MAX(l_quantity) > 30 THEN MAX(l_tax) END AS f, MIN(l_orderkey) AS asof_ts FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey % 10 = 1 GROUP BY 1, 2, l_linenumber)"


@query("rates_overlay", f"WITH {_RQ}, w AS (SELECT date, MAX(CASE WHEN ric = 'two' THEN y END) AS us2y, MAX(CASE WHEN ric = 'ten' THEN y END) AS us10y, MAX(CASE WHEN ric = 'sofr' THEN COALESCE(f, y) END) AS sofr, MIN(asof_ts) AS rates_asof FROM rq GROUP BY 1), r AS (SELECT CAST(o_orderdate AS DATE) AS date, ROUND(MAX(o_totalprice), 2) AS dtb3 FROM orders GROUP BY 1) SELECT date, dtb3, us2y, us10y, sofr, rates_asof FROM r FULL JOIN w USING (date)")
def rates_overlay(spark, sf_dir):
    n = F.col("l_linenumber")
    q = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3 and l_suppkey % 10 = 1").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.when(n == 1, "two").when(n == 2, "ten").otherwise("sofr").alias("ric"))
    quotes = q.agg(F.max("l_quantity").alias("YLDTOMAT"), F.when((F.first("l_linenumber") == 3) & (F.max("l_quantity") > 30), F.max("l_tax")).alias("FIXING_1"), F.min("l_orderkey").alias("asof_ts"))
    rates = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.max("o_totalprice"), 2).alias("dtb3"), F.lit(0).alias("us2y"))
    return L.rates_overlay(rates, quotes, {"two": ("us2y", False), "ten": ("us10y", False), "sofr": ("sofr", True)})


_IND = ", ".join(f"({c}, '{name}')" for name, codes in K.INDUSTRY_SECTORS.items() for c in codes)


@query("industry_sectors", f"WITH m AS (SELECT * FROM (VALUES {_IND}) v(c, sector)) SELECT p_partkey, sector, CASE p_size % 4 WHEN 0 THEN 'health_care' WHEN 1 THEN 'utilities_real_estate' WHEN 2 THEN 'info_tech' END AS named FROM part LEFT JOIN m ON c = p_partkey % 90 + 10")
def industry_sectors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("SIC "), (F.col("p_partkey") % 90 + 10).cast("string"), F.lit("34"))
    k = F.col("p_size") % 4
    name = F.when(k == 0, " Health Care").when(k == 1, "REAL ESTATE").when(k == 2, "Information technology ").otherwise("none")
    return p.select("p_partkey", K.industry_sector(code).alias("sector"), K.class_sector(name).alias("named"))


def _view(spark, sf_dir, *names):
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(f"remote_{n}")


@query("remote_statements", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_custkey IN (1, 2, 3, 5, 8, 13, 21) AND o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1999-12-31'")
def remote_statements(spark, sf_dir):
    _view(spark, sf_dir, "orders")
    return spark.sql(L.select_sql("remote_orders", ["o_orderkey", "o_custkey", "o_totalprice"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ("o_custkey", [1, 2, 3, 5, 8, 13, 21]), ("o_orderdate", "1996-01-01", "1999-12-31")))


@query("remote_links", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_name IN ('Supplier#000000003', 'Supplier#3', 'it''s') OR s_nationkey IN (3, 4)")
def remote_links(spark, sf_dir):
    _view(spark, sf_dir, "supplier")
    one = spark.sql(L.links_sql("remote_supplier", ["s_suppkey", "s_nationkey"], ("s_name", "x"), ["Supplier#000000003", "Supplier#3", "it's"]))
    return one.union(spark.sql(L.links_sql("remote_supplier", ["s_suppkey", "s_nationkey"], ("s_nationkey", "x"), [3, 4]))).distinct()


@query("remote_years", "SELECT o_orderkey, o_orderdate FROM orders WHERE YEAR(o_orderdate) IN (1996, 1998) AND o_custkey IN (10, 11, 12) AND o_totalprice > 1000")
def remote_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    for y in (1996, 1998):
        o.where(F.year("o_orderdate") == y).createOrReplaceTempView(f"remote_orders{y}")
    return spark.sql(L.yearly_sql("remote_orders", [1996, 1998], ["o_orderkey", "o_orderdate"], ("o_custkey", [10, 11, 12]), "o_totalprice > 1000"))


@query("landed_head", """SELECT o_orderstatus AS stem, MEDIAN(o_totalprice) AS median_price, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS n_large, COUNT(DISTINCT o_orderpriority)::INT AS kinds, MAX(c)::BIGINT AS most FROM (SELECT *, COUNT(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS c FROM orders) GROUP BY 1""")
def landed_head(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = S.head_summary(o, ["o_orderstatus"], {"median_price": "o_totalprice"}, {"n_large": F.col("o_totalprice") > 200000}, "o_orderpriority")
    return made.select(F.col("o_orderstatus").alias("stem"), "median_price", "n", "n_large", F.size("counts").alias("kinds"), F.array_max(F.map_values("counts")).alias("most"))


@query("bridge_coverage", "SELECT (SELECT COUNT(*) FROM customer) AS total, (SELECT COUNT(*) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)) AS bridged, ROUND((SELECT COUNT(*) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)) / (SELECT COUNT(*) FROM customer)::DOUBLE, 8) AS share")
def bridge_coverage(spark, sf_dir):
    return tidy(S.bridge_coverage(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), ["k"]), 8)


@query("universe_count", f"{P} SELECT YEAR(dt)::INT AS year, COUNT(DISTINCT entity) AS names, MIN(dt) AS first, MAX(dt) AS last FROM p GROUP BY 1")
def universe_count(spark, sf_dir):
    return panel_frame(spark, sf_dir).groupBy(F.year("dt").alias("year")).agg(F.countDistinct("entity").alias("names"), F.min("dt").alias("first"), F.max("dt").alias("last"))


@query("sector_one_hot", f"{P}, g AS (SELECT entity, entity % 9 AS grp, COUNT(*) AS n FROM p GROUP BY 1), t AS (SELECT grp, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, grp) AS k FROM g GROUP BY 1 ORDER BY COUNT(*) DESC, grp LIMIT 4) SELECT entity, " + ", ".join(f"CAST(COALESCE(k = {i}, FALSE) AS INT) AS g{i}" for i in range(1, 5)) + " FROM g LEFT JOIN t USING (grp)")
def sector_one_hot(spark, sf_dir):
    e = panel_frame(spark, sf_dir).select("entity").distinct().withColumn("grp", F.col("entity") % 9)
    made = S.one_hot(e, "grp", 4)
    return made.select("entity", *(F.col(f"grp_{i}").alias(f"g{i + 1}") for i in range(4)))
