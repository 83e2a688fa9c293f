"""Queries of point-in-time joins and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import pit as T
from lodestar.operators import screens as C
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import panel_frame, query, table, tidy


def _events(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


@query("asof_by_key", """SELECT c.event_id, c.user_id, c.ts, e.value AS rate FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2) e ON c.user_id = e.user_id AND c.ts >= e.ts""")
def asof_by_key(spark, sf_dir):
    left = _events(spark, sf_dir, "click").select("event_id", "user_id", "ts")
    return T.asof_join(left, _events(spark, sf_dir, "error").select("user_id", "ts", F.col("value").alias("rate")), "ts", ["user_id"], ["rate"])


@query("asof_strict_tolerance", """SELECT c.event_id, c.user_id, c.ts, CASE WHEN DATE_DIFF('day', CAST(e.ts AS DATE), CAST(c.ts AS DATE)) <= 2 THEN e.value END AS rate FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2) e ON c.user_id = e.user_id AND c.ts > e.ts""")
def asof_strict_tolerance(spark, sf_dir):
    left = _events(spark, sf_dir, "click").select("event_id", "user_id", "ts")
    return T.asof_join(left, _events(spark, sf_dir, "error").select("user_id", "ts", F.col("value").alias("rate")), "ts", ["user_id"], ["rate"], strict=True, tolerance=2)


_RATE = "rate AS (SELECT CAST(o_orderdate AS DATE) AS day, ROUND(MAX(o_totalprice), 2) AS rf FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1)"


def _rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.max("o_totalprice"), 2).alias("rf"))


@query("asof_series", f"{P}, {_RATE} SELECT p.entity, p.dt, rate.rf, rate.day AS stamp FROM p ASOF LEFT JOIN rate ON p.dt >= rate.day")
def asof_series(spark, sf_dir):
    left = panel_frame(spark, sf_dir).select("entity", "dt")
    return T.asof_series(left, _rates(spark, sf_dir), "dt", ["rf"], "day", stamp="stamp")


@query("publication_lag", f"{P}, {_RATE}, a AS (SELECT day + 14 AS available, rf FROM rate) SELECT p.entity, p.dt, a.rf FROM p ASOF LEFT JOIN a ON p.dt >= a.available")
def publication_lag(spark, sf_dir):
    releases = T.lagged(_rates(spark, sf_dir), "day", 14).drop("day")
    return T.asof_join(panel_frame(spark, sf_dir).select("entity", "dt"), releases, "dt", None, ["rf"], "available")


_CUST = "c AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS dt, MAX(o_totalprice) AS price FROM orders GROUP BY 1, 2)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("dt")).agg(F.max("o_totalprice").alias("price"))


@query("nearest_within_days", f"""WITH {_CUST}, o AS (SELECT k, dt, price FROM c WHERE price > 300000), l AS (SELECT k, dt FROM c WHERE price <= 300000),
m AS (SELECT l.k, l.dt, o.price AS near_price, DATE_DIFF('day', l.dt, o.dt) AS off, ROW_NUMBER() OVER (PARTITION BY l.k, l.dt ORDER BY ABS(DATE_DIFF('day', l.dt, o.dt)), o.dt) AS rn FROM l JOIN o ON l.k = o.k AND ABS(DATE_DIFF('day', l.dt, o.dt)) <= 60)
SELECT l.k, l.dt, near_price, CAST(off AS INT) AS days_off FROM l LEFT JOIN m ON l.k = m.k AND l.dt = m.dt AND rn = 1""")
def nearest_within_days(spark, sf_dir):
    c = _orders(spark, sf_dir)
    return T.nearest_join(c.where("price <= 300000").select("k", "dt"), c.where("price > 300000").withColumnRenamed("price", "near_price"), "dt", ["k"], ["near_price"], 60)


@query("value_a_year_ago", f"""WITH {_CUST}, m AS (SELECT a.k, a.dt, b.price AS past, ROW_NUMBER() OVER (PARTITION BY a.k, a.dt ORDER BY ABS(DATE_DIFF('day', a.dt, b.dt + 365)), b.dt) AS rn FROM c a JOIN c b ON a.k = b.k AND ABS(DATE_DIFF('day', a.dt, b.dt + 365)) <= 90)
SELECT c.k, c.dt, c.price, m.past AS price_year_ago FROM c LEFT JOIN m ON c.k = m.k AND c.dt = m.dt AND rn = 1""")
def value_a_year_ago(spark, sf_dir):
    return T.value_a_year_ago(_orders(spark, sf_dir), "k", "dt", "price")


_LINKS = "links AS (SELECT k, dt AS start_date, LEAD(dt) OVER (PARTITION BY k ORDER BY dt) AS end_date, price AS score FROM c)"


def _links(spark, sf_dir):
    from pyspark.sql import Window

    c = _orders(spark, sf_dir)
    return c.select("k", F.col("dt").alias("start_date"), F.lead("dt").over(Window.partitionBy("k").orderBy("dt")).alias("end_date"), F.col("price").alias("score"))


@query("interval_link", f"""WITH {_CUST}, {_LINKS}, m AS (SELECT c.k, c.dt, l.start_date, l.end_date, l.score, ROW_NUMBER() OVER (PARTITION BY c.k, c.dt ORDER BY l.score DESC, l.start_date) AS rn FROM c LEFT JOIN links l ON c.k = l.k AND c.dt >= l.start_date AND (l.end_date IS NULL OR c.dt <= l.end_date)) SELECT k, dt, start_date, end_date, score FROM m WHERE rn = 1""")
def interval_link(spark, sf_dir):
    left = _orders(spark, sf_dir).select("k", "dt")
    return T.interval_join(left, _links(spark, sf_dir), "k", "dt", "start_date", "end_date", [F.desc("r.score"), F.col("r.start_date")])


@query("membership_expanded", f"""WITH {_CUST}, {_LINKS}, cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
SELECT DISTINCT cal.dt, k AS member FROM cal JOIN links ON cal.dt >= start_date AND cal.dt <= COALESCE(end_date, (SELECT MAX(dt) FROM cal)) WHERE score > 400000""")
def membership_expanded(spark, sf_dir):
    members = _links(spark, sf_dir).where("score > 400000").withColumnRenamed("k", "member")
    return T.expand_membership(_rates(spark, sf_dir).select(F.col("day").alias("dt")), members, "dt", "member", "start_date", "end_date")


@query("members_at", f"WITH {_CUST}, {_LINKS} SELECT DISTINCT k AS member FROM links WHERE start_date <= DATE '1998-06-30' AND (end_date IS NULL OR end_date >= DATE '1998-06-30')")
def members_at(spark, sf_dir):
    return T.members_at(_links(spark, sf_dir).withColumnRenamed("k", "member"), F.lit("1998-06-30").cast("date"))


@query("latest_known_version", """SELECT user_id, event_type, event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_known_version(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    return T.latest_version(log, ["user_id", "event_type"], "ts", F.lit("2024-01-15 00:00:00").cast("timestamp"), ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("exact_else_asof", """SELECT c.event_id, c.user_id, c.ts, e.value AS rate FROM (SELECT * FROM events WHERE event_type = 'view') c ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type IN ('error', 'view') AND value > 5 GROUP BY 1, 2) e ON c.user_id = e.user_id AND c.ts >= e.ts""")
def exact_else_asof(spark, sf_dir):
    right = table(spark, sf_dir, "events").where("event_type in ('error', 'view')").select("user_id", "ts", F.when(F.col("value") > 5, F.col("value")).alias("rate"))
    return T.exact_else_asof(_events(spark, sf_dir, "view").select("event_id", "user_id", "ts"), right, "ts", ["user_id"], "rate")


@query("calendar_days", "SELECT CAST(d AS DATE) AS dt FROM generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY) t(d) WHERE DAYOFWEEK(d) BETWEEN 1 AND 5")
def calendar_days(spark, sf_dir):
    return T.calendar("1998-01-01", "1998-12-31", spark, True)


def _screens() -> C.Screens:
    q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return {"volume": q > 5, "tick": p >= 2000, "bounds": p / q <= 3000, "discount": d.between(0.01, 0.09), "taxed": t > 0, "flag": F.col("l_returnflag") != "R"}


_CONDS = {"volume": "l_quantity > 5", "tick": "l_extendedprice >= 2000", "bounds": "l_extendedprice / l_quantity <= 3000", "discount": "l_discount BETWEEN 0.01 AND 0.09", "taxed": "l_tax > 0", "flag": "l_returnflag <> 'R'"}
_ALL = " AND ".join(f"COALESCE({c}, FALSE)" for c in _CONDS.values())


@query("screen_attrition", "SELECT COUNT(*) AS n_base, " + ", ".join(f"COUNT(*) FILTER (WHERE NOT COALESCE({c}, FALSE)) AS fail_{k}" for k, c in _CONDS.items()) + f", COUNT(*) FILTER (WHERE {_ALL}) AS n_retained, COUNT(DISTINCT CASE WHEN {_ALL} THEN l_suppkey END) AS n_entities FROM lineitem")
def screen_attrition(spark, sf_dir):
    return C.attrition(table(spark, sf_dir, "lineitem"), _screens(), "l_suppkey")


_KEYS = list(_CONDS)
_FUNNEL = " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS stage, '{k}' AS screen, COUNT(*) FILTER (WHERE {' AND '.join(f'COALESCE({_CONDS[x]}, FALSE)' for x in _KEYS[:i]) or 'TRUE'}) AS n_in, COUNT(*) FILTER (WHERE {' AND '.join(f'COALESCE({_CONDS[x]}, FALSE)' for x in _KEYS[: i + 1])}) AS n_out FROM lineitem"
    for i, k in enumerate(_KEYS)
)


@query("screen_funnel", f"SELECT *, n_in - n_out AS n_dropped FROM ({_FUNNEL})")
def screen_funnel(spark, sf_dir):
    return C.funnel(table(spark, sf_dir, "lineitem"), _screens())


@query("screened_rows", f"SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE {_ALL} GROUP BY 1")
def screened_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(C.passes(_screens())).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


_SURF = "s AS (SELECT l_suppkey AS entity, p_size AS days, l_returnflag AS cp, CAST(ROUND(l_discount * 100) AS INT) AS delta, AVG(l_tax) + 0.1 AS vol FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"


def _surface(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_suppkey").alias("entity"), F.col("p_size").alias("days"), F.col("l_returnflag").alias("cp"), F.round(F.col("l_discount") * 100).cast("int").alias("delta")).agg((F.avg("l_tax") + 0.1).alias("vol"))


@query("calendar_arbitrage", f"""WITH {_SURF}, w AS (SELECT *, vol * vol * days / 365.0 AS tv FROM s WHERE days > 0), l AS (SELECT entity, tv, LAG(tv) OVER (PARTITION BY entity, cp, delta ORDER BY days) AS before FROM w) SELECT entity, COUNT(*) AS violations FROM l WHERE tv + 1e-8 < before GROUP BY 1""")
def calendar_arbitrage(spark, sf_dir):
    return C.calendar_violations(_surface(spark, sf_dir), ["entity"], ["cp", "delta"], "days", "vol")


_CHAIN = "c AS (SELECT l_suppkey AS entity, CAST(l_quantity AS INT) AS strike, ROUND(AVG(l_extendedprice) / 1000, 4) AS price FROM lineitem GROUP BY 1, 2)"


def _chain(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_quantity").cast("int").alias("strike")).agg(F.round(F.avg("l_extendedprice") / 1000, 4).alias("price"))


_BAD = "g AS (SELECT entity, strike AS k1, price AS c1, LEAD(strike, 1) OVER o AS k2, LEAD(price, 1) OVER o AS c2, LEAD(strike, 2) OVER o AS k3, LEAD(price, 2) OVER o AS c3 FROM c WINDOW o AS (PARTITION BY entity ORDER BY strike)), v AS (SELECT entity, COUNT(*) AS violations FROM g WHERE (k3 - k2) * c1 - (k3 - k1) * c2 + (k2 - k1) * c3 <= -1e-8 GROUP BY 1)"


@query("butterfly_arbitrage", f"WITH {_CHAIN}, {_BAD} SELECT * FROM v")
def butterfly_arbitrage(spark, sf_dir):
    return C.butterfly_violations(_chain(spark, sf_dir), ["entity"], [], "strike", "price", ["price"])


@query("without_bad_keys", f"WITH {_CHAIN}, {_BAD} SELECT entity, strike, price FROM c WHERE entity NOT IN (SELECT entity FROM v WHERE violations > 20)")
def without_bad_keys(spark, sf_dir):
    chain = _chain(spark, sf_dir)
    bad = C.butterfly_violations(chain, ["entity"], [], "strike", "price", ["price"]).where("violations > 20")
    return C.without(chain, bad, ["entity"])


@query("no_event_in_life", """WITH o AS (SELECT o_custkey AS k, o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders) SELECT o_orderkey, k, dt, NOT EXISTS (SELECT 1 FROM o b WHERE b.k = o.k AND b.dt > o.dt AND b.dt <= o.dt + 90) AS clear FROM o""")
def no_event_in_life(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("dt"))
    return C.no_later_event(o, o, "k", "dt", "dt", 90)


@query("liquidity_bands", f"""{P}, m AS (SELECT entity, MEDIAN(value) AS median FROM p GROUP BY 1), s AS (SELECT *, (RANK() OVER (ORDER BY median) + (COUNT(*) OVER (PARTITION BY median) - 1) / 2.0) / COUNT(*) OVER () AS share FROM m) SELECT entity, ROUND(median, 3) AS median, ROUND(share, 8) AS share, CASE WHEN share <= 1.0 / 3 THEN 'low' WHEN share <= 2.0 / 3 THEN 'middle' ELSE 'high' END AS band FROM s""")
def liquidity_bands(spark, sf_dir):
    return tidy(C.liquidity_bands(panel_frame(spark, sf_dir), "entity", "value"), 8, median=3)


@query("coverage_filter", f"{P} SELECT entity, ROUND(COUNT(r) / 2400.0, 8) AS coverage FROM p GROUP BY 1 HAVING COUNT(r) / 2400.0 >= 0.22")
def coverage_filter(spark, sf_dir):
    return tidy(C.coverage(panel_frame(spark, sf_dir), "entity", "r", 0.22, 2400), 8)


@query("quote_quality", "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE b IS NULL OR a IS NULL) AS missing, COUNT(*) FILTER (WHERE a < b) AS crossed, COUNT(*) FILTER (WHERE a = b) AS locked, COUNT(*) FILTER (WHERE b <= 0) AS no_bid FROM (SELECT NULLIF(l_discount, 0.05) AS b, l_tax AS a FROM lineitem)")
def quote_quality(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.nullif("l_discount", F.lit(0.05)).alias("b"), F.col("l_tax").alias("a"))
    return C.quality_counts(df, "b", "a")
