"""Queries of regimes, breadth, optimised weights and other operators with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import reshape as S
from lodestar.operators import sequential as G
from lodestar.panel import PANEL, Panel, correlation
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import panel_frame, query, table, tidy, win
from lodestar.plans.sections import _NATION, _grouped

_MK = f"{P}, m AS (SELECT entity, dt, r, AVG(r) OVER (PARTITION BY dt) AS mk FROM p)"


def _rebalances(spark, sf_dir):
    """Every 63rd date, the quarterly cadence."""
    dates = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("dt")).distinct()
    return dates.withColumn("keep", S.every_nth("dt", 63)).where("keep").select("dt")


@query("residual_volatility", f"""{_MK}, b AS (SELECT entity, dt, CASE WHEN r IS NOT NULL AND mk IS NOT NULL THEN r END AS a, CASE WHEN r IS NOT NULL THEN mk END AS b FROM m), f AS (SELECT entity, dt, COUNT(a) OVER w AS n, VAR_POP(a) OVER w - POWER(COVAR_POP(a, b) OVER w, 2) / NULLIF(VAR_POP(b) OVER w, 0) AS rest FROM b WINDOW w AS {win(63)})
SELECT entity, dt, CASE WHEN n = 63 THEN ROUND(SQRT(GREATEST(rest, 0.0) * n / (n - 1)) * SQRT(252.0), 4) END AS ivol FROM f""")
def residual_volatility(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("mk", F.avg("r").over(PANEL.section))
    return tidy(df.select("entity", "dt", G.residual_volatility(F.col("r"), F.col("mk")).alias("ivol")), 4)


@query("past_percentile", f"{P}, f AS (SELECT entity, dt, value AS spread FROM p), g AS (SELECT a.entity, a.dt, COUNT(b.dt) AS n, COUNT(*) FILTER (WHERE b.spread <= a.spread) AS k FROM f a LEFT JOIN f b ON a.entity = b.entity AND b.dt < a.dt GROUP BY 1, 2) SELECT entity, dt, ROUND(k / NULLIF(n, 0)::DOUBLE, 8) AS percentile FROM g")
def past_percentile(spark, sf_dir):
    return tidy(G.past_percentile(panel_frame(spark, sf_dir), "value").withColumn("percentile", F.nanvl("percentile", F.lit(None).cast("double"))), 8)


_PCT = "(SELECT COUNT(*) FILTER (WHERE b.{x} <= a.{x}) / NULLIF(COUNT(b.{x}), 0)::DOUBLE FROM d b WHERE b.dt < a.dt)"


@query("regime_labels", f"""{P}, d AS (SELECT dt, STDDEV_POP(r) AS x, MAX(hi) AS y, ROW_NUMBER() OVER (ORDER BY dt) AS i FROM p GROUP BY dt), s AS (SELECT dt, CASE WHEN i <= 252 THEN 'calm' WHEN x IS NOT NULL AND {_PCT.format(x='x')} >= 0.85 THEN 'crisis' WHEN {_PCT.format(x='y')} >= 0.70 THEN 'inflationary' ELSE 'calm' END AS state FROM d a),
w AS (SELECT *, COALESCE(state <> LAG(state) OVER (ORDER BY dt), FALSE) AS sw FROM s), c AS (SELECT *, SUM(CAST(sw AS INT)) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM w), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY dt) AS days FROM c)
SELECT dt, state, COALESCE(LAST_VALUE(CASE WHEN days >= 10 THEN state END IGNORE NULLS) OVER e, FIRST_VALUE(state) OVER e) AS label FROM n WINDOW e AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def regime_labels(spark, sf_dir):
    """Crisis, inflationary or calm by past percentiles of the day's dispersion and highest price; ten rows in a row to switch."""
    daily = panel_frame(spark, sf_dir).groupBy("dt").agg(F.stddev_pop("r").alias("x"), F.max("hi").alias("y")).withColumn("entity", F.lit(0))
    pan = Panel()
    px, py = G.past_percentile(daily, "x", "px", pan), G.past_percentile(daily, "y", "py", pan)
    joined = px.join(py, ["entity", "dt"])
    state = F.when(F.col("px") >= 0.85, "crisis").when(F.col("py") >= 0.70, "inflationary").otherwise("calm")
    order = F.row_number().over(pan.series)
    return S.persistent(joined.select("entity", "dt", F.when(order <= 252, "calm").otherwise(state).alias("state")), "state", 10).select("dt", "state", "label")


@query("sector_returns", f"{P}, {_NATION}, a AS (SELECT dt, grp % 5 AS sector, CASE WHEN COUNT(r) >= 3 THEN AVG(r) END AS v FROM g GROUP BY 1, 2) SELECT dt, " + ", ".join(f"ROUND(MAX(v) FILTER (WHERE sector = {k}), 6) + 0.0 AS sector_{k}" for k in range(5)) + " FROM a GROUP BY dt")
def sector_returns(spark, sf_dir):
    means = _grouped(spark, sf_dir).groupBy("dt", (F.col("grp") % 5).alias("sector")).agg(F.when(F.count("r") >= 3, F.avg("r")).alias("v"))
    return tidy(S.wide(means, "dt", "sector", "v", list(range(5)), "sector"))


@query("signal_refresh", f"{P}, l AS (SELECT dt, spread, LAG(spread) OVER (PARTITION BY entity ORDER BY dt) AS y FROM p) SELECT dt, ROUND(COVAR_POP(spread, y) / NULLIF(STDDEV_POP(spread) * STDDEV_POP(y), 0), 6) + 0.0 AS ar1, COUNT(y) AS n FROM l WHERE y IS NOT NULL GROUP BY dt HAVING COUNT(y) >= 5")
def signal_refresh(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("y", F.lag("spread").over(PANEL.series)).where("y is not null")
    return tidy(df.groupBy("dt").agg(correlation("spread", "y").alias("ar1"), F.count("y").alias("n")).where("n >= 5"))


@query("turbulence")
def turbulence(spark, sf_dir):
    return tidy(G.turbulence(panel_frame(spark, sf_dir), "r"))


@query("residual_momentum")
def residual_momentum(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("mk", F.avg("r").over(PANEL.section))
    return tidy(G.rolling_regression(df, "r", ["mk", "spread"], 126))


def _online(method: str):
    return lambda spark, sf_dir: tidy(G.online_portfolio(panel_frame(spark, sf_dir), "r", method=method))


def _optimal(method: str):
    return lambda spark, sf_dir: tidy(G.optimised(panel_frame(spark, sf_dir), "r", _rebalances(spark, sf_dir), method))


for _m in ("eg", "pamr", "olmar", "universal"):
    query(f"online_{_m}")(_online(_m))
for _m in ("min_variance", "max_diversification", "mean_variance", "hierarchical"):
    query(f"weights_{_m}")(_optimal(_m))


query("online_bah", f"{P}, d AS (SELECT DISTINCT dt FROM p), e AS (SELECT DISTINCT entity FROM p), g AS (SELECT d.dt, e.entity, COALESCE(p.r, 0) AS r FROM d CROSS JOIN e LEFT JOIN p ON p.dt = d.dt AND p.entity = e.entity), w AS (SELECT dt, entity, EXP(COALESCE(SUM(LN(1 + r)) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS v FROM g) SELECT dt, entity, ROUND(v / SUM(v) OVER (PARTITION BY dt), 6) AS weight FROM w")(_online("bah"))


@query("dynamic_universe")
def dynamic_universe(spark, sf_dir):
    return G.spread_out(panel_frame(spark, sf_dir), "r", _rebalances(spark, sf_dir))
