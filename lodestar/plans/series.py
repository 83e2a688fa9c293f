"""Queries of time-series windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.operators import cross_section as X
from lodestar.operators import reshape as S
from lodestar.panel import PANEL, ratio
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import gate, panel_frame, query, tidy, win

E = "(PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
HV21 = f"{gate('STDDEV_SAMP(r)', 'r', 21, 10)} * SQRT(252.0)"


@query("flagship_long_short", f"""{P}, v AS (SELECT entity, dt, r, {HV21} AS hv FROM p),
z AS (SELECT *, hv AS x FROM v),
k AS (SELECT *, COUNT(x) OVER (PARTITION BY dt) AS c, ROW_NUMBER() OVER (PARTITION BY dt, x IS NULL ORDER BY x, entity) AS rk, LEAD(r) OVER (PARTITION BY entity ORDER BY dt) AS label FROM z),
w AS (SELECT *, GREATEST(FLOOR(c / 5.0), 1) AS m FROM k),
l AS (SELECT dt, label, CASE WHEN x IS NULL OR c < 10 THEN 0.0 WHEN rk > c - m THEN 1.0 / m WHEN rk <= m THEN -1.0 / m ELSE 0.0 END AS wt FROM w)
SELECT dt, ROUND(SUM(wt * COALESCE(label, 0.0)), 6) + 0.0 AS pnl, CAST(COUNT(*) FILTER (WHERE wt <> 0) AS BIGINT) AS names FROM l GROUP BY dt""")
def flagship(spark, sf_dir):
    df = panel_frame(spark, sf_dir)
    df = df.withColumns({"hv": R.volatility(F.col("r"), 21), "label": F.lead("r").over(PANEL.series)})
    return tidy(X.long_short(df, "hv", "label"))


@query("rolling_returns", f"""{P} SELECT entity, dt, ROUND({gate('SUM(LN(1 + r))', 'r', 5, 5)}, 6) + 0.0 AS lr5, ROUND({gate('SUM(LN(1 + r))', 'r', 21, 21)}, 6) + 0.0 AS lr21,
ROUND(EXP({gate('SUM(LN(1 + r))', 'r', 63, 63)}) - 1, 5) + 0.0 AS rel63, ROUND({gate('SUM(LN(1 + r))', 'r', 231, 231, 21)}, 6) + 0.0 AS mom_12_1,
ROUND(EXP({gate('SUM(LN(1 + r))', 'r', 252, 252)} - {gate('SUM(LN(1 + r))', 'r', 21, 21)}) - 1, 5) + 0.0 AS mom_ratio FROM p""")
def rolling_returns(spark, sf_dir):
    r = F.col("r")
    df = panel_frame(spark, sf_dir).select("entity", "dt", R.log_return(r, 5).alias("lr5"), R.log_return(r, 21).alias("lr21"), R.price_relative(r, 63).alias("rel63"), R.momentum_12_1(r).alias("mom_12_1"), R.momentum_by_ratio(r).alias("mom_ratio"))
    return tidy(df, rel63=5, mom_ratio=5)


@query("rolling_volatility", f"""{P}, v AS (SELECT entity, dt, {HV21} AS hv21, {gate('STDDEV_SAMP(r)', 'r', 63, 31)} * SQRT(252.0) AS hv63, {gate('STDDEV_POP(r)', 'r', 252, 20, 1, False)} AS past FROM p)
SELECT entity, dt, ROUND(hv21, 5) AS hv21, ROUND(hv63, 5) AS hv63, ROUND(past, 6) AS past, ROUND({gate('STDDEV_SAMP(hv21)', 'hv21', 21, 10)}, 5) AS vov FROM v""")
def rolling_volatility(spark, sf_dir):
    year = 252**0.5
    df = R.trailing(panel_frame(spark, sf_dir), {"hv21": R.Feature("sd", "r", 21, 10, scale=year), "hv63": R.Feature("sd", "r", 63, 31, scale=year), "past": R.Feature("sd", "r", 252, 20, ddof=0, full=False, shift=1)})
    return tidy(R.trailing(df, {"vov": R.Feature("sd", "hv21", 21, 10)}, ["hv21", "hv63", "past"]), 5, past=6)


@query("range_volatility", f"""{P}, d AS (SELECT *, POWER(LN(hi / lo), 2) / (4 * LN(2.0)) AS pk, 0.5 * POWER(LN(hi / lo), 2) - (2 * LN(2.0) - 1) * POWER(LN(px / op), 2) AS gk,
LN(hi / px) * LN(hi / op) + LN(lo / px) * LN(lo / op) AS rs, LN(op / LAG(px) OVER (PARTITION BY entity ORDER BY dt)) AS overnight, LN(px / op) AS intraday FROM p)
SELECT entity, dt, ROUND({gate('AVG(pk)', 'pk', 21, 10)}, 6) AS parkinson, ROUND({gate('AVG(gk)', 'gk', 21, 10)}, 6) + 0.0 AS garman_klass, ROUND({gate('AVG(rs)', 'rs', 21, 10)}, 6) + 0.0 AS rogers_satchell,
ROUND(SQRT(GREATEST({gate('VAR_SAMP(overnight)', 'overnight', 21, 10)} + (0.34 / (1.34 + 22.0 / 20.0)) * {gate('VAR_SAMP(intraday)', 'intraday', 21, 10)} + (1 - 0.34 / (1.34 + 22.0 / 20.0)) * {gate('AVG(rs)', 'rs', 21, 10)}, CASE WHEN COUNT(*) OVER {win(21)} = 21 AND COUNT(overnight) OVER {win(21)} >= 10 THEN 0.0 END)) * SQRT(252.0), 4) AS yang_zhang FROM d""")
def range_volatility(spark, sf_dir):
    o, h, l, c = (F.col(x) for x in ("op", "hi", "lo", "px"))
    df = panel_frame(spark, sf_dir).withColumns({"pk": R.parkinson(h, l), "gk": R.garman_klass(o, h, l, c), "rs": R.rogers_satchell(o, h, l, c), "overnight": F.ln(ratio(o, F.lag("px").over(PANEL.series))), "intraday": F.ln(c / o)})
    mean = lambda x: R.gated(F.col(x), 21, R.mean, "half")
    yz = R.yang_zhang(F.col("overnight"), F.col("intraday"), F.col("rs"))
    within = R.Trailing(F.col("overnight"), 21)
    ready, full = within.n >= 10, within.full
    return tidy(df.select("entity", "dt", mean("pk").alias("parkinson"), mean("gk").alias("garman_klass"), mean("rs").alias("rogers_satchell"), F.when(ready & full, yz).alias("yang_zhang")), yang_zhang=4)


@query("liquidity_features", f"""{P} SELECT entity, dt, ROUND({gate('AVG(ABS(r) / NULLIF(value, 0))', '(ABS(r) / NULLIF(value, 0))', 21, 1)} * 1e6, 5) AS amihud, ROUND({gate('AVG(value)', 'value', 21, 1)}, 2) AS adv,
ROUND({gate('AVG(spread)', 'spread', 21, 21)}, 6) AS spread21, ROUND({gate('MAX(r)', 'r', 21, 1)}, 6) + 0.0 AS max21, ROUND({gate('MIN(r)', 'r', 21, 1)}, 6) + 0.0 AS min21 FROM p""")
def liquidity_features(spark, sf_dir):
    df, r = panel_frame(spark, sf_dir), F.col("r")
    return tidy(df.select("entity", "dt", (R.amihud(r, F.col("value")) * 1e6).alias("amihud"), R.gated(F.col("value"), 21, R.mean, "any").alias("adv"), R.gated(F.col("spread"), 21, R.mean).alias("spread21"), R.extreme(r, 21).alias("max21"), R.extreme(r, 21, False).alias("min21")), amihud=5, adv=2)


@query("power_moments", f"""{P}, s AS (SELECT entity, dt, COUNT(r) OVER w AS c, COUNT(*) OVER w AS rows, SUM(r) OVER w AS t1, SUM(r*r) OVER w AS t2, SUM(r*r*r) OVER w AS t3, SUM(r*r*r*r) OVER w AS t4, STDDEV_SAMP(r) OVER w AS sd FROM p WINDOW w AS {win(63)}),
m AS (SELECT *, t1 / c AS s1, t2 / c AS s2, t3 / c AS s3, t4 / c AS s4 FROM s WHERE c > 0)
SELECT entity, dt, CASE WHEN c = 63 AND rows = 63 AND sd > 1e-12 THEN ROUND((s3 - 3*s1*s2 + 2*s1*s1*s1) / POWER(sd, 3), 4) + 0.0 END AS skew, CASE WHEN c = 63 AND rows = 63 AND sd > 1e-12 THEN ROUND((s4 - 4*s1*s3 + 6*s1*s1*s2 - 3*s1*s1*s1*s1) / POWER(sd, 4), 4) END AS kurt FROM m""")
def power_moments(spark, sf_dir):
    df = R.trailing(panel_frame(spark, sf_dir), {"skew": R.Feature("skew", "r", 63, 63), "kurt": R.Feature("kurt", "r", 63, 63), "some": R.Feature("mean", "r", 63, 1, full=False)})
    return tidy(df.where("some is not null").drop("some"), 4)


@query("betas", f"""{P}, k AS (SELECT entity, dt, r, AVG(r) OVER (PARTITION BY dt) AS m FROM p), b AS (SELECT entity, dt, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL THEN m END AS y FROM k),
c AS (SELECT *, CASE WHEN y < 0 THEN x END AS xd, CASE WHEN y < 0 THEN y END AS yd, CASE WHEN y > 0 THEN x END AS xu, CASE WHEN y > 0 THEN y END AS yu FROM b),
f AS (SELECT entity, dt, CASE WHEN COUNT(x) OVER w >= 21 THEN COVAR_SAMP(x, y) OVER w / NULLIF(VAR_SAMP(y) OVER w, 0) END AS beta, CASE WHEN COUNT(xd) OVER w >= 5 THEN COVAR_SAMP(xd, yd) OVER w / NULLIF(VAR_SAMP(yd) OVER w, 0) END - CASE WHEN COUNT(xu) OVER w >= 5 THEN COVAR_SAMP(xu, yu) OVER w / NULLIF(VAR_SAMP(yu) OVER w, 0) END AS asym FROM c WINDOW w AS {win(63)})
SELECT entity, dt, ROUND(beta, 4) + 0.0 AS beta, ROUND(asym, 3) + 0.0 AS asym FROM f""")
def betas(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("m", F.avg("r").over(PANEL.section))
    side = lambda k: R.Feature("beta", "r", 63, 5, "m", full=False, side=k)
    made = R.trailing(df, {"beta": R.Feature("beta", "r", 63, 21, "m", full=False), "down": side(-1), "up": side(1)})
    return tidy(made.select("entity", "dt", "beta", (F.col("down") - F.col("up")).alias("asym")), 4, asym=3)


@query("time_series_z", f"""{P} SELECT entity, dt, CASE WHEN COUNT(px) OVER {win(252)} >= 50 AND STDDEV_POP(px) OVER {win(252)} >= 1e-12 THEN ROUND((px - AVG(px) OVER {win(252)}) / STDDEV_POP(px) OVER {win(252)}, 5) + 0.0 END AS z252,
CASE WHEN COUNT(px) OVER {E} < 2 THEN NULL WHEN STDDEV_POP(px) OVER {E} < 1e-12 THEN 0.0 ELSE ROUND(LEAST(GREATEST((px - AVG(px) OVER {E}) / STDDEV_POP(px) OVER {E}, -3.0), 3.0), 5) + 0.0 END AS zexp FROM p""")
def time_series_z(spark, sf_dir):
    return tidy(panel_frame(spark, sf_dir).select("entity", "dt", R.rolling_z(F.col("px")).alias("z252"), R.expanding_z(F.col("px")).alias("zexp")), 5)


@query("history_ranks", f"""{P} SELECT entity, dt, px > QUANTILE_CONT(px, 0.9) OVER {E} AS above, ROUND((px - MIN(px) OVER {win(63)}) / NULLIF(MAX(px) OVER {win(63)} - MIN(px) OVER {win(63)}, 0), 6) AS place FROM p""")
def history_ranks(spark, sf_dir):
    marked = R.expanding_quantile(panel_frame(spark, sf_dir), "px", 0.9)
    return tidy(marked.select("entity", "dt", (F.col("px") > F.col("threshold")).alias("above"), R.rank_in_history(F.col("px"), 63).alias("place")))


@query("entity_drawdown", f"""{P}, c AS (SELECT entity, dt, SUM(COALESCE(r, 0)) OVER {E} AS cum FROM p) SELECT entity, dt, ROUND(cum - MAX(cum) OVER {E}, 5) + 0.0 AS drawdown FROM c""")
def entity_drawdown(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("cum", F.sum(F.coalesce("r", F.lit(0.0))).over(PANEL.expanding()))
    return tidy(df.select("entity", "dt", R.drawdown(F.col("cum")).alias("drawdown")), 5)


@query("differences_and_fills", f"""{P}, s0 AS (SELECT entity, dt, n, px / 7.1::DOUBLE AS px FROM p), s AS (SELECT *, CASE WHEN n >= 2 THEN px END AS sparse FROM s0) SELECT entity, dt, ROUND(px - LAG(px, 1) OVER o, 6) + 0.0 AS d1, ROUND(px - LAG(px, 5) OVER o, 6) + 0.0 AS d5, ROUND(px - LAG(px, 21) OVER o, 6) + 0.0 AS d21,
ROUND(LAST_VALUE(sparse IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled, ROUND(LAST_VALUE(sparse IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS filled5 FROM s WINDOW o AS (PARTITION BY entity ORDER BY dt)""")
def differences_and_fills(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("px", F.col("px") / 7.1).withColumn("sparse", F.when(F.col("n") >= 2, F.col("px")))
    return tidy(df.select("entity", "dt", *(R.change("px", k).alias(f"d{k}") for k in (1, 5, 21)), R.forward_fill("sparse").alias("filled"), R.forward_fill("sparse", 5).alias("filled5")))


@query("trailing_yield", f"""{P} SELECT entity, dt, CASE WHEN ROW_NUMBER() OVER (PARTITION BY entity ORDER BY dt) >= 21 THEN ROUND(SUM(COALESCE(disc, 0.0)) OVER {win(252)} / NULLIF(px, 0), 8) END AS yield FROM p""")
def trailing_yield(spark, sf_dir):
    return tidy(panel_frame(spark, sf_dir).select("entity", "dt", R.trailing_yield(F.col("disc"), F.col("px")).alias("yield")), 8)


@query("runs_of_gains", f"""{P}, a AS (SELECT entity, dt, COALESCE(r > 0, FALSE) AS hit, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY dt) AS i FROM p), b AS (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY entity, hit ORDER BY dt) AS run FROM a)
SELECT entity, MIN(dt) AS first, MAX(dt) AS last, COUNT(*) AS length FROM b WHERE hit GROUP BY entity, run""")
def runs_of_gains(spark, sf_dir):
    return S.islands(panel_frame(spark, sf_dir), F.col("r") > 0)


_STATE = "CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS state"


@query("state_runs", f"""{P}, a AS (SELECT entity, dt, {_STATE} FROM p), b AS (SELECT *, COALESCE(state <> LAG(state) OVER (PARTITION BY entity ORDER BY dt), FALSE) AS switched FROM a), c AS (SELECT *, SUM(CAST(switched AS INT)) OVER {E} AS run FROM b)
SELECT entity, dt, state, switched, CAST(ROW_NUMBER() OVER (PARTITION BY entity, run ORDER BY dt) AS INT) AS days_in_state FROM c""")
def state_runs(spark, sf_dir):
    df = panel_frame(spark, sf_dir).select("entity", "dt", F.when(F.col("r") > 0, "up").otherwise("down").alias("state"))
    return S.state_runs(df, "state")


@query("persistent_state", f"""{P}, a AS (SELECT entity, dt, {_STATE} FROM p), b AS (SELECT *, COALESCE(state <> LAG(state) OVER (PARTITION BY entity ORDER BY dt), FALSE) AS switched FROM a), c AS (SELECT *, SUM(CAST(switched AS INT)) OVER {E} AS run FROM b),
d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, run ORDER BY dt) AS days FROM c)
SELECT entity, dt, state, COALESCE(LAST_VALUE(CASE WHEN days >= 3 THEN state END IGNORE NULLS) OVER {E}, FIRST_VALUE(state) OVER {E}) AS label FROM d""")
def persistent_state(spark, sf_dir):
    df = panel_frame(spark, sf_dir).select("entity", "dt", F.when(F.col("r") > 0, "up").otherwise("down").alias("state"))
    return S.persistent(df, "state", 3)


@query("observation_windows", f"""{P} SELECT entity, dt, ROUND(SUM(COALESCE(r, 0) + COALESCE(disc, 0)) OVER {win(5)}, 5) + 0.0 AS total, CAST(10 AS INT) AS size FROM p QUALIFY COUNT(*) OVER {win(5)} = 5""")
def observation_windows(spark, sf_dir):
    df = S.observation(panel_frame(spark, sf_dir), ["r", "disc"], 5).where("observation is not null")
    return tidy(df.select("entity", "dt", F.aggregate("observation", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("observation").alias("size")), 5)


@query("sampling_dates", f"""{P}, d AS (SELECT DISTINCT dt FROM p) SELECT dt, dt = MAX(dt) OVER (PARTITION BY DATE_TRUNC('month', dt)) AS month_end, dt = MAX(dt) OVER (PARTITION BY DATE_TRUNC('week', dt)) AS week_end, (ROW_NUMBER() OVER (ORDER BY dt) - 1) % 63 = 0 AS rebalance FROM d""")
def sampling_dates(spark, sf_dir):
    df = panel_frame(spark, sf_dir).select("dt").distinct()
    return df.select("dt", S.last_of("month").alias("month_end"), S.last_of("week").alias("week_end"), S.every_nth("dt", 63).alias("rebalance"))
