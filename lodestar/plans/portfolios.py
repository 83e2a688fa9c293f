"""Queries of weights, costs, profit and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.operators import portfolio as B
from lodestar.panel import PANEL
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import gate, panel_frame, query, tidy, win
from lodestar.plans.series import E, HV21

_W = f"{P}, w AS (SELECT *, COALESCE(value / SUM(value) OVER (PARTITION BY dt), 0.0) AS weight FROM p)"


def held(spark, sf_dir):
    """Weights by traded value."""
    return panel_frame(spark, sf_dir).withColumn("weight", B.normalised(F.col("value")))


@query("baseline_weights", f"""{P}, v AS (SELECT *, {HV21} AS hv, {gate('SUM(LN(1 + r))', 'r', 21, 21)} AS past FROM p), k AS (SELECT *, CASE WHEN hv > 1e-12 THEN 1 / hv END AS iv, COUNT(hv) OVER (PARTITION BY dt) AS nh, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY hv NULLS LAST, entity) AS rh, COUNT(past) OVER (PARTITION BY dt) AS np, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY past NULLS LAST, entity) AS rp FROM v),
l AS (SELECT *, CASE WHEN hv IS NOT NULL AND rh <= CEIL(nh / 5.0) THEN 1.0 END AS calm, FLOOR(np / 2.0) AS m FROM k)
SELECT entity, dt, ROUND(1.0 / COUNT(*) OVER (PARTITION BY dt), 8) AS ew, ROUND(COALESCE(iv / SUM(iv) OVER (PARTITION BY dt), 0), 8) AS inv_vol, ROUND(COALESCE(calm / SUM(calm) OVER (PARTITION BY dt), 0), 8) AS low_vol,
ROUND(CASE WHEN past IS NULL OR m < 1 THEN 0.0 WHEN rp <= m THEN -0.5 / m WHEN rp > np - m THEN 0.5 / m ELSE 0.0 END, 8) + 0.0 AS mom, ROUND(-CASE WHEN past IS NULL OR m < 1 THEN 0.0 WHEN rp <= m THEN -0.5 / m WHEN rp > np - m THEN 0.5 / m ELSE 0.0 END, 8) + 0.0 AS rev FROM l""")
def baseline_weights(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumns({"hv": R.volatility(F.col("r"), 21), "past": R.log_return(F.col("r"), 21)})
    return tidy(df.select("entity", "dt", B.equal(F.lit(True)).alias("ew"), B.inverse_volatility(F.col("hv")).alias("inv_vol"), B.low_volatility("hv").alias("low_vol"), B.past_sum_long("past").alias("mom"), B.past_sum_long("past", True).alias("rev")), 8)


@query("drifted_weights", f"""{P}, d AS (SELECT entity, dt, FIRST_VALUE(value) OVER {E} * EXP(COALESCE(SUM(LN(1 + COALESCE(r, 0))) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cap FROM p) SELECT entity, dt, ROUND(cap / SUM(cap) OVER (PARTITION BY dt), 7) AS weight FROM d""")
def drifted_weights(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("cap", B.drifted("value", "r"))
    return tidy(df.select("entity", "dt", B.normalised(F.col("cap")).alias("weight")), 7)


_T = f"{_W}, t AS (SELECT *, weight - COALESCE(LAG(weight) OVER (PARTITION BY entity ORDER BY dt), 0.0) AS trade FROM w)"


@query("trading_costs", f"""{_T} SELECT dt, ROUND(5.0 / 1e4 * SUM(ABS(trade)), 8) AS spread_cost, ROUND(10.0 / 1e4 * SUM(SQRT(CASE WHEN value > 0 THEN ABS(trade) * 1e6 / value ELSE ABS(trade) END)), 6) AS impact_cost, ROUND(50.0 / 1e4 / 252 * SUM(GREATEST(-weight, 0.0)), 8) + 0.0 AS borrow_cost, ROUND(SUM(ABS(trade)) / 2, 6) AS turnover FROM t GROUP BY dt""")
def trading_costs(spark, sf_dir):
    return tidy(B.costs(held(spark, sf_dir), adv="value"), 6, spread_cost=8, borrow_cost=8)


_L = f"{_W}, l AS (SELECT *, COALESCE(LAG(weight) OVER (PARTITION BY entity ORDER BY dt), 0.0) * COALESCE(r, 0.0) AS c FROM w), pnl AS (SELECT dt, SUM(c) AS pnl, SUM(ABS(weight)) AS gross, SUM(weight) AS net FROM l GROUP BY dt)"


@query("daily_ledger", f"{_L} SELECT dt, ROUND(pnl, 6) + 0.0 AS pnl, ROUND(gross, 6) AS gross, ROUND(net, 6) AS net FROM pnl")
def daily_ledger(spark, sf_dir):
    return tidy(B.ledger(held(spark, sf_dir), "weight", "r"))


@query("concentration", f"""{_W}, o AS (SELECT *, ABS(weight - 1.0 / COUNT(*) OVER (PARTITION BY dt)) AS off_ FROM w) SELECT dt, ROUND(SUM(weight * weight), 7) AS hhi, ROUND(1 / SUM(weight * weight), 5) AS effective_n, ROUND(MAX(weight), 7) AS max_weight, ROUND(SUM(off_), 6) + 0.0 AS l1_vs_equal, COUNT(*) FILTER (WHERE weight > 1e-6) AS support, ROUND(-SUM(CASE WHEN weight > 0 THEN weight * LN(weight) ELSE 0 END), 6) + 0.0 AS entropy FROM o GROUP BY dt""")
def concentration(spark, sf_dir):
    return tidy(B.concentration(held(spark, sf_dir)), 6, hhi=7, max_weight=7, effective_n=5)


_S = f"{_W}, s AS (SELECT dt, entity, weight > 0.05 AS now_, COALESCE(LAG(weight > 0.05) OVER (PARTITION BY entity ORDER BY dt), FALSE) AS was FROM w)"


@query("support_changes", f"{_S} SELECT dt, ROUND(COUNT(*) FILTER (WHERE now_ AND was)::DOUBLE / NULLIF(COUNT(*) FILTER (WHERE now_ OR was), 0), 8) AS jaccard, ROUND(COUNT(*) FILTER (WHERE was AND NOT now_)::DOUBLE / NULLIF(COUNT(*) FILTER (WHERE was), 0), 8) AS exit_rate FROM s GROUP BY dt")
def support_changes(spark, sf_dir):
    return tidy(B.support_changes(held(spark, sf_dir), eps=0.05), 8)


@query("reentries", f"{_S} SELECT entity, COUNT(*) FILTER (WHERE now_ AND NOT was) AS spells, COUNT(*) FILTER (WHERE now_ AND NOT was) >= 2 AS came_back FROM s GROUP BY entity")
def reentries(spark, sf_dir):
    return B.reentry(held(spark, sf_dir), eps=0.05)


@query("weight_autocorrelation", f"{_W}, a AS (SELECT entity, weight, LAG(weight) OVER (PARTITION BY entity ORDER BY dt) AS y FROM w) SELECT entity, ROUND(CORR(weight, y), 6) + 0.0 AS autocorrelation, COUNT(y) AS n FROM a GROUP BY entity")
def weight_autocorrelation(spark, sf_dir):
    return tidy(B.autocorrelation(held(spark, sf_dir), "weight"))


@query("performance", f"""{P}, c AS (SELECT entity, QUANTILE_CONT(r, 0.05) AS cut FROM p GROUP BY 1), m AS (SELECT entity, AVG(r) AS mu FROM p GROUP BY 1) SELECT p.entity, COUNT(r) AS n, ROUND(AVG(r), 6) + 0.0 AS mean, ROUND(STDDEV_POP(r), 6) AS sd, ROUND(AVG(r) / (STDDEV_POP(r) + 1e-12) * SQRT(252.0), 4) + 0.0 AS sharpe, ROUND(AVG(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END), 6) AS hit_rate, ROUND(AVG(CASE WHEN r <= cut THEN r END), 6) + 0.0 AS cvar_5, ROUND(AVG(POWER(r - mu, 3)) / POWER(STDDEV_POP(r), 3), 4) + 0.0 AS skew FROM p JOIN c ON p.entity = c.entity JOIN m ON p.entity = m.entity GROUP BY p.entity""")
def performance(spark, sf_dir):
    return tidy(B.performance(panel_frame(spark, sf_dir), "r", ["entity"]), 6, sharpe=4, skew=4)


@query("captures", f"{P}, m AS (SELECT entity, r, AVG(r) OVER (PARTITION BY dt) AS mk FROM p) SELECT ROUND(SUM(CASE WHEN mk > 0 THEN r END) / SUM(CASE WHEN mk > 0 THEN mk END), 6) + 0.0 AS up_capture, ROUND(SUM(CASE WHEN mk < 0 THEN r END) / SUM(CASE WHEN mk < 0 THEN mk END), 6) + 0.0 AS down_capture FROM m")
def captures(spark, sf_dir):
    return tidy(B.capture(panel_frame(spark, sf_dir).withColumn("mk", F.avg("r").over(PANEL.section)), "r", "mk"))


@query("drawdown_path", f"""{_L}, q AS (SELECT dt, SUM(pnl / 10) OVER d AS s, SUM(LN(1 + pnl / 10)) OVER d AS g FROM pnl WINDOW d AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT dt, ROUND(s - GREATEST(MAX(s) OVER d, 0.0), 5) + 0.0 AS drawdown, ROUND(1 - EXP(g - GREATEST(MAX(g) OVER d, 0.0)), 5) + 0.0 AS wealth_drawdown FROM q WINDOW d AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def drawdown_path(spark, sf_dir):
    daily = B.ledger(held(spark, sf_dir), "weight", "r").select("dt", (F.col("pnl") / 10).alias("pnl"))
    return tidy(B.drawdowns(daily), 5)


@query("capacity_curve", f"""{_T}, c AS (SELECT dt, 5.0 / 1e4 * SUM(ABS(trade)) AS sp, 10.0 / 1e4 * SUM(SQRT(CASE WHEN value > 0 THEN ABS(trade) * 1e6 / value ELSE ABS(trade) END)) AS im FROM t GROUP BY dt), l AS (SELECT *, COALESCE(LAG(weight) OVER (PARTITION BY entity ORDER BY dt), 0.0) * COALESCE(r, 0.0) AS x FROM w), g AS (SELECT dt, SUM(x) AS pnl FROM l GROUP BY dt)
SELECT m AS multiple, ROUND(AVG(pnl - sp - im * SQRT(m)), 6) + 0.0 AS mean_net FROM g JOIN c USING (dt), (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) v(m) GROUP BY m""")
def capacity_curve(spark, sf_dir):
    df = held(spark, sf_dir)
    daily = B.ledger(df, "weight", "r").join(B.costs(df, adv="value"), "dt").withColumnRenamed("pnl", "gross_pnl")
    return tidy(B.capacity(daily, (1, 2, 5, 10)))


@query("buy_and_hold", f"{P}, w AS (SELECT dt, EXP(SUM(LN(1 + COALESCE(r, 0) / 100)) OVER {E}) AS w FROM p) SELECT dt, ROUND(LN(AVG(w)), 6) + 0.0 AS wealth FROM w GROUP BY dt")
def buy_and_hold(spark, sf_dir):
    return tidy(B.buy_and_hold(panel_frame(spark, sf_dir).withColumn("r", F.col("r") / 100), "r").withColumn("wealth", F.ln("wealth")))


@query("best_single", f"{P} SELECT entity, ROUND(EXP(SUM(LN(1 + COALESCE(r, 0)))), 4) AS wealth FROM p GROUP BY 1 ORDER BY EXP(SUM(LN(1 + COALESCE(r, 0)))) DESC, entity LIMIT 1")
def best_single(spark, sf_dir):
    return tidy(B.best_single(panel_frame(spark, sf_dir), "r"), 4)


@query("trailing_sharpe", f"{P} SELECT entity, dt, ROUND(CASE WHEN COUNT(r) OVER {win(63)} >= 31 AND COUNT(*) OVER {win(63)} = 63 THEN AVG(r) OVER {win(63)} / (STDDEV_POP(r) OVER {win(63)} + 1e-12) END, 5) + 0.0 AS sharpe FROM p")
def trailing_sharpe(spark, sf_dir):
    made = R.gated(F.col("r"), 63, lambda t: t.mean / (t.sd(0) + 1e-12), "half")
    return tidy(panel_frame(spark, sf_dir).select("entity", "dt", made.alias("sharpe")), 5)
