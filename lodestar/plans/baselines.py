"""Queries of frictions, option baselines, composites and benchmark walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.operators import baselines as L
from lodestar.panel import PANEL
from lodestar.plans.portfolios import _W, held
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import gate, panel_frame, query, tidy, win

_FR = f"{_W}, f0 AS (SELECT *, weight - 0.02 AS x, entity % 3 = 0 AS o, 0.5 + disc AS delta, px / 10 AS spot, px / 20 AS base, spread * px / 100 AS hs FROM w), f1 AS (SELECT *, COALESCE(LAG(x) OVER (PARTITION BY entity ORDER BY dt), 0) AS b, LAG(delta) OVER (PARTITION BY entity ORDER BY dt) AS d0 FROM f0), f2 AS (SELECT *, CASE WHEN o THEN ABS(x - b) ELSE 0 END AS ot, CASE WHEN o THEN 0 ELSE ABS(x - b) END AS st FROM f1)"


def _slots(spark, sf_dir):
    c = F.col
    return held(spark, sf_dir).withColumns({"w": c("weight") - 0.02, "delta": 0.5 + c("disc"), "spot": c("px") / 10, "base": c("px") / 20, "hs": c("spread") * c("px") / 100})


@query("frictions", f"""{_FR}, g AS (SELECT dt, SUM(x * COALESCE(r, 0)) AS gross, 2 * SUM(ot * hs / ABS(base)) AS option_spread, 2 * (5 / 1e4 * SUM(st) + 0.5 / 1e4 * SUM(SQRT(CASE WHEN value > 0 THEN st * 1e6 / value ELSE st END))) AS equity_spread,
2 * 5 / 1e4 * SUM(CASE WHEN o THEN ABS(x - b) * ABS(delta * spot) / ABS(base) + ABS(x) * ABS(delta - COALESCE(d0, 0)) * ABS(spot) / ABS(base) ELSE 0 END) AS hedge, 2 * 25 / 1e4 / 252 * SUM(GREATEST(-x, 0)) AS funding, COUNT(*) FILTER (WHERE r IS NULL) AS missing FROM f2 GROUP BY dt)
SELECT dt, ROUND(gross, 6) + 0.0 AS gross, ROUND(option_spread, 8) AS option_spread, ROUND(equity_spread, 8) AS equity_spread, ROUND(hedge, 8) AS hedge, ROUND(funding, 9) AS funding, missing, ROUND(gross - option_spread - equity_spread - hedge - funding, 6) + 0.0 AS net FROM g""")
def frictions(spark, sf_dir):
    made = L.frictions(_slots(spark, sf_dir), L.Friction().scaled(2.0), "w", option=F.col("entity") % 3 == 0, adv="value", half_spread="hs", base="base", spot="spot", delta="delta", aum=1e6)
    return tidy(made, 6, option_spread=8, equity_spread=8, hedge=8, funding=9)


@query("execution_drag", f"{_FR} SELECT dt, ROUND(5 / 1e4 * LEAST(1.0, GREATEST(0.05, 0.1 / 0.2)) * SUM(ot) + 0.5 * LEAST(1.0, GREATEST(0.05, 0.1 / 0.2)) * SQRT(SUM(ot)), 8) AS drag FROM f2 GROUP BY dt")
def execution_drag(spark, sf_dir):
    rows = _slots(spark, sf_dir).withColumn("t", F.when(F.col("entity") % 3 == 0, F.abs(F.col("w") - F.coalesce(F.lag("w").over(PANEL.series), F.lit(0.0)))).otherwise(0.0))
    made = L.execution_drag(F.col("t"), F.sum("t"), L.Friction(touch=False), vol_scale=L.volatility_scale(F.lit(0.1)))
    return tidy(rows.groupBy("dt").agg(made.alias("drag")), 8)


_OP = f"{P}, op AS (SELECT entity, dt, 0.15 + spread AS iv, disc * 4 AS delta, {gate('STDDEV_SAMP(r)', 'r', 21, 10)} / 20 AS hv, spread - disc AS skew, LEAD(r) OVER (PARTITION BY entity ORDER BY dt) / 100 AS label FROM p)"


def _options(spark, sf_dir):
    df = R.trailing(panel_frame(spark, sf_dir).withColumn("label", F.lead("r").over(PANEL.series) / 100), {"hv": R.Feature("sd", "r", 21, 10, scale=1 / 20)}, ["spread", "disc", "label"])
    return df.select("entity", "dt", (0.15 + F.col("spread")).alias("iv"), (F.col("disc") * 4).alias("delta"), "hv", (F.col("spread") - F.col("disc")).alias("skew"), "label")


_K = "COUNT(*) OVER (PARTITION BY dt)"


def _sz(x: str) -> str:
    return f"COALESCE(CASE WHEN STDDEV_POP({x}) OVER (PARTITION BY dt) >= 1e-12 THEN ({x} - AVG({x}) OVER (PARTITION BY dt)) / STDDEV_POP({x}) OVER (PARTITION BY dt) END, 0)"


_W20 = win(20)
_RAW = {
    "short_vol_carry": f"-1.0 / {_K}",
    "iv_momentum": f"-TANH((AVG(iv) OVER {win(5)} - AVG(iv) OVER {_W20}) * 20) / {_K}",
    "iv_rank_timing": f"CASE WHEN COUNT(*) OVER {_W20} < 2 THEN 0 ELSE -TANH(3 * (2 * CASE WHEN MAX(iv) OVER {_W20} - MIN(iv) OVER {_W20} < 1e-12 THEN 0.5 ELSE (iv - MIN(iv) OVER {_W20}) / (MAX(iv) OVER {_W20} - MIN(iv) OVER {_W20}) END - 1)) / {_K} END",
    "hv_less_iv": f"COALESCE(TANH(8 * (hv - iv)) / {_K}, 0)",
    "timed_long_gamma": f"CASE WHEN hv IS NULL THEN 0 ELSE GREATEST(TANH(8 * (hv - iv)), 0) / {_K} END",
    "skew_risk_reversal": f"-TANH({_sz('skew')}) / {_K}",
    "short_high_vol": f"-TANH({_sz('hv')}) / {_K}",
}
_WT = "CASE WHEN SUM(ABS(raw)) OVER (PARTITION BY dt) > 1e-12 THEN raw / (SUM(ABS(raw)) OVER (PARTITION BY dt) + 1e-12) ELSE 0 END"


def _baseline(name: str):
    def run(spark, sf_dir):
        made = L.option_baseline(_options(spark, sf_dir), name, hv="hv", skew="skew")
        return tidy(made.select("entity", "dt", "weight"))

    return run


for _name, _sql in _RAW.items():
    query(f"baseline_{_name}", f"{_OP}, ra AS (SELECT entity, dt, ({_sql}) / (1 + 2 * ABS(delta)) AS raw FROM op) SELECT entity, dt, ROUND({_WT}, 6) + 0.0 AS weight FROM ra")(_baseline(_name))
query("baseline_garch_vol_timing")(_baseline("garch_vol_timing"))


_SU = " UNION ALL ".join(f"SELECT '{n}' AS strategy, entity, dt, label, ({s}) / (1 + 2 * ABS(delta)) AS raw FROM op" for n, s in _RAW.items())


@query("option_suite", f"""{_OP}, ra AS ({_SU}), wt AS (SELECT strategy, entity, dt, label, CASE WHEN SUM(ABS(raw)) OVER (PARTITION BY strategy, dt) > 1e-12 THEN raw / (SUM(ABS(raw)) OVER (PARTITION BY strategy, dt) + 1e-12) ELSE 0 END AS weight FROM ra), ds AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM op)),
ch AS (SELECT strategy, dt, weight * COALESCE(label, 0) AS x, ABS(weight - COALESCE(LAG(weight) OVER (PARTITION BY strategy, entity ORDER BY dt), 0)) AS d FROM wt JOIN ds USING (dt) WHERE i >= 20), dy AS (SELECT strategy, dt, SUM(x) AS pnl, SUM(d) AS t FROM ch GROUP BY 1, 2)
SELECT strategy, COUNT(pnl) AS n_days, ROUND(AVG(pnl), 7) + 0.0 AS mean, ROUND(AVG(pnl) / (STDDEV_POP(pnl) + 1e-12) * SQRT(252.0), 4) + 0.0 AS sharpe, ROUND(AVG(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, ROUND(AVG(t), 6) AS mean_turnover FROM dy GROUP BY 1""")
def option_suite(spark, sf_dir):
    made = L.option_suite(_options(spark, sf_dir), "label", tuple(_RAW), hv="hv", skew="skew")
    return tidy(made, 6, mean=7, sharpe=4)


_CZ = f"{P}, zz AS (SELECT entity, dt, ({_sz('spread')} + {_sz('disc')}) / 2 AS s FROM p)"


@query("composite_long", f"{_CZ}, e AS (SELECT *, EXP(s - MAX(s) OVER (PARTITION BY dt)) AS e FROM zz) SELECT entity, dt, ROUND(e / SUM(e) OVER (PARTITION BY dt), 7) AS weight FROM e")
def composite_long(spark, sf_dir):
    return tidy(L.composite(panel_frame(spark, sf_dir), ["spread", "disc"]).select("entity", "dt", "weight"), 7)


@query("composite_long_short", f"{_CZ}, e AS (SELECT *, CASE WHEN STDDEV_POP(s) OVER (PARTITION BY dt) < 1e-15 THEN 1.0 / {_K} ELSE s - AVG(s) OVER (PARTITION BY dt) END AS e FROM zz) SELECT entity, dt, ROUND(CASE WHEN SUM(ABS(e)) OVER (PARTITION BY dt) > 1e-12 THEN e / SUM(ABS(e)) OVER (PARTITION BY dt) ELSE 1.0 / {_K} END, 6) + 0.0 AS weight FROM e")
def composite_long_short(spark, sf_dir):
    return tidy(L.composite(panel_frame(spark, sf_dir), ["spread", "disc"], False).select("entity", "dt", "weight"))


_RUN = "(ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"


@query("ridge_composite", f"""{P}, pr AS (SELECT entity, dt, spread AS x, LEAD(r) OVER (PARTITION BY entity ORDER BY dt) AS y, LAG(spread) OVER (PARTITION BY entity ORDER BY dt) AS l FROM p), sm AS (SELECT dt, COUNT(*) FILTER (WHERE y IS NOT NULL) AS n, SUM(x) FILTER (WHERE y IS NOT NULL) AS sx, SUM(x * x) FILTER (WHERE y IS NOT NULL) AS sxx, SUM(y) AS sy, SUM(x * y) AS sxy FROM pr GROUP BY 1),
cu AS (SELECT dt, COALESCE(SUM(n) OVER {_RUN}, 0) AS n0, COALESCE(SUM(n) OVER {_RUN}, 0) + 1.0 AS n, COALESCE(SUM(sx) OVER {_RUN}, 0) AS sx, COALESCE(SUM(sxx) OVER {_RUN}, 0) + 1.0 AS sxx, COALESCE(SUM(sy) OVER {_RUN}, 0) AS sy, COALESCE(SUM(sxy) OVER {_RUN}, 0) AS sxy FROM sm),
ft AS (SELECT dt, CASE WHEN n0 > 0 THEN (sxx * sy - sx * sxy) / (n * sxx - sx * sx) ELSE 0 END AS c0, CASE WHEN n0 > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0 END AS c1 FROM cu), sc AS (SELECT entity, dt, COALESCE(c0 + c1 * l, 0) AS s FROM pr JOIN ft USING (dt)), ex AS (SELECT *, EXP(s - MAX(s) OVER (PARTITION BY dt)) AS e FROM sc) SELECT entity, dt, ROUND(e / SUM(e) OVER (PARTITION BY dt), 7) AS weight FROM ex""")
def ridge_composite(spark, sf_dir):
    return tidy(L.ridge_composite(panel_frame(spark, sf_dir), ["spread"], "r").select("entity", "dt", "weight"), 7)


_PAST = "(ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("volatility_managed", f"""{P}, d AS (SELECT dt, SUM(COALESCE(r, 0)) / COUNT(*) / 100 AS p, COUNT(*) AS k FROM p GROUP BY 1), v AS (SELECT dt, k, COUNT(p) OVER {_PAST} AS c, STDDEV_SAMP(p) OVER {_PAST} * SQRT(252.0) AS vol FROM d) SELECT entity, dt, ROUND(CASE WHEN c < 20 THEN 0.0 WHEN vol < 1e-12 THEN 1.0 ELSE LEAST(GREATEST(0.15 / vol, 0.25), 2.0) END / k, 7) AS weight FROM p JOIN v USING (dt)""")
def volatility_managed(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("r", F.col("r") / 100)
    return tidy(L.volatility_managed(df, "r").select("entity", "dt", "weight"), 7)


_HV63 = gate("STDDEV_SAMP(r)", "r", 63, 31, 1)
_BW = f"""{P}, b0 AS (SELECT entity, dt, r, value, {_HV63} AS hv, {gate('SUM(LN(1 + r))', 'r', 21, 21, 1)} AS mo FROM p), b1 AS (SELECT *, CASE WHEN hv > 1e-12 THEN 1 / hv END AS iv, FLOOR(COUNT(mo) OVER (PARTITION BY dt) / 2.0) AS m, COUNT(mo) OVER (PARTITION BY dt) AS nm, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY mo NULLS LAST, entity) AS rm FROM b0),
b2 AS (SELECT 'equal_weight' AS strategy, entity, dt, r, value, 1.0 / {_K} AS w FROM b1 UNION ALL SELECT 'inverse_vol', entity, dt, r, value, COALESCE(iv / SUM(iv) OVER (PARTITION BY dt), 0) FROM b1 UNION ALL SELECT 'short_term_reversal', entity, dt, r, value, -CASE WHEN mo IS NULL OR m < 1 THEN 0.0 WHEN rm <= m THEN -0.5 / m WHEN rm > nm - m THEN 0.5 / m ELSE 0.0 END FROM b1),
b3 AS (SELECT strategy, dt, w, r, value, ABS(w - COALESCE(LAG(w) OVER (PARTITION BY strategy, entity ORDER BY dt), 0)) AS d FROM b2)"""


@query("benchmark_walk", f"""{_BW} SELECT strategy, dt, ROUND(SUM(w * COALESCE(r, 0)), 6) + 0.0 AS gross, ROUND(5 / 1e4 * SUM(d) + 0.5 / 1e4 * SUM(SQRT(CASE WHEN value > 0 THEN d / value ELSE d END)) + 25 / 1e4 / 252 * SUM(GREATEST(-w, 0)), 8) AS cost,
ROUND(SUM(w * COALESCE(r, 0)) - (5 / 1e4 * SUM(d) + 0.5 / 1e4 * SUM(SQRT(CASE WHEN value > 0 THEN d / value ELSE d END)) + 25 / 1e4 / 252 * SUM(GREATEST(-w, 0))), 6) + 0.0 AS net, ROUND(SUM(d) / 2, 7) AS turnover FROM b3 GROUP BY 1, 2""")
def benchmark_walk(spark, sf_dir):
    made = L.benchmark_walk(["equal_weight", "inverse_vol", "short_term_reversal"], panel_frame(spark, sf_dir), "r", spec=L.Friction(), adv="value")
    return tidy(made, 6, cost=8, turnover=7)


@query("capped_weights")
def capped_weights(spark, sf_dir):
    return tidy(L.capped_path(held(spark, sf_dir), 0.3))


_OF = "k AS (SELECT *, COUNT(x) OVER (PARTITION BY dt) AS c, CASE WHEN x IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY dt, x IS NULL ORDER BY x, entity) END AS rk FROM u), l AS (SELECT *, CASE WHEN rk IS NULL OR c < 10 THEN 0.0 WHEN rk > c - GREATEST(FLOOR(c / 5.0), 1) THEN 1 / GREATEST(FLOOR(c / 5.0), 1) WHEN rk <= GREATEST(FLOOR(c / 5.0), 1) THEN -1 / GREATEST(FLOOR(c / 5.0), 1) ELSE 0.0 END AS wt FROM k)"


@query("option_factors", f"{_OP}, u AS (SELECT entity, dt, label, LN(CASE WHEN hv > 1e-9 THEN hv END / CASE WHEN iv > 1e-9 THEN iv END) AS x FROM op), {_OF} SELECT dt, ROUND(AVG(label), 7) + 0.0 AS market_ew, ROUND(SUM(wt * COALESCE(label, 0)), 7) + 0.0 AS hv_minus_iv FROM l GROUP BY dt")
def option_factors(spark, sf_dir):
    positive = lambda c: F.when(F.col(c) > 1e-9, F.col(c))
    df = _options(spark, sf_dir).withColumn("vol_deviation", F.ln(positive("hv") / positive("iv")))
    return tidy(L.option_factors(df, "label", {"hv_minus_iv": "vol_deviation"}), 7)


@query("episodes", f"{P}, e AS (SELECT dt, CASE WHEN YEAR(dt) < 1998 THEN 'train' ELSE 'eval' END AS phase, AVG(r) AS pnl, AVG(disc) * 10 AS turnover FROM p GROUP BY 1) SELECT dt, phase, ROUND(pnl, 6) + 0.0 AS pnl, ROUND(turnover, 6) AS turnover, ROUND(pnl - 0.001 * COALESCE(turnover, 0), 6) + 0.0 AS net_pnl, COALESCE(turnover, 0) > 0.503 AS breach, ROUND(GREATEST(0.503 - COALESCE(turnover, 0), 0), 6) AS slack FROM e")
def episodes(spark, sf_dir):
    daily = panel_frame(spark, sf_dir).groupBy("dt").agg(F.avg("r").alias("pnl"), (F.avg("disc") * 10).alias("turnover"))
    early = F.year("dt") < 1998
    return tidy(L.episode_net(daily.where(early), daily.where(~early), 0.001, 0.503))
