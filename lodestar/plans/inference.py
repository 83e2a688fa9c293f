"""Queries of HAC inference, gates, breadth, behaviour vectors and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import behaviour as H
from lodestar.operators import inference as I
from lodestar.operators import statistics as Z
from lodestar.panel import PANEL
from lodestar.plans.portfolios import _W, held
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import panel_frame, query, table, tidy
from lodestar.plans.tests_of_skill import _M, _market


def hac(source: str, keys: str, value: str, time: str = "dt", lags: str = "FLOOR(4 * POWER(n / 100.0, 2.0 / 9))") -> str:
    """SQL of Bartlett sums: (keys, n, s) of a column without nulls."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{source}_i AS (SELECT {keys}, {value} AS z, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {time}) AS i, COUNT(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
{source}_l AS (SELECT *, {lags} AS l FROM {source}_i),
{source}_s AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, ANY_VALUE(a.n) AS n, SUM(CASE WHEN a.i = b.i THEN 1.0 ELSE 2 * (1 - (a.i - b.i) / (a.l + 1)) END * a.z * b.z) AS s FROM {source}_l a JOIN {source}_l b ON {same} AND b.i BETWEEN a.i - a.l AND a.i GROUP BY {', '.join('a.' + k for k in keys.split(', '))})"""


_HS = f"""{P}, e AS (SELECT entity, dt, r, r - AVG(r) OVER (PARTITION BY entity) AS e FROM p WHERE r IS NOT NULL), {hac('e', 'entity', 'e')}, m AS (SELECT entity, AVG(r) AS mean, STDDEV_SAMP(r) AS sd FROM e GROUP BY 1),
h AS (SELECT entity, n, mean, sd, CASE WHEN n >= 3 THEN SQRT(GREATEST(s / n, 1e-24) / n) END AS se_hac, CASE WHEN n >= 3 AND sd > 0 THEN sd / SQRT(n) END AS se_iid FROM e_s JOIN m USING (entity))"""


@query("hac_sharpe", f"""{_HS} SELECT entity, n, ROUND(CASE WHEN n >= 3 AND sd > 0 THEN mean / sd * SQRT(252.0) END, 5) + 0.0 AS sharpe, ROUND(CASE WHEN n >= 3 AND sd > 0 THEN SQRT((1 + 0.5 * (mean / sd) * (mean / sd)) / n) * COALESCE(se_hac / NULLIF(se_iid, 0), 1.0) * SQRT(252.0) END, 5) AS se,
ROUND(mean / sd / (SQRT((1 + 0.5 * (mean / sd) * (mean / sd)) / n) * COALESCE(se_hac / NULLIF(se_iid, 0), 1.0)), 4) + 0.0 AS t, ROUND(COALESCE(se_hac / NULLIF(se_iid, 0), 1.0), 6) AS inflation FROM h""")
def hac_sharpe(spark, sf_dir):
    return tidy(I.hac_sharpe(panel_frame(spark, sf_dir), "r", "dt", ["entity"]), 5, t=4, inflation=6)


_NW = f"""{_M}, d AS (SELECT entity, dt, r AS y, mk AS x FROM m WHERE r IS NOT NULL AND mk IS NOT NULL), q AS (SELECT entity, COUNT(*) AS k, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy FROM d GROUP BY 1 HAVING COUNT(*) >= 4),
f AS (SELECT *, k * sxx - sx * sx AS det, (sxx * sy - sx * sxy) / (k * sxx - sx * sx) AS b0, (k * sxy - sx * sy) / (k * sxx - sx * sx) AS b1 FROM q),
z AS (SELECT entity, dt, term, CASE term WHEN 'intercept' THEN b0 ELSE b1 END AS coef, (y - b0 - b1 * x) * CASE term WHEN 'intercept' THEN sxx - sx * x ELSE k * x - sx END / det AS z FROM d JOIN f USING (entity), (VALUES ('intercept'), ('mk')) v(term)),
{hac('z', 'entity, term', 'z')}, c AS (SELECT entity, term, ANY_VALUE(coef) AS coef FROM z GROUP BY 1, 2)"""


@query("newey_west", f"{_NW} SELECT entity, term, ROUND(coef, 6) + 0.0 AS coef, ROUND(SQRT(GREATEST(s, 0)), 6) AS se, ROUND(coef / SQRT(GREATEST(s, 0)), 3) + 0.0 AS t, n FROM z_s JOIN c USING (entity, term)")
def newey_west(spark, sf_dir):
    return tidy(I.newey_west(_market(spark, sf_dir), "r", ["mk"], "dt", ["entity"]), 6, t=3)


@query("alpha_gate", f"{_NW}, a AS (SELECT entity, coef AS alpha, coef / SQRT(GREATEST(s, 0)) AS t, n FROM z_s JOIN c USING (entity, term) WHERE term = 'intercept') SELECT entity, ROUND(alpha, 6) + 0.0 AS alpha, ROUND(alpha * 252, 4) + 0.0 AS alpha_annual, ROUND(t, 3) + 0.0 AS t, n, COALESCE(alpha > 0 AND t >= 2, FALSE) AS passes, CASE WHEN alpha > 0 AND t >= 2 THEN 'continue' ELSE 'pivot' END AS decision, COALESCE(ABS(t) > 1.96, FALSE) AS clears_1_96, COALESCE(ABS(t) > 3.0, FALSE) AS clears_3_0, COALESCE(ABS(t) > 3.9, FALSE) AS clears_3_9 FROM a")
def alpha_gate(spark, sf_dir):
    made = I.alpha_gate(_market(spark, sf_dir), "r", ["mk"], "dt", ["entity"])
    return tidy(made.withColumns(I.hurdles(F.col("t"))), 6, alpha_annual=4, t=3)


_FM = f"""{P}, l AS (SELECT *, LEAD(r) OVER (PARTITION BY entity ORDER BY dt) AS y FROM p), u AS (SELECT 'spread' AS signal, dt, spread AS x, y FROM l UNION ALL SELECT 'disc', dt, disc, y FROM l UNION ALL SELECT 'volume', dt, volume, y FROM l),
s0 AS (SELECT signal, dt, CASE WHEN COUNT(*) >= 3 AND VAR_POP(x) * COUNT(*) > 1e-12 THEN REGR_SLOPE(y, x) END AS slope FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2), s1 AS (SELECT *, slope - AVG(slope) OVER (PARTITION BY signal) AS e FROM s0 WHERE slope IS NOT NULL),
{hac('s1', 'signal', 'e')}, g AS (SELECT signal, AVG(slope) AS mean_coef, STDDEV_SAMP(slope) AS sd FROM s1 GROUP BY 1), w AS (SELECT signal, mean_coef, mean_coef / (sd / SQRT(n)) AS t, mean_coef / SQRT(GREATEST(s / n, 1e-24) / n) AS t_hac, n AS n_dates FROM g JOIN s1_s USING (signal))"""


def _labelled(spark, sf_dir):
    return panel_frame(spark, sf_dir).withColumn("y", F.lead("r").over(PANEL.series)).withColumn("nothing", F.lit(None).cast("double"))


@query("fama_macbeth_hac", f"{_FM} SELECT signal, ROUND(mean_coef, 6) + 0.0 AS mean_coef, ROUND(t, 4) + 0.0 AS t, ROUND(t_hac, 4) + 0.0 AS t_hac, n_dates FROM w")
def fama_macbeth_hac(spark, sf_dir):
    return tidy(I.fama_macbeth(_labelled(spark, sf_dir), ["spread", "disc", "volume"], "y"), 4, mean_coef=6)


@query("signal_gate", f"{_FM} SELECT signal, ROUND(mean_coef, 6) + 0.0 AS mean_coef, ROUND(t, 4) + 0.0 AS t, ROUND(t_hac, 4) + 0.0 AS t_hac, n_dates, 'scored' AS status, ABS(t) > 1.0 AS admitted, ABS(t_hac) >= 3 AS discovery FROM w UNION ALL SELECT 'nothing', NULL, NULL, NULL, 0, 'unscored', FALSE, FALSE")
def signal_gate(spark, sf_dir):
    made = I.signal_gate(_labelled(spark, sf_dir), ["spread", "disc", "volume", "nothing"], "y", "2010-01-01", t_min=1.0, version=1)
    return tidy(made.drop("p", "legacy"), 4, mean_coef=6)


@query("signal_discoveries")
def signal_discoveries(spark, sf_dir):
    """False discoveries are controlled over the p of the Newey-West t; Student's distribution isn't SQL."""
    return tidy(I.signal_gate(_labelled(spark, sf_dir), ["spread", "disc", "volume", "nothing"], "y", "2010-01-01"), 4, mean_coef=6, p=8)


_SR = f"{P}, sr AS (SELECT CASE WHEN entity = 3 THEN 'olps:corn' ELSE 's' || entity END AS name, AVG(r) / (STDDEV_POP(r) + 1e-12) * SQRT(252.0) AS sharpe FROM p GROUP BY 1)"


@query("peers_gate", f"""{_SR}, o AS (SELECT sharpe AS own FROM sr WHERE name = 's7'), k AS (SELECT own, name, sharpe FROM sr, o WHERE name NOT IN ('s7', 'olps:corn') AND sharpe IS NOT NULL)
SELECT COUNT(*) AS peers, COUNT(*) FILTER (WHERE own > sharpe) AS beaten, ARG_MAX(name, sharpe) AS best_peer, ROUND(ANY_VALUE(own) - MAX(sharpe), 5) + 0.0 AS edge, ANY_VALUE(own) > MAX(sharpe) AS passes, CASE WHEN ANY_VALUE(own) > MAX(sharpe) THEN 'continue' ELSE 'pivot' END AS decision FROM k""")
def peers_gate(spark, sf_dir):
    name = F.when(F.col("entity") == 3, "olps:corn").otherwise(F.concat(F.lit("s"), F.col("entity").cast("string")))
    rated = panel_frame(spark, sf_dir).groupBy(name.alias("name")).agg((F.avg("r") / (F.stddev_pop("r") + 1e-12) * 252**0.5).alias("sharpe"))
    return tidy(I.peers_gate(rated, "name", "sharpe", "s7"), 5)


@query("break_even_gate", f"{_W}, c AS (SELECT entity, AVG(weight) * 10 AS multiplier FROM w GROUP BY 1) SELECT entity, ROUND(multiplier, 6) AS multiplier, multiplier >= 0.25 AS passes, CASE WHEN multiplier >= 0.25 THEN 'continue' ELSE 'pivot' END AS decision FROM c")
def break_even_gate(spark, sf_dir):
    ladder = held(spark, sf_dir).groupBy("entity").agg((F.avg("weight") * 10).alias("multiplier"))
    return tidy(I.break_even_gate(ladder, "multiplier"), 6)


@query("periods_per_year", "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem) SELECT COUNT(*) AS n, ROUND((COUNT(*) - 1) / (DATE_DIFF('day', MIN(dt), MAX(dt)) / 365.25), 6) AS periods FROM d")
def periods_per_year(spark, sf_dir):
    return tidy(I.periods_per_year(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("dt"))))


_PC = f"{P}, f AS (SELECT entity, dt, r FROM p WHERE r IS NOT NULL), pc AS (SELECT a.entity AS a, b.entity AS b, CASE WHEN STDDEV_POP(a.r) * STDDEV_POP(b.r) > 0 THEN CORR(a.r, b.r) END AS corr FROM f a JOIN f b ON a.dt = b.dt AND a.entity < b.entity GROUP BY 1, 2)"
_NE = "(SELECT COUNT(DISTINCT entity)::DOUBLE FROM f)"


@query("breadth_measures", f"{_PC} SELECT ROUND(AVG(corr), 6) + 0.0 AS mean_corr, ROUND(GREATEST({_NE} / (1 + ({_NE} - 1) * LEAST(GREATEST(AVG(corr), 0), 0.999)), 1.0), 4) AS by_mean, ROUND({_NE} * {_NE} / ({_NE} + 2 * SUM(COALESCE(corr, 0) * COALESCE(corr, 0))), 4) AS by_eigenvalues FROM pc")
def breadth_measures(spark, sf_dir):
    df = panel_frame(spark, sf_dir).where("r is not null")
    pairs = Z.pairwise_correlation(df, "r", "dt", "entity")
    return tidy(I.breadth(pairs, df.select("entity").distinct().count()), 4, mean_corr=6)


@query("entropy_breadth")
def entropy_breadth(spark, sf_dir):
    pairs, weights, _ = Z.distinct_correlation(panel_frame(spark, sf_dir), "r", "dt", "entity")
    return tidy(I.entropy_breadth(pairs, names=max(1, weights.count()), weights=weights), 4)


@query("information_ratio", f"{P}, l AS (SELECT dt, spread, LAG(spread) OVER (PARTITION BY entity ORDER BY dt) AS y FROM p), c AS (SELECT dt, COVAR_POP(spread, y) / NULLIF(STDDEV_POP(spread) * STDDEV_POP(y), 0) AS ar1 FROM l WHERE y IS NOT NULL GROUP BY dt HAVING COUNT(y) >= 5), g AS (SELECT AVG(ar1) AS ar1, COUNT(ar1) AS dates FROM c) SELECT dates, ROUND(-LN(LEAST(GREATEST(ar1, 1e-6), 1 - 1e-12)) * 252, 4) AS refresh, ROUND(0.03 * SQRT(-LN(LEAST(GREATEST(ar1, 1e-6), 1 - 1e-12)) * 252 * 20) * 0.5, 6) AS predicted FROM g")
def information_ratio(spark, sf_dir):
    from lodestar.panel import correlation

    df = panel_frame(spark, sf_dir).withColumn("y", F.lag("spread").over(PANEL.series)).where("y is not null")
    daily = df.groupBy("dt").agg(correlation("spread", "y").alias("ar1"), F.count("y").alias("n")).where("n >= 5")
    g = daily.agg(F.count("ar1").alias("dates"), I.refresh_rate(F.avg("ar1")).alias("refresh"))
    return tidy(g.withColumn("predicted", I.information_ratio(F.lit(0.03), F.lit(20.0), F.col("refresh"), F.lit(0.5))), 6, refresh=4)


@query("sharpe_difference")
def sharpe_difference(spark, sf_dir):
    return tidy(I.sharpe_difference(_market(spark, sf_dir), "r", "mk", "dt", ["entity"]))


@query("stepwise_tests")
def stepwise_tests(spark, sf_dir):
    df = _market(spark, sf_dir).withColumn("excess", F.col("r") - F.col("mk"))
    return tidy(I.stepwise(df, "excess", "dt", "entity", replicates=199))


@query("style_loadings")
def style_loadings(spark, sf_dir):
    df = _market(spark, sf_dir).withColumns({"f2": F.col("spread") - 0.04, "f3": F.col("disc") - 0.05})
    made = I.style(df, "r", ["mk", "f2", "f3"], ["entity"])
    return tidy(made.select("entity", "n", *(F.col("loadings")[i].alias(f"b{i}") for i in range(3)), "r2"), 5)


@query("chi_square_regime", f"{_M}, d AS (SELECT dt, VAR_POP(r) * 30 AS turbulence FROM m GROUP BY 1) SELECT dt, ROUND(turbulence, 6) AS turbulence, COALESCE(turbulence > 12.548861396889375, FALSE) AS turbulent FROM d")
def chi_square_regime(spark, sf_dir):
    daily = panel_frame(spark, sf_dir).groupBy("dt").agg((F.var_pop("r") * 30).alias("turbulence"))
    return tidy(daily.withColumn("turbulent", I.chi_square_regime(F.col("turbulence"), 10)))


@query("residual_steps", f"{_M} SELECT entity, dt, ROUND(r - spread - 0.0001 - 0.00002 - (0.8 * mk + 0.1 * spread), 6) + 0.0 AS reward FROM m WHERE r IS NOT NULL AND mk IS NOT NULL")
def residual_steps(spark, sf_dir):
    df = _market(spark, sf_dir).where("r is not null and mk is not null")
    made = I.residual_step(F.col("r"), F.col("spread"), F.array(F.lit(0.8), F.lit(0.1)), F.array("mk", "spread"), 0.0001, 0.00002)
    return tidy(df.select("entity", "dt", made.alias("reward")))


# behaviour

_SL = "sl AS (SELECT DISTINCT entity, 's' || (entity % 7) AS sleeve FROM p UNION SELECT DISTINCT entity, 's' || (entity % 5) FROM p WHERE entity % 3 = 0)"
_TI = f"{_W}, {_SL}, wk AS (SELECT dt, entity, weight, COUNT(*) OVER (PARTITION BY dt) AS k FROM w), ti AS (SELECT dt, sleeve, SUM(weight) - COUNT(*)::DOUBLE / ANY_VALUE(k) AS tilt FROM wk JOIN sl USING (entity) GROUP BY 1, 2)"


def _members(spark, sf_dir):
    e = panel_frame(spark, sf_dir).select("entity").distinct()
    name = lambda n: F.concat(F.lit("s"), (F.col("entity") % n).cast("string")).alias("sleeve")
    return e.select("entity", name(7)).union(e.where("entity % 3 = 0").select("entity", name(5)))


def _tilts(spark, sf_dir):
    return H.tilts(held(spark, sf_dir), _members(spark, sf_dir))


@query("sleeve_tilts", f"{_TI} SELECT dt, sleeve, ROUND(tilt, 7) + 0.0 AS tilt FROM ti")
def sleeve_tilts(spark, sf_dir):
    return tidy(_tilts(spark, sf_dir), 7)


@query("mean_tilts", f"{_TI} SELECT sleeve, ROUND(AVG(tilt), 7) + 0.0 AS mean_tilt, COUNT(*) AS dates FROM ti GROUP BY 1")
def mean_tilts(spark, sf_dir):
    return tidy(H.mean_tilts(_tilts(spark, sf_dir)), 7)


@query("rotation_rate", f"{_TI}, d AS (SELECT dt, ABS(tilt - LAG(tilt, 21) OVER (PARTITION BY sleeve ORDER BY dt)) AS d FROM ti), s AS (SELECT dt, SUM(d) AS d FROM d GROUP BY 1) SELECT ROUND(AVG(d), 7) AS rotation_rate, COUNT(d) AS dates FROM s")
def rotation_rate(spark, sf_dir):
    return tidy(H.rotation_rate(_tilts(spark, sf_dir)), 7)


@query("tilt_autocorrelation", f"{_TI}, d AS (SELECT sleeve, tilt, LAG(tilt, 21) OVER (PARTITION BY sleeve ORDER BY dt) AS y FROM ti) SELECT sleeve, ROUND(COVAR_POP(tilt, y) / NULLIF(STDDEV_POP(CASE WHEN y IS NOT NULL THEN tilt END) * STDDEV_POP(y), 0), 6) + 0.0 AS autocorrelation FROM d GROUP BY 1")
def tilt_autocorrelation(spark, sf_dir):
    return tidy(H.tilt_autocorrelation(_tilts(spark, sf_dir)))


_RG = "rg AS (SELECT DISTINCT dt, CASE MONTH(dt) % 3 WHEN 0 THEN 'calm' WHEN 1 THEN 'inflationary' ELSE 'crisis' END AS regime FROM p)"


def _regimes(spark, sf_dir):
    m = F.month("dt") % 3
    return panel_frame(spark, sf_dir).select("dt").distinct().withColumn("regime", F.when(m == 0, "calm").when(m == 1, "inflationary").otherwise("crisis"))


@query("tilt_variances", f"{_TI}, {_RG}, b AS (SELECT regime, sleeve, AVG(tilt) AS m, VAR_POP(tilt) AS v FROM ti JOIN rg USING (dt) GROUP BY 1, 2), x AS (SELECT VAR_POP(m) AS a FROM b GROUP BY sleeve), y AS (SELECT AVG(v) AS v FROM b GROUP BY regime) SELECT ROUND((SELECT AVG(a) FROM x) * 1e6, 4) AS across, ROUND((SELECT AVG(v) FROM y) * 1e4, 5) AS within")
def tilt_variances(spark, sf_dir):
    made = H.tilt_variances(_tilts(spark, sf_dir), _regimes(spark, sf_dir))
    return tidy(made.select((F.col("across") * 1e6).alias("across"), (F.col("within") * 1e4).alias("within")), 5, across=4)


_MS = f"""{_TI}, mc AS (SELECT CAST(o_orderdate AS DATE) AS dt, AVG(o_totalprice) / 1e5 AS x FROM orders GROUP BY 1), ml AS (SELECT dt, LAG(x) OVER (ORDER BY dt) AS x FROM mc), d AS (SELECT sleeve, dt, tilt AS y, x FROM ti JOIN ml USING (dt) WHERE x IS NOT NULL),
q AS (SELECT sleeve, COUNT(*) AS k, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy FROM d GROUP BY 1 HAVING COUNT(*) >= 4), f AS (SELECT *, k * sxx - sx * sx AS det, (sxx * sy - sx * sxy) / (k * sxx - sx * sx) AS b0, (k * sxy - sx * sy) / (k * sxx - sx * sx) AS b1 FROM q),
z AS (SELECT sleeve, dt, term, CASE term WHEN 'intercept' THEN b0 ELSE b1 END AS coef, (y - b0 - b1 * x) * CASE term WHEN 'intercept' THEN sxx - sx * x ELSE k * x - sx END / det AS z FROM d JOIN f USING (sleeve), (VALUES ('intercept'), ('x')) v(term)),
{hac('z', 'sleeve, term', 'z', lags='21')}, c AS (SELECT sleeve, term, ANY_VALUE(coef) AS coef FROM z GROUP BY 1, 2)"""


@query("macro_sensitivity", f"{_MS} SELECT sleeve, term, ROUND(coef, 6) + 0.0 AS coef, ROUND(SQRT(GREATEST(s, 0)), 6) AS se, ROUND(coef / SQRT(GREATEST(s, 0)), 3) + 0.0 AS t, n FROM z_s JOIN c USING (sleeve, term)")
def macro_sensitivity(spark, sf_dir):
    macro = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("dt")).agg((F.avg("o_totalprice") / 1e5).alias("x"))
    return tidy(H.macro_sensitivity(_tilts(spark, sf_dir), macro, ["x"]), 6, t=3)


def _vector_sql(by: str) -> str:
    part, keys = (f"{by}, ", by) if by else ("", "")
    over = f"PARTITION BY {by} ORDER BY dt" if by else "ORDER BY dt"
    source = f"SELECT w.*, {by} FROM w JOIN rg USING (dt)" if by else "SELECT * FROM w"
    pn = f"PARTITION BY {part}entity ORDER BY dt"
    return f"""{_W}, {_RG}, a AS ({source}), b AS (SELECT *, weight AS x, LAG(weight) OVER ({pn}) AS bf, COUNT(*) OVER (PARTITION BY dt) AS k FROM a),
st AS (SELECT {part}dt, SUM(x * x) AS hhi, MAX(x) AS mx, SUM(ABS(x - 1.0 / k)) AS l1, -SUM(CASE WHEN x > 0 THEN x * LN(x) ELSE 0 END) AS en, COUNT(*) FILTER (WHERE x > 1e-8) AS su, SUM(ABS(x - bf)) / 2 AS tu,
 CASE WHEN COUNT(bf) > 0 THEN COUNT(*) FILTER (WHERE x > 1e-8 AND COALESCE(bf > 1e-8, FALSE)) / NULLIF(COUNT(*) FILTER (WHERE x > 1e-8 OR COALESCE(bf > 1e-8, FALSE)), 0)::DOUBLE END AS ja, CASE WHEN COUNT(bf) > 0 THEN COUNT(*) FILTER (WHERE bf > 1e-8 AND NOT x > 1e-8) / NULLIF(COUNT(*) FILTER (WHERE bf > 1e-8), 0)::DOUBLE END AS ex,
 SUM(x * COALESCE(r, 0) / 10) AS pnl, AVG(COALESCE(r, 0) / 10) AS mk FROM b GROUP BY {part}dt),
lg AS (SELECT *, SUM(LN(1 + pnl)) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lw FROM st), dd AS (SELECT *, 1 - EXP(lw - MAX(lw) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS dd FROM lg),
qq AS (SELECT {part}QUANTILE_CONT(pnl, 0.05) AS cut, AVG(pnl) AS mu, STDDEV_POP(pnl) AS sp FROM st {f'GROUP BY {by}' if by else ''}),
nm AS (SELECT {part}entity, COVAR_POP(x, bf) / NULLIF(STDDEV_POP(CASE WHEN bf IS NOT NULL THEN x END) * STDDEV_POP(bf), 0) AS c, COUNT(*) FILTER (WHERE x > 1e-8 AND NOT COALESCE(bf > 1e-8, FALSE)) AS s FROM b GROUP BY {part}entity),
nn AS (SELECT {part}AVG(c) AS ac, COUNT(*) FILTER (WHERE s >= 2) / NULLIF(COUNT(*) FILTER (WHERE s >= 1), 0)::DOUBLE AS re FROM nm {f'GROUP BY {by}' if by else ''}),
me AS (SELECT {part}COUNT(*) AS n_days, AVG(hhi) AS hhi_mean, AVG(1 / GREATEST(hhi, 1e-12)) AS n_eff_mean, AVG(mx) AS max_weight_mean, AVG(l1) AS l1_vs_ew_mean, AVG(tu) AS turnover_mean, AVG(en) AS action_entropy_mean, AVG(su) AS support_size_mean, AVG(ja) AS support_jaccard_lag1, AVG(ex) AS support_exit_rate,
 AVG(CASE WHEN tu IS NOT NULL THEN CAST(tu >= 0.3 - 1e-15 AS INT) END) AS turnover_cap_binding_frac, SUM(CASE WHEN mk > 0 THEN pnl END) / NULLIF(SUM(CASE WHEN mk > 0 THEN mk END), 0) AS upside_capture, SUM(CASE WHEN mk < 0 THEN pnl END) / NULLIF(SUM(CASE WHEN mk < 0 THEN mk END), 0) AS downside_capture,
 AVG(POWER(pnl - mu, 3)) / POWER(ANY_VALUE(sp), 3) AS return_skew, MAX(dd) AS max_drawdown, AVG(CASE WHEN pnl <= cut THEN pnl END) AS cvar_05 FROM dd {f'JOIN qq USING ({by})' if by else ', qq'} {f'GROUP BY {by}' if by else ''})
SELECT {part}n_days, {', '.join(f'ROUND({c}, 5) + 0.0 AS {c}' for c in _MEASURES if c not in ('weight_autocorr_lag1', 'support_reentry_rate', 'holding_period_days'))}, ROUND(CASE WHEN turnover_mean > 1e-12 THEN 1 / turnover_mean END, 5) AS holding_period_days, ROUND(ac, 5) + 0.0 AS weight_autocorr_lag1, ROUND(re, 5) AS support_reentry_rate FROM me {f'JOIN nn USING ({by})' if by else ', nn'}"""


_MEASURES = ("hhi_mean", "n_eff_mean", "max_weight_mean", "l1_vs_ew_mean", "turnover_mean", "action_entropy_mean", "support_size_mean", "support_jaccard_lag1", "support_exit_rate", "turnover_cap_binding_frac", "upside_capture", "downside_capture", "return_skew", "max_drawdown", "cvar_05", "holding_period_days", "weight_autocorr_lag1", "support_reentry_rate")


def _scaled(spark, sf_dir):
    return held(spark, sf_dir).withColumn("r", F.col("r") / 10)


@query("behaviour_vector", _vector_sql(""))
def behaviour_vector(spark, sf_dir):
    return tidy(H.vector(_scaled(spark, sf_dir), r="r", turnover_cap=0.3), 5)


@query("behaviour_by_regime", _vector_sql("regime"))
def behaviour_by_regime(spark, sf_dir):
    df = _scaled(spark, sf_dir).join(F.broadcast(_regimes(spark, sf_dir)), "dt")
    return tidy(H.vector(df, r="r", by=["regime"], turnover_cap=0.3), 5)


@query("regime_deltas", f"WITH v AS ({_vector_sql('regime')}) SELECT " + ", ".join(f"ROUND(MAX(CASE WHEN regime = 'crisis' THEN {m} END) - MAX(CASE WHEN regime = 'calm' THEN {m} END), 4) + 0.0 AS delta_{m}" for m in ("hhi_mean", "turnover_mean")) + " FROM v")
def regime_deltas(spark, sf_dir):
    return tidy(H.regime_deltas(behaviour_by_regime(spark, sf_dir), ["hhi_mean", "turnover_mean"]), 4)


@query("merged_regimes", f"{P}, {_RG}, d AS (SELECT dt, STDDEV_POP(r) > 1.0 AS hot FROM p GROUP BY 1) SELECT dt, CASE WHEN COALESCE(hot, FALSE) AND regime = 'calm' THEN 'crisis' ELSE regime END AS regime FROM d JOIN rg USING (dt)")
def merged_regimes(spark, sf_dir):
    hot = panel_frame(spark, sf_dir).groupBy("dt").agg((F.stddev_pop("r") > 1.0).alias("hot"))
    return hot.join(_regimes(spark, sf_dir), "dt").select("dt", H.merged_regime(F.col("regime"), F.col("hot")).alias("regime"))


@query("occupancy", f"{P}, {_RG}, a AS (SELECT regime, COALESCE(regime <> LAG(regime) OVER (ORDER BY dt), TRUE) AS b FROM rg) SELECT regime, COUNT(*) AS days, ROUND(COUNT(*) / SUM(COUNT(*)) OVER ()::DOUBLE, 8) AS share, COUNT(*) FILTER (WHERE b) AS spells, ROUND(COUNT(*) / COUNT(*) FILTER (WHERE b)::DOUBLE, 6) AS mean_days FROM a GROUP BY 1")
def occupancy(spark, sf_dir):
    return tidy(H.occupancy(_regimes(spark, sf_dir), "regime"), 8, mean_days=6)


_WN = "wn AS (SELECT * FROM (VALUES ('a', DATE '1996-01-10', DATE '1996-04-02'), ('b', DATE '1998-03-01', DATE '1999-02-01'), ('none', DATE '2030-01-01', DATE '2030-02-01')) v(id, s, e))"


def _windows(spark):
    rows = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).cast("date").alias("start"), F.lit(e).cast("date").alias("end")) for i, s, e in (("a", "1996-01-10", "1996-04-02"), ("b", "1998-03-01", "1999-02-01"), ("none", "2030-01-01", "2030-02-01"))))
    return spark.range(1).select(F.inline(rows))


@query("window_hits", f"{P}, {_RG}, {_WN}, d AS (SELECT dt, COALESCE(STDDEV_POP(r) > 1.0, FALSE) AS turbulent FROM p GROUP BY 1), h AS (SELECT dt, turbulent, regime = 'crisis' AS crisis FROM d JOIN rg USING (dt)) SELECT id, COUNT(dt) AS n_days, ROUND(AVG(CAST(crisis AS INT)), 8) AS crisis_frac, ROUND(AVG(CAST(turbulent AS INT)), 8) AS turbulent_frac FROM wn LEFT JOIN h ON dt BETWEEN s AND e GROUP BY 1")
def window_hits(spark, sf_dir):
    hot = panel_frame(spark, sf_dir).groupBy("dt").agg(F.coalesce(F.stddev_pop("r") > 1.0, F.lit(False)).alias("turbulent"))
    flags = hot.join(_regimes(spark, sf_dir), "dt").withColumn("crisis", F.col("regime") == "crisis")
    return tidy(H.window_hits(flags, _windows(spark), ["crisis", "turbulent"]), 8)


@query("window_performance", f"{P}, {_WN}, d AS (SELECT dt, AVG(r) AS pnl FROM p GROUP BY 1) SELECT id, COUNT(pnl) AS n_days, ROUND(AVG(pnl), 6) + 0.0 AS mean, ROUND(AVG(pnl) / (STDDEV_POP(pnl) + 1e-12) * SQRT(252.0), 4) + 0.0 AS sharpe, ROUND(AVG(CASE WHEN pnl > 0 THEN 1.0 WHEN pnl <= 0 THEN 0.0 END), 8) AS hit_rate FROM wn JOIN d ON dt BETWEEN s AND e GROUP BY 1")
def window_performance(spark, sf_dir):
    daily = panel_frame(spark, sf_dir).groupBy("dt").agg(F.avg("r").alias("pnl"))
    return tidy(H.window_performance(daily, _windows(spark)), 6, sharpe=4, hit_rate=8)


@query("performance_by_regime", f"{P}, d AS (SELECT dt, AVG(r) AS ew, MAX(r) AS top, COALESCE(STDDEV_POP(r) > 1.0, FALSE) AS hot FROM p GROUP BY 1), u AS (SELECT 'ew' AS book, hot, ew AS r FROM d UNION ALL SELECT 'top', hot, top FROM d) SELECT book, CASE WHEN hot THEN 'turbulent' ELSE 'calm' END AS regime, COUNT(r) AS n_days, ROUND(AVG(r), 6) + 0.0 AS mean, ROUND(CASE WHEN STDDEV_SAMP(r) <= 1e-15 THEN 0.0 ELSE AVG(r) / STDDEV_SAMP(r) * SQRT(252.0) END, 4) + 0.0 AS sharpe FROM u WHERE r IS NOT NULL GROUP BY 1, 2")
def performance_by_regime(spark, sf_dir):
    daily = panel_frame(spark, sf_dir).groupBy("dt").agg(F.avg("r").alias("ew"), F.max("r").alias("top"), F.coalesce(F.stddev_pop("r") > 1.0, F.lit(False)).alias("hot"))
    return tidy(H.by_regime(daily, ["ew", "top"], "hot"), 6, sharpe=4)


@query("missing_sections", f"{P}, c AS (SELECT dt, CASE WHEN n >= 3 THEN px END AS deep, r FROM p), d AS (SELECT dt, COUNT(deep) AS deep, COUNT(r) AS r FROM c GROUP BY 1), u AS (SELECT 'deep' AS channel, deep AS k FROM d UNION ALL SELECT 'r', r FROM d) SELECT channel, COUNT(*) AS n_dates, COUNT(*) FILTER (WHERE k = 0) AS n_missing, ROUND(COUNT(*) FILTER (WHERE k = 0) / COUNT(*)::DOUBLE, 8) AS share, COUNT(*) FILTER (WHERE k = 0) / COUNT(*)::DOUBLE > 0.2 AS fails FROM u GROUP BY 1")
def missing_sections(spark, sf_dir):
    cube = panel_frame(spark, sf_dir).withColumn("deep", F.when(F.col("n") >= 3, F.col("px")))
    return tidy(H.missing_sections(cube, ["deep", "r"]), 8)


@query("decision_trace", f"{_W}, t AS (SELECT dt, entity, weight, weight - COALESCE(LAG(weight) OVER (PARTITION BY entity ORDER BY dt), 0) AS d FROM w) SELECT dt, COUNT(*)::INT AS names, ROUND(SUM(weight), 6) AS gross, ROUND(SUM(ABS(d)) / 2, 6) AS turnover, SUM(ABS(d)) / 2 >= 0.3 - 1e-15 AS cap_binds FROM t GROUP BY 1")
def decision_trace(spark, sf_dir):
    made = H.decision_trace(held(spark, sf_dir), turnover_cap=0.3)
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x)
    return tidy(made.select("dt", F.size("weights").alias("names"), total.alias("gross"), "turnover", "cap_binds"))
