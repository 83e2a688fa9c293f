"""Queries of feature blocks, cubes, universe selection, episodes and bitemporal reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import blocks as K
from lodestar.operators import pit as T
from lodestar.operators import universe as N
from lodestar.panel import PANEL
from lodestar.plans.further import _rebalances
from lodestar.plans.portfolios import _W, held
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import gate, panel_frame, query, table, tidy, win

_HV = "STDDEV_SAMP(r)"


def _z(x: str, cut: bool = True) -> str:
    v = f"c_{x}" if cut else x
    sd = f"STDDEV_POP({v}) OVER (PARTITION BY dt)"
    return f"CASE WHEN {v} IS NOT NULL THEN ROUND(LEAST(GREATEST(({v} - AVG({v}) OVER (PARTITION BY dt)) / CASE WHEN {sd} < 1e-12 THEN 1.0 ELSE {sd} END, -3.0), 3.0), 4) + 0.0 END AS {x}"


_CH = ("log_ret_5", "mom_12_1", "hv_21", "amihud", "adv")
_CUBE = f"""{P}, c0 AS (SELECT entity, dt, n >= 2 OR entity % 2 = 0 AS ok, {gate('SUM(LN(1 + r))', 'r', 5, 5)} AS log_ret_5, {gate('SUM(LN(1 + r))', 'r', 231, 231, 21)} AS mom_12_1, {gate(_HV, 'r', 21, 10)} * SQRT(252.0) AS hv_21, {gate('AVG(ABS(r) / NULLIF(value, 0))', '(ABS(r) / NULLIF(value, 0))', 21, 1)} AS amihud, {gate('AVG(value)', 'value', 21, 1)} AS adv FROM p),
c1 AS (SELECT entity, dt, {', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in _CH)} FROM c0), q AS (SELECT dt, {', '.join(f'QUANTILE_CONT({c}, 0.01) AS l_{c}, QUANTILE_CONT({c}, 0.99) AS h_{c}' for c in _CH)} FROM c1 GROUP BY 1), c2 AS (SELECT entity, dt, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN LEAST(GREATEST({c}, l_{c}), h_{c}) END AS c_{c}' for c in _CH)} FROM c1 JOIN q USING (dt)),
mc AS (SELECT dt, AVG(spread) AS m FROM p GROUP BY 1), mz AS (SELECT dt, CASE WHEN COUNT(m) OVER e < 2 THEN NULL WHEN STDDEV_POP(m) OVER e < 1e-12 THEN 0.0 ELSE LEAST(GREATEST((m - AVG(m) OVER e) / STDDEV_POP(m) OVER e, -3.0), 3.0) END AS z FROM mc WINDOW e AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("feature_cube", f"{_CUBE} SELECT entity, dt, {', '.join(_z(c) for c in _CH)}, ROUND(z, 4) + 0.0 AS macro_spread FROM c2 JOIN mz USING (dt)")
def feature_cube(spark, sf_dir):
    df = panel_frame(spark, sf_dir)
    df = df.join(F.broadcast(df.groupBy("dt").agg(F.avg("spread").alias("macro_spread"))), "dt")
    names: list[str] = []
    for block in (lambda d: K.returns_momentum(d, "r"), lambda d: K.volatility(d, "r"), lambda d: K.liquidity(d, "r", "value")):
        df, made = block(df)
        names += made
    mask = (F.col("n") >= 2) | (F.col("entity") % 2 == 0)
    cube, _ = K.cube(df, names, mask, macro=["macro_spread"], exclude=["log_ret_1", "log_ret_21", "log_ret_63", "hv_63", "vol_of_vol"])
    return tidy(cube, 4)


@query("microstructure_block", f"{P} SELECT entity, dt, ROUND({gate('AVG(spread)', 'spread', 21, 1)}, 6) AS eff_spread_21, ROUND({gate('AVG(disc)', 'disc', 5, 1)}, 6) AS vwap_dev_5, ROUND({gate('AVG(volume)', 'volume', 21, 1)}, 5) AS block_share_21, ROUND({gate('AVG(n)', 'n', 21, 1)}, 6) AS turnover_21 FROM p")
def microstructure_block(spark, sf_dir):
    df, names = K.microstructure(panel_frame(spark, sf_dir), "spread", "disc", "volume", "n")
    return tidy(df.select("entity", "dt", *names), 6, block_share_21=5)


@query("sentiment_block", f"{P}, s AS (SELECT entity, dt, disc AS si, 1 + spread * 50 AS rec FROM p) SELECT entity, dt, ROUND(si, 6) AS si_pct, ROUND(si - LAG(si, 21) OVER o, 6) + 0.0 AS si_pct_chg_21, ROUND(6 - rec, 6) + 0.0 AS rec_mean_inv, ROUND(LAG(rec, 63) OVER o - rec, 6) + 0.0 AS rec_chg_63 FROM s WINDOW o AS (PARTITION BY entity ORDER BY dt)")
def sentiment_block(spark, sf_dir):
    df, names = K.sentiment(panel_frame(spark, sf_dir).withColumn("rec", 1 + F.col("spread") * 50), "disc", "rec")
    return tidy(df.select("entity", "dt", *names))


@query("option_flow_block", f"{P} SELECT entity, dt, ROUND(disc, 6) AS pc_vol, n AS oi_lvl, ROUND(disc - LAG(disc, 5) OVER o, 6) + 0.0 AS pc_vol_chg_5, n - LAG(n, 21) OVER o AS oi_chg_21 FROM p WINDOW o AS (PARTITION BY entity ORDER BY dt)")
def option_flow_block(spark, sf_dir):
    df, names = K.option_flow(panel_frame(spark, sf_dir), {"pc_vol": "disc", "oi_lvl": "n"}, {"pc_vol_chg_5": ("disc", 5), "oi_chg_21": ("n", 21)})
    return tidy(df.select("entity", "dt", *names))


@query("lottery_block", f"""{P}, k AS (SELECT *, AVG(r) OVER (PARTITION BY dt) AS m FROM p), b AS (SELECT *, CASE WHEN m < 0 THEN r END AS xd, CASE WHEN m < 0 AND r IS NOT NULL THEN m END AS yd, CASE WHEN m > 0 THEN r END AS xu, CASE WHEN m > 0 AND r IS NOT NULL THEN m END AS yu FROM k)
SELECT entity, dt, ROUND({gate('MAX(r)', 'r', 21, 0)}, 6) + 0.0 AS max_ret_21, ROUND({gate('MIN(r)', 'r', 21, 0)}, 6) + 0.0 AS min_ret_21, ROUND(CASE WHEN COUNT(xd) OVER {win(63)} >= 21 THEN COVAR_SAMP(xd, yd) OVER {win(63)} / NULLIF(VAR_SAMP(yd) OVER {win(63)}, 0) END - CASE WHEN COUNT(xu) OVER {win(63)} >= 21 THEN COVAR_SAMP(xu, yu) OVER {win(63)} / NULLIF(VAR_SAMP(yu) OVER {win(63)}, 0) END, 3) + 0.0 AS beta_asym_63 FROM b""")
def lottery_block(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("m", F.avg("r").over(PANEL.section))
    out, _ = K.lottery(df, "r", "m")
    return tidy(out.select("entity", "dt", "max_ret_21", "min_ret_21", "beta_asym_63"), 6, beta_asym_63=3)


@query("interaction_block", f"""{P}, b AS (SELECT entity, dt, entity % 6 AS grp, {gate('AVG(spread)', 'spread', 21, 1)} * disc AS x_spread_x_amihud, disc * n AS x_si_x_mom, (n - LAG(n, 21) OVER (PARTITION BY entity ORDER BY dt)) * spread AS x_oi_skew_flow, (hi - lo) - (px - op) AS x_vrp_term, {gate('AVG(spread)', 'spread', 21, 1)} / {gate('AVG(ABS(r))', 'r', 21, 1)} AS x_overnight_share_21, EXP({gate('SUM(LN(1 + r))', 'r', 21, 21)}) - 1 AS m FROM p)
SELECT entity, dt, ROUND(x_spread_x_amihud / 7.1::DOUBLE, 7) AS x_spread_x_amihud, ROUND(x_si_x_mom, 6) AS x_si_x_mom, ROUND(x_oi_skew_flow, 6) + 0.0 AS x_oi_skew_flow, ROUND(x_vrp_term / 7.1::DOUBLE, 4) + 0.0 AS x_vrp_term, ROUND(x_overnight_share_21, 6) AS x_overnight_share_21, ROUND(m - AVG(m) OVER (PARTITION BY dt, grp), 5) + 0.0 AS x_rel_mom_21 FROM b""")
def interaction_block(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("grp", F.col("entity") % 6)
    out, names = K.interactions(df, "r", "grp", "spread", "disc", "disc", "n", "n", "spread", "hi", "px", "lo", "op", "spread", "r")
    return tidy(out.select("entity", "dt", *names).withColumns({c: F.col(c) / 7.1 for c in ("x_vrp_term", "x_spread_x_amihud")}), 6, x_spread_x_amihud=7, x_vrp_term=4, x_rel_mom_21=5)


@query("analyst_rules", "SELECT p_partkey, ROUND(6 - p_size / 10.0, 6) + 0.0 AS rec, ROUND(p_retailprice / NULLIF(p_size, 0) - 1, 6) AS gap, ROUND(1 / NULLIF(p_size::DOUBLE, 0), 8) AS ey, ROUND(LN(p_retailprice * p_size), 6) AS size FROM part")
def analyst_rules(spark, sf_dir):
    s, v = F.col("p_size").cast("double"), F.col("p_retailprice")
    p = table(spark, sf_dir, "part")
    return tidy(p.select("p_partkey", K.inverted_recommendation(s / 10).alias("rec"), K.target_gap(v, s).alias("gap"), K.earnings_yield(s).alias("ey"), K.log_size(v, s).alias("size")), 6, ey=8)


@query("mark_arrays", f"{P}, k AS (SELECT dt, entity, r, value, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY value DESC, entity) - 1 AS slot FROM p) SELECT dt, ROUND(SUM(CASE WHEN slot < 3 THEN COALESCE(r, 0) ELSE 0 END), 6) + 0.0 AS options, ROUND(SUM(CASE WHEN slot < 2 THEN COALESCE(value / 7.1::DOUBLE, 0) ELSE 0 END), 4) AS stocks, 5::INT AS slots FROM k GROUP BY dt")
def mark_arrays(spark, sf_dir):
    from lodestar.operators import reshape as S

    top = S.slots(panel_frame(spark, sf_dir).withColumn("v", F.col("value") / 7.1), "value", 5)
    wide = S.wide(top, "dt", "slot", "r", [0, 1, 2], "ret").join(S.wide(top, "dt", "slot", "v", [0, 1], "val"), "dt")
    made = K.marks(wide, 3, 2, "ret", "val")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return tidy(made.select("dt", total(F.slice("labels", 1, 3)).alias("options"), total(F.slice("labels", 4, 2)).alias("stocks"), F.size("is_option").alias("slots")), 6, stocks=4)


@query("liquid_universe_by_coverage", f"{P}, d AS (SELECT COUNT(DISTINCT dt)::DOUBLE AS n FROM p) SELECT entity, ROUND(COUNT(r) / ANY_VALUE(d.n), 8) AS coverage, ROUND(STDDEV_POP(r), 6) AS vol, ROUND(1 / STDDEV_POP(r), 6) AS inverse_vol FROM p, d GROUP BY entity ORDER BY COUNT(r) DESC, 1 / STDDEV_POP(r) DESC LIMIT 10")
def liquid_universe_by_coverage(spark, sf_dir):
    return tidy(N.liquid(panel_frame(spark, sf_dir), "r", 10), 6, coverage=8)


@query("eligible_names", f"{P}, d AS (SELECT DISTINCT dt FROM p WHERE dt <= DATE '2000-06-30' ORDER BY dt DESC LIMIT 126) SELECT entity, COUNT(r) AS n_r, COUNT(CASE WHEN n >= 2 THEN px END) AS n_deep, ROUND(AVG(volume), 6) AS mean_volume, ROUND(1 - COUNT(volume) / 126.0, 8) AS missing FROM p WHERE dt IN (SELECT dt FROM d) GROUP BY 1 HAVING COUNT(r) >= 21 AND COUNT(CASE WHEN n >= 2 THEN px END) >= 3 AND AVG(volume) >= 20 AND 1 - COUNT(volume) / 126.0 <= 0.9")
def eligible_names(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("deep", F.when(F.col("n") >= 2, F.col("px")))
    made = N.eligible(df, ["r"], F.lit("2000-06-30").cast("date"), 126, 21, "volume", 20.0, 0.9)
    deep = N.eligible(df, ["deep"], F.lit("2000-06-30").cast("date"), 126, 3)
    return tidy(made.join(deep, "entity").select("entity", "n_r", "n_deep", "mean_volume", "missing"), 6, missing=8)


@query("less_illiquid", f"{P}, m AS (SELECT entity, MEDIAN(ABS(r) / NULLIF(value, 0)) AS median FROM p GROUP BY 1) SELECT entity, ROUND(median * 1e6, 6) AS median FROM m WHERE median <= (SELECT QUANTILE_CONT(median, 0.9) FROM m)")
def less_illiquid(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("x", F.abs("r") / F.col("value"))
    return tidy(N.less_illiquid(df, "x").withColumn("median", F.col("median") * 1e6))


@query("pool_residuals", f"{P}, k AS (SELECT *, AVG(r) OVER (PARTITION BY dt) AS m FROM p), f AS (SELECT entity, REGR_SLOPE(r, m) AS b, REGR_INTERCEPT(r, m) AS a FROM k WHERE r IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 4) SELECT entity, dt, ROUND(r - a - b * m, 5) + 0.0 AS residual FROM k JOIN f USING (entity)")
def pool_residuals(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("m", F.avg("r").over(PANEL.section))
    return tidy(N.residuals(df, "r", ["m"]).select("entity", "dt", "residual"), 5)


def _with_market(df, name: str):
    """Adds the mean return of the row's date: a row a date is broadcast, and rows stay where their series are."""
    mean = df.groupBy(F.col("dt").alias("__dt")).agg(F.avg("r").alias(name))
    return df.join(F.broadcast(mean), F.col("dt").eqNullSafe(F.col("__dt")), "left").drop("__dt")


@query("residual_communities")
def residual_communities(spark, sf_dir):
    df = _with_market(panel_frame(spark, sf_dir), "m")
    return N.communities(N.residuals(df, "r", ["m"]), "residual", F.year("dt"))


@query("clustered_universe")
def clustered_universe(spark, sf_dir):
    return N.select_by(panel_frame(spark, sf_dir), "r", _rebalances(spark, sf_dir), "clusters")


@query("tail_universe")
def tail_universe(spark, sf_dir):
    return N.select_by(panel_frame(spark, sf_dir), "spread", _rebalances(spark, sf_dir), "tail_hypergraph")


def _zw(x: str) -> str:
    return f"COALESCE(CASE WHEN STDDEV_POP({x}) OVER () >= 1e-12 THEN ({x} - AVG({x}) OVER ()) / STDDEV_POP({x}) OVER () END, 0)"


@query("sleeve_scores", f"""{P}, k AS (SELECT entity, dt, COALESCE(r, 0) AS e, px AS beta, value AS adv, spread AS iv, disc AS hv, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY dt DESC) AS i FROM p),
w AS (SELECT entity, COALESCE(SUM(e) FILTER (WHERE i BETWEEN 22 AND 252), 0) AS trend, -SUM(e) FILTER (WHERE i <= 21) AS reversal, STDDEV_SAMP(e) FILTER (WHERE i <= 63) AS sigma, ARG_MAX(beta, dt) AS beta, MEDIAN(adv) AS adv, ARG_MAX(iv, dt) AS iv, ARG_MAX(hv, dt) AS hv FROM k GROUP BY 1),
x AS (SELECT *, iv - hv AS c, COALESCE(sigma, 0) + ABS(hv) AS l, -(RANK() OVER (ORDER BY adv) + (COUNT(*) OVER (PARTITION BY adv) - 1) / 2.0) / COUNT(*) OVER () AS q, {_zw('sigma')} AS zs, {_zw('beta')} AS zb FROM w), y AS (SELECT *, ABS(hv - iv) AS d1, ABS(hv) AS d2, ABS(iv) AS d3, (-zs - zb) / 2 AS df, {_zw('trend')} AS ztr, {_zw('reversal')} AS zre FROM x),
v AS (SELECT *, {_zw('d1')} + {_zw('d2')} + {_zw('d3')} + {_zw('d3')} AS isf, ABS(ztr) AS atr, {_zw('c')} AS carry, {_zw('df')} AS defensive, {_zw('l')} AS lottery, {_zw('q')} AS illiquid FROM y)
SELECT entity, ROUND(ztr, 5) + 0.0 AS trend, ROUND(zre, 5) + 0.0 AS reversal, ROUND(carry, 5) + 0.0 AS carry, ROUND(defensive, 5) + 0.0 AS defensive, ROUND(lottery, 5) + 0.0 AS lottery, ROUND(illiquid, 5) + 0.0 AS illiquid, ROUND(0.4 * zs + 0.3 * {_zw('isf')} + 0.3 * {_zw('atr')}, 5) + 0.0 AS within_rank, ROUND(sigma, 5) AS sigma FROM v""")
def sleeve_scores(spark, sf_dir):
    made = N.sleeve_scores(panel_frame(spark, sf_dir), "r", "px", "value", {"iv": "spread", "hv": "disc", "skew": "disc", "term": "spread", "skewness": "spread"})
    return tidy(made, 5)


@query("ridge_signal", f"{P}, m AS (SELECT entity, COALESCE(AVG(r), 0) AS m FROM p GROUP BY 1) SELECT entity, ROUND((m + 2 * AVG(m) OVER ()) / 3, 6) + 0.0 AS signal FROM m")
def ridge_signal(spark, sf_dir):
    return tidy(N.ridge_signal(panel_frame(spark, sf_dir), "r", 2.0))


@query("participation", f"{_W}, m AS (SELECT entity, ARG_MAX(weight, dt) AS weight, AVG(value) AS adv FROM w GROUP BY 1) SELECT b AS book, ROUND(5 / 1e4 * SUM(ABS(weight)) + 0.5 / 1e4 * SUM(SQRT(ABS(weight) * b / adv)), 7) AS cost, ROUND(MAX(ABS(weight) * b / adv), 6) AS most_participation FROM m, (VALUES (1e6::DOUBLE), (1e7::DOUBLE), (1e8::DOUBLE)) v(b) GROUP BY 1")
def participation(spark, sf_dir):
    last = held(spark, sf_dir).groupBy("entity").agg(F.max_by("weight", "dt").alias("weight"), F.avg("value").alias("adv"))
    return tidy(N.participation(last, "weight", "adv", (1e6, 1e7, 1e8)), 7, most_participation=6)


@query("packed_universe", f"{P}, e AS (SELECT DISTINCT entity, (entity * 7) % 5 AS c FROM p) SELECT entity, c AS community, CAST(ROW_NUMBER() OVER (ORDER BY c, entity) - 1 AS INT) AS slot, CAST(DENSE_RANK() OVER (ORDER BY c) - 1 AS INT) AS shard FROM e")
def packed_universe(spark, sf_dir):
    e = panel_frame(spark, sf_dir).select("entity").distinct().withColumn("community", (F.col("entity") * 7) % 5)
    return N.packed_frame(e, "entity", "community")


@query("masked_members", f"{P}, m AS (SELECT entity, dt FROM p WHERE n >= 2) SELECT p.entity, p.dt, ROUND(CASE WHEN m.entity IS NOT NULL THEN p.r END, 6) + 0.0 AS r, p.n FROM p LEFT JOIN m USING (entity, dt)")
def masked_members(spark, sf_dir):
    df = panel_frame(spark, sf_dir).select("entity", "dt", "r", "n")
    return tidy(N.masked_members(df, df.where("n >= 2"), ["r"], ["entity", "dt"]))


@query("far_from_equal", f"{_W}, o AS (SELECT entity, dt, ABS(weight - 1.0 / COUNT(*) OVER (PARTITION BY dt)) AS l1 FROM w), k AS (SELECT entity FROM o GROUP BY 1 HAVING AVG(l1) >= 0.015) SELECT entity, COUNT(*) AS rows FROM o WHERE entity IN (SELECT entity FROM k) GROUP BY 1")
def far_from_equal(spark, sf_dir):
    k = F.count(F.lit(1)).over(PANEL.section)
    paths = held(spark, sf_dir).withColumn("l1", F.abs(F.col("weight") - 1 / k))
    return N.far_from_equal(paths, "entity", "l1", 0.015).groupBy("entity").agg(F.count(F.lit(1)).alias("rows"))


@query("reported_returns", f"{P}, i AS (SELECT entity, dt, ABS(px / LAG(px) OVER (PARTITION BY entity ORDER BY dt) - 1 - spread) AS d FROM p), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY dt) AS j FROM i WHERE d IS NOT NULL) SELECT entity, COUNT(*) AS checked, COUNT(*) FILTER (WHERE d > 0.3) AS off, ROUND(MAX(d), 6) AS worst FROM k WHERE j <= 3 GROUP BY 1")
def reported_returns(spark, sf_dir):
    return tidy(N.reported_returns(panel_frame(spark, sf_dir), "px", "spread", tolerance=0.3))


# episodes and bitemporal reads

_EP = "ep AS (SELECT o_orderkey AS episode, o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 120 AS e FROM orders WHERE o_orderstatus = 'P'), fa AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, o_orderstatus AS st FROM orders WHERE o_orderstatus <> 'P')"


def _episodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    ep = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("episode"), F.col("o_custkey").alias("k"), F.col("d").alias("start"), F.date_add("d", 120).alias("end"))
    return ep, o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("k"), "d", F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("st"))


@query("episode_median", f"WITH {_EP}, i AS (SELECT episode, MEDIAN(v) AS m FROM ep JOIN fa ON ep.k = fa.k AND d BETWEEN s AND e GROUP BY 1), a AS (SELECT k, MEDIAN(v) AS m FROM fa GROUP BY 1) SELECT ep.episode, ep.k, ROUND(COALESCE(i.m, a.m), 3) AS median_v FROM ep LEFT JOIN i USING (episode) LEFT JOIN a ON ep.k = a.k")
def episode_median(spark, sf_dir):
    ep, fa = _episodes(spark, sf_dir)
    return tidy(T.episode_median(ep, fa, "k", "d", "v").select("episode", "k", "median_v"), 3)


@query("episode_latest", f"WITH {_EP}, f AS (SELECT k, d, MAX(v) AS v FROM fa GROUP BY 1, 2) SELECT episode, ep.k, ROUND(f.v, 2) AS v FROM ep ASOF LEFT JOIN f ON ep.k = f.k AND ep.e >= f.d")
def episode_latest(spark, sf_dir):
    ep, fa = _episodes(spark, sf_dir)
    return tidy(T.episode_latest(ep, fa.select("k", "d", "v"), "k", "d", ["v"]).select("episode", "k", "v"), 2)


@query("episode_fields", f"WITH {_EP} SELECT episode, ep.k, COUNT(v) AS n, MEDIAN(CASE WHEN st = 'F' THEN v END) AS filled, COUNT(*) FILTER (WHERE st = 'O') AS open_ FROM ep JOIN fa ON ep.k = fa.k AND d BETWEEN s AND e GROUP BY 1, 2")
def episode_fields(spark, sf_dir):
    ep, fa = _episodes(spark, sf_dir)
    made = T.in_interval(fa, ep, "k", "d", "start", "end", {"n": F.count("v"), "filled": F.percentile(F.when(F.col("st") == "F", F.col("v")), F.lit(0.5)), "open_": F.count_if(F.col("st") == "O")})
    return made.where("n is not null").select("episode", "k", "n", "filled", "open_")


@query("spine", "SELECT LPAD(CAST(c.c_nationkey AS VARCHAR), 6, '0') AS gvkey, c_custkey, s_suppkey AS secid, n_regionkey::BIGINT AS permno FROM customer c LEFT JOIN (SELECT DISTINCT n_nationkey, n_regionkey FROM nation) n ON n_nationkey = c_nationkey JOIN (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier) s ON s_nationkey = n_regionkey")
def spine(spark, sf_dir):
    facts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("gvkey"), "c_custkey")
    first = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gvkey"), F.col("n_regionkey").cast("string").alias("permno"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("permno"), F.col("s_suppkey").alias("secid"))
    return T.spine(facts, first, second, "gvkey", "permno", "secid", ["c_custkey"]).select("gvkey", "c_custkey", "secid", "permno")


_LOG = "lg AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, ts AS kn, event_id, value AS v, CASE WHEN value > 50 THEN value END AS rate FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-25'), la AS (SELECT k, d, v, rate FROM lg QUALIFY ROW_NUMBER() OVER (PARTITION BY k, d ORDER BY kn DESC) = 1)"


@query("read_filled", f"""WITH {_LOG}, c AS (SELECT CAST(x AS DATE) AS d FROM generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-28', INTERVAL 1 DAY) t(x) WHERE ISODOW(x) <= 5), a AS (SELECT d FROM c UNION SELECT d FROM la WHERE d <= DATE '2024-01-28'), f AS (SELECT a.d, LAST_VALUE(v IGNORE NULLS) OVER w AS v, LAST_VALUE(rate IGNORE NULLS) OVER w AS rate FROM a LEFT JOIN la USING (d) WINDOW w AS (ORDER BY a.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT d, ROUND(v, 6) AS v, ROUND(COALESCE(rate, 0), 6) AS rate FROM f WHERE d BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' AND v IS NOT NULL""")
def read_filled(spark, sf_dir):
    log = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("d"), "ts", F.col("value").alias("v"), F.when(F.col("value") > 50, F.col("value")).alias("rate"))
    return tidy(T.read_filled(log, ["k"], "d", "ts", F.lit("2024-01-25").cast("timestamp"), "2024-01-03", "2024-01-28", ["v", "rate"], ["rate"]))


@query("wide_macro", """WITH l AS (SELECT event_type AS s, CAST(ts AS DATE) AS e, CAST(ts AS DATE) + 2 AS a, value AS v, ts FROM events WHERE event_type IN ('click', 'error')), x AS (SELECT s, a, ARG_MAX(v, ts) AS v FROM l GROUP BY 1, 2), c AS (SELECT CAST(x AS DATE) AS dt, s FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-10', INTERVAL 1 DAY) t(x), (VALUES ('click'), ('error')) v(s)), j AS (SELECT c.dt, c.s, x.v FROM c ASOF LEFT JOIN x ON c.s = x.s AND c.dt >= x.a) SELECT dt, ROUND(MAX(CASE WHEN s = 'click' THEN v END), 6) AS click, ROUND(MAX(CASE WHEN s = 'error' THEN v END), 6) AS error FROM j GROUP BY 1""")
def wide_macro(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumn("a", F.date_add(F.col("ts").cast("date"), 2))
    return tidy(T.wide_macro(log, "event_type", "ts", "a", "value", ["click", "error"], "2024-01-05", "2024-02-10"))


@query("state_filter")
def state_filter(spark, sf_dir):
    from lodestar.operators import latent

    daily = panel_frame(spark, sf_dir).groupBy("dt").agg(F.avg("r").alias("x")).withColumn("k", F.lit(0))
    return tidy(latent.state_filter(daily, "x", "dt", "k", 504, 63))


@query("characteristic_residuals")
def characteristic_residuals(spark, sf_dir):
    from lodestar.operators import latent

    df = panel_frame(spark, sf_dir).withColumn("one", F.lit(1.0))
    chars = ["one", "spread", "disc"]
    loadings, factors = latent.characteristic_factors(df, "r", chars, 2)
    return tidy(latent.characteristic_residuals(df, "r", chars, loadings, factors).select("entity", "dt", "residual"), 5)


@query("chosen_universe")
def chosen_universe(spark, sf_dir):
    df = _with_market(panel_frame(spark, sf_dir), "mk").withColumn("illiq", F.abs("r") / F.col("value"))
    n = df.select("entity").distinct().count()
    spec = N.Spec(k=max(4, min(30, n // 3)), quotas=(("trend", 3), ("reversal", 2), ("carry", 2), ("defensive", 2), ("lottery", 1), ("illiquid", 1), ("core", 2)), most_of_community=max(8, n // 3))
    made, _ = N.choose_universe(df, "2000-12-31", ["mk"], "spread", "value", "illiq", {"iv": "spread", "hv": "disc", "skew": "disc", "term": "spread", "skewness": "spread"}, spec=spec, project=lambda w: w * 0.5)
    return spark.createDataFrame(made)


@query("implied_volatilities")
def implied_volatilities(spark, sf_dir):
    from lodestar.functions import scalars
    from lodestar.operators import latent

    p = table(spark, sf_dir, "part")
    s, years, call = F.col("p_retailprice"), F.col("p_size") / 365.0 + 0.1, F.col("p_partkey") % 2 == 0
    price = scalars.greeks(s, F.lit(1000.0), years, F.lit(0.25), 0.02, call)["price"]
    return tidy(p.select("p_partkey", latent.implied_volatility(price, s, F.lit(1000.0), years, F.lit(0.02), call).alias("vol")), 3)


_GW = "SELECT QUANTILE_CONT(px, 0.01) AS ql, QUANTILE_CONT(px, 0.99) AS qh FROM p"


@query("winsorized_overall", f"{P}, g AS ({_GW}) SELECT entity, dt, ROUND(LEAST(GREATEST(px, ql), qh) / 7.1::DOUBLE, 5) AS px FROM p, g")
def winsorized_overall(spark, sf_dir):
    from lodestar.operators import cross_section as X

    made = X.winsorize_all(panel_frame(spark, sf_dir).select("entity", "dt", "px"), ["px"])
    return tidy(made.withColumn("px", F.col("px") / 7.1), 5)


@query("exposure_inputs", f"{P}, q AS (SELECT dt, QUANTILE_CONT(r, 0.01) AS ql, QUANTILE_CONT(r, 0.99) AS qh FROM p GROUP BY 1) SELECT entity, dt, ROUND(COALESCE(CASE WHEN r IS NOT NULL THEN LEAST(GREATEST(r, ql), qh) END, 0), 6) + 0.0 AS r FROM p JOIN q USING (dt)")
def exposure_inputs(spark, sf_dir):
    from lodestar.operators import cross_section as X

    return tidy(X.exposure_inputs(panel_frame(spark, sf_dir).select("entity", "dt", "r"), ["r"]))


@query("short_interest", f"{P}, rl AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS dt, MAX(l_discount) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders WHERE DAYOFWEEK(o_orderdate) BETWEEN 1 AND 5), e AS (SELECT DISTINCT entity FROM p), g AS (SELECT entity, dt, v FROM d CROSS JOIN e LEFT JOIN rl USING (entity, dt)) SELECT entity, dt, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ratio FROM g")
def short_interest(spark, sf_dir):
    from lodestar.operators import reshape as S

    releases = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("dt"), "l_discount")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("dt")).where(F.dayofweek("dt").between(2, 6)).distinct()
    return S.short_interest(releases, dates, panel_frame(spark, sf_dir).select("entity").distinct(), "l_discount")


@query("aligned_mask", "WITH m AS (SELECT CAST(o_orderdate AS DATE) AS dt, BOOL_OR(o_orderstatus = 'P') AS mask FROM orders GROUP BY 1), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem) SELECT dt, COALESCE(mask, FALSE) AS mask FROM d LEFT JOIN m USING (dt)")
def aligned_mask(spark, sf_dir):
    from lodestar.operators import reshape as S

    sealed = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("dt"), (F.col("o_orderstatus") == "P").alias("mask"))
    return S.aligned_mask(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("dt")), sealed, 3)


@query("coverage_masks", f"{P} SELECT entity, dt, CASE WHEN entity % 2 = 0 THEN r IS NOT NULL AND n >= 2 ELSE r IS NOT NULL AND volume > 20 END AS valid FROM p")
def coverage_masks(spark, sf_dir):
    from lodestar.operators import reshape as S

    only = lambda c, v: F.when(c, F.col(v))
    made = S.coverage_mask(F.col("entity") % 2 == 0, F.col("r"), only(F.col("n") >= 2, "px"), only(F.col("volume") > 20, "px"))
    return panel_frame(spark, sf_dir).select("entity", "dt", made.alias("valid"))


@query("fixed_slots", f"{P}, d AS (SELECT DISTINCT dt FROM p), s AS (SELECT (entity // 10)::INT AS slot, entity FROM p WHERE entity % 10 = 3 GROUP BY entity), m AS (SELECT DISTINCT dt, entity FROM p WHERE n >= 2) SELECT d.dt, s.slot, s.entity, m.entity IS NOT NULL AS valid FROM d CROSS JOIN s LEFT JOIN m ON m.dt = d.dt AND m.entity = s.entity")
def fixed_slots(spark, sf_dir):
    from lodestar.operators import reshape as S

    df = panel_frame(spark, sf_dir)
    slots_ = df.where("entity % 10 = 3").select(F.floor(F.col("entity") / 10).cast("int").alias("slot"), "entity").distinct()
    return S.fixed_slots(slots_, df.select("dt"), df.where("n >= 2"))


@query("risk_premia", f"{P}, v AS (SELECT entity, dt, {gate(_HV, 'r', 21, 10)} * SQRT(252.0) AS hv, 0.15 + spread AS iv FROM p) SELECT entity, dt, ROUND(iv * iv - hv * hv, 5) + 0.0 AS vrp, ROUND(iv - hv, 6) + 0.0 AS level FROM v")
def risk_premia(spark, sf_dir):
    from lodestar.functions import rolling as R

    iv, hv = 0.15 + F.col("spread"), R.volatility(F.col("r"), 21)
    return tidy(panel_frame(spark, sf_dir).select("entity", "dt", R.variance_risk_premium(iv, hv).alias("vrp"), (iv - hv).alias("level")), 6, vrp=5)


@query("tail_asymmetry")
def tail_asymmetry(spark, sf_dir):
    from lodestar.functions import rolling as R

    df = panel_frame(spark, sf_dir).withColumn("m", F.avg("r").over(PANEL.section))
    return tidy(R.tail_asymmetry(df, "r", "m").select("entity", "dt", "tail_asymmetry"))


@query("text_embeddings")
def text_embeddings(spark, sf_dir):
    from lodestar.functions import text

    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("words"))
    made = text.embedded(p, "words", 4, 256)
    return tidy(made.select("p_partkey", *(F.abs(F.col("embedding")[i]).alias(f"e{i}") for i in range(4))), 5)
