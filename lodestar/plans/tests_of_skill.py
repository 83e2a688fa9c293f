"""Queries of validation geometry and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import experts as X
from lodestar.operators import statistics as Z
from lodestar.operators import validation as V
from lodestar.panel import PANEL
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import panel_frame, query, returns_frame, table, tidy

_D = "d AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS idx, COUNT(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders))"
_E = "e AS (SELECT g, CAST(FLOOR(g * n / 6.0) AS BIGINT) AS low, CAST(FLOOR((g + 1) * n / 6.0) AS BIGINT) - 1 AS high FROM (SELECT DISTINCT n FROM d), generate_series(0, 5) t(g))"


def _dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("dt")).distinct()


@query("date_groups", f"WITH {_D}, {_E} SELECT dt, CAST(idx AS INT) AS idx, n, CAST(g AS INT) AS \"group\" FROM d JOIN e ON idx BETWEEN low AND high")
def date_groups(spark, sf_dir):
    return V.grouped_dates(_dates(spark, sf_dir))


_F = "f AS (SELECT a.g AS g1, b.g AS g2, a.low AS l1, a.high AS h1, b.low AS l2, b.high AS h2, ROW_NUMBER() OVER (ORDER BY a.g, b.g) - 1 AS fold FROM e a JOIN e b ON a.g < b.g)"


@query("cpcv_folds", f"""WITH {_D}, {_E}, {_F}, r AS (SELECT CAST(fold AS INT) AS fold, dt, CAST(g AS INT) AS "group", CASE WHEN g IN (g1, g2) THEN 'test' WHEN NOT (idx BETWEEN l1 - 21 AND h1 + 21 OR idx BETWEEN l2 - 21 AND h2 + 21) THEN 'train' END AS role FROM d JOIN e ON idx BETWEEN low AND high CROSS JOIN f) SELECT * FROM r WHERE role IS NOT NULL""")
def cpcv_folds(spark, sf_dir):
    return V.cpcv_folds(_dates(spark, sf_dir))


@query("cpcv_paths", f"WITH {_D}, {_E}, {_F}, t AS (SELECT fold, g1 AS g FROM f UNION ALL SELECT fold, g2 FROM f) SELECT CAST(ROW_NUMBER() OVER (PARTITION BY g ORDER BY fold) - 1 AS INT) AS path, CAST(g AS INT) AS \"group\", CAST(fold AS INT) AS fold FROM t")
def cpcv_paths(spark, sf_dir):
    return V.cpcv_paths(6, 2, spark)


@query("walk_forward", f"""WITH {_D}, b AS (SELECT *, GREATEST(10, ROUND(n * 0.15 / 5)) AS block FROM d), r AS (SELECT CAST(k AS INT) AS fold, dt, CASE WHEN idx >= n - block * (5 - k) AND idx < n - block * (4 - k) THEN 'test' WHEN idx < n - block * (5 - k) THEN 'train' END AS role FROM b, generate_series(0, 4) t(k)) SELECT * FROM r WHERE role IS NOT NULL""")
def walk_forward(spark, sf_dir):
    return V.walk_forward(_dates(spark, sf_dir))


@query("hac_mean", f"""{P}, x AS (SELECT entity, dt, r, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY dt) AS i, COUNT(*) OVER (PARTITION BY entity) AS n, r - AVG(r) OVER (PARTITION BY entity) AS e, FLOOR(4 * POWER(COUNT(*) OVER (PARTITION BY entity) / 100.0, 2.0 / 9)) AS l FROM p WHERE r IS NOT NULL),
g AS (SELECT a.entity, SUM(CASE WHEN a.i = b.i THEN 1.0 ELSE 2 * (1 - (a.i - b.i) / (a.l + 1)) END * a.e * b.e) AS s FROM x a JOIN x b ON a.entity = b.entity AND b.i BETWEEN a.i - a.l AND a.i GROUP BY 1), m AS (SELECT entity, AVG(r) AS mean, MAX(n) AS n FROM x GROUP BY 1)
SELECT entity, n, ROUND(mean, 7) + 0.0 AS mean, ROUND(SQRT(GREATEST(s / n, 1e-24) / n), 7) AS se, ROUND(mean / SQRT(GREATEST(s / n, 1e-24) / n), 4) + 0.0 AS t FROM g JOIN m USING (entity)""")
def hac_mean(spark, sf_dir):
    return tidy(Z.hac_mean(panel_frame(spark, sf_dir), "r", "dt", "entity"), 7, t=4)


_M = f"{P}, m AS (SELECT entity, dt, r, AVG(r) OVER (PARTITION BY dt) AS mk, spread FROM p)"


def _market(spark, sf_dir):
    return panel_frame(spark, sf_dir).withColumn("mk", F.avg("r").over(PANEL.section))


@query("factor_alpha", f"{_M} SELECT entity, ROUND(REGR_INTERCEPT(r, mk), 6) + 0.0 AS alpha, ROUND(REGR_SLOPE(r, mk), 5) + 0.0 AS beta, ROUND(REGR_R2(r, mk), 6) AS r2, COUNT(*) AS n FROM m WHERE r IS NOT NULL AND mk IS NOT NULL GROUP BY entity")
def factor_alpha(spark, sf_dir):
    return tidy(Z.alpha(_market(spark, sf_dir), "r", "mk", ["entity"]), 6, beta=5)


@query("multi_factor_alpha", f"""{_M}, s AS (SELECT entity, COUNT(*) AS n, REGR_SLOPE(r, mk) AS bm, COVAR_POP(r, mk) AS rm, COVAR_POP(r, spread) AS rs, COVAR_POP(mk, spread) AS ms, VAR_POP(mk) AS vm, VAR_POP(spread) AS vs, AVG(r) AS ar, AVG(mk) AS am, AVG(spread) AS asp FROM m WHERE r IS NOT NULL AND mk IS NOT NULL AND spread IS NOT NULL GROUP BY 1), b AS (SELECT *, (rm * vs - rs * ms) / (vm * vs - ms * ms) AS b1, (rs * vm - rm * ms) / (vm * vs - ms * ms) AS b2 FROM s)
SELECT entity, n, ROUND(ar - b1 * am - b2 * asp, 5) + 0.0 AS alpha, ROUND(b1, 5) + 0.0 AS beta_mk, ROUND(b2, 4) + 0.0 AS beta_spread FROM b""")
def multi_factor_alpha(spark, sf_dir):
    return tidy(Z.multi_alpha(_market(spark, sf_dir), "r", ["mk", "spread"], "entity"), 5, beta_spread=4)


_PV = "v AS (SELECT l_suppkey AS entity, COUNT(*) / 10000.0 AS pv FROM lineitem GROUP BY 1)"


@query("false_discovery", f"""WITH {_PV}, k AS (SELECT entity, pv, pv * COUNT(*) OVER () / ROW_NUMBER() OVER (ORDER BY pv, entity) AS raw FROM v) SELECT entity, ROUND(pv, 8) AS pv, ROUND(LEAST(MIN(raw) OVER (ORDER BY pv, entity ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 8) AS adjusted, LEAST(MIN(raw) OVER (ORDER BY pv, entity ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) <= 0.06 AS discovery FROM k""")
def false_discovery(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg((F.count(F.lit(1)) / 10000).alias("pv")).orderBy("entity")
    return tidy(Z.false_discovery(p, "pv", 0.06), 8)


@query("overfitting_probability", f"""{P}, f AS (SELECT entity, dt, r, CAST(FLOOR((DENSE_RANK() OVER (ORDER BY dt) - 1) * 8.0 / (SELECT COUNT(DISTINCT dt) FROM p)) AS INT) AS b FROM p), b AS (SELECT entity, b, COUNT(r) AS c, SUM(r) AS s, SUM(r * r) AS q FROM f GROUP BY 1, 2),
masks AS (SELECT i, k FROM generate_series(0, 255) a(i), generate_series(0, 7) c(k) WHERE bit_count(i::INT) = 4), all_ AS (SELECT i, k, (i >> k) & 1 = 1 AS inside FROM masks),
t AS (SELECT i, entity, inside, SUM(c) AS c, SUM(s) AS s, SUM(q) AS q FROM b JOIN all_ ON b = k GROUP BY 1, 2, 3), h AS (SELECT i, entity, inside, s / c / (SQRT(GREATEST(q / c - (s / c) * (s / c), 0)) + 1e-12) AS sr FROM t), o AS (SELECT i, entity, MAX(CASE WHEN inside THEN sr END) AS ins, MAX(CASE WHEN NOT inside THEN sr END) AS outs FROM h GROUP BY 1, 2),
k AS (SELECT i, ROW_NUMBER() OVER (PARTITION BY i ORDER BY ins DESC, entity) AS best, ROW_NUMBER() OVER (PARTITION BY i ORDER BY outs, entity) / (COUNT(*) OVER (PARTITION BY i) + 1.0) AS w FROM o) SELECT ROUND(AVG(CASE WHEN w < 0.5 THEN 1.0 ELSE 0.0 END), 8) AS pbo, COUNT(*) AS combos FROM k WHERE best = 1""")
def overfitting_probability(spark, sf_dir):
    return tidy(Z.overfitting_probability(panel_frame(spark, sf_dir), "r", "dt", "entity"), 8)


@query("signed_rank", f"""{P}, z AS (SELECT entity, r, ABS(r) AS a FROM p WHERE r <> 0), k AS (SELECT *, RANK() OVER (PARTITION BY entity ORDER BY a) + (COUNT(*) OVER (PARTITION BY entity, a) - 1) / 2.0 AS rk FROM z), s AS (SELECT entity, SUM(CASE WHEN r > 0 THEN rk ELSE 0.0 END) AS w_plus, COUNT(*) AS n FROM k GROUP BY 1) SELECT entity, ROUND(w_plus, 2) AS w_plus, n, ROUND((w_plus - n * (n + 1) / 4.0) / SQRT(n * (n + 1) * (2 * n + 1) / 24.0), 6) + 0.0 AS z FROM s""")
def signed_rank(spark, sf_dir):
    return tidy(Z.signed_rank(panel_frame(spark, sf_dir), "r", "entity"), 6, w_plus=2)


@query("deflated_sharpe")
def deflated_sharpe(spark, sf_dir):
    return tidy(Z.deflated_sharpe(panel_frame(spark, sf_dir), "r", "entity"))


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    return tidy(Z.bootstrap_interval(panel_frame(spark, sf_dir), "r", "dt", "entity"))


@query("reality_check")
def reality_check(spark, sf_dir):
    return tidy(Z.reality_check(panel_frame(spark, sf_dir), "r", "dt", "entity"))


_X = "x AS (SELECT event_type AS expert, CAST(ts AS DATE) AS dt, ROUND(AVG(value), 6) AS loss FROM events GROUP BY 1, 2)"


def _losses(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("expert"), F.col("ts").cast("date").alias("dt")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query("unit_losses", f"""WITH {_X}, d AS (SELECT dt, MIN(loss) AS l, MAX(loss) AS h FROM x GROUP BY 1), q AS (SELECT dt, MIN(l) OVER w AS l, MAX(h) OVER w AS h FROM d WINDOW w AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT expert, dt, ROUND(loss, 6) AS loss, ROUND(COALESCE(CASE WHEN h > l THEN LEAST(GREATEST((loss - l) / (h - l), 0.0), 1.0) END, 0.5), 6) AS unit_loss FROM x JOIN q USING (dt)""")
def unit_losses(spark, sf_dir):
    return tidy(Z.unit_losses(_losses(spark, sf_dir), "loss", "dt", "expert").select("expert", "dt", "loss", "unit_loss"))


@query("follow_the_leader", f"""WITH {_X}, c AS (SELECT *, COALESCE(SUM(loss) OVER (PARTITION BY expert ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM x), b AS (SELECT *, c <= MIN(c) OVER (PARTITION BY dt) + 1e-15 AS best FROM c) SELECT expert, dt, ROUND(loss, 6) AS loss, ROUND(CASE WHEN best THEN 1.0 ELSE 0.0 END / COUNT(*) FILTER (WHERE best) OVER (PARTITION BY dt), 8) AS weight FROM b""")
def follow_the_leader(spark, sf_dir):
    return tidy(Z.follow_the_leader(_losses(spark, sf_dir), "loss", "dt", "expert").select("expert", "dt", "loss", "weight"), 8, loss=6)


def _mixed(method: str):
    def run(spark, sf_dir):
        losses = Z.unit_losses(_losses(spark, sf_dir), "loss", "dt", "expert")
        experts = [r[0] for r in losses.select("expert").distinct().orderBy("expert").collect()]
        return tidy(Z.mix_experts(losses, "unit_loss", "dt", "expert", experts, method))

    return run


for _method in ("adahedge", "fixed_share", "variable_share", "page_hinkley", "boa"):
    query(f"experts_{_method}")(_mixed(_method))


_XU = f"{_X}, d AS (SELECT dt, MIN(loss) AS l, MAX(loss) AS h FROM x GROUP BY 1), q AS (SELECT dt, MIN(l) OVER w AS l, MAX(h) OVER w AS h FROM d WINDOW w AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), u AS (SELECT expert, dt, COALESCE(CASE WHEN h > l THEN LEAST(GREATEST((loss - l) / (h - l), 0.0), 1.0) END, 0.5) AS unit_loss FROM x JOIN q USING (dt))"
query("experts_hedge", f"WITH {_XU}, c AS (SELECT expert, dt, EXP(-0.5 * COALESCE(SUM(unit_loss) OVER (PARTITION BY expert ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS e FROM u) SELECT expert, dt, ROUND(e / SUM(e) OVER (PARTITION BY dt), 6) AS weight FROM c")(_mixed("hedge"))


@query("garch_variance", f"""{P}, a AS (SELECT entity, COUNT(*) AS n, LIST(r ORDER BY dt) AS s FROM p WHERE r IS NOT NULL GROUP BY 1) SELECT entity, CAST(n AS INT) AS n, ROUND(list_reduce(list_prepend(s[1] * s[1], s), lambda h, x: 1e-6 + 0.05 * x * x + 0.9 * h), 8) AS variance FROM a""")
def garch_variance(spark, sf_dir):
    return tidy(Z.garch(panel_frame(spark, sf_dir), "r", "dt", "entity"), 8)


@query("pairwise_correlation", f"{P}, f AS (SELECT entity, dt, r FROM p WHERE r IS NOT NULL) SELECT a.entity AS a, b.entity AS b, ROUND(CORR(a.r, b.r), 6) + 0.0 AS corr, COUNT(*) AS n FROM f a JOIN f b ON a.dt = b.dt AND a.entity < b.entity GROUP BY 1, 2")
def pairwise_correlation(spark, sf_dir):
    return Z.pairwise_correlation(returns_frame(spark, sf_dir), "r", "dt", "entity", digits=6)


@query("tail_dependence", f"""{P}, f AS (SELECT entity, dt, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY r, dt) / (COUNT(*) OVER (PARTITION BY entity) + 1.0) AS u FROM p WHERE r IS NOT NULL), h AS (SELECT entity, dt FROM f WHERE u > 0.9), c AS (SELECT entity, COUNT(*) AS c FROM h GROUP BY 1), j AS (SELECT a.entity AS a, b.entity AS b, COUNT(*) AS both_ FROM h a JOIN h b ON a.dt = b.dt AND a.entity < b.entity GROUP BY 1, 2)
SELECT a, b, both_ AS "both", ROUND((both_ / x.c::DOUBLE + both_ / y.c::DOUBLE) / 2, 8) AS tail_dependence FROM j JOIN c x ON x.entity = a JOIN c y ON y.entity = b""")
def tail_dependence(spark, sf_dir):
    return tidy(Z.tail_dependence(panel_frame(spark, sf_dir), "r", "dt", "entity"), 8)


_XR = "xr AS (SELECT event_type AS expert, CAST(ts AS DATE) AS dt, AVG(value) / 1000 - 0.04 AS r FROM events GROUP BY 1, 2)"
_W5 = "(PARTITION BY expert ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_XS = f"{_XR}, xs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY expert ORDER BY dt) - 1 AS seen, CASE WHEN COUNT(r) OVER {_W5} >= 3 THEN CASE WHEN STDDEV_SAMP(r) OVER {_W5} <= 1e-15 THEN 0.0 ELSE AVG(r) OVER {_W5} / STDDEV_SAMP(r) OVER {_W5} * SQRT(252.0) END END AS score FROM xr)"


def _returns(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("expert"), F.col("ts").cast("date").alias("dt")).agg((F.avg("value") / 1000 - 0.04).alias("r"))


@query("rolling_leader", f"WITH {_XS}, u AS (SELECT *, CASE WHEN seen >= 5 THEN score END AS s FROM xs) SELECT dt, expert, ROUND(CASE WHEN COUNT(s) OVER (PARTITION BY dt) = 0 THEN 1.0 / COUNT(*) OVER (PARTITION BY dt) WHEN ROW_NUMBER() OVER (PARTITION BY dt ORDER BY s DESC NULLS LAST, expert) = 1 THEN 1.0 ELSE 0.0 END, 8) AS weight FROM u")
def rolling_leader(spark, sf_dir):
    return tidy(X.rolling_leader(_returns(spark, sf_dir), "r", "dt", "expert", 5, 3), 8)


@query("held_leader", f"WITH {_XS}, u AS (SELECT *, CASE WHEN seen > 0 AND seen % 4 = 0 THEN score END AS s FROM xs), c AS (SELECT dt, expert, CASE WHEN seen > 0 AND seen % 4 = 0 THEN CASE WHEN COUNT(s) OVER (PARTITION BY dt) = 0 THEN 1.0 / COUNT(*) OVER (PARTITION BY dt) WHEN ROW_NUMBER() OVER (PARTITION BY dt ORDER BY s DESC NULLS LAST, expert) = 1 THEN 1.0 ELSE 0.0 END WHEN seen = 0 THEN 1.0 / COUNT(*) OVER (PARTITION BY dt) END AS w FROM u) SELECT dt, expert, ROUND(LAST_VALUE(w IGNORE NULLS) OVER (PARTITION BY expert ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS weight FROM c")
def held_leader(spark, sf_dir):
    return tidy(X.held_leader(_returns(spark, sf_dir), "r", "dt", "expert", 5, 4, 3), 8)


def _named(spark, sf_dir):
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]


@query("experts_flip_flop")
def experts_flip_flop(spark, sf_dir):
    losses = Z.unit_losses(_losses(spark, sf_dir), "loss", "dt", "expert")
    return tidy(X.flip_flop(losses, "unit_loss", "dt", "expert", _named(spark, sf_dir)))


@query("experts_hysteresis")
def experts_hysteresis(spark, sf_dir):
    names = _named(spark, sf_dir)
    return tidy(X.hysteresis(_returns(spark, sf_dir), "r", "dt", "expert", names, names[0], 6, least=3))


@query("experts_sleeping")
def experts_sleeping(spark, sf_dir):
    df = _returns(spark, sf_dir).withColumn("hot", F.dayofmonth("dt") % 3 == 0)
    return tidy(X.sleeping_share(df, "r", "hot", "dt", "expert", _named(spark, sf_dir)))


@query("experts_eg")
def experts_eg(spark, sf_dir):
    return tidy(Z.mix_experts(_returns(spark, sf_dir), "r", "dt", "expert", _named(spark, sf_dir), "eg", rate=0.05))


@query("best_path", f"WITH {_X}, t AS (SELECT expert, SUM(loss) AS s FROM x GROUP BY 1), b AS (SELECT expert FROM t ORDER BY s, expert LIMIT 1) SELECT dt, expert, CASE WHEN expert = (SELECT expert FROM b) THEN 1.0::DOUBLE ELSE 0.0 END AS weight FROM x")
def best_path(spark, sf_dir):
    """Without a switch allowed it is the best single expert; paths with switches are tested against every path."""
    return tidy(X.best_path(_losses(spark, sf_dir), "loss", "dt", "expert", _named(spark, sf_dir), 0))


def _fold_pnl(spark, sf_dir):
    dates = panel_frame(spark, sf_dir).groupBy("dt").agg(F.avg("r").alias("mk"))
    folds = V.cpcv_folds(dates.select("dt")).where("role = 'test'")
    return folds.join(dates, "dt").select("fold", "dt", (F.col("mk") * (1 + F.col("fold") / 10)).alias("pnl")), dates.select("dt")


_EDGE = "pe AS (SELECT g, CAST(FLOOR(g * n / 6.0) AS BIGINT) AS low, CAST(FLOOR((g + 1) * n / 6.0) AS BIGINT) - 1 AS high FROM (SELECT DISTINCT n FROM di), generate_series(0, 5) t(g)), pf AS (SELECT a.g AS g1, b.g AS g2, ROW_NUMBER() OVER (ORDER BY a.g, b.g) - 1 AS fold FROM pe a JOIN pe b ON a.g < b.g), pt AS (SELECT fold, g1 AS g FROM pf UNION ALL SELECT fold, g2 FROM pf), pa AS (SELECT g, fold, ROW_NUMBER() OVER (PARTITION BY g ORDER BY fold) - 1 AS path FROM pt)"
_PATHS = f"{P}, dd AS (SELECT dt, AVG(r) AS mk FROM p GROUP BY 1), di AS (SELECT dt, mk, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS idx, COUNT(*) OVER () AS n FROM dd), {_EDGE}, pp AS (SELECT path, dt, fold, mk * (1 + fold / 10.0::DOUBLE) AS pnl FROM di JOIN pe ON idx BETWEEN low AND high JOIN pa USING (g)), ps AS (SELECT path, COUNT(pnl) AS n_days, COUNT(*) FILTER (WHERE pnl IS NULL) AS n_missing, AVG(pnl) AS mean_pnl, AVG(pnl) / (STDDEV_POP(pnl) + 1e-12) * SQRT(252.0) AS sharpe FROM pp GROUP BY 1)"


@query("path_sharpes", f"{_PATHS} SELECT CAST(path AS INT) AS path, n_days, n_missing, ROUND(mean_pnl, 6) + 0.0 AS mean_pnl, ROUND(sharpe, 5) + 0.0 AS sharpe FROM ps")
def path_sharpes(spark, sf_dir):
    pnl, dates = _fold_pnl(spark, sf_dir)
    return tidy(V.path_sharpes(V.reconstruct_paths(pnl, dates)), 6, sharpe=5)


@query("path_summary", f"{_PATHS} SELECT COUNT(*) AS n_paths, ROUND(AVG(sharpe), 5) + 0.0 AS sharpe_mean, ROUND(STDDEV_POP(sharpe), 5) AS sharpe_std, ROUND(QUANTILE_CONT(sharpe, 0.05), 5) + 0.0 AS sharpe_p05, ROUND(MEDIAN(sharpe), 5) + 0.0 AS sharpe_median, ROUND(QUANTILE_CONT(sharpe, 0.95), 5) + 0.0 AS sharpe_p95, ROUND(AVG(CAST(sharpe > 0 AS INT)), 8) AS positive_path_rate FROM ps")
def path_summary(spark, sf_dir):
    pnl, dates = _fold_pnl(spark, sf_dir)
    return tidy(V.summarise_paths(V.path_sharpes(V.reconstruct_paths(pnl, dates))), 5, positive_path_rate=8)


@query("reselect_purge", f"WITH {_D}, m AS (SELECT dt, idx, idx % 100 = 7 AS s FROM d) SELECT a.dt, CAST(a.idx AS INT) AS idx, BOOL_OR(b.s) AS purged FROM m a JOIN m b ON b.idx BETWEEN a.idx - 21 AND a.idx + 21 GROUP BY 1, 2")
def reselect_purge(spark, sf_dir):
    dates = _dates(spark, sf_dir).withColumn("i", F.row_number().over(Window.orderBy("dt")) - 1)
    return V.reselect_purge(dates, F.col("i") % 100 == 7)


@query("fold_runs", f"{P}, dd AS (SELECT dt, AVG(r) AS mk FROM p GROUP BY 1), di AS (SELECT dt, mk, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS idx, COUNT(*) OVER () AS n FROM dd), b AS (SELECT *, GREATEST(10, ROUND(n * 0.15 / 5)) AS block FROM di), f AS (SELECT CAST(k AS BIGINT) AS fold, mk, CASE WHEN idx >= n - block * (5 - k) AND idx < n - block * (4 - k) THEN 'test' WHEN idx < n - block * (5 - k) THEN 'train' END AS role FROM b, generate_series(0, 4) t(k)) SELECT fold, COUNT(*) FILTER (WHERE role = 'train') AS n_train, COUNT(*) FILTER (WHERE role = 'test') AS n_test, ROUND(AVG(mk) FILTER (WHERE role = 'train'), 6) + 0.0 AS fitted, ROUND(AVG(mk) FILTER (WHERE role = 'test'), 6) + 0.0 AS scored FROM f GROUP BY 1")
def fold_runs(spark, sf_dir):
    import pandas as pd

    def trainer(fold, train, test):
        return pd.DataFrame({"fold": [fold], "n_train": [len(train)], "n_test": [len(test)], "fitted": [train.mk.mean()], "scored": [test.mk.mean()]})

    daily = panel_frame(spark, sf_dir).groupBy("dt").agg(F.avg("r").alias("mk"))
    return tidy(V.run_folds(daily, V.walk_forward(daily.select("dt")), trainer, "fold long, n_train long, n_test long, fitted double, scored double"))
