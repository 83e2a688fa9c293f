"""Queries over the cross-section of each date."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.operators import cross_section as X
from lodestar.operators import reshape as S
from lodestar.panel import PANEL
from lodestar.plans.registry import PANEL_SQL as P
from lodestar.plans.registry import panel_frame, query, table, tidy
from lodestar.session import cut

Q = "q AS (SELECT dt, QUANTILE_CONT(px, 0.01) AS lo1, QUANTILE_CONT(px, 0.99) AS hi1, QUANTILE_CONT(r, 0.01) AS lo2, QUANTILE_CONT(r, 0.99) AS hi2 FROM p GROUP BY dt), c AS (SELECT entity, dt, LEAST(GREATEST(px, lo1), hi1) AS px, CASE WHEN r IS NOT NULL THEN LEAST(GREATEST(r, lo2), hi2) END AS r FROM p JOIN q USING (dt))"
RK = "CASE WHEN {x} IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY dt, {x} IS NULL ORDER BY {x}, entity) END"


@query("winsorized", f"{P}, {Q} SELECT entity, dt, ROUND(px / 7.1::DOUBLE, 6) AS px, ROUND(r, 6) + 0.0 AS r FROM c")
def winsorized(spark, sf_dir):
    return tidy(X.winsorize(panel_frame(spark, sf_dir).select("entity", "dt", "px", "r"), ["px", "r"]).withColumn("px", F.col("px") / 7.1))


def _z(x: str) -> str:
    return f"ROUND(LEAST(GREATEST(({x} - AVG({x}) OVER (PARTITION BY dt)) / CASE WHEN STDDEV_POP({x}) OVER (PARTITION BY dt) < 1e-12 THEN 1.0 ELSE STDDEV_POP({x}) OVER (PARTITION BY dt) END, -3.0), 3.0), 5) + 0.0"


@query("section_z", f"{P} SELECT entity, dt, {_z('px')} AS z_px, CASE WHEN r IS NOT NULL THEN {_z('r')} END AS z_r FROM p")
def section_z(spark, sf_dir):
    return tidy(panel_frame(spark, sf_dir).select("entity", "dt", X.zscore(F.col("px")).alias("z_px"), X.zscore(F.col("r")).alias("z_r")), 5)


@query("section_law", f"{P}, {Q} SELECT entity, dt, {_z('px')} AS px, CASE WHEN r IS NOT NULL THEN {_z('r')} END AS r FROM c")
def section_law(spark, sf_dir):
    return tidy(X.normalise(panel_frame(spark, sf_dir).select("entity", "dt", "px", "r"), ["px", "r"]), 5)


@query("section_ranks", f"""{P} SELECT entity, dt, CAST({RK.format(x='n')} AS INT) AS ordinal, ROUND((RANK() OVER (PARTITION BY dt, n IS NULL ORDER BY n) + (COUNT(*) OVER (PARTITION BY dt, n) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY dt, n IS NULL), 8) AS share FROM p""")
def section_ranks(spark, sf_dir):
    return tidy(panel_frame(spark, sf_dir).select("entity", "dt", X.ordinal_rank("n").alias("ordinal"), X.average_rank_share("n").alias("share")), 8)


_LEGS = f"""k AS (SELECT *, COUNT(r) OVER (PARTITION BY dt) AS c, {RK.format(x='r')} AS rk FROM p), m AS (SELECT *, GREATEST(FLOOR(c / 5.0), 1) AS m FROM k),
l AS (SELECT *, CASE WHEN rk IS NULL OR c < 10 THEN 0.0 WHEN rk > c - m THEN 1.0 / m WHEN rk <= m THEN -1.0 / m ELSE 0.0 END AS weight FROM m)"""


@query("quantile_legs", f"{P}, {_LEGS} SELECT entity, dt, ROUND(weight, 8) + 0.0 AS weight FROM l")
def quantile_legs(spark, sf_dir):
    return tidy(X.leg_weights(panel_frame(spark, sf_dir), "r").select("entity", "dt", "weight"), 8)


@query("decile_long_short", f"""{P}, a AS (SELECT *, LEAD(r) OVER (PARTITION BY entity ORDER BY dt) AS nx FROM p), b AS (SELECT * FROM a WHERE spread IS NOT NULL), s AS (SELECT dt, nx, ({RK.format(x='spread')} - 1) / NULLIF(COUNT(*) OVER (PARTITION BY dt) - 1.0, 0) AS share FROM b)
SELECT dt, ROUND(AVG(CASE WHEN share >= 1 - 1.0 / 10 THEN nx END) - AVG(CASE WHEN share <= 1.0 / 10 THEN nx END), 6) + 0.0 AS spread, COUNT(nx) AS n FROM s GROUP BY dt""")
def decile_long_short(spark, sf_dir):
    return tidy(X.decile_long_short(panel_frame(spark, sf_dir), "spread", "r"))


_IC = f"a AS (SELECT *, LEAD(r) OVER (PARTITION BY entity ORDER BY dt) AS y FROM p), b AS (SELECT * FROM a WHERE r IS NOT NULL AND y IS NOT NULL)"


@query("information_coefficient", f"""{P}, {_IC}, k AS (SELECT dt, CAST({RK.format(x='r')} AS DOUBLE) AS rx, CAST({RK.format(x='y')} AS DOUBLE) AS ry FROM b) SELECT dt, ROUND(CORR(rx, ry), 6) + 0.0 AS ic, COUNT(*) AS n FROM k GROUP BY dt HAVING COUNT(*) >= 5""")
def information_coefficient(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("y", F.lead("r").over(PANEL.series))
    return tidy(X.information_coefficient(df, "r", "y"))


@query("ic_decay", f"""{P}, a AS (SELECT entity, dt, r, h AS horizon, CASE h WHEN 1 THEN LEAD(r, 1) OVER o WHEN 3 THEN LEAD(r, 3) OVER o WHEN 6 THEN LEAD(r, 6) OVER o ELSE LEAD(r, 12) OVER o END AS y FROM p, (VALUES (1), (3), (6), (12)) v(h) WINDOW o AS (PARTITION BY entity, h ORDER BY dt)),
b AS (SELECT * FROM a WHERE r IS NOT NULL AND y IS NOT NULL), k AS (SELECT horizon, dt, CAST(ROW_NUMBER() OVER (PARTITION BY dt, horizon ORDER BY r, entity) AS DOUBLE) AS rx, CAST(ROW_NUMBER() OVER (PARTITION BY dt, horizon ORDER BY y, entity) AS DOUBLE) AS ry FROM b),
d AS (SELECT horizon, dt, CORR(rx, ry) AS ic FROM k GROUP BY 1, 2 HAVING COUNT(*) >= 5) SELECT CAST(horizon AS INT) AS horizon, ROUND(AVG(ic), 6) + 0.0 AS mean_ic, COUNT(ic) AS dates FROM d GROUP BY 1""")
def ic_decay(spark, sf_dir):
    return tidy(X.ic_decay(panel_frame(spark, sf_dir), "r", "r"))


@query("fama_macbeth", f"""{P}, {_IC}, s AS (SELECT dt, REGR_SLOPE(y, r) AS slope FROM b GROUP BY dt HAVING COUNT(*) >= 5) SELECT ROUND(AVG(slope), 6) + 0.0 AS mean_slope, ROUND(AVG(slope) / (STDDEV_SAMP(slope) / SQRT(COUNT(slope))), 4) + 0.0 AS t, COUNT(slope) AS dates FROM s""")
def fama_macbeth(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("y", F.lead("r").over(PANEL.series))
    return tidy(X.fama_macbeth(df, "r", "y"), t=4)


@query("orthogonalised", f"""{P}, a AS (SELECT entity, dt, volume, n + 0.0 AS size FROM p) SELECT entity, dt, ROUND(volume, 5) AS volume, ROUND(size - AVG(size) OVER w - COALESCE(COVAR_POP(size, volume) OVER w / NULLIF(VAR_POP(volume) OVER w, 0), 0) * (volume - AVG(volume) OVER w), 5) + 0.0 AS size FROM a WINDOW w AS (PARTITION BY dt)""")
def orthogonalised(spark, sf_dir):
    df = panel_frame(spark, sf_dir).select("entity", "dt", "volume", F.col("n").cast("double").alias("size"))
    return tidy(X.orthogonalise(df, ["volume", "size"]), 5)


_NATION = "g AS (SELECT p.*, s_nationkey AS grp FROM p JOIN supplier ON entity = s_suppkey)"


def _grouped(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"))
    return panel_frame(spark, sf_dir).join(s, "entity")


@query("relative_to_group", f"{P}, {_NATION} SELECT entity, dt, ROUND(r - AVG(r) OVER (PARTITION BY dt, grp), 6) + 0.0 AS rel FROM g")
def relative_to_group(spark, sf_dir):
    return tidy(_grouped(spark, sf_dir).select("entity", "dt", X.relative_to_group("r", "grp").alias("rel")))


@query("exposures", f"{P}, {_LEGS} SELECT dt, ROUND(SUM(weight * COALESCE(px, 0)), 3) + 0.0 AS exposure_px, ROUND(SUM(weight * COALESCE(spread, 0)), 6) + 0.0 AS exposure_spread FROM l GROUP BY dt")
def exposures(spark, sf_dir):
    return tidy(X.exposures(X.leg_weights(panel_frame(spark, sf_dir), "r"), "weight", ["px", "spread"]), exposure_px=3)


@query("group_concentration", f"{P}, {_NATION}, h AS (SELECT dt, grp, SUM(ABS(value)) AS v FROM g GROUP BY 1, 2) SELECT dt, ROUND(SUM(v * v) / POWER(SUM(v), 2), 8) AS hhi FROM h GROUP BY dt")
def group_concentration(spark, sf_dir):
    return tidy(X.group_hhi(_grouped(spark, sf_dir), "value", "grp"), 8)


@query("frequent_groups", f"{P}, {_NATION} SELECT grp, COUNT(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, grp LIMIT 11")
def frequent_groups(spark, sf_dir):
    return X.frequent_groups(_grouped(spark, sf_dir), "grp")


@query("style_of_day", f"""{P}, s AS (SELECT entity, dt, COALESCE({_z('r')}, -1e300) AS a, {_z('spread')} AS b, {_z('volume')} AS c FROM p) SELECT entity, dt, CASE WHEN a >= b AND a >= c AND a - GREATEST(b, c) >= 0.25 THEN 'trend' WHEN b >= a AND b >= c AND b - GREATEST(a, c) >= 0.25 THEN 'cost' WHEN c >= a AND c >= b AND c - GREATEST(a, b) >= 0.25 THEN 'size' ELSE 'mixed' END AS style FROM s""")
def style_of_day(spark, sf_dir):
    z = lambda x: F.round(X.zscore(F.col(x)), 5) + 0.0
    df = panel_frame(spark, sf_dir).withColumns({"a": z("r"), "b": z("spread"), "c": z("volume")})
    return df.select("entity", "dt", X.best_of({"trend": F.col("a"), "cost": F.col("b"), "size": F.col("c")}).alias("style"))


@query("slots", f"{P}, k AS (SELECT dt, entity, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY value DESC, entity) - 1 AS slot FROM p) SELECT dt, CAST(slot AS INT) AS slot, entity FROM k WHERE slot < 5")
def slots(spark, sf_dir):
    return S.slots(panel_frame(spark, sf_dir), "value", 5).select("dt", "slot", "entity")


@query("slot_values", f"{P}, k AS (SELECT dt, entity, COALESCE(r, 0.0) AS r, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY value DESC, entity) - 1 AS slot FROM p) SELECT dt, CAST(slot AS INT) AS slot, entity, ROUND(r, 6) + 0.0 AS r FROM k WHERE slot < 5")
def slot_values(spark, sf_dir):
    df = panel_frame(spark, sf_dir)
    return tidy(S.gather(S.slots(df, "value", 5), df, ["r"]).select("dt", "slot", "entity", "r"))


@query("universe_turnover", f"""{P}, k AS (SELECT dt, entity, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY value DESC, entity) AS i FROM p), s AS (SELECT dt, entity, DENSE_RANK() OVER (ORDER BY dt) AS d FROM k WHERE i <= 5), n AS (SELECT dt, d, COUNT(*) AS held FROM s GROUP BY 1, 2),
c AS (SELECT a.d, COUNT(*) AS both_ FROM s a JOIN s b ON a.d = b.d + 1 AND a.entity = b.entity GROUP BY 1) SELECT n.dt, CAST(n.held - COALESCE(both_, 0) AS INT) AS came, CAST(COALESCE(m.held, 0) - COALESCE(both_, 0) AS INT) AS went, CAST(n.held AS INT) AS held FROM n LEFT JOIN c ON n.d = c.d LEFT JOIN n m ON m.d = n.d - 1""")
def universe_turnover(spark, sf_dir):
    return S.set_turnover(S.slots(panel_frame(spark, sf_dir), "value", 5))


@query("mask_overlap", f"{P} SELECT entity, ROUND(COUNT(*) FILTER (WHERE r > 0 AND n >= 2) / NULLIF(COUNT(*) FILTER (WHERE r > 0 OR n >= 2), 0)::DOUBLE, 8) AS jaccard, COUNT(*) FILTER (WHERE r > 0 AND n >= 2) AS n_both FROM p GROUP BY entity")
def mask_overlap(spark, sf_dir):
    df = panel_frame(spark, sf_dir)
    return tidy(S.jaccard(df, F.col("r") > 0, F.col("n") >= 2, ["entity"]), 8)


@query("wide_and_back", f"{P} SELECT dt, 'px_' || entity AS field, ROUND(MAX(px / 7.1::DOUBLE), 6) AS value FROM p GROUP BY 1, 2")
def wide_and_back(spark, sf_dir):
    df = panel_frame(spark, sf_dir).withColumn("px", F.col("px") / 7.1)
    names = cut(S.blocks(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity")), "entity"))
    table_ = S.wide_blocks(df, "dt", "entity", "px", names)
    return tidy(S.long_blocks(table_, "dt", "entity", names, "px"))


@query("filled_grid", f"""{P}, d AS (SELECT DISTINCT dt FROM p), e AS (SELECT DISTINCT entity FROM p), g AS (SELECT d.dt, e.entity, px FROM d CROSS JOIN e LEFT JOIN p ON p.dt = d.dt AND p.entity = e.entity)
SELECT dt, entity, ROUND(LAST_VALUE(px / 7.1::DOUBLE IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS px FROM g""")
def filled_grid(spark, sf_dir):
    df = panel_frame(spark, sf_dir)
    whole = S.grid(df.select("dt").distinct(), df.select("entity").distinct(), df.select("dt", "entity", "px"), ["dt", "entity"])
    return tidy(whole.select("dt", "entity", (R.forward_fill("px") / 7.1).alias("px")))
