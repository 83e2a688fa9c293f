"""Weights, costs, back-tests and behaviour measures over long weight paths (date, entity, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.panel import PANEL, UNBOUNDED, Panel, correlation, ratio


def normalised(raw: Column, panel: Panel = PANEL) -> Column:
    """A raw score as weights that add up to 1 on each date; null scores get 0."""
    return F.coalesce(ratio(raw, F.sum(raw).over(panel.section)), F.lit(0.0))


def equal(active: Column, panel: Panel = PANEL) -> Column:
    return normalised(F.when(active, 1.0), panel)


def inverse_volatility(vol: Column, panel: Panel = PANEL) -> Column:
    """Also what risk parity comes to with a diagonal risk proxy."""
    return normalised(F.when(vol > 1e-12, 1 / vol), panel)


def low_volatility(vol: str, parts: int = 5, panel: Panel = PANEL) -> Column:
    """Equal weights of the ceil(n / parts) least volatile."""
    n = F.count(vol).over(panel.section)
    rank = F.row_number().over(Window.partitionBy(panel.time).orderBy(F.col(vol).asc_nulls_last(), panel.entity))
    return normalised(F.when(F.col(vol).isNotNull() & (rank <= F.ceil(n / parts)), 1.0), panel)


def past_sum_long(past: str, losers: bool = False, panel: Panel = PANEL) -> Column:
    """Long and short halves of the section by a past return: momentum, or reversal for losers; gross 1."""
    n = F.count(past).over(panel.section)
    rank = F.row_number().over(Window.partitionBy(panel.time).orderBy(F.col(past).asc_nulls_last(), panel.entity))
    m = F.floor(n / 2)
    side = F.when(F.col(past).isNull() | (m < 1), 0.0).when(rank <= m, -0.5 / m).when(rank > n - m, 0.5 / m).otherwise(0.0)
    return -side if losers else side


def drifted(cap: str, r: str, panel: Panel = PANEL) -> Column:
    """Buy and hold from first capitalisation: cap times the running product of 1 + r up to yesterday, normalised."""
    past = F.coalesce(F.sum(F.ln(1 + F.coalesce(r, F.lit(0.0)))).over(panel.series.rowsBetween(UNBOUNDED, -1)), F.lit(0.0))
    return F.first(cap).over(panel.series.rowsBetween(UNBOUNDED, 0)) * F.exp(past)


def trades(df: DataFrame, weight: str = "weight", panel: Panel = PANEL) -> DataFrame:
    """Adds the change of weight; the first row of an entity trades all of it."""
    return df.withColumn("trade", F.col(weight) - F.coalesce(F.lag(weight).over(panel.series), F.lit(0.0)))


def costs(df: DataFrame, weight: str = "weight", adv: str | None = None, aum: float = 1e6, spread_bps: float = 5.0, impact: float = 10.0, borrow_bps: float = 50.0, panel: Panel = PANEL) -> DataFrame:
    """Daily spread, square-root impact and borrow costs. Without or with no volume, impact is the root of the trade itself."""
    size = F.abs("trade")
    scaled = size if adv is None else F.when(F.col(adv) > 0, size * aum / F.col(adv)).otherwise(size)
    return trades(df, weight, panel).groupBy(panel.time).agg(
        (spread_bps / 1e4 * F.sum(size)).alias("spread_cost"),
        (impact / 1e4 * F.sum(F.sqrt(scaled))).alias("impact_cost"),
        (borrow_bps / 1e4 / 252 * F.sum(F.greatest(-F.col(weight), F.lit(0.0)))).alias("borrow_cost"),
        (F.sum(size) / 2).alias("turnover"),
    )


def ledger(df: DataFrame, weight: str, r: str, panel: Panel = PANEL) -> DataFrame:
    """Daily profit: yesterday's weights on today's returns."""
    held = F.coalesce(F.lag(weight).over(panel.series), F.lit(0.0))
    return df.withColumn("__p", held * F.coalesce(r, F.lit(0.0))).groupBy(panel.time).agg(F.sum("__p").alias("pnl"), F.sum(F.abs(weight)).alias("gross"), F.sum(weight).alias("net"))


def concentration(df: DataFrame, weight: str = "weight", eps: float = 1e-6, panel: Panel = PANEL) -> DataFrame:
    """Per date: HHI, effective number, largest weight, distance from equal weights, support, entropy."""
    w, k = F.col(weight), F.count(F.lit(1)).over(panel.section)
    held = df.withColumn("__off", F.abs(w - 1 / k))
    return held.groupBy(panel.time).agg(
        F.sum(w * w).alias("hhi"), ratio(F.lit(1.0), F.sum(w * w)).alias("effective_n"), F.max(w).alias("max_weight"), F.sum("__off").alias("l1_vs_equal"),
        F.count_if(w > eps).alias("support"), (-F.sum(F.when(w > 0, w * F.ln(w)).otherwise(0.0))).alias("entropy"),
    )


def support_changes(df: DataFrame, weight: str = "weight", eps: float = 1e-6, panel: Panel = PANEL) -> DataFrame:
    """Per date: Jaccard overlap of the support with that of the row before, and the share of it that left."""
    now = F.col(weight) > eps
    was = F.coalesce(F.lag(now).over(panel.series), F.lit(False))
    flags = df.withColumns({"__now": now, "__was": was})
    return flags.groupBy(panel.time).agg(ratio(F.count_if(F.col("__now") & F.col("__was")).cast("double"), F.count_if(F.col("__now") | F.col("__was")).cast("double")).alias("jaccard"), ratio(F.count_if(F.col("__was") & ~F.col("__now")).cast("double"), F.count_if("__was").cast("double")).alias("exit_rate"))


def reentry(df: DataFrame, weight: str = "weight", eps: float = 1e-6, panel: Panel = PANEL) -> DataFrame:
    """Per entity: spells of holding, and whether it came back after leaving."""
    now = F.col(weight) > eps
    begins = now & ~F.coalesce(F.lag(now).over(panel.series), F.lit(False))
    return df.withColumn("__b", begins).groupBy(panel.entity).agg(F.count_if("__b").alias("spells"), (F.count_if("__b") >= 2).alias("came_back"))


def autocorrelation(df: DataFrame, x: str, lag: int = 1, panel: Panel = PANEL) -> DataFrame:
    return df.withColumn("__y", F.lag(x, lag).over(panel.series)).groupBy(panel.entity).agg(correlation(x, "__y").alias("autocorrelation"), F.count("__y").alias("n"))


def performance(df: DataFrame, pnl: str = "pnl", by: list[str] | None = None, periods: int = 252) -> DataFrame:
    """Mean, volatility, Sharpe (population, 1e-12 added), hit rate and the mean of the worst 5 %."""
    x = F.col(pnl)
    cut = df.groupBy(*(by or [])).agg(F.percentile(x, F.lit(0.05)).alias("__cut"))
    joined = df.join(cut, by) if by else df.crossJoin(cut)
    return joined.groupBy(*(by or [])).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), (F.avg(x) / (F.stddev_pop(x) + 1e-12) * periods**0.5).alias("sharpe"),
        F.avg((x > 0).cast("double")).alias("hit_rate"), F.avg(F.when(x <= F.col("__cut"), x)).alias("cvar_5"), F.skewness(x).alias("skew"),
    )


def capture(df: DataFrame, pnl: str, market: str) -> DataFrame:
    up, down = F.col(market) > 0, F.col(market) < 0
    return df.agg(ratio(F.sum(F.when(up, F.col(pnl))), F.sum(F.when(up, F.col(market)))).alias("up_capture"), ratio(F.sum(F.when(down, F.col(pnl))), F.sum(F.when(down, F.col(market)))).alias("down_capture"))


def drawdowns(df: DataFrame, pnl: str = "pnl", time: str = "dt", by: list[str] | None = None) -> DataFrame:
    """Per date, additive drawdown (0 or below) of the running sum and multiplicative one (0 or above) of the wealth."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(time).rowsBetween(UNBOUNDED, 0)
    run = df.withColumns({"__sum": F.sum(pnl).over(w), "__log": F.sum(F.ln(1 + F.col(pnl))).over(w)})
    return run.select(*(by or []), time, (F.col("__sum") - F.greatest(F.max("__sum").over(w), F.lit(0.0))).alias("drawdown"), (1 - F.exp(F.col("__log") - F.greatest(F.max("__log").over(w), F.lit(0.0)))).alias("wealth_drawdown"))


def capacity(daily: DataFrame, multipliers: tuple[float, ...], gross: str = "gross_pnl", spread: str = "spread_cost", impact: str = "impact_cost") -> DataFrame:
    """Mean net profit at multiples of the assets: impact grows with their root."""
    m = F.explode(F.array(*(F.lit(float(x)) for x in multipliers)))
    return daily.select("*", m.alias("multiple")).groupBy("multiple").agg(F.avg(F.col(gross) - F.col(spread) - F.col(impact) * F.sqrt("multiple")).alias("mean_net"))


def buy_and_hold(df: DataFrame, r: str, panel: Panel = PANEL) -> DataFrame:
    """Daily wealth of an equal start left alone: the mean of the entities' running products."""
    wealth = F.exp(F.sum(F.ln(1 + F.coalesce(r, F.lit(0.0)))).over(panel.expanding()))
    return df.withColumn("__w", wealth).groupBy(panel.time).agg(F.avg("__w").alias("wealth"))


def best_single(df: DataFrame, r: str, panel: Panel = PANEL) -> DataFrame:
    """The entity with the greatest final wealth."""
    return df.groupBy(panel.entity).agg(F.exp(F.sum(F.ln(1 + F.coalesce(r, F.lit(0.0))))).alias("wealth")).orderBy(F.desc("wealth"), panel.entity).limit(1)
