"""Behaviour of weight paths: sleeve tilts, rotation, cap binding, the vector of all measures, and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.inference import newey_west
from lodestar.panel import PANEL, Panel, correlation, ratio

#: The regimes that measures are conditioned on.
REGIMES = ("calm", "inflationary", "crisis")
#: A weight above this is held.
HELD = 1e-8


def tilts(weights: DataFrame, members: DataFrame, weight: str = "weight", sleeve: str = "sleeve", panel: Panel = PANEL) -> DataFrame:
    """``(dt, sleeve, tilt)``: a sleeve's weight less its share of the names on the date, from (entity, sleeve) memberships."""
    w = weights.select(panel.time, panel.entity, F.coalesce(weight, F.lit(0.0)).alias("__w"), F.count(F.lit(1)).over(panel.section).alias("__k"))
    joined = w.join(members.select(panel.entity, sleeve).distinct(), panel.entity)
    return joined.groupBy(panel.time, sleeve).agg((F.sum("__w") - F.count(F.lit(1)) / F.first("__k")).alias("tilt"))


def mean_tilts(tilts_: DataFrame, sleeve: str = "sleeve") -> DataFrame:
    return tilts_.groupBy(sleeve).agg(F.avg("tilt").alias("mean_tilt"), F.count(F.lit(1)).alias("dates"))


def rotation_rate(tilts_: DataFrame, lag: int = 21, sleeve: str = "sleeve", time: str = "dt") -> DataFrame:
    """Mean over dates of the absolute change of all tilts since ``lag`` dates before."""
    w = Window.partitionBy(sleeve).orderBy(time)
    daily = tilts_.withColumn("__d", F.abs(F.col("tilt") - F.lag("tilt", lag).over(w))).groupBy(time).agg(F.sum("__d").alias("__d"))
    return daily.agg(F.avg("__d").alias("rotation_rate"), F.count("__d").alias("dates"))


def tilt_autocorrelation(tilts_: DataFrame, lag: int = 21, sleeve: str = "sleeve", time: str = "dt") -> DataFrame:
    lagged = tilts_.withColumn("__y", F.lag("tilt", lag).over(Window.partitionBy(sleeve).orderBy(time)))
    return lagged.groupBy(sleeve).agg(correlation("tilt", "__y").alias("autocorrelation"))


def tilt_variances(tilts_: DataFrame, regimes: DataFrame, regime: str = "regime", sleeve: str = "sleeve", time: str = "dt") -> DataFrame:
    """Mean over sleeves of the variance of regime means, and mean over regimes and sleeves of the variance within."""
    by = tilts_.join(regimes.select(time, regime), time).groupBy(regime, sleeve).agg(F.avg("tilt").alias("m"), F.var_pop("tilt").alias("v"))
    across = by.groupBy(sleeve).agg(F.when(F.count(F.lit(1)) >= 2, F.var_pop("m")).alias("a")).agg(F.avg("a").alias("across"))
    within = by.groupBy(regime).agg(F.avg("v").alias("v")).agg(F.avg("v").alias("within"))
    return across.crossJoin(within)  # a row each


def macro_sensitivity(tilts_: DataFrame, macro: DataFrame, columns: list[str], lags: int = 21, sleeve: str = "sleeve", time: str = "dt") -> DataFrame:
    """``(sleeve, term, coef, se, t, n)``: tilts on the macro columns of the date before, with Newey-West errors."""
    late = macro.select(time, *(F.lag(c).over(Window.orderBy(time)).alias(c) for c in columns))  # a row for each date
    return newey_west(tilts_.join(late, time), "tilt", columns, time, [sleeve], lags)


def steps(weights: DataFrame, weight: str = "weight", r: str | None = None, by: list[str] | None = None, panel: Panel = PANEL) -> DataFrame:
    """One row a date (and regime, if ``by`` names it): sums from which all measures follow.

    Changes are those since the row before within ``by``; the path has a row for each entity on each date.
    """
    by = by or []
    series = Window.partitionBy(*by, panel.entity).orderBy(panel.time)
    w = F.coalesce(weight, F.lit(0.0))
    rows = weights.withColumns({"__w": w, "__k": F.count(F.lit(1)).over(panel.section)}).withColumn("__b", F.lag("__w").over(series))
    own, was = F.col("__w") > HELD, F.coalesce(F.col("__b") > HELD, F.lit(False))
    x = F.col("__w")
    ret = F.lit(None).cast("double") if r is None else F.coalesce(r, F.lit(0.0))
    return rows.groupBy(*by, panel.time).agg(
        F.sum(x * x).alias("hhi"), F.max(x).alias("max_weight"), F.sum(F.abs(x - 1 / F.col("__k"))).alias("l1_vs_equal"),
        (-F.sum(F.when(x > 0, x * F.ln(x)).otherwise(0.0))).alias("entropy"), F.count_if(own).alias("support"),
        (F.sum(F.abs(x - F.col("__b"))) / 2).alias("turnover"),
        F.when(F.count("__b") > 0, ratio(F.count_if(own & was).cast("double"), F.count_if(own | was).cast("double"))).alias("jaccard"),
        F.when(F.count("__b") > 0, ratio(F.count_if(was & ~own).cast("double"), F.count_if(was).cast("double"))).alias("exit_rate"),
        F.sum(x * ret).alias("pnl"), F.avg(ret).alias("market"),
    )


def vector(weights: DataFrame, weight: str = "weight", r: str | None = None, by: list[str] | None = None, turnover_cap: float | None = None, panel: Panel = PANEL) -> DataFrame:
    """All path measures in one row (for each regime, if ``by`` names it)."""
    by = by or []
    s = steps(weights, weight, r, by, panel)
    run = Window.partitionBy(*(by or [F.lit(0)])).orderBy(panel.time).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__log", F.sum(F.ln(1 + F.col("pnl"))).over(run))
    s = s.withColumns({"__dd": 1 - F.exp(F.col("__log") - F.max("__log").over(run)), "__cut": F.percentile("pnl", F.lit(0.05)).over(Window.partitionBy(*(by or [F.lit(0)])))})
    up, down = F.col("market") > 0, F.col("market") < 0
    only = lambda c, v: F.sum(F.when(c, F.col(v)))
    measured = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("hhi").alias("hhi_mean"), F.avg(1 / F.greatest("hhi", F.lit(1e-12))).alias("n_eff_mean"), F.avg("max_weight").alias("max_weight_mean"), F.avg("l1_vs_equal").alias("l1_vs_ew_mean"),
        F.avg("turnover").alias("turnover_mean"), F.avg("entropy").alias("action_entropy_mean"), F.avg("support").alias("support_size_mean"), F.avg("jaccard").alias("support_jaccard_lag1"), F.avg("exit_rate").alias("support_exit_rate"),
        (F.lit(None).cast("double") if turnover_cap is None else F.avg(F.when(F.col("turnover").isNotNull(), (F.col("turnover") >= turnover_cap - 1e-15).cast("double")))).alias("turnover_cap_binding_frac"),
        ratio(only(up, "pnl"), only(up, "market")).alias("upside_capture"), ratio(only(down, "pnl"), only(down, "market")).alias("downside_capture"),
        F.skewness("pnl").alias("return_skew"), F.max("__dd").alias("max_drawdown"), F.avg(F.when(F.col("pnl") <= F.col("__cut"), F.col("pnl"))).alias("cvar_05"),
    )
    measured = measured.withColumn("holding_period_days", F.when(F.col("turnover_mean") > 1e-12, 1 / F.col("turnover_mean")))
    series = Window.partitionBy(*by, panel.entity).orderBy(panel.time)
    rows = weights.withColumn("__w", F.coalesce(weight, F.lit(0.0))).withColumn("__b", F.lag("__w").over(series))
    held = F.col("__w") > HELD
    begins = held & ~F.coalesce(F.col("__b") > HELD, F.lit(False))
    names = rows.groupBy(*by, panel.entity).agg(correlation("__w", "__b").alias("__c"), F.count_if(begins).alias("__s"))
    names = names.groupBy(*by).agg(F.avg("__c").alias("weight_autocorr_lag1"), ratio(F.count_if(F.col("__s") >= 2).cast("double"), F.count_if(F.col("__s") >= 1).cast("double")).alias("support_reentry_rate"))
    return measured.join(names, by) if by else measured.crossJoin(names)


def regime_deltas(by_regime: DataFrame, measures: list[str], regime: str = "regime", high: str = "crisis", low: str = "calm") -> DataFrame:
    """``delta_<measure>``: a measure in one regime less that in another, one row."""
    at = lambda name, m: F.max(F.when(F.col(regime) == name, F.col(m)))
    return by_regime.agg(*((at(high, m) - at(low, m)).alias(f"delta_{m}") for m in measures))


def merged_regime(existing: Column, turbulent: Column) -> Column:
    """Turbulent days turn calm into crisis; other regimes stay, unknown ones are calm."""
    known = F.when(existing.isin(*REGIMES), existing).otherwise("calm")
    return F.when(F.coalesce(turbulent, F.lit(False)) & (known == "calm"), "crisis").otherwise(known)


def occupancy(labels: DataFrame, label: str = "label", time: str = "dt") -> DataFrame:
    """Days, share of days, spells and their mean length by regime; one series of dates."""
    w = Window.orderBy(time)
    begins = F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True))
    rows = labels.withColumn("__b", begins)
    out = rows.groupBy(label).agg(F.count(F.lit(1)).alias("days"), F.count_if("__b").alias("spells"))
    return out.select(label, "days", (F.col("days") / F.sum("days").over(Window.partitionBy(F.lit(0)))).alias("share"), "spells", (F.col("days") / F.col("spells")).alias("mean_days"))


def window_hits(flags: DataFrame, windows: DataFrame, columns: list[str], time: str = "dt", name: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """For each stated window of dates: its days and the share on which each flag holds; null shares where it has no days."""
    hit = flags.join(F.broadcast(windows), F.col(time).between(F.col(start), F.col(end)))
    found = hit.groupBy(name).agg(F.count(F.lit(1)).alias("n_days"), *(F.avg(F.col(c).cast("double")).alias(f"{c}_frac") for c in columns))
    return windows.select(name).join(found, name, "left").withColumn("n_days", F.coalesce("n_days", F.lit(0).cast("long")))


def window_performance(daily: DataFrame, windows: DataFrame, pnl: str = "pnl", turnover: str | None = None, time: str = "dt", name: str = "id", start: str = "start", end: str = "end", periods: int = 252) -> DataFrame:
    """For each stated window: days, mean, Sharpe (population + 1e-12), hit rate and mean turnover."""
    rows = daily.join(F.broadcast(windows), F.col(time).between(F.col(start), F.col(end)))
    x = F.col(pnl)
    extra = [F.avg(turnover).alias("mean_turnover")] if turnover else []
    return rows.groupBy(name).agg(F.count(x).alias("n_days"), F.avg(x).alias("mean"), (F.avg(x) / (F.stddev_pop(x) + 1e-12) * periods**0.5).alias("sharpe"), F.avg((x > 0).cast("double")).alias("hit_rate"), *extra)


def by_regime(daily: DataFrame, returns: list[str], turbulent: str, periods: int = 252) -> DataFrame:
    """``(book, regime, n_days, mean, sharpe)`` of several return columns on turbulent and calm days (sample deviation)."""
    books = F.array(*(F.struct(F.lit(c).alias("book"), F.col(c).alias("r")) for c in returns))
    rows = daily.select(F.when(F.col(turbulent), "turbulent").otherwise("calm").alias("regime"), F.inline(books)).where("r is not null")
    sd = F.stddev_samp("r")
    return rows.groupBy("book", "regime").agg(F.count("r").alias("n_days"), F.avg("r").alias("mean"), F.when(sd <= 1e-15, 0.0).otherwise(F.avg("r") / sd * periods**0.5).alias("sharpe"))


def missing_sections(cube: DataFrame, channels: list[str], most: float = 0.2, panel: Panel = PANEL) -> DataFrame:
    """``(channel, n_dates, n_missing, share, fails)``: dates on which no entity has a value, and whether they are too many."""
    daily = cube.groupBy(panel.time).agg(*(F.count(c).alias(c) for c in channels))
    long = daily.select(F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("k")) for c in channels))))
    share = F.avg((F.col("k") == 0).cast("double"))
    return long.groupBy("channel").agg(F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("k") == 0).alias("n_missing"), share.alias("share"), (share > most).alias("fails"))


def decision_trace(weights: DataFrame, weight: str = "weight", turnover_cap: float | None = None, panel: Panel = PANEL) -> DataFrame:
    """One row a date: weights and their changes as maps by entity, turnover, and whether the cap binds."""
    rows = weights.withColumn("__w", F.coalesce(weight, F.lit(0.0))).withColumn("__d", F.col("__w") - F.coalesce(F.lag("__w").over(panel.series), F.lit(0.0)))
    listed = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(panel.entity), F.col(c)))))
    turn = F.sum(F.abs("__d")) / 2
    binds = F.lit(False) if turnover_cap is None else turn >= turnover_cap - 1e-15
    return rows.groupBy(panel.time).agg(listed("__w").alias("weights"), listed("__d").alias("changes"), turn.alias("turnover"), binds.alias("cap_binds"))
