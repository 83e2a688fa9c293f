"""Frictions, caps on turnover, option baselines, composites and the walk of named weight rules over a panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.operators import portfolio as B
from lodestar.operators.statistics import garch_path
from lodestar.panel import PANEL, UNBOUNDED, Panel, ratio


@dataclass(frozen=True)
class Friction:
    """Cost parameters; ``multiplier`` scales every component. Two specs agree if they differ in the multiplier only."""

    name: str = "quote_touch"
    equity_bps: float = 5.0
    hedge_bps: float = 5.0
    option_spread_bps: float = 5.0
    option_impact: float = 0.5
    touch: bool = True
    touch_fee_bps: float = 0.0
    touch_spread: float = 1.0
    equity_spread: float = 1.0
    borrow_bps: float = 25.0
    equity_impact: float = 0.5
    multiplier: float = 1.0

    def scaled(self, multiplier: float) -> Friction:
        if multiplier <= 0:
            raise ValueError("the multiplier must be positive")
        return replace(self, multiplier=multiplier)

    def agrees(self, other: Friction) -> bool:
        return replace(self, multiplier=1.0) == replace(other, multiplier=1.0)


def execution_drag(traded: Column, turnover: Column, spec: Friction, half_spread: Column | None = None, base: Column | None = None, vol_scale: Column | float = 1.0) -> Column:
    """Cost of an option block on a date, as an aggregate over its rows: a touch of the quoted half spread on each trade
    by the capital it stands on, or else a spread and a square-root impact on the turnover."""
    if spec.touch:
        per_name = F.lit(0.0) if half_spread is None else traded * F.coalesce(half_spread, F.lit(0.0)) * spec.touch_spread
        if base is not None:
            per_name = F.when(F.abs(base) > 1e-8, per_name / F.abs(base)).otherwise(0.0)
        return F.sum(per_name) + spec.touch_fee_bps / 1e4 * F.sum(traded)
    return spec.option_spread_bps / 1e4 * vol_scale * turnover + spec.option_impact * vol_scale * F.sqrt(F.greatest(turnover, F.lit(0.0)))


def volatility_scale(vol: Column, reference: float = 0.2, floor: float = 0.05, cap: float = 1.0) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), vol / max(reference, 1e-6)))


def hedge_notional(weight: Column, before: Column, delta: Column, delta_before: Column | None, spot: Column, base: Column) -> Column:
    """Stock traded for a unit of invested capital: by rebalancing the package, and by re-hedging what is held as delta drifts."""
    safe, z = F.abs(base) > 1e-8, lambda c: F.coalesce(c, F.lit(0.0))
    rebalance = F.abs(weight - before) * F.abs(z(delta) * z(spot)) / F.abs(base)
    drift = F.lit(0.0) if delta_before is None else F.abs(weight) * F.abs(z(delta) - z(delta_before)) * F.abs(z(spot)) / F.abs(base)
    return F.coalesce(F.when(safe, rebalance + drift), F.lit(0.0))


def frictions(df: DataFrame, spec: Friction, weight: str = "weight", r: str = "r", option: Column | None = None, adv: str | None = None, half_spread: str | None = None, base: str | None = None, spot: str | None = None, delta: str | None = None, aum: float = 1.0, panel: Panel = PANEL) -> DataFrame:
    """``(dt, gross, option_spread, equity_spread, hedge, funding, net, missing)`` of a weight path with a row per entity and date.

    ``option`` marks option slots; the others are stock. A missing return counts as 0. Impact on stock is the square root of
    the trade by volume, or of the trade itself where there is none.
    """
    col = lambda c: None if c is None else F.col(c)
    is_option = F.lit(False) if option is None else option
    w = F.coalesce(weight, F.lit(0.0))
    rows = df.withColumns({"__w": w, "__o": is_option}).withColumns({"__b": F.coalesce(F.lag("__w").over(panel.series), F.lit(0.0)), "__d0": F.lag(delta).over(panel.series) if delta else F.lit(None).cast("double")})
    traded = F.abs(F.col("__w") - F.col("__b"))
    opt, stock = F.when(F.col("__o"), traded).otherwise(0.0), F.when(~F.col("__o"), traded).otherwise(0.0)
    scaled = stock if adv is None else F.when(F.col(adv) > 0, stock * aum / F.col(adv)).otherwise(stock)
    hedge = F.lit(0.0)
    if spot and base and delta:
        hedge = F.sum(F.when(F.col("__o"), hedge_notional(F.col("__w"), F.col("__b"), F.col(delta), F.col("__d0"), F.col(spot), F.col(base))).otherwise(0.0))
    m = spec.multiplier
    daily = rows.groupBy(panel.time).agg(
        F.sum(F.col("__w") * F.coalesce(r, F.lit(0.0))).alias("gross"),
        (m * execution_drag(opt, F.sum(opt), spec, col(half_spread), col(base))).alias("option_spread"),
        (m * (spec.equity_bps / 1e4 * spec.equity_spread * F.sum(stock) + spec.equity_impact / 1e4 * F.sum(F.sqrt(scaled)))).alias("equity_spread"),
        (m * spec.hedge_bps / 1e4 * hedge).alias("hedge"),
        (m * spec.borrow_bps / 1e4 / 252 * F.sum(F.greatest(-F.col("__w"), F.lit(0.0)))).alias("funding"),
        F.count_if(F.col(r).isNull()).alias("missing"),
    )
    return daily.withColumn("net", F.col("gross") - F.col("option_spread") - F.col("equity_spread") - F.col("hedge") - F.col("funding"))


def capped(weight: Column, before: Column, turnover: Column, cap: float) -> Column:
    """One step towards ``weight``, scaled so that the sum of absolute changes is ``cap`` at most."""
    return F.when(turnover <= cap, weight).otherwise(before + (weight - before) * F.lit(cap) / turnover)


def capped_path(df: DataFrame, cap: float, weight: str = "weight", by: list[str] | None = None, panel: Panel = PANEL) -> DataFrame:
    """(by, dt, entity, weight): each date's wanted weights approached from what is held, absolute changes adding up to ``cap``
    at most. A single path's rows pass one task, which holds a weight a name; of several paths, each is one task's."""
    if not by:
        from lodestar.operators.sequential import walked

        slim = df.select(panel.time, panel.entity, F.coalesce(weight, F.lit(0.0)).cast("double").alias("__w"))
        return walked(slim, "__w", "capped", 0.0, {"cap": cap}, panel)
    kinds = dict(df.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=panel.time, columns=panel.entity, values="__w", aggfunc="last").sort_index().sort_index(axis=1).fillna(0.0)
        wanted, held = m.to_numpy(float), np.zeros(m.shape[1])
        out = np.empty_like(wanted)
        for t, w in enumerate(wanted):
            step = w - held
            size = np.abs(step).sum()
            held = w if size <= cap or size < 1e-12 else held + step * (cap / size)
            out[t] = held
        own = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame({panel.time: np.repeat(m.index.to_numpy(), m.shape[1]), panel.entity: np.tile(m.columns.to_numpy(), len(m)), "weight": out.ravel()}).assign(**own)[[*by, panel.time, panel.entity, "weight"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*by, panel.time, panel.entity]), "weight double"])
    slim = df.select(*by, panel.time, panel.entity, F.coalesce(weight, F.lit(0.0)).cast("double").alias("__w"))
    return slim.groupBy(*by).applyInPandas(walk, schema)


def _section_z(x: Column, panel: Panel) -> Column:
    """Population z over the section; 0 for a missing value or a section without spread."""
    sd = F.stddev_pop(x).over(panel.section)
    return F.coalesce(F.when(sd >= 1e-12, (x - F.avg(x).over(panel.section)) / sd), F.lit(0.0))


#: Option baselines, which need these columns besides implied volatility.
OPTION_BASELINES = ("short_vol_carry", "garch_vol_timing", "iv_momentum", "hv_less_iv", "iv_rank_timing", "timed_long_gamma", "skew_risk_reversal", "short_high_vol")
_NEEDS = {"hv_less_iv": "hv", "timed_long_gamma": "hv", "skew_risk_reversal": "skew"}


def option_baseline(df: DataFrame, name: str, iv: str = "iv", delta: str | None = "delta", hv: str | None = None, skew: str | None = None, history: int = 20, gross: float = 1.0, panel: Panel = PANEL) -> DataFrame:
    """Adds ``weight``: a baseline's signal from the last ``history`` rows of each entity, shrunk by 1 / (1 + 2 |delta|) and
    scaled to the gross on each date. A date without any signal has weights of 0."""
    if name not in OPTION_BASELINES:
        raise KeyError(f"unknown baseline {name!r}")
    have = {"hv": hv, "skew": skew}
    if (need := _NEEDS.get(name)) and not have[need]:
        raise KeyError(f"{name} needs {need}")
    w, x = panel.trailing(history), F.coalesce(iv, F.lit(0.0))
    k = F.count(F.lit(1)).over(panel.section)
    unit = gross / k
    out = df
    if name == "garch_vol_timing":
        out = garch_path(df.withColumn("__x", x), "__x", panel.time, panel.entity, history, "__vol")
        raw = -F.tanh((x - (F.avg("__x").over(panel.trailing(min(history, 20))) + F.col("__vol"))) * 10.0) * unit
        out = out.withColumn("__raw", raw)
    else:
        if name == "short_vol_carry":
            raw = -unit
        elif name == "iv_momentum":
            raw = -F.tanh((F.avg(x).over(panel.trailing(5)) - F.avg(x).over(panel.trailing(20) if history >= 20 else w)) * 20.0) * unit
        elif name == "iv_rank_timing":
            low, high = F.min(x).over(w), F.max(x).over(w)
            place = F.when(high - low < 1e-12, 0.5).otherwise((x - low) / (high - low))
            raw = F.when(F.count(F.lit(1)).over(w) < 2, 0.0).otherwise(-F.tanh(3.0 * (2.0 * place - 1.0)) * unit)
        elif name in ("hv_less_iv", "timed_long_gamma"):
            edge = F.tanh(8.0 * (F.col(hv) - F.col(iv)))
            raw = F.coalesce((edge if name == "hv_less_iv" else F.greatest(edge, F.lit(0.0))) * unit, F.lit(0.0))
        elif name == "skew_risk_reversal":
            raw = -F.tanh(_section_z(F.coalesce(skew, F.lit(0.0)), panel)) * unit
        else:
            raw = -F.tanh(_section_z(F.col(hv) if hv else x, panel)) * unit
        out = out.withColumn("__raw", raw)
    if delta:
        out = out.withColumn("__raw", F.col("__raw") / (1.0 + 2.0 * F.abs(F.coalesce(delta, F.lit(0.0)))))
    total = F.sum(F.abs("__raw")).over(panel.section)
    scaled = F.when(total > 1e-12, F.col("__raw") * gross / (total + 1e-12)).otherwise(0.0)
    return out.withColumn("weight", scaled).drop("__raw", "__x", "__vol")


def option_suite(df: DataFrame, label: str, names: tuple[str, ...] = OPTION_BASELINES, history: int = 20, cap: float | None = None, panel: Panel = PANEL, **columns: str) -> DataFrame:
    """``(strategy, n_days, mean, sharpe, hit_rate, mean_turnover)`` of the baselines whose columns are there.

    Weights of a row earn its label, which spans the time after it; the first ``history`` - 1 dates are left out.
    """
    out = None
    dates = df.select(panel.time).distinct().withColumn("__i", F.row_number().over(Window.orderBy(panel.time)))  # a row for each date
    for name in names:
        if _NEEDS.get(name) and not columns.get(_NEEDS[name]):
            continue
        weighted = option_baseline(df, name, history=history, panel=panel, **columns).join(F.broadcast(dates), panel.time).where(F.col("__i") >= history)
        if cap is not None:
            weighted = capped_path(weighted, cap, panel=panel).join(weighted.drop("weight"), [panel.time, panel.entity])
        before = F.coalesce(F.lag("weight").over(panel.series), F.lit(0.0))
        daily = weighted.withColumn("__d", F.abs(F.col("weight") - before)).groupBy(panel.time).agg(F.sum(F.col("weight") * F.coalesce(label, F.lit(0.0))).alias("pnl"), F.sum("__d").alias("turnover"))
        daily = daily.withColumn("strategy", F.lit(name))
        out = daily if out is None else out.unionByName(daily)
    x = F.col("pnl")
    return out.groupBy("strategy").agg(F.count(x).alias("n_days"), F.avg(x).alias("mean"), (F.avg(x) / (F.stddev_pop(x) + 1e-12) * 252**0.5).alias("sharpe"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.avg("turnover").alias("mean_turnover"))


def score_weights(score: Column, long_only: bool = True, panel: Panel = PANEL) -> Column:
    """A softmax over the section, or demeaned scores, not yet scaled to an absolute sum of 1. ``score`` is a plain column."""
    s, k = F.coalesce(score, F.lit(0.0)), F.count(F.lit(1)).over(panel.section)
    if long_only:
        return F.exp(s - F.max(s).over(panel.section))
    return F.when(F.stddev_pop(s).over(panel.section) < 1e-15, 1.0 / k).otherwise(s - F.avg(s).over(panel.section))


def composite(df: DataFrame, signals: list[str], long_only: bool = True, name: str = "weight", panel: Panel = PANEL) -> DataFrame:
    """Adds weights from the mean of the section's z-scores of several signals."""
    zs = df.withColumns({f"__z{i}": _section_z(F.col(s), panel) for i, s in enumerate(signals)})
    scored = zs.withColumn("__s", sum((F.col(f"__z{i}") for i in range(len(signals))), F.lit(0.0)) / len(signals))
    return _normalised(scored, "__s", long_only, name, panel).drop("__s", *(f"__z{i}" for i in range(len(signals))))


def _normalised(df: DataFrame, score: str, long_only: bool, name: str, panel: Panel) -> DataFrame:
    made = df.withColumn("__w", score_weights(F.col(score), long_only, panel))
    total = F.sum(F.abs("__w")).over(panel.section)
    return made.withColumn(name, F.when(total > 1e-12, F.col("__w") / total).otherwise(1.0 / F.count(F.lit(1)).over(panel.section))).drop("__w")


def ridge_composite(df: DataFrame, signals: list[str], r: str, l2: float = 1.0, long_only: bool = True, name: str = "weight", panel: Panel = PANEL) -> DataFrame:
    """Adds weights from a ridge regression of the next row's return on signals, fitted on strictly earlier dates.

    Products are summed by date and run up over the calendar, a row for each date; each date's small system is solved apart.
    A date's fit uses signals up to two dates before it and returns up to the date before; scores come from the date before.
    """
    k = len(signals) + 1
    nxt = F.lead(r).over(panel.series)
    pairs = df.withColumn("__y", nxt).where(F.col("__y").isNotNull())
    for s in signals:
        pairs = pairs.where(F.col(s).isNotNull())
    x = [F.lit(1.0), *(F.col(s) for s in signals)]
    sums = pairs.groupBy(panel.time).agg(*(F.sum(x[i] * x[j]).alias(f"__a{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * F.col("__y")).alias(f"__b{i}") for i in range(k)))
    every = df.select(panel.time).distinct().join(sums, panel.time, "left")
    run = Window.orderBy(panel.time).rowsBetween(UNBOUNDED, -2)  # a date's pairs are known on the date after it
    total = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0.0))
    at = lambda i, j: total(f"__a{min(i, j)}_{max(i, j)}")
    systems = every.select(panel.time, F.array(*(at(i, j) for i in range(k) for j in range(k))).alias("__a"), F.array(*(total(f"__b{i}") for i in range(k))).alias("__b"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(np.linalg.solve(np.array(m, float).reshape(k, k) + l2 * np.eye(k), np.array(v, float)) if m[0] > 0 else np.zeros(k)).tolist() for m, v in zip(a, b, strict=True)])

    fits = systems.select(panel.time, solve("__a", "__b").alias("__c"))
    late = df.withColumns({f"__l{i}": F.lag(s).over(panel.series) for i, s in enumerate(signals)}).join(F.broadcast(fits), panel.time)
    c = F.col("__c")
    scored = late.withColumn("__s", sum((c[i + 1] * F.col(f"__l{i}") for i in range(k - 1)), c[0]))
    return _normalised(scored, "__s", long_only, name, panel).drop("__c", "__s", *(f"__l{i}" for i in range(k - 1)))


def volatility_managed(df: DataFrame, r: str, target: float = 0.15, least: int = 20, low: float = 0.25, high: float = 2.0, panel: Panel = PANEL) -> DataFrame:
    """Adds equal weights scaled by target over realised volatility of the equal-weight portfolio of strictly earlier dates."""
    n = F.count(F.lit(1))
    daily = df.groupBy(panel.time).agg((F.sum(F.coalesce(r, F.lit(0.0))) / n).alias("__p"), n.alias("__k"))
    past = Window.orderBy(panel.time).rowsBetween(UNBOUNDED, -1)  # a row for each date
    vol = F.stddev_samp("__p").over(past) * 252**0.5
    scale = F.when(F.count("__p").over(past) < least, 0.0).when(vol < 1e-12, 1.0).otherwise(F.least(F.greatest(target / vol, F.lit(low)), F.lit(high)))
    return df.join(F.broadcast(daily.select(panel.time, "__k", scale.alias("__c"))), panel.time).withColumn("weight", F.col("__c") / F.col("__k")).drop("__c", "__k")


def _hv(df: DataFrame, r: str, window: int, panel: Panel) -> DataFrame:
    return df.withColumn("__hv", R.gated(F.col(r), window, lambda t: t.sd(), "half", 1, panel))


#: Weight rules by name: each takes a panel and the name of its return, and adds ``weight`` from strictly earlier rows.
RULES: dict[str, Callable[..., DataFrame]] = {
    "equal_weight": lambda df, r, panel=PANEL: df.withColumn("weight", B.equal(F.lit(True), panel)),
    "inverse_vol": lambda df, r, panel=PANEL: _hv(df, r, 63, panel).withColumn("weight", B.inverse_volatility(F.col("__hv"), panel)).drop("__hv"),
    "risk_parity": lambda df, r, panel=PANEL: RULES["inverse_vol"](df, r, panel),
    "low_vol_long": lambda df, r, panel=PANEL: _hv(df, r, 63, panel).withColumn("weight", B.low_volatility("__hv", panel=panel)).drop("__hv"),
    "momentum_12_1": lambda df, r, panel=PANEL: df.withColumn("__m", R.gated(F.ln(1 + F.col(r)), 231, lambda t: t.sum, shift=22, panel=panel)).withColumn("weight", B.past_sum_long("__m", panel=panel)).drop("__m"),
    "short_term_reversal": lambda df, r, panel=PANEL: df.withColumn("__m", R.gated(F.ln(1 + F.col(r)), 21, lambda t: t.sum, shift=1, panel=panel)).withColumn("weight", B.past_sum_long("__m", True, panel)).drop("__m"),
    "vol_managed": lambda df, r, panel=PANEL: volatility_managed(df, r, panel=panel),
}


def weights_by_name(name: str, df: DataFrame, r: str, panel: Panel = PANEL) -> DataFrame:
    if name not in RULES:
        raise KeyError(f"unknown rule {name!r}; known: {sorted(RULES)}")
    return RULES[name](df, r, panel=panel)


def benchmark_walk(names: list[str], df: DataFrame, r: str, mask: Column | None = None, cap: float | None = None, spec: Friction | None = None, adv: str | None = None, panel: Panel = PANEL) -> DataFrame:
    """``(strategy, dt, gross, cost, net, turnover)``: weights from strictly earlier rows, masked and capped, on the row's return."""
    out = None
    for name in names:
        w = weights_by_name(name, df, r, panel).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        if mask is not None:
            w = w.withColumn("weight", F.when(mask, F.col("weight")).otherwise(0.0))
        if cap is not None:
            w = capped_path(w, cap, panel=panel).join(w.drop("weight"), [panel.time, panel.entity])
        before = F.coalesce(F.lag("weight").over(panel.series), F.lit(0.0))
        w = w.withColumn("__d", F.abs(F.col("weight") - before))
        cost = frictions(w, spec or Friction(equity_bps=0.0, equity_impact=0.0, borrow_bps=0.0), r=r, adv=adv, panel=panel)
        turn = w.groupBy(panel.time).agg((F.sum("__d") / 2).alias("turnover"))
        daily = cost.select(panel.time, "gross", (F.col("gross") - F.col("net")).alias("cost"), "net").join(turn, panel.time).withColumn("strategy", F.lit(name))
        out = daily if out is None else out.unionByName(daily)
    return out.select("strategy", panel.time, "gross", "cost", "net", "turnover")


def option_factors(df: DataFrame, label: str, characteristics: dict[str, str], panel: Panel = PANEL) -> DataFrame:
    """``(dt, market_ew, <factor>...)``: the mean label of the date's options, and quintile long-short sorts on each characteristic."""
    from lodestar.operators.cross_section import leg_weights

    out, names = df, []
    for factor, c in characteristics.items():
        out = leg_weights(out, c, 5, f"__{factor}", panel)
        names.append(factor)
    y = F.coalesce(label, F.lit(0.0))
    return out.groupBy(panel.time).agg(F.avg(label).alias("market_ew"), *(F.sum(F.col(f"__{n}") * y).alias(n) for n in names))


def episode_net(train: DataFrame, held_out: DataFrame, cost_per_turnover: float, limit: float, pnl: str = "pnl", turnover: str = "turnover") -> DataFrame:
    """Episodes of both phases with net profit, whether the turnover limit is broken, and the slack to it."""
    both = train.withColumn("phase", F.lit("train")).unionByName(held_out.withColumn("phase", F.lit("eval")), allowMissingColumns=True)
    t = F.coalesce(turnover, F.lit(0.0))
    return both.withColumns({"net_pnl": F.col(pnl) - cost_per_turnover * t, "breach": t > limit, "slack": F.greatest(limit - t, F.lit(0.0))})
