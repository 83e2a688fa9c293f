"""Feature blocks and the cube: named channels of a panel, their exclusions, masks and normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.operators.cross_section import normalise
from lodestar.panel import PANEL, Panel, ratio

#: Groups that channels can be excluded by; prefixes stand for channels numbered or named freely.
GROUPS: dict[str, tuple[str, ...]] = {
    "returns_momentum": ("log_ret_1", "log_ret_5", "log_ret_21", "log_ret_63", "mom_12_1", "resid_mom_12_1"),
    "volatility_vrp": ("hv_21", "hv_63", "vol_of_vol", "vrp"),
    "liquidity": ("amihud", "adv"),
    "range_volatility": ("parkinson", "garman_klass", "rogers_satchell", "yang_zhang"),
    "microstructure": ("eff_spread_21", "vwap_dev_5", "block_share_21", "turnover_21"),
    "sentiment": ("si_pct", "si_pct_chg_21", "rec_mean_inv", "rec_chg_63", "pt_gap"),
    "option_flow": ("pc_vol", "pc_oi", "oi_lvl", "os_vol", "pc_vol_chg_5", "oi_chg_21"),
    "lottery": ("max_ret_21", "min_ret_21", "skew_63", "kurt_63", "idio_vol_63", "beta_asym_63"),
    "experimental": ("x_range_cc_21", "x_overnight_share_21", "x_vrp_term", "x_spread_x_amihud", "x_si_x_mom", "x_rel_mom_21", "x_oi_skew_flow", "x_tail_dep_asym_63"),
}
PREFIXES = {"images": "image_px_", "macro": "macro_", "fundamentals": "fund_"}


def returns_momentum(df: DataFrame, r: str, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    made = {f"log_ret_{w}": R.log_return(F.col(r), w, panel) for w in (1, 5, 21, 63)} | {"mom_12_1": R.momentum_12_1(F.col(r), panel=panel)}
    return df.withColumns(made), list(made)


def volatility(df: DataFrame, r: str, iv: str | None = None, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """hv_21, hv_63, vol_of_vol, and the variance risk premium if implied volatility is given."""
    year = 252**0.5
    keep = [c for c in df.columns if c not in (panel.entity, panel.time)]
    one = R.trailing(df, {"hv_21": R.Feature("sd", r, 21, 10, scale=year), "hv_63": R.Feature("sd", r, 63, 31, scale=year)}, keep, panel)
    two = R.trailing(one, {"vol_of_vol": R.Feature("sd", "hv_21", 21, 10)}, [*keep, "hv_21", "hv_63"], panel)
    names = ["hv_21", "hv_63", "vol_of_vol"]
    if iv:
        two, names = two.withColumn("vrp", R.variance_risk_premium(F.col(iv), F.col("hv_21"))), [*names, "vrp"]
    return two, names


def liquidity(df: DataFrame, r: str, dollar_volume: str, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    positive = F.when(F.col(dollar_volume) > 0, F.col(dollar_volume))
    made = {"amihud": R.amihud(F.col(r), positive, panel=panel), "adv": R.gated(F.col(dollar_volume), 21, R.mean, "any", panel=panel)}
    return df.withColumns(made), list(made)


def microstructure(df: DataFrame, spread: str, vwap_dev: str, block_share: str, turnover: str, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    made = {n: R.gated(F.col(c), w, R.mean, "any", panel=panel) for n, c, w in (("eff_spread_21", spread, 21), ("vwap_dev_5", vwap_dev, 5), ("block_share_21", block_share, 21), ("turnover_21", turnover, 21))}
    return df.withColumns(made), list(made)


def sentiment(df: DataFrame, short_interest: str | None = None, recommendation: str | None = None, target_gap: str | None = None, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    made: dict[str, Column] = {}
    if short_interest:
        made |= {"si_pct": F.col(short_interest), "si_pct_chg_21": R.change(short_interest, 21, panel)}
    if recommendation:
        made |= {"rec_mean_inv": inverted_recommendation(F.col(recommendation)), "rec_chg_63": inverted_recommendation(F.col(recommendation)) - F.lag(inverted_recommendation(F.col(recommendation)), 63).over(panel.series)}
    if target_gap:
        made["pt_gap"] = F.col(target_gap)
    return df.withColumns(made), list(made)


def option_flow(df: DataFrame, levels: dict[str, str], changes: dict[str, tuple[str, int]], panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """Levels under their channel names, and changes of a column over so many rows."""
    made = {n: F.col(c) for n, c in levels.items()} | {n: R.change(c, lag, panel) for n, (c, lag) in changes.items()}
    return df.withColumns(made), list(made)


def lottery(df: DataFrame, r: str, market: str, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """Extreme returns, moments over 63 rows, one-factor residual volatility, and down less up beta."""
    from lodestar.operators.sequential import residual_volatility

    keep = [c for c in df.columns if c not in (panel.entity, panel.time)]
    side = lambda k: R.Feature("beta", r, 63, 21, market, full=False, side=k)
    out = R.trailing(df, {"skew_63": R.Feature("skew", r, 63, 31), "kurt_63": R.Feature("kurt", r, 63, 31), "__down": side(-1), "__up": side(1)}, keep, panel)
    made = {"max_ret_21": R.extreme(F.col(r), 21, True, panel), "min_ret_21": R.extreme(F.col(r), 21, False, panel), "idio_vol_63": residual_volatility(F.col(r), F.col(market), 63, panel), "beta_asym_63": F.col("__down") - F.col("__up")}
    return out.withColumns(made).drop("__down", "__up"), ["skew_63", "kurt_63", *made]


def selected(df: DataFrame, columns: list[str], prefix: str = "") -> tuple[DataFrame, list[str]]:
    """A block of columns that are there already: a surface's signals, borrow fees, fundamentals as known on the date."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    names = [f"{prefix}{c}" for c in columns]
    return df.withColumns({n: F.col(c) for n, c in zip(names, columns, strict=True) if n != c}), names


def interactions(df: DataFrame, r: str, group: str | None = None, spread: str | None = None, amihud: str | None = None, short_interest: str | None = None, momentum: str | None = None, oi: str | None = None, skew_change: str | None = None, near: str | None = None, far: str | None = None, hv_near: str | None = None, hv_far: str | None = None, overnight: str | None = None, close_return: str | None = None, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """Products and differences of channels, for those whose parts are given; a missing part gives a missing value."""
    col = F.col
    made: dict[str, Column] = {}
    if overnight and close_return:
        made["x_overnight_share_21"] = ratio(R.gated(col(overnight), 21, R.mean, "any", panel=panel), R.gated(F.abs(col(close_return)), 21, R.mean, "any", panel=panel))
    if near and far and hv_near and hv_far:
        made["x_vrp_term"] = (col(near) - col(hv_near)) - (col(far) - col(hv_far))
    if spread and amihud:
        made["x_spread_x_amihud"] = R.gated(col(spread), 21, R.mean, "any", panel=panel) * col(amihud)
    if short_interest and momentum:
        made["x_si_x_mom"] = col(short_interest) * col(momentum)
    if oi and skew_change:
        made["x_oi_skew_flow"] = R.change(oi, 21, panel) * col(skew_change)
    out = df.withColumns(made)
    if group:
        known = F.coalesce(col(group).cast("string"), F.lit("")) != ""
        out = out.withColumn("__m", F.when(known, R.price_relative(col(r), 21, panel)))
        out = out.withColumn("x_rel_mom_21", col("__m") - F.avg("__m").over(Window.partitionBy(panel.time, group))).drop("__m")
        made["x_rel_mom_21"] = F.lit(None)
    return out, list(made)


def distinct_names(names: list[str], second: dict[str, str] | None = None) -> list[str]:
    """Names without repeats: a second borrow rate gets a name of its own, any other repeat fails."""
    second = {"borrow_rate": "borrow_rate_fee"} if second is None else second
    out: list[str] = []
    for n in names:
        use = n if n not in out else second.get(n)
        if use is None or use in out:
            raise ValueError(f"channel {n!r} occurs twice")
        out.append(use)
    return out


def excluded(groups: list[str], channels: list[str], names: list[str]) -> set[str]:
    """Channels to leave out, by group and name; unknown ones fail, known ones that aren't there are ignored."""
    known = {c for g in GROUPS.values() for c in g}
    out: set[str] = set()
    for g in groups:
        if g in PREFIXES:
            out |= {n for n in names if n.startswith(PREFIXES[g])}
        elif g in GROUPS:
            out |= set(GROUPS[g]) & set(names)
        else:
            raise ValueError(f"unknown group {g!r}; known: {sorted([*GROUPS, *PREFIXES])}")
    for c in channels:
        if c in names:
            out.add(c)
        elif c not in known and not c.startswith(tuple(PREFIXES.values())):
            raise ValueError(f"unknown channel {c!r}")
    return out


def cube(df: DataFrame, channels: list[str], mask: Column | None = None, law: bool = True, macro: list[str] | None = None, exclude_groups: list[str] | None = None, exclude: list[str] | None = None, panel: Panel = PANEL) -> tuple[DataFrame, list[str]]:
    """(entity, dt, channels) and the names that are left, in order.

    Where the mask doesn't hold, channels are missing; then each is winsorised and standardised by date. Macro columns are
    standardised over their own past instead, which has a row for each date, and are alike for all entities.
    """
    names = distinct_names(channels)
    macro = macro or []
    drop = excluded(exclude_groups or [], exclude or [], [*names, *macro])
    names, macro = [n for n in names if n not in drop], [m for m in macro if m not in drop]
    out = df.select(panel.entity, panel.time, *names, *macro, *([mask.alias("__mask")] if mask is not None else []))
    if mask is not None:
        out = out.withColumns({n: F.when(F.col("__mask"), F.col(n)) for n in names}).drop("__mask")
    if law and names:
        out = normalise(out, names, panel)
    if macro:
        daily = out.groupBy(panel.time).agg(*(F.max(m).alias(m) for m in macro))
        calendar = Panel("__all", panel.time)
        made = daily.withColumn("__all", F.lit(0)).select(panel.time, *(R.expanding_z(F.col(m), panel=calendar).alias(m) for m in macro))
        out = out.drop(*macro).join(F.broadcast(made), panel.time)
    return out.select(panel.entity, panel.time, *names, *macro), [*names, *macro]


def stem_columns(df: DataFrame, stem: str, slots: int) -> list[str]:
    """The columns stem_0 to stem_(slots - 1) of a wide table; fails if one is missing."""
    names = [f"{stem}_{k}" for k in range(slots)]
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return names


def stem_matrix(df: DataFrame, stem: str, slots: int, index: str = "dt", fill: float | None = None) -> DataFrame:
    """(index, values): the slots of a stem as an array, in order; missing values are filled if told so."""
    cells = [F.coalesce(F.col(n), F.lit(fill)) if fill is not None else F.col(n) for n in stem_columns(df, stem, slots)]
    return df.select(index, F.array(*cells).alias(stem))


def marks(df: DataFrame, options: int, stocks: int, option_stem: str, stock_stem: str, index: str = "dt") -> DataFrame:
    """(index, labels, is_option): option slots first, then stock slots, missing labels 0."""
    cell = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    names = [*stem_columns(df, option_stem, options), *stem_columns(df, stock_stem, stocks)]
    return df.select(index, F.array(*map(cell, names)).alias("labels"), F.array(*(F.lit(k < options) for k in range(options + stocks))).alias("is_option"))


def inverted_recommendation(mean: Column) -> Column:
    """Analysts' 1 to 5, turned so that more is better."""
    return 6 - mean


def target_gap(target: Column, price: Column) -> Column:
    return ratio(target, price) - 1


def earnings_yield(price_earnings: Column) -> Column:
    return ratio(F.lit(1.0), price_earnings)


def log_size(price: Column, shares: Column) -> Column:
    size = price * shares
    return F.when(size > 0, F.ln(size))


#: Family loaders by name: (spark, folder, start, end) to a DataFrame. ``register`` adds one; names are unique.
LOADERS: dict[str, Callable] = {}


def register(name: str):
    def add(f: Callable):
        if name in LOADERS:
            raise ValueError(f"loader {name!r} is there already")
        LOADERS[name] = f
        return f

    return add


def load_family(name: str, spark, folder: str, start: str, end: str) -> DataFrame:
    if name not in LOADERS:
        raise KeyError(f"unknown family {name!r}; known: {sorted(LOADERS)}")
    return LOADERS[name](spark, folder, start, end)
