"""The marks pipeline: from quotes to one marked contract a day for each security, with hedged-return labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestar.operators.pit import asof_series
from lodestar.operators.screens import Screens, passes


@dataclass(frozen=True)
class Bands:
    """Which contract is marked, and how long a label may be held."""

    least_days: int = 14
    most_days: int = 45
    low_delta: float = 0.35
    high_delta: float = 0.65
    least_hold: int = 1
    most_hold: int = 5


def continued(quotes: DataFrame, key: list[str], time: str, carried: list[str]) -> DataFrame:
    """Yesterday's delta and the next day's date and values of the same contract."""
    w = Window.partitionBy(*key).orderBy(time)
    return quotes.withColumns({"delta_lag": F.lag("delta").over(w), f"{time}_next": F.lead(time).over(w)} | {f"{c}_next": F.lead(c).over(w) for c in carried})


def selected(cont: DataFrame, entity: str, time: str, tie: str, bands: Bands = Bands()) -> DataFrame:
    """One contract for each security and day: calls near the money first, then the delta closest to one half, then open interest."""
    near = (F.col("cp") == "C") & F.col("delta").between(bands.low_delta, bands.high_delta)
    ok = F.coalesce(F.col("delta").isNotNull() & F.col("dte").between(bands.least_days, bands.most_days), F.lit(False))
    order = [F.when(ok, 0).otherwise(1), F.when(near, 0).otherwise(1), F.abs(F.abs("delta") - 0.5), F.col("open_interest").desc_nulls_last(), F.col(tie)]
    return cont.withColumn("__rn", F.row_number().over(Window.partitionBy(entity, time).orderBy(*order))).where((F.col("__rn") == 1) & ok).drop("__rn")


def flow(group: WindowSpec | None = None) -> dict[str, Column]:
    """Skew at a quarter delta, volume imbalance and open-interest ratio: aggregates, or values over a window of a day's quotes."""
    put, call = F.col("cp") == "P", F.col("cp") == "C"
    over = (lambda c: c.over(group)) if group is not None else (lambda c: c)
    of = lambda c, x: over(F.sum(F.when(c, F.col(x))))
    iv = lambda c, low, high: over(F.avg(F.when(c & F.col("delta").between(low, high), F.col("iv"))))
    total = of(call, "volume") + of(put, "volume")
    return {
        "skew_25d": iv(put, -0.30, -0.20) - iv(call, 0.20, 0.30),
        "volume_imbalance": F.try_divide(of(call, "volume") - of(put, "volume"), F.nullif(total, F.lit(0.0))),
        "put_call_oi": F.try_divide(of(put, "open_interest"), F.nullif(of(call, "open_interest"), F.lit(0.0))),
    }


def labels(marked: DataFrame, time: str, bands: Bands = Bands()) -> DataFrame:
    """Delta-hedged returns at today's and yesterday's delta, and the returns of the contract and the stock."""
    hold = F.datediff(f"{time}_next", time)
    usable = F.col(f"{time}_next").isNotNull() & hold.between(bands.least_hold, bands.most_hold) & F.col("spot").isNotNull() & F.col("spot_next").isNotNull() & F.col("mid").isNotNull() & F.col("mid_next").isNotNull() & F.col("adj").eqNullSafe(F.col("adj_next"))

    def hedged(delta: str) -> tuple[Column, Column]:
        base = F.col(delta) * F.col("spot") - F.col("mid")
        ok = F.coalesce(usable & (base > 0), F.lit(False))
        gain = (F.col("mid_next") - F.col("mid")) - F.col(delta) * (F.col("spot_next") - F.col("spot")) - F.col("rf") / 100 * hold / 365 * base
        return ok, F.when(ok, F.try_divide(gain, base))

    ok, now = hedged("delta")
    ok_lag, lag = hedged("delta_lag")
    return marked.withColumns({"hold_days": hold, "label_ok": ok, "label_ok_lag": ok_lag, "dh_ret": now, "dh_ret_lagdelta": lag, "fwd_ret": F.when(ok, F.col("mid_next") - F.col("mid")), "stk_ret": F.when(ok_lag, F.try_divide(F.col("spot_next") - F.col("spot"), F.col("spot")))})


def daily_marks(quotes: DataFrame, rates: DataFrame, screens: Screens, entity: str = "entity", contract: str = "contract", time: str = "dt", tie: str = "contract", bands: Bands = Bands()) -> DataFrame:
    """The whole pipeline: screens, same-contract leads, selection, flow, risk-free rate as of the day, labels."""
    good = quotes.where(passes(screens))
    cont = continued(good, [entity, contract], time, ["mid", "spot", "adj"])
    # a day's flow and its best contract need the same rows together: one shuffle serves both
    whole = cont.withColumns(flow(Window.partitionBy(entity, time)))
    picked = selected(whole, entity, time, tie, bands)
    return labels(asof_series(picked, rates.where("rf is not null"), time, ["rf"], time), time, bands)
