"""Gated window features over a panel.

Counts, sums and means over trailing rows are differences of running sums, so their cost is linear in the rows, whatever
the window. Second and higher moments are not: after one outlier, a difference of running sums of squares would have lost
the digits of all calmer windows. As columns they use moving frames, which Spark sums afresh for each row; ``trailing``
computes any number of them for a series at once from matrices of windows, centred before they are squared, in one
grouped map, which is several times faster from windows of about 60 rows on.

Three gates decide when a trailing window of w rows has a value: ``full`` (w rows, all present), ``half`` (w rows, at least
max(2, w // 2) present) and ``any`` (w rows, one present at least).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.panel import PANEL, Panel, clip, ratio

YEAR = 252


class Trailing:
    """Number, sum, mean and moments of the values in the last ``window`` rows, ending ``shift`` rows ago."""

    def __init__(self, x: Column, window: int, shift: int = 0, panel: Panel = PANEL):
        self.x, self.window, self._frame = x, window, panel.trailing(window, shift)
        self._now, self._before = panel.expanding(shift), panel.expanding(shift + window)
        self.n = F.count(x).over(self._now) - F.count(x).over(self._before)

    @property
    def full(self) -> Column:
        """The window lies within the series."""
        return F.count(F.lit(1)).over(self._now) >= self.window

    @property
    def sum(self) -> Column:
        total = F.coalesce(F.sum(self.x).over(self._now), F.lit(0.0)) - F.coalesce(F.sum(self.x).over(self._before), F.lit(0.0))
        return F.when(self.n > 0, total)

    @property
    def mean(self) -> Column:
        return self.sum / self.n

    def var(self, ddof: int = 1) -> Column:
        return (F.var_samp if ddof else F.var_pop)(self.x).over(self._frame)

    def sd(self, ddof: int = 1) -> Column:
        return (F.stddev_samp if ddof else F.stddev_pop)(self.x).over(self._frame)

    def cov(self, y: Column, ddof: int = 1) -> Column:
        return (F.covar_samp if ddof else F.covar_pop)(self.x, y).over(self._frame)


@dataclass(frozen=True)
class Feature:
    """A trailing statistic: sd, mean, z, skew or kurt of ``x``, or beta of ``x`` on ``y``.

    ``least`` values are needed; ``full``: only once the window lies within the series; ``shift``: the window ends so many
    rows ago; ``side``: only rows on which y is below (-1) or above (1) zero; ``scale``: a factor.
    """

    kind: str
    x: str
    window: int
    least: int
    y: str | None = None
    ddof: int = 1
    full: bool = True
    shift: int = 0
    side: int = 0
    scale: float = 1.0


#: Entries of a matrix of windows, at most about.
_ENTRIES = 1 << 21


def _feature(f: Feature, v: dict[str, np.ndarray]) -> np.ndarray:
    x, y = v[f.x], v[f.y] if f.y else None
    both = np.isfinite(x) if y is None else np.isfinite(x) & np.isfinite(y)
    if f.side:
        both &= np.sign(np.nan_to_num(y)) == f.side
    size, out = len(x), np.full(len(x), np.nan)
    pad = np.zeros(f.window - 1 + f.shift)
    view = lambda a: np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, a])[: size + f.window - 1], f.window)
    ok_all, x_all = view(both), view(np.where(both, x, 0.0))
    y_all = None if y is None else view(np.where(both, y, 0.0))
    step = max(1, _ENTRIES // f.window)
    with np.errstate(all="ignore"):
        for low in range(0, size, step):
            part = slice(low, min(low + step, size))
            ok, n = ok_all[part], ok_all[part].sum(1)
            mean = x_all[part].sum(1) / n
            d = (x_all[part] - mean[:, None]) * ok
            square = d * d
            var = square.sum(1) / (n - f.ddof)
            if f.kind == "mean":
                made = mean
            elif f.kind == "sd":
                made = np.sqrt(var)
            elif f.kind == "z":
                made = np.where(np.sqrt(var) >= 1e-12, (x[part] - mean) / np.sqrt(var), np.nan)
            elif f.kind == "beta":
                e = (y_all[part] - (y_all[part].sum(1) / n)[:, None]) * ok
                made = (d * e).sum(1) / (e * e).sum(1)
            else:
                high = square * (d if f.kind == "skew" else square)
                made = np.where(var > 1e-24, high.sum(1) / n / (var * np.sqrt(var) if f.kind == "skew" else var * var), np.nan)
            out[part] = np.where((n >= f.least) & (n > f.ddof * (f.kind != "mean")), made, np.nan)
    if f.full:
        out[: f.window - 1 + f.shift] = np.nan
    out[~np.isfinite(out)] = np.nan
    return f.scale * out


def trailing(df: DataFrame, features: dict[str, Feature], keep: list[str] | None = None, panel: Panel = PANEL) -> DataFrame:
    """(entity, dt, kept columns, features): one shuffle by entity; null where a feature has no value."""
    needed = list(dict.fromkeys(c for f in features.values() for c in (f.x, f.y) if c))
    kept = [c for c in keep or [] if c not in (panel.entity, panel.time)]

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(panel.time)
        v = {c: pdf[f"__{c}"].to_numpy(float) for c in needed}
        out = pdf[[panel.entity, panel.time, *kept]].copy()
        for name, f in features.items():
            out[name] = _feature(f, v)
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (panel.entity, panel.time, *kept)] + [f"`{n}` double" for n in features])
    slim = df.select(panel.entity, panel.time, *kept, *(F.col(c).cast("double").alias(f"__{c}") for c in needed))
    found = slim.groupBy(panel.entity).applyInPandas(made, schema)
    return found.select(panel.entity, panel.time, *kept, *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in features))


def gated(x: Column, window: int, make: Callable[[Trailing], Column], gate: str = "full", shift: int = 0, panel: Panel = PANEL, least: int | None = None) -> Column:
    """``make`` of the trailing values, where the gate is open; ``least`` overrides the number of values needed."""
    t = Trailing(x, window, shift, panel)
    open_ = t.n >= (least or {"full": window, "half": max(2, window // 2), "any": 1}[gate])
    return F.when(open_ if least is not None else open_ & t.full, make(t))


def mean(t: Trailing) -> Column:
    return t.mean


def extreme(x: Column, window: int, greatest: bool = True, panel: Panel = PANEL) -> Column:
    """Greatest or least value of the trailing rows, where there is one: a moving frame."""
    w = panel.trailing(window)
    return F.when(Trailing(x, window, 0, panel).full, (F.max if greatest else F.min)(x).over(w))


def change(x: str, lag: int = 1, panel: Panel = PANEL) -> Column:
    return F.col(x) - F.lag(x, lag).over(panel.series)


def pct_change(x: str, panel: Panel = PANEL) -> Column:
    return ratio(F.col(x), F.lag(x).over(panel.series)) - 1


def log_return(r: Column, window: int, panel: Panel = PANEL) -> Column:
    return gated(F.ln(1 + r), window, lambda t: t.sum, panel=panel)


def price_relative(r: Column, window: int, panel: Panel = PANEL) -> Column:
    return F.exp(log_return(r, window, panel)) - 1


def momentum_12_1(r: Column, long: int = 252, skip: int = 21, panel: Panel = PANEL) -> Column:
    """Log return from ``long`` rows ago to ``skip`` rows ago."""
    return gated(F.ln(1 + r), long - skip, lambda t: t.sum, shift=skip, panel=panel)


def momentum_by_ratio(r: Column, long: int = 252, skip: int = 21, panel: Panel = PANEL) -> Column:
    return (1 + price_relative(r, long, panel)) / (1 + price_relative(r, skip, panel)) - 1


def volatility(r: Column, window: int, panel: Panel = PANEL, gate: str = "half") -> Column:
    return gated(r, window, lambda t: t.sd(), gate, panel=panel) * YEAR**0.5


def past_volatility(r: Column, window: int = 252, least: int = 20, panel: Panel = PANEL) -> Column:
    """Population standard deviation of rows strictly before this one."""
    return gated(r, window, lambda t: t.sd(0), shift=1, panel=panel, least=least)


def parkinson(high: Column, low: Column) -> Column:
    return F.pow(F.ln(ratio(high, low)), 2) / (4 * F.ln(F.lit(2.0)))


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    return 0.5 * F.pow(F.ln(ratio(high, low)), 2) - (2 * F.ln(F.lit(2.0)) - 1) * F.pow(F.ln(ratio(close, open_)), 2)


def rogers_satchell(open_: Column, high: Column, low: Column, close: Column) -> Column:
    up, down = F.ln(ratio(high, close)) * F.ln(ratio(high, open_)), F.ln(ratio(low, close)) * F.ln(ratio(low, open_))
    return up + down


def yang_zhang(overnight: Column, intraday: Column, rs: Column, window: int = 21, panel: Panel = PANEL) -> Column:
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    var = lambda x: gated(x, window, lambda t: t.var(), "half", panel=panel)
    total = var(overnight) + k * var(intraday) + (1 - k) * gated(rs, window, mean, "half", panel=panel)
    return F.sqrt(F.greatest(total, F.lit(0.0))) * YEAR**0.5


def amihud(r: Column, dollar_volume: Column, window: int = 21, panel: Panel = PANEL) -> Column:
    return gated(ratio(F.abs(r), dollar_volume), window, mean, "any", panel=panel)


def power_moments(x: Column, window: int, panel: Panel = PANEL) -> tuple[Column, Column]:
    """Skewness and kurtosis (not excess) of centred moments scaled by the sample standard deviation."""
    w, t = panel.trailing(window), Trailing(x, window, 0, panel)
    s1, s2, s3, s4 = (F.avg(v).over(w) for v in (x, x * x, x * x * x, x * x * x * x))
    m3 = s3 - 3 * s1 * s2 + 2 * s1 * s1 * s1
    m4 = s4 - 4 * s1 * s3 + 6 * s1 * s1 * s2 - 3 * s1 * s1 * s1 * s1
    var = t.var()
    open_ = (t.n == window) & t.full & (var > 1e-24)
    return F.when(open_, m3 / F.pow(var, F.lit(1.5))), F.when(open_, m4 / (var * var))


def beta(r: Column, market: Column, window: int = 63, least: int = 21, panel: Panel = PANEL, when: Column | None = None) -> Column:
    """Covariance with the market by its variance over the rows that have both and, if given, meet a condition."""
    both = r.isNotNull() & market.isNotNull() if when is None else r.isNotNull() & market.isNotNull() & when
    x, t = F.when(both, r), Trailing(F.when(both, market), window, 0, panel)
    return F.when(t.n >= least, ratio(t.cov(x), t.var()))


def asymmetric_beta(r: Column, market: Column, window: int = 63, least: int = 5, panel: Panel = PANEL) -> Column:
    return beta(r, market, window, least, panel, market < 0) - beta(r, market, window, least, panel, market > 0)


def rolling_z(x: Column, window: int = 252, least: int | None = None, panel: Panel = PANEL) -> Column:
    t = Trailing(x, window, 0, panel)
    return F.when((t.n >= (least or max(20, window // 5))) & (t.sd(0) >= 1e-12), (x - t.mean) / t.sd(0))


def vol_of_vol(r: str, window: int = 21, of: int = 21, panel: Panel = PANEL) -> Callable[[DataFrame], DataFrame]:
    """Two stages, as a window over a window's result: adds ``hv`` and ``vol_of_vol``."""
    return lambda df: df.withColumn("hv", volatility(F.col(r), window, panel)).withColumn("vol_of_vol", gated(F.col("hv"), of, lambda t: t.sd(), "half", panel=panel))


def variance_risk_premium(iv: Column, hv: Column) -> Column:
    """Squared implied less squared historical volatility."""
    return iv * iv - hv * hv


def tail_asymmetry(df: DataFrame, r: str, market: str, window: int = 63, level: float = 0.95, least: int | None = None, name: str = "tail_asymmetry", panel: Panel = PANEL) -> DataFrame:
    """Adds upper less lower empirical tail dependence on the market over the trailing rows that have both.

    Ranks are those within the window, by value and then by age; a series' windows are ranked together as matrices.
    """
    least = least or max(8, window // 3)
    kept = [c for c in df.columns if c not in (panel.entity, panel.time)]

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(panel.time)
        y, m = pdf["__y"].to_numpy(float), pdf["__m"].to_numpy(float)
        both = np.isfinite(y) & np.isfinite(m)
        view = lambda a, fill: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window - 1, fill), a]), window)
        out, ok_all = np.full(len(y), np.nan), view(both, False)
        y_all, m_all = view(np.where(both, y, np.inf), np.inf), view(np.where(both, m, np.inf), np.inf)
        step = max(1, _ENTRIES // window)
        rank = lambda a: np.argsort(np.argsort(a, axis=1, kind="stable"), axis=1, kind="stable") + 1
        for low in range(0, len(y), step):
            part = slice(low, low + step)
            ok, n = ok_all[part], ok_all[part].sum(1)
            u, v = rank(y_all[part]) / (n + 1)[:, None], rank(m_all[part]) / (n + 1)[:, None]
            with np.errstate(all="ignore"):
                up, down = ok & (u > level), ok & (u < 1 - level)
                value = (up & (v > level)).sum(1) / up.sum(1) - (down & (v < 1 - level)).sum(1) / down.sum(1)
            out[part] = np.where(n >= least, value, np.nan)
        out[: window - 1] = np.nan
        return pdf.drop(columns=["__y", "__m"]).assign(**{name: out})[[panel.entity, panel.time, *kept, name]]

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (panel.entity, panel.time, *kept)] + [f"`{name}` double"])
    found = df.withColumns({"__y": F.col(r).cast("double"), "__m": F.col(market).cast("double")}).groupBy(panel.entity).applyInPandas(made, schema)
    return found.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))


def expanding_z(x: Column, least: int = 2, bound: float = 3.0, panel: Panel = PANEL, warm_up: int = 0) -> Column:
    """Degenerate spread gives 0, rows before ``warm_up`` too."""
    w = panel.expanding()
    sd = F.stddev_pop(x).over(w)
    z = F.when(x.isNull() | (F.count(x).over(w) < least), None).when(sd < 1e-12, 0.0).otherwise(clip((x - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0)), -bound, bound))
    return F.when(F.row_number().over(panel.series) <= warm_up, 0.0).otherwise(z) if warm_up else z


def expanding_quantile(df: DataFrame, x: str, q: float, name: str = "threshold", panel: Panel = PANEL) -> DataFrame:
    """(entity, dt, x, threshold): the linearly interpolated quantile of an entity's values up to the row, its own included.

    Two heaps around the quantile are kept for each series, so a row costs a logarithm of its history; a window function
    would sort the history again at every row.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(panel.time)
        low: list[float] = []  # the smallest, negated, up to the quantile's lower neighbour
        high: list[float] = []
        out = []
        for v in pdf[x]:
            if v is not None and v == v:
                if low and v < -low[0]:
                    heapq.heappush(low, -v)
                else:
                    heapq.heappush(high, v)
                size = len(low) + len(high)
                want = int(math.floor(q * (size - 1))) + 1
                while len(low) < want:
                    heapq.heappush(low, -heapq.heappop(high))
                while len(low) > want:
                    heapq.heappush(high, -heapq.heappop(low))
            size = len(low) + len(high)
            at = q * (size - 1)
            part = at - math.floor(at)
            out.append(math.nan if not size else -low[0] + (part * (high[0] + low[0]) if part and high else 0.0))
        return pdf.assign(**{name: out})[[panel.entity, panel.time, x, name]]

    kinds = dict(df.dtypes)
    schema = f"{panel.entity} {kinds[panel.entity]}, {panel.time} {kinds[panel.time]}, {x} double, {name} double"
    return df.select(panel.entity, panel.time, x).groupBy(panel.entity).applyInPandas(walk, schema)


def rank_in_history(x: Column, window: int = 252, panel: Panel = PANEL) -> Column:
    """(x - min) / (max - min) over the trailing rows."""
    w = panel.trailing(window)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return ratio(x - low, high - low)


def drawdown(pnl: Column, panel: Panel = PANEL) -> Column:
    """Additive: running sum less its running maximum, 0 or below. Two windows, so call it on a column."""
    return pnl - F.max(pnl).over(panel.expanding())


def forward_fill(x: str | Column, limit: int | None = None, panel: Panel = PANEL) -> Column:
    """The last value; with a limit, one at most so many rows back. Never fills backwards."""
    w = panel.series.rowsBetween(-limit, 0) if limit else panel.expanding()
    return F.last(x, ignorenulls=True).over(w)


def trailing_yield(paid: Column, price: Column, window: int = 252, least: int = 21, panel: Panel = PANEL) -> Column:
    total = Trailing(F.coalesce(paid, F.lit(0.0)), window, 0, panel).sum
    return F.when(F.row_number().over(panel.series) >= least, ratio(total, price))
