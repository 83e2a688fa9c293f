"""Operators that need a matrix, a solver or the state of the step before: one series or one rebalance date at a time.

Groups are a series, the window of a rebalance date or a block of dates. Only the online portfolios and capped paths, whose
every step needs all weights of the one before, pass all rows through one task, in order of dates. Anything that windows can
express is in the other modules.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.rolling import Trailing
from lodestar.operators.pairs import dense, instant, moment, series
from lodestar.panel import PANEL, Panel
from lodestar.session import cut


def residual_volatility(y: Column, x: Column, window: int = 63, panel: Panel = PANEL) -> Column:
    """Annualised standard deviation of one-factor residuals, in closed form over the trailing rows that are all present."""
    both = y.isNotNull() & x.isNotNull()
    a, b = F.when(both, y), F.when(both, x)
    ta, tb = Trailing(a, window, 0, panel), Trailing(b, window, 0, panel)
    rest = ta.var(0) - F.try_divide(F.pow(ta.cov(b, 0), 2), F.nullif(tb.var(0), F.lit(0.0)))
    return F.when(ta.n == window, F.sqrt(F.greatest(rest, F.lit(0.0)) * window / (window - 1)) * 252**0.5)


def rolling_regression(df: DataFrame, y: str, factors: list[str], window: int = 252, hold: int = 21, panel: Panel = PANEL) -> DataFrame:
    """Adds the sum of the last residuals without the newest ``hold`` of them, from trailing least squares on factors.

    A series' windows are fitted together: their products are one batch of small matrices. Rows with a missing value are no
    part of a window; at least half the window is needed.
    """
    k = len(factors) + 1
    least = max(window // 2, k + 1)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(panel.time).reset_index(drop=True)
        v, out = pdf[[y, *factors]].to_numpy(float), np.full(len(pdf), np.nan)
        ok = np.isfinite(v).all(1)
        a = np.where(ok[:, None], np.column_stack([np.ones(len(v)), v[:, 1:]]), 0.0)
        b = np.where(ok, v[:, 0], 0.0)
        step = max(1, (1 << 20) // (window * k))
        for low in range(window - 1, len(v), step):
            high = min(low + step, len(v))
            cut = slice(low - window + 1, high)
            windows = lambda x: np.lib.stride_tricks.sliding_window_view(x[cut], window, axis=0)  # noqa: E731, B023
            xs, ys, use = windows(a), windows(b), windows(ok)
            inverse = np.linalg.pinv(np.einsum("mit,mjt->mij", xs, xs), rcond=1e-13, hermitian=True)
            beta = np.einsum("mij,mj->mi", inverse, np.einsum("mit,mt->mi", xs, ys))
            rest = ys - np.einsum("mit,mi->mt", xs, beta)
            after = np.cumsum(use[:, ::-1], axis=1)[:, ::-1]  # usable rows from here to the window's end
            total = np.where(use & (after > hold), rest, 0.0).sum(1)
            out[low:high] = np.where(use.sum(1) >= least, total, np.nan)
        return pdf.assign(residual_momentum=out)[[panel.entity, panel.time, "residual_momentum"]]

    kinds = dict(df.dtypes)
    slim = df.select(panel.entity, panel.time, y, *factors)
    return slim.groupBy(panel.entity).applyInPandas(fitted, f"{panel.entity} {kinds[panel.entity]}, {panel.time} {kinds[panel.time]}, residual_momentum double")


def past_percentile(df: DataFrame, x: str, name: str = "percentile", panel: Panel = PANEL) -> DataFrame:
    """Share of an entity's strictly earlier values that are at most the row's; null on the first and for missing ones."""

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(panel.time)
        seen: list[float] = []
        out = []
        for v in pdf[x]:
            known = v is not None and v == v
            out.append(bisect_right(seen, v) / len(seen) if known and seen else np.nan)
            if known:
                insort(seen, v)
        return pdf.assign(**{name: out})[[panel.entity, panel.time, name]]

    kinds = dict(df.dtypes)
    return df.select(panel.entity, panel.time, x).groupBy(panel.entity).applyInPandas(ranked, f"{panel.entity} {kinds[panel.entity]}, {panel.time} {kinds[panel.time]}, {name} double")


def matrix(df: DataFrame, x: str, panel: Panel = PANEL):
    """Rows of dates by sorted entities, as one pandas frame inside a grouped map."""

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.pivot_table(index=panel.time, columns=panel.entity, values=x, aggfunc="last", dropna=False).sort_index().sort_index(axis=1)

    return table


def turbulence(df: DataFrame, x: str, window: int = 252, least: int = 60, block: int = 63, panel: Panel = PANEL) -> DataFrame:
    """Squared Mahalanobis distance of each date from the strictly earlier window, by the number of usable entities.

    Dates run in parallel by blocks, each with the window before it; a row goes to as many blocks as its window reaches.
    """
    rows = df.select(panel.entity, panel.time, F.col(x).cast("double").alias(x)).where(F.col(x).isNotNull() & ~F.isnan(x))
    dates = rows.select(panel.time).distinct().withColumn("__i", F.row_number().over(Window.orderBy(panel.time)) - 1)
    dates = dates.withColumn("__last", F.max("__i").over(Window.partitionBy(F.lit(0))))
    reach = F.floor(F.least(F.col("__i") + window, F.col("__last")) / block)
    dates = dates.select(panel.time, "__i", F.explode(F.sequence(F.floor(F.col("__i") / block), reach)).alias("__block"))

    def distances(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = int(pdf["__block"].iloc[0]) * block
        days = pdf[["__i", panel.time]].drop_duplicates().sort_values("__i")
        index = days["__i"].to_numpy()
        # a usable entity has more than 0.9 of some date's window
        held = pdf[pdf.groupby(panel.entity)[x].transform("size") > 0.9 * min(window, max(least, begin))]
        code, names = pd.factorize(held[panel.entity])
        v, out = np.full((len(index), len(names)), np.nan), np.full(len(index), np.nan)
        v[np.searchsorted(index, held["__i"]), code] = held[x]
        for t in np.flatnonzero(index >= max(begin, least)):
            past = v[max(0, t - window) : t]
            use = np.isfinite(v[t]) & (np.isfinite(past).mean(0) > 0.9)
            past = past[np.isfinite(past[:, use]).all(1)][:, use]
            if use.sum() and len(past) > max(least // 2, use.sum() + 1):
                d = v[t, use] - past.mean(0)
                out[t] = d @ np.linalg.pinv(np.atleast_2d(np.cov(past, rowvar=False))) @ d / use.sum()
        own = index >= begin
        return pd.DataFrame({panel.time: days[panel.time].to_numpy()[own], "turbulence": out[own]})

    return rows.join(dates, panel.time).groupBy("__block").applyInPandas(distances, f"{panel.time} {dict(df.dtypes)[panel.time]}, turbulence double")


def _shares(v: np.ndarray) -> np.ndarray:
    """What is positive, as shares of 1; equal shares if nothing is."""
    v = np.maximum(np.nan_to_num(v), 0.0)
    return v / v.sum() if v.sum() > 1e-12 else np.full(len(v), 1 / len(v))


#: Names whose weights are made together, and rows that are handed on together.
NAMES, ROWS = 256, 1 << 17


def points(held: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """(entity, t, x): a row for each value of ``series``, a name's next to each other and in order; one without any has a null.

    Python gets so many rows at a time, however long the series are; a batch of whole series can take an executor's memory.
    """
    rows = held.select(panel.entity, F.explode_outer(F.arrays_zip("t", "x")).alias("__p"))
    return rows.select(panel.entity, F.coalesce("__p.t", F.lit(0)).alias("t"), F.col("__p.x").alias("x"))


def parts(batches, entity: str, times: np.ndarray, size: int):
    """(names, values by dates) for ``size`` names at most at a time, from ``points``; missing values are NaN."""

    def blocks(rows: list[pd.DataFrame]):
        pdf = pd.concat(rows, ignore_index=True)
        name, t, x = (pdf[c].to_numpy() for c in (entity, "t", "x"))
        edges = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
        x = x.astype(float)
        at = np.searchsorted(times, t)
        for low in range(0, len(edges) - 1, size):
            own = edges[low : low + size + 1]
            rows_ = slice(own[0], own[-1])
            known = ~np.isnan(x[rows_])
            v = np.full((len(own) - 1, len(times)), np.nan)
            v[np.repeat(np.arange(len(own) - 1), np.diff(own))[known], at[rows_][known]] = x[rows_][known]
            yield name[own[:-1]], v

    held, count, last = [], 0, None
    for pdf in batches:
        if len(pdf):
            name = pdf[entity].to_numpy()
            new = np.flatnonzero(np.r_[last is None or name[0] != last, name[1:] != name[:-1]])
            count, last = count + len(new), name[-1]
            if count > size:  # the newest name may go on
                yield from blocks([*held, pdf.iloc[: new[-1]]])
                held, count = [pdf.iloc[new[-1] :]], 1
            else:
                held.append(pdf)
    if held:
        yield from blocks(held)


def _scalars(method: str, w: np.ndarray, x: np.ndarray, par: dict) -> tuple[float, float]:
    """What a step needs of all names: a name's own part follows from these two numbers."""
    if method == "capped":
        size = np.abs(x - w).sum()
        return 0.0, np.nan if size <= par["cap"] or size < 1e-12 else par["cap"] / size
    if method == "eg":
        return max(w @ x, 1e-12), 0.0
    if method == "bah":
        return 0.0, 0.0
    off = x - x.mean()
    if method == "pamr":
        return x.mean(), -max(0.0, w @ x - par["epsilon"]) / (off @ off + 1 / (2 * par["aggressiveness"]))
    return x.mean(), max(0.0, par["epsilon"] - w @ x) / (off @ off) if off @ off >= 1e-12 else np.nan


def _moved(method: str, w: np.ndarray, x: np.ndarray, a: float, b: float, par: dict) -> np.ndarray:
    """Weights after a step, before they are made shares."""
    if method == "capped":
        return x if np.isnan(b) else w + (x - w) * b
    if method == "eg":
        return w * np.exp(par["eta"] * x / a)
    return w * x if method == "bah" else w + b * (x - a)


def walked(df: DataFrame, x: str, method: str, base: float, par: dict, panel: Panel = PANEL) -> DataFrame:
    """(dt, entity, weight) of a path whose every step needs all weights of the one before.

    One task walks over the rows in order of dates and holds one weight a name (and a moving average's few dates); it keeps
    three numbers a date. From these, blocks of names make their own weights in parallel. ``base`` is added to the values, and
    is the value of a missing one.
    """
    held = cut(series(df, x, panel.time, panel.entity))
    kinds = dict(df.dtypes)
    names = pd.Index(sorted(r[0] for r in held.select(panel.entity).collect()))
    times = np.array(sorted(r[0] for r in df.where(F.col(panel.time).isNotNull()).select(instant(df, panel.time)).distinct().collect()))
    k, shared, window = len(names), method != "capped", par.get("window", 1)
    start = 1 / max(k, 1) if shared else 0.0

    def expected(recent: list) -> np.ndarray:
        return np.maximum(np.mean(recent, axis=0), 1e-12) if method == "olmar" else recent[-1]

    def walk(batches):
        w, now, done, recent = np.full(k, start), np.full(k, base), 0, []

        def step() -> tuple:
            nonlocal w, now, recent
            recent = [*recent[-(window - 1) :], now] if window > 1 else [now]
            v = expected(recent)
            a, b = _scalars(method, w, v, par)
            total = np.nan
            if not (method == "olmar" and np.isnan(b)):
                w = _moved(method, w, v, a, b, par)
                if shared:
                    w = np.maximum(np.nan_to_num(w), 0.0)
                    total = w.sum()
                    w = w / total if total > 1e-12 else np.full(k, 1 / k)
            now = np.full(k, base)
            return a, b, total

        out = []
        for pdf in batches:
            at = np.searchsorted(times, pdf["t"].to_numpy())
            code, value = names.get_indexer(pdf[panel.entity]), base + pdf["x"].to_numpy(float)
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for low, high in zip(edges, edges[1:], strict=False):
                while done < at[low]:
                    out.append((done, *step()))
                    done += 1
                now[code[low:high]] = value[low:high]
        while done < len(times):
            out.append((done, *step()))
            done += 1
        yield pd.DataFrame(out, columns=["i", "a", "b", "total"])

    if method == "universal":
        shares = df.sparkSession.sparkContext.broadcast(_universal(held, names, times, par, panel))
    else:
        told = points(held, panel).where("x is not null").repartition(1).sortWithinPartitions("t").mapInPandas(walk, "i int, a double, b double, total double").toPandas().sort_values("i")
        told = told[["a", "b", "total"]].to_numpy(float)

    def weights(batches):
        for own, v in parts(batches, panel.entity, times, NAMES):
            if method == "universal":
                mine = names.get_indexer(own)
                rng = np.random.default_rng(par["seed"])
                mixes = np.stack([rng.dirichlet(np.ones(k))[mine] for _ in range(par["samples"])])
                out = np.ascontiguousarray((shares.value @ mixes).T)
                out[:, 0] = start
            else:
                v = v.T + base
                v[np.isnan(v)] = base
                w, out, recent = np.full(len(own), start), np.empty((len(own), len(times))), []
                for t, (a, b, total) in enumerate(told):
                    if shared:
                        out[:, t] = w
                    recent = [*recent[-(window - 1) :], v[t]] if window > 1 else [v[t]]
                    if not (method == "olmar" and np.isnan(b)):
                        w = _moved(method, w, expected(recent), a, b, par)
                        if shared:
                            w = np.maximum(np.nan_to_num(w), 0.0) / total if total > 1e-12 else np.full(len(own), 1 / k)
                    if not shared:
                        out[:, t] = w
            step = max(1, ROWS // max(len(times), 1))
            for low in range(0, len(own), step):
                part = own[low : low + step]
                yield pd.DataFrame({"t": np.tile(times, len(part)), panel.entity: np.repeat(part, len(times)), "weight": out[low : low + step].ravel()})

    made = points(held, panel).mapInPandas(weights, f"t long, {panel.entity} {kinds[panel.entity]}, weight double")
    return made.select(moment(F.col("t"), kinds[panel.time]).alias(panel.time), panel.entity, "weight")


def _universal(held: DataFrame, names: pd.Index, times: np.ndarray, par: dict, panel: Panel) -> np.ndarray:
    """Each sample's share of the wealth before each date. Dates are independent; a task draws the samples a few at a time."""
    k, samples, days = len(names), par["samples"], 31

    def gains(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.searchsorted(times, pdf["t"].to_numpy())
        own = np.unique(at)
        x = np.ones((len(own), k))
        x[np.searchsorted(own, at), names.get_indexer(pdf[panel.entity])] += pdf["x"].to_numpy(float)
        rng, out = np.random.default_rng(par["seed"]), np.empty((len(own), samples))
        for low in range(0, samples, 16):
            mixes = rng.dirichlet(np.ones(k), size=min(16, samples - low))
            out[:, low : low + 16] = np.log(np.maximum(x @ mixes.T, 1e-12))
        return pd.DataFrame({"i": own, "gain": list(out)})

    edges = F.array(*(F.lit(int(t)) for t in times[::days]))
    rows = held.select(panel.entity, F.explode(F.arrays_zip("t", "x")).alias("p")).select(panel.entity, F.col("p.t").alias("t"), F.col("p.x").alias("x"))
    block = F.size(F.filter(edges, lambda e: e <= F.col("t")))
    made = rows.groupBy(block.alias("__b")).applyInPandas(gains, "i int, gain array<double>").toPandas()
    log = np.zeros((len(times) + 1, samples))
    log[made["i"].to_numpy() + 1] = np.stack(made["gain"].tolist()) if len(made) else 0.0
    wealth = np.cumsum(log, axis=0)[:-1]
    share = np.exp(wealth - wealth.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    return share


def online_portfolio(df: DataFrame, r: str, entities: DataFrame | None = None, method: str = "eg", eta: float = 0.05, window: int = 5, epsilon: float | None = None, aggressiveness: float = 500.0, samples: int = 1000, seed: int = 0, panel: Panel = PANEL) -> DataFrame:
    """Weights before each date's returns, by name: eg (exponentiated gradient), pamr (passive-aggressive reversion), olmar
    (moving-average reversion), universal (Cover's, by Dirichlet samples) or bah (buy and hold). A missing return is 0.

    Over all entities unless some are given.
    """
    if method not in ONLINE:
        raise KeyError(f"unknown algorithm {method!r}; known: {ONLINE}")
    few = df if entities is None else df.join(F.broadcast(entities), panel.entity, "left_semi")
    par = {"eta": eta, "window": window if method == "olmar" else 1, "aggressiveness": aggressiveness, "samples": samples, "seed": seed, "epsilon": epsilon if epsilon is not None else 0.5 if method == "pamr" else 10.0}
    return walked(few, r, method, 1.0, par, panel)


#: Names of the online portfolios.
ONLINE = ("eg", "pamr", "olmar", "universal", "bah")


def trailing_blocks(df: DataFrame, x: str, rebalances: DataFrame, days: int, panel: Panel = PANEL) -> DataFrame:
    """(rebalance, entity, dt, x): strictly earlier rows within so many days of each rebalance date, months as cells."""
    r = rebalances.select(F.col(panel.time).alias("rebalance")).distinct()
    cells = r.select("rebalance", F.explode(F.sequence(F.trunc(F.date_sub("rebalance", days), "month"), F.trunc("rebalance", "month"), F.expr("interval 1 month"))).alias("__cell"))
    rows = df.select(panel.entity, panel.time, x).withColumn("__cell", F.trunc(panel.time, "month"))
    inside = (F.col(panel.time) < F.col("rebalance")) & (F.col(panel.time) >= F.date_sub("rebalance", days))
    return rows.join(cells, "__cell").where(inside).drop("__cell")


def optimised(df: DataFrame, r: str, rebalances: DataFrame, method: str = "min_variance", days: int = 365, least: int = 40, panel: Panel = PANEL) -> DataFrame:
    """(rebalance, entity, weight) from the shrunk covariance of strictly earlier returns.

    No matrix has a row and a column a name. Names are taken by blocks; only the hierarchical weights, whose order goes from one
    name to the next, hold the values of a rebalance's window in one task.
    """
    from lodestar.operators.clusters import Packed, hierarchical
    from lodestar.operators.windows import by_window, optimal, windows

    held = windows(df, r, rebalances, days, least, panel)
    if method != "hierarchical":
        return optimal(held, method)

    def solve(names: np.ndarray, p: Packed) -> pd.DataFrame:
        return pd.DataFrame({panel.entity: names, "weight": hierarchical(p) if p.dates > 2 else np.zeros(len(p))})

    return by_window(held, solve, f"{panel.entity} {dict(df.dtypes)[panel.entity]}, weight double")


def spread_out(df: DataFrame, r: str, rebalances: DataFrame, k: int = 10, days: int = 365, least: int = 40, panel: Panel = PANEL) -> DataFrame:
    """(rebalance, slot, entity): the entity with most rows first, then the one furthest in correlation from those chosen."""

    from lodestar.operators.windows import furthest, windows

    return furthest(windows(df, r, rebalances, days, least, panel), k)
