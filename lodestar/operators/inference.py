"""Inference: HAC regressions and Sharpe ratios, hurdles, gates of signals and policies, breadth, style regressions.

Series are strategies, entities or signals; sums go through grouped aggregates and windows by series. Small systems are
solved for many series at once; only resampling takes a series at a time, through a grouped map.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.statistics import stationary_indices
from lodestar.panel import PANEL, Panel, ratio

#: Lags that a window array holds; the rule reaches it at 26 million observations of one series.
MOST_LAGS = 64


def bartlett(df: DataFrame, z: str, time: str, by: list[str], lags: int | None = None) -> DataFrame:
    """Adds ``__n`` and ``__term``, whose sum by series is that of z_t z_(t-j) over all |j| up to the lags, weighted by Bartlett.

    ``z`` has no nulls. Lags: floor(4 (n / 100)^(2 / 9)) unless given; more than MOST_LAGS fail.
    """
    w, whole = Window.partitionBy(*by).orderBy(time), Window.partitionBy(*by)
    if lags is not None and lags > MOST_LAGS:
        raise ValueError(f"at most {MOST_LAGS} lags")
    n = F.count(F.lit(1)).over(whole)
    most = F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int") if lags is None else F.lit(lags)
    held = df.withColumns({"__n": n, "__l": most, "__past": F.collect_list(z).over(w.rowsBetween(-(MOST_LAGS if lags is None else lags), 0))})
    held = held.withColumn("__l", F.when(F.col("__l") > MOST_LAGS, F.raise_error("a series is too long for the lags held").cast("int")).otherwise(F.col("__l")))
    past, size = F.col("__past"), F.size("__past")
    weight = lambda j: F.when(j == 0, 1.0).otherwise(2 * (1 - j / (F.col("__l") + 1)))
    term = F.aggregate(F.sequence(F.lit(0), F.least(F.col("__l"), size - 1)), F.lit(0.0), lambda a, j: a + weight(j) * F.col(z) * F.get(past, size - 1 - j))
    return held.withColumn("__term", term).drop("__past")


def hac_mean(df: DataFrame, x: str, time: str, by: list[str], lags: int | None = None) -> DataFrame:
    """Mean of each series with its plain and Newey-West standard errors and t; null below three observations."""
    whole = Window.partitionBy(*by)
    rows = df.where(F.col(x).isNotNull()).select(*by, time, x).withColumn("__e", F.col(x) - F.avg(x).over(whole))
    out = bartlett(rows, "__e", time, by, lags).groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.first("__n").alias("n"), F.sum("__term").alias("__s"))
    n, enough = F.col("n"), F.col("n") >= 3
    se = F.when(enough, F.sqrt(F.greatest(F.col("__s") / n, F.lit(1e-24)) / n))
    iid = F.when(enough & (F.col("sd") > 0), F.col("sd") / F.sqrt(n))
    return out.select(*by, "n", "mean", "sd", iid.alias("se_iid"), se.alias("se_hac"), (F.col("mean") / iid).alias("t_iid"), (F.col("mean") / se).alias("t_hac"))


def hac_sharpe(df: DataFrame, x: str, time: str, by: list[str], periods: int = 252) -> DataFrame:
    """Annual Sharpe ratio (sample deviation) with a standard error scaled by the ratio of HAC to plain errors of the mean."""
    m = hac_mean(df, x, time, by)
    sr = ratio(F.col("mean"), F.col("sd"))
    inflation = F.coalesce(ratio(F.col("se_hac"), F.col("se_iid")), F.lit(1.0))
    se = F.sqrt((1 + 0.5 * sr * sr) / F.col("n")) * inflation * periods**0.5
    sharpe = F.when((F.col("n") >= 3) & (F.col("sd") > 0), sr * periods**0.5)
    return m.select(*by, "n", sharpe.alias("sharpe"), F.when(sharpe.isNotNull(), se).alias("se"), (sharpe / se).alias("t"), inflation.alias("inflation"))


def newey_west(df: DataFrame, y: str, xs: list[str], time: str, by: list[str], lags: int | None = None) -> DataFrame:
    """``(by, term, coef, se, t, n)``: least squares with intercept and Bartlett HAC errors, a row for each coefficient.

    The error of a coefficient is that of the sum of a_t = (row of the inverse of X'X) x_t e_t, so each is a HAC sum of
    its own. Rows with a missing value are left out; no values with fewer than two rows more than coefficients.
    """
    k = len(xs) + 1
    full = df.where(F.col(y).isNotNull())
    for x in xs:
        full = full.where(F.col(x).isNotNull())
    full = full.select(*by, time, F.col(y).cast("double").alias("__y"), F.array(F.lit(1.0), *(F.col(x).cast("double") for x in xs)).alias("__x"))
    x = F.col("__x")
    sums = full.groupBy(*by).agg(F.array(*(F.sum(x[i] * x[j]) for i in range(k) for j in range(k))).alias("__xx"), F.array(*(F.sum(x[i] * F.col("__y")) for i in range(k))).alias("__xy"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("struct<beta:array<double>,inverse:array<array<double>>>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
        inverse = [np.linalg.pinv(np.array(a, float).reshape(k, k)) for a in xx]
        beta = [(m @ np.array(b, float)).tolist() for m, b in zip(inverse, xy, strict=True)]
        return pd.DataFrame({"beta": beta, "inverse": [m.tolist() for m in inverse]})

    fit = sums.where(F.col("n") >= k + 2).select(*by, "n", solve("__xx", "__xy").alias("__f"))
    joined = full.join(F.broadcast(fit), by) if by else full.crossJoin(F.broadcast(fit))
    f, x = F.col("__f"), F.col("__x")
    dot = lambda a: sum((a[i] * x[i] for i in range(k)), F.lit(0.0))
    scored = joined.withColumn("__e", F.col("__y") - dot(f["beta"]))
    terms = F.array(*(F.struct(F.lit(name).alias("term"), f["beta"][i].alias("coef"), (dot(f["inverse"][i]) * F.col("__e")).alias("__z")) for i, name in enumerate(["intercept", *xs])))
    rows = scored.select(*by, time, "n", F.inline(terms))
    out = bartlett(rows, "__z", time, [*by, "term"], lags).groupBy(*by, "term").agg(F.first("coef").alias("coef"), F.sqrt(F.greatest(F.sum("__term"), F.lit(0.0))).alias("se"), F.first("n").alias("n"))
    return out.withColumn("t", F.when(F.col("se") > 1e-12, F.col("coef") / F.col("se"))).select(*by, "term", "coef", "se", "t", "n")


def factor_alpha(df: DataFrame, y: str, factors: list[str], time: str, by: list[str], lags: int | None = None) -> DataFrame:
    """The intercept on several factors with its Newey-West t."""
    return newey_west(df, y, factors, time, by, lags).where("term = 'intercept'").select(*by, F.col("coef").alias("alpha"), "se", "t", "n")


def hurdles(t: Column) -> dict[str, Column]:
    """Whether a t-statistic clears 1.96 and the hurdles for new factors, 3.0 and 3.9."""
    return {f"clears_{name}": F.coalesce(F.abs(t) > bound, F.lit(False)) for name, bound in (("1_96", 1.96), ("3_0", 3.0), ("3_9", 3.9))}


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def student_p(t: float, freedom: float) -> float:
    """Two-sided p of Student's t."""
    if t is None or not math.isfinite(t):
        return math.nan
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def student_p_column(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([student_p(a, max(b - 1, 1)) for a, b in zip(t, n, strict=True)])


def fama_macbeth(df: DataFrame, signals: list[str], label: str, least: int = 3, panel: Panel = PANEL) -> DataFrame:
    """``(signal, mean_coef, t, t_hac, n_dates)`` of the daily slopes of a label on each signal, all signals in one pass."""
    named = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals))
    rows = df.where(F.col(label).isNotNull()).select(panel.time, F.col(label).alias("y"), F.inline(named)).where("x is not null")
    daily = rows.groupBy("signal", panel.time).agg(F.when((F.count(F.lit(1)) >= least) & (F.var_pop("x") * F.count(F.lit(1)) > 1e-12), F.regr_slope("y", "x")).alias("slope"))
    m = hac_mean(daily, "slope", panel.time, ["signal"])
    return m.select("signal", F.col("mean").alias("mean_coef"), F.col("t_iid").alias("t"), "t_hac", F.col("n").alias("n_dates"))


def signal_gate(df: DataFrame, signals: list[str], label: str, selection_end: str, rate: float = 0.05, hurdle: float = 3.0, t_min: float = 2.0, version: int = 2, panel: Panel = PANEL) -> DataFrame:
    """A row for each signal: Fama-MacBeth statistics, p, and whether it is admitted.

    Version 1 admits an absolute t above ``t_min``; version 2 controls false discoveries at ``rate`` by Benjamini-Hochberg
    over the p of the Newey-West t, and only discloses the hurdle and the older rule. A signal without any value is
    "unscored" and no part of the family. Rows after ``selection_end`` are refused.
    """
    late = df.where(F.col(panel.time) > F.lit(selection_end).cast("date")).limit(1).count()
    if late:
        raise ValueError(f"the gate refuses dates after {selection_end}")
    scored = fama_macbeth(df, signals, label, panel=panel).withColumn("p", student_p_column("t_hac", "n_dates"))
    everything = Window.partitionBy(F.lit(0))  # a row for each signal
    order = everything.orderBy(F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0)), "signal")
    rank, m = F.row_number().over(order), F.count(F.lit(1)).over(everything)
    below = scored.withColumn("__ok", F.coalesce(F.col("p") <= rate * rank / m, F.lit(False))).withColumn("__rank", rank)
    cut = F.max(F.when(F.col("__ok"), F.col("__rank"))).over(everything)
    judged = below.withColumn("__bh", F.coalesce(F.col("__rank") <= cut, F.lit(False)))
    legacy = F.coalesce(F.abs("t") > t_min, F.lit(False))
    out = judged.select("signal", "mean_coef", "t", "t_hac", "p", "n_dates", F.lit("scored").alias("status"), (F.col("__bh") if version == 2 else legacy).alias("admitted"), F.coalesce(F.abs("t_hac") >= hurdle, F.lit(False)).alias("discovery"), legacy.alias("legacy"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in signals))).alias("signal"))
    return names.join(out, "signal", "left").withColumns({"status": F.coalesce("status", F.lit("unscored")), "n_dates": F.coalesce("n_dates", F.lit(0).cast("long")), **{c: F.coalesce(c, F.lit(False)) for c in ("admitted", "discovery", "legacy")}})


def break_even_gate(df: DataFrame, multiplier: str, floor: float = 0.25) -> DataFrame:
    """Adds whether the break-even cost multiplier reaches the floor, and the decision."""
    ok = F.coalesce(F.col(multiplier) >= floor, F.lit(False))
    return df.withColumns({"passes": ok, "decision": _decision(ok)})


def alpha_gate(df: DataFrame, y: str, factors: list[str], time: str, by: list[str], least_t: float = 2.0, periods: int = 252) -> DataFrame:
    """Positive alpha with a Newey-West t of at least ``least_t``."""
    a = factor_alpha(df, y, factors, time, by)
    ok = F.coalesce((F.col("alpha") > 0) & (F.col("t") >= least_t), F.lit(False))
    return a.select(*by, "alpha", (F.col("alpha") * periods).alias("alpha_annual"), "t", "n", ok.alias("passes"), _decision(ok).alias("decision"))


#: Peers that are copies of another algorithm and count for nothing.
STUB_PEERS = ("corn", "bnn", "ons", "anticor", "cwmr", "rmr")


def without_stubs(df: DataFrame, name: str) -> DataFrame:
    """Leaves out peers whose bare name, or name behind a colon, is a stub's."""
    key = F.lower(F.trim(F.regexp_replace(F.trim(name), r"^[^:]*:", "")))
    return df.where(~key.isin(*STUB_PEERS))


def peers_gate(df: DataFrame, name: str, sharpe: str, policy: str, every: bool = False) -> DataFrame:
    """One row: whether a policy's Sharpe ratio beats the best peer (or all of them), how many it beats, and by how much."""
    own = df.where(F.col(name) == policy).agg(F.max(sharpe).alias("own"))
    peers = without_stubs(df.where((F.col(name) != policy) & F.col(sharpe).isNotNull() & ~F.isnan(sharpe)), name)
    both = peers.crossJoin(F.broadcast(own)).agg(F.first("own").alias("own"), F.count(F.lit(1)).alias("peers"), F.count_if(F.col("own") > F.col(sharpe)).alias("beaten"), F.max(sharpe).alias("best"), F.max_by(name, sharpe).alias("best_peer"))
    ok = F.coalesce((F.col("peers") > 0) & ((F.col("beaten") == F.col("peers")) if every else (F.col("own") > F.col("best"))), F.lit(False))
    return both.select("peers", "beaten", "best_peer", (F.col("own") - F.col("best")).alias("edge"), ok.alias("passes"), _decision(ok).alias("decision"))


def _decision(ok: Column) -> Column:
    return F.when(ok, "continue").otherwise("pivot")


def periods_per_year(dates: DataFrame, time: str = "dt", least: int = 30) -> DataFrame:
    """Observations a year that a calendar of distinct dates implies; null for fewer than ``least``."""
    d = dates.select(time).distinct()
    span = F.datediff(F.max(time), F.min(time))
    return d.agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= least) & (span > 0), (F.count(F.lit(1)) - 1) / (span / 365.25)).alias("periods"))


def information_ratio(ic: Column, n_eff: Column, refresh: Column, transfer: Column) -> Column:
    """Predicted by the fundamental law: IC times the root of breadth (refresh times effective names) times transfer."""
    breadth = refresh * n_eff
    return F.when(breadth >= 0, ic * F.sqrt(breadth) * transfer)


def refresh_rate(mean_autocorrelation: Column, periods: float = 252.0) -> Column:
    """Refreshes a year from the mean cross-sectional autocorrelation."""
    return -F.ln(F.least(F.greatest(mean_autocorrelation, F.lit(1e-6)), F.lit(1 - 1e-12))) * periods


def breadth(pairs: DataFrame, entities: int, corr: str = "corr") -> DataFrame:
    """Effective numbers of names: by the mean correlation, and by the squared eigenvalues, which is the squared Frobenius norm.

    ``pairs`` has each two entities once; missing correlations count as 0.
    """
    c = F.coalesce(corr, F.lit(0.0))
    rho = F.least(F.greatest(F.avg(corr), F.lit(0.0)), F.lit(0.999))
    k = F.lit(float(entities))
    return pairs.agg(F.avg(corr).alias("mean_corr"), F.greatest(k / (1 + (k - 1) * rho), F.lit(1.0)).alias("by_mean"), (k * k / (k + 2 * F.sum(c * c))).alias("by_eigenvalues"))


def entropy_breadth(pairs: DataFrame, a: str = "a", b: str = "b", corr: str = "corr", names: int = 1024, weights: DataFrame | None = None) -> DataFrame:
    """exp of the entropy of a correlation matrix's eigenvalue shares. The matrix is one task's, 8 bytes for every two names and
    as much for its eigenvalues; pairs are read into it as they come. It begins with room for ``names`` of them.

    With ``weights`` (name, how many names have its series) the pairs are those of distinct series, with themselves too
    (``distinct_correlation``): the matrix of all names has the eigenvalues of theirs, scaled by the roots of both weights, and
    zeros. A series without a correlation with itself has none with its copies, so each of them is a 1.
    """

    def entropy(batches):
        place: dict = {}
        m, met, size, lone = np.zeros((names, names)), np.zeros(names, bool), np.ones(names), np.zeros(names, bool)
        for pdf in batches:
            seen = lambda c: np.fromiter((place.setdefault(x, len(place)) for x in pdf[c].tolist()), int, len(pdf))  # noqa: E731, B023
            i, j = seen(a), seen(b)
            if len(place) > len(m):
                old, k = len(m), 2 * len(place)
                more = np.zeros((k, k))
                more[:old, :old] = m
                m, met, size, lone = more, np.r_[met, np.zeros(k - old, bool)], np.r_[size, np.ones(k - old)], np.r_[lone, np.zeros(k - old, bool)]
            own, w, v = i == j, pdf[["__a", "__b"]].to_numpy(float), pdf[corr].to_numpy(float)
            m[i, j] = m[j, i] = np.nan_to_num(v) * np.sqrt(w[:, 0] * w[:, 1])
            met[i[~own]] = met[j[~own]] = True
            size[i], size[j] = w[:, 0], w[:, 1]
            lone[i[own & np.isnan(v)]] = True
        met |= size > 1
        keep = np.flatnonzero(met)
        if not len(keep):
            return
        lone, size = lone[keep], size[keep]
        if len(keep) < len(m):
            m = m[: keep[-1] + 1, : keep[-1] + 1] if keep[-1] + 1 == len(keep) else m[np.ix_(keep, keep)]
        np.fill_diagonal(m, np.where(lone, 1.0, size))
        p = np.r_[np.clip(np.linalg.eigvalsh(m), 0, None), np.ones(int((size[lone] - 1).sum()))]
        p = p[p > 0] / p.sum()
        yield pd.DataFrame({"entities": [int(size.sum())], "by_entropy": [float(np.exp(-(p * np.log(p)).sum()))]})

    rows = pairs.select(a, b, corr)
    if weights is None:
        rows = rows.withColumns({"__a": F.lit(1.0), "__b": F.lit(1.0)})
    else:  # a row a distinct series
        rows = rows.join(F.broadcast(weights.toDF(a, "__a")), a).join(F.broadcast(weights.toDF(b, "__b")), b)
    return rows.select(a, b, corr, "__a", "__b").repartition(1).mapInPandas(entropy, "entities long, by_entropy double")


def sharpe_difference(df: DataFrame, a: str, b: str, time: str, by: list[str], block: float = 5.0, replicates: int = 499, seed: int = 0, periods: int = 252) -> DataFrame:
    """Annual Sharpe ratios (population deviation + 1e-12) of two series, their difference, its stationary-bootstrap interval and p."""
    kinds = dict(df.dtypes)

    def sharpe(x: np.ndarray) -> float:
        return x.mean() / (x.std() + 1e-12) * math.sqrt(periods)

    def tested(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.sort_values(time)[[a, b]].dropna().to_numpy(float).T
        own = {c: [pdf[c].iloc[0]] for c in by}
        if len(x) < 10:
            return pd.DataFrame(own | {"n": [len(x)]} | {c: [np.nan] for c in ("sharpe_a", "sharpe_b", "delta", "p", "low", "high")})
        rng = np.random.default_rng(seed)
        draws = []
        for _ in range(replicates):
            i = stationary_indices(len(x), block, rng)
            draws.append(sharpe(x[i]) - sharpe(y[i]))
        draws, delta = np.array(draws), sharpe(x) - sharpe(y)
        low, high = np.quantile(draws, [0.025, 0.975])
        return pd.DataFrame(own | {"n": [len(x)], "sharpe_a": [sharpe(x)], "sharpe_b": [sharpe(y)], "delta": [delta], "p": [(abs(draws - draws.mean()) >= abs(delta) - 1e-15).mean()], "low": [low], "high": [high]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long", *(f"{c} double" for c in ("sharpe_a", "sharpe_b", "delta", "p", "low", "high"))])
    return df.select(*by, time, a, b).groupBy(*by).applyInPandas(tested, schema)


def stepwise(df: DataFrame, excess: str, time: str, rival: str, block: float = 5.0, replicates: int = 499, seed: int = 0, level: float = 0.05) -> DataFrame:
    """Romano-Wolf: ``(rival, t, step, critical, p, rejected)`` for excess returns over a benchmark, family-wise at ``level``.

    All rivals are resampled alike, so a replicate is how often it draws each date, and rivals are resampled in parallel;
    what meets in one task is a row of ``replicates`` numbers for each rival. A missing excess counts as 0.
    """
    dates = sorted(r[0] for r in df.select(time).distinct().collect())
    n = len(dates)
    if n < 20:
        raise ValueError("at least 20 dates are needed")
    rng = np.random.default_rng(seed)
    counts = np.stack([np.bincount(stationary_indices(n, block, rng), minlength=n) for _ in range(replicates)]).astype(float)
    held = df.sparkSession.sparkContext.broadcast((pd.Index(dates), counts))
    kind = dict(df.dtypes)[rival]

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        index, c = held.value
        d = np.zeros(n)
        d[index.get_indexer(pdf[time])] = pdf["__x"].fillna(0.0)
        mean, sd = d.mean(), d.std(ddof=1)
        means = c @ d / n
        sds = np.sqrt(np.maximum(c @ (d * d) - n * means * means, 0) / (n - 1))
        boot = np.divide((means - mean) * math.sqrt(n), sds, out=np.zeros(len(means)), where=sds > 0)
        return pd.DataFrame({rival: [pdf[rival].iloc[0]], "t": [mean / (sd / math.sqrt(n)) if sd > 0 else -1e300], "__b": [boot.tolist()]})

    rows = df.groupBy(rival, time).agg(F.avg(excess).cast("double").alias("__x")).groupBy(rival).applyInPandas(resampled, f"{rival} {kind}, t double, __b array<double>")

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", rival], ascending=[False, True]).reset_index(drop=True)
        b = np.array(pdf["__b"].tolist())
        most = np.maximum.accumulate(b[::-1], axis=0)[::-1]  # over a rival and all that come after it
        out, stopped = [], None
        for k in range(len(pdf)):
            at = k if stopped is None else stopped
            critical = np.quantile(most[at], 1 - level)
            if stopped is None and pdf["t"][k] <= critical:
                stopped = k
            out.append((at + 1, critical, float((most[at] >= pdf["t"][k]).mean()), stopped is None))
        step, critical, p, rejected = zip(*out, strict=True)
        return pd.DataFrame({rival: pdf[rival], "t": pdf["t"], "step": step, "critical": critical, "p": p, "rejected": rejected})

    return rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(steps, f"{rival} {kind}, t double, step long, critical double, p double, rejected boolean")


def style(df: DataFrame, y: str, factors: list[str], by: list[str]) -> DataFrame:
    """``(by, loadings, r2)``: least squares on factors with loadings of 0 or more that add up to 1."""
    kinds, k = dict(df.dtypes), len(factors)

    def nearest(v: np.ndarray) -> np.ndarray:
        u = np.sort(v)[::-1]
        css = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
        return np.maximum(v - css[np.flatnonzero(u > css)[-1]], 0)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[[y, *factors]].dropna().to_numpy(float)
        own = {c: [pdf[c].iloc[0]] for c in by}
        if len(v) < k + 1:
            return pd.DataFrame(own | {"n": [len(v)], "loadings": [None], "r2": [np.nan]})
        r, f = v[:, 0], v[:, 1:]
        xx, xy = f.T @ f, f.T @ r
        step, c = 1 / max(np.linalg.eigvalsh(xx)[-1], 1e-18), np.full(k, 1 / k)
        ahead, speed = c.copy(), 1.0
        for _ in range(20_000):  # projected gradients with momentum
            new = nearest(ahead - step * (xx @ ahead - xy))
            quick = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
            ahead = new + (speed - 1) / quick * (new - c)
            done = np.abs(new - c).max() < 1e-13
            c, speed = new, quick
            if done:
                break
        rest, total = r - f @ c, ((r - r.mean()) ** 2).sum()
        return pd.DataFrame(own | {"n": [len(v)], "loadings": [c.tolist()], "r2": [float(np.clip(1 - rest @ rest / total, 0, 1)) if total > 1e-18 else 0.0]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long", "loadings array<double>", "r2 double"])
    return df.select(*by, y, *factors).groupBy(*by).applyInPandas(fitted, schema)


def chi_square_quantile(q: float, freedom: float) -> float:
    """By bisection on the regularised incomplete gamma function."""

    def below(x: float) -> float:
        a, x = freedom / 2, x / 2
        if x <= 0:
            return 0.0
        front = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            k = a
            while term > total * 1e-16:
                k += 1
                term *= x / k
                total += term
            return front * total
        b, c = x + 1 - a, 1e300
        d = 1 / b
        out = d
        for i in range(1, 10_000):
            top = -i * (i - a)
            b += 2
            d, c = 1 / (top * d + b), b + top / c
            out *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return 1 - front * out

    if not 0 < q < 1 or freedom < 1:
        raise ValueError("a share between 0 and 1 and at least one degree of freedom are needed")
    low, high = 0.0, max(freedom, 1.0)
    while below(high) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < q else (low, mid)
    return (low + high) / 2


def chi_square_regime(turbulence: Column, columns: int, q: float = 0.75) -> Column:
    """Whether turbulence lies above the chi-square quantile; missing turbulence doesn't."""
    return F.coalesce(turbulence > chi_square_quantile(q, columns), F.lit(False))


def residual_step(gross: Column, costs: Column, exposures: Column, factors: Column, borrow: Column | float = 0.0, rf: Column | float = 0.0) -> Column:
    """Gross less costs, borrow, the riskless rate once, and yesterday's exposures on today's factor returns (arrays)."""
    product = F.aggregate(F.zip_with(exposures, factors, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return gross - costs - (F.lit(borrow) if isinstance(borrow, float) else borrow) - (F.lit(rf) if isinstance(rf, float) else rf) - product
