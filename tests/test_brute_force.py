"""Operators that SQL can't express, against plain loops of the same definition on small fixtures."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.functions import scalars as K
from lodestar.functions import text as T
from lodestar.operators import baselines as L
from lodestar.operators import experts as X
from lodestar.operators import inference as I
from lodestar.operators import sequential as G
from lodestar.operators import statistics as Z
from lodestar.operators import universe as N


def day(k: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def wide():
    """Returns of 80 dates by 5 entities, some missing."""
    rng = np.random.default_rng(7)
    m = rng.normal(0.0005, 0.02, (80, 5)) + rng.normal(0, 0.01, (80, 1))
    m[rng.random(m.shape) < 0.04] = np.nan
    return m


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(e, day(t), None if np.isnan(wide[t, e]) else float(wide[t, e])) for t in range(80) for e in range(5)]
    return spark.createDataFrame(rows, "entity int, dt date, r double")


def matrix(df, column, index="dt", columns="entity"):
    return df.toPandas().pivot_table(index=index, columns=columns, values=column, dropna=False).sort_index().sort_index(axis=1).to_numpy(float)


# windows


def test_moments_survive_an_outlier(spark):
    """One tick of a billion doesn't spoil the digits of the windows after it."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, 90)
    x[5] = 1e9
    df = spark.createDataFrame([(0, day(k), float(v)) for k, v in enumerate(x)], "entity int, dt date, r double")
    out = R.trailing(df, {"sd": R.Feature("sd", "r", 20, 20), "skew": R.Feature("skew", "r", 20, 20), "kurt": R.Feature("kurt", "r", 20, 20)}, ["r"]).withColumn("sd2", R.gated(F.col("r"), 20, lambda t: t.sd())).toPandas().sort_values("dt")
    for t in range(30, 90):
        w = x[t - 19 : t + 1]
        d, s = w - w.mean(), w.std(ddof=1)
        assert out.sd.iloc[t] == pytest.approx(s, rel=1e-12) and out.sd2.iloc[t] == pytest.approx(s, rel=1e-9)
        assert out["skew"].iloc[t] == pytest.approx((d**3).mean() / s**3, rel=1e-9) and out["kurt"].iloc[t] == pytest.approx((d**4).mean() / s**4, rel=1e-9)


def test_features_against_pandas(spark, panel, wide):
    df = panel.withColumn("m", F.avg("r").over(R.PANEL.section))
    made = R.trailing(df, {"hv": R.Feature("sd", "r", 10, 5), "z": R.Feature("z", "r", 12, 4, ddof=0, full=False), "b": R.Feature("beta", "r", 15, 6, "m", full=False), "past": R.Feature("sd", "r", 9, 3, ddof=0, full=False, shift=1)})
    frame = pd.DataFrame(wide)
    mk = frame.mean(axis=1)
    full = np.repeat(np.arange(80)[:, None] >= 9, 5, axis=1)
    np.testing.assert_allclose(matrix(made, "hv"), frame.rolling(10, min_periods=5).std().where(full), atol=1e-12)
    z = (frame - frame.rolling(12, min_periods=4).mean()) / frame.rolling(12, min_periods=4).std(ddof=0)
    np.testing.assert_allclose(matrix(made, "z"), z, atol=1e-9)
    np.testing.assert_allclose(matrix(made, "past"), frame.shift(1).rolling(9, min_periods=3).std(ddof=0), atol=1e-12)
    for e in range(5):
        both = pd.DataFrame({"x": frame[e], "y": mk.where(frame[e].notna())})
        beta = both.x.rolling(15, min_periods=6).cov(both.y) / both.y.rolling(15, min_periods=6).var()
        np.testing.assert_allclose(matrix(made, "b")[:, e], beta, atol=1e-9)


def test_expanding_quantile(spark, panel, wide):
    got = matrix(R.expanding_quantile(panel, "r", 0.9), "threshold")
    for t in range(80):
        np.testing.assert_allclose(got[t], [np.quantile(c[~np.isnan(c)], 0.9) if (~np.isnan(c)).any() else np.nan for c in wide[: t + 1].T], atol=1e-12)


def test_tail_asymmetry(spark, panel, wide):
    made = R.tail_asymmetry(panel.withColumn("m", F.avg("r").over(R.PANEL.section)), "r", "m", 30, 0.8, 8)
    got, mk = matrix(made, "tail_asymmetry"), np.nanmean(wide, axis=1)
    for t in range(29, 80):
        for e in range(5):
            y, m = wide[t - 29 : t + 1, e], mk[t - 29 : t + 1]
            ok = np.isfinite(y)
            u, v = ((np.argsort(np.argsort(a[ok], kind="stable"), kind="stable") + 1) / (ok.sum() + 1) for a in (y, m))
            up, low = u > 0.8, u < 1 - 0.8
            expected = (up & (v > 0.8)).sum() / up.sum() - (low & (v < 1 - 0.8)).sum() / low.sum()
            assert got[t, e] == pytest.approx(expected)


def test_residual_momentum(spark, panel, wide):
    df = panel.withColumns({"f1": F.avg("r").over(R.PANEL.section), "f2": F.sin(F.dayofyear("dt") * 0.7)})
    got = matrix(G.rolling_regression(df, "r", ["f1", "f2"], 30, 5), "residual_momentum")
    f = np.column_stack([np.nanmean(wide, axis=1), np.sin(np.array([day(t).timetuple().tm_yday for t in range(80)]) * 0.7)])
    assert np.isnan(got[:29]).all()
    for t in range(29, 80):
        for e in range(5):
            part = np.column_stack([wide[:, e], f])[t - 29 : t + 1]
            part = part[np.isfinite(part).all(1)]
            a = np.column_stack([np.ones(len(part)), part[:, 1:]])
            rest = part[:, 0] - a @ np.linalg.lstsq(a, part[:, 0], rcond=None)[0]
            assert got[t, e] == pytest.approx(rest[:-5].sum(), abs=1e-9)


# statistics


def test_deflated_sharpe(spark, panel, wide):
    rows = {r.entity: r for r in Z.deflated_sharpe(panel, "r", "entity").collect()}
    series = [pd.Series(c).dropna() for c in wide.T]
    sr = [s.mean() / (s.std(ddof=0) + 1e-12) for s in series]
    n01, k = NormalDist(), len(sr)
    bar = math.sqrt(np.var(sr)) * ((1 - np.euler_gamma) * n01.inv_cdf(1 - 1 / k) + np.euler_gamma * n01.inv_cdf(1 - 1 / (k * math.e)))
    for e, s in enumerate(series):
        skew, kurt = s.skew(), s.kurt() + 3
        z = (sr[e] - bar) * math.sqrt(len(s) - 1) / math.sqrt(1 - skew * sr[e] + (kurt - 1) / 4 * sr[e] ** 2)
        assert rows[e].sr == pytest.approx(sr[e]) and rows[e].skew == pytest.approx(skew) and rows[e].kurt == pytest.approx(kurt) and rows[e].dsr == pytest.approx(n01.cdf(z))


def test_greeks(spark):
    cases = [(100.0, 90.0, 0.5, 0.2, True), (100.0, 110.0, 1.0, 0.4, False), (50.0, 50.0, 0.1, 0.1, True), (50.0, 0.0, 0.1, 0.1, True)]
    df = spark.createDataFrame(cases, "s double, k double, y double, v double, c boolean")
    made = K.greeks(F.col("s"), F.col("k"), F.col("y"), F.col("v"), 0.03, F.col("c"))
    rows = df.select(*df.columns, *(c.alias(n) for n, c in made.items())).collect()
    n01 = NormalDist()
    price = lambda s, k, y, v, r, c: (lambda d1, d2: s * n01.cdf(d1) - k * math.exp(-r * y) * n01.cdf(d2) if c else k * math.exp(-r * y) * n01.cdf(-d2) - s * n01.cdf(-d1))((math.log(s / k) + (r + v * v / 2) * y) / (v * math.sqrt(y)), (math.log(s / k) + (r - v * v / 2) * y) / (v * math.sqrt(y)))
    for r in rows[:3]:
        at, h = (r.s, r.k, r.y, r.v, 0.03, r.c), 1e-3
        assert r.price == pytest.approx(price(*at), abs=1e-4)
        assert r.delta == pytest.approx((price(r.s + h, *at[1:]) - price(r.s - h, *at[1:])) / (2 * h), abs=1e-4)
        assert r.gamma == pytest.approx((price(r.s + h, *at[1:]) - 2 * price(*at) + price(r.s - h, *at[1:])) / h**2, abs=1e-3)
        assert r.vega == pytest.approx((price(r.s, r.k, r.y, r.v + 1e-5, 0.03, r.c) - price(r.s, r.k, r.y, r.v - 1e-5, 0.03, r.c)) / 2e-5, rel=1e-3)
        assert r.theta == pytest.approx(-(price(r.s, r.k, r.y + 1e-5, r.v, 0.03, r.c) - price(r.s, r.k, r.y - 1e-5, r.v, 0.03, r.c)) / 2e-5, rel=1e-3)
    assert rows[3].price is None


def test_student_and_chi_square():
    for t, freedom in ((0.5, 3), (2.1, 12), (4.0, 200)):  # by integrating the density
        x = np.linspace(-t, t, 200_001)
        density = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi) * (1 + x * x / freedom) ** (-(freedom + 1) / 2)
        assert I.student_p(t, freedom) == pytest.approx(1 - np.trapezoid(density, x), abs=1e-8)
    for q, k in ((0.75, 4), (0.95, 30)):
        x = np.linspace(0, I.chi_square_quantile(q, k), 400_001)[1:]
        assert np.trapezoid(np.exp((k / 2 - 1) * np.log(x) - x / 2 - k / 2 * math.log(2) - math.lgamma(k / 2)), x) == pytest.approx(q, abs=1e-5)


def test_newey_west_with_several_factors(spark, panel, wide):
    df = panel.withColumns({"f1": F.avg("r").over(R.PANEL.section), "f2": F.sin(F.dayofyear("dt") * 0.7)})
    rows = {(r.entity, r.term): r for r in I.newey_west(df, "r", ["f1", "f2"], "dt", ["entity"], 4).collect()}
    f1, f2 = np.nanmean(wide, axis=1), np.sin(np.array([day(t).timetuple().tm_yday for t in range(80)]) * 0.7)
    for e in range(5):
        ok = np.isfinite(wide[:, e])
        a, y = np.column_stack([np.ones(80), f1, f2])[ok], wide[ok, e]
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        u = a * (y - a @ beta)[:, None]
        s = u.T @ u
        for j in range(1, 5):
            g = u[j:].T @ u[:-j]
            s += (1 - j / 5) * (g + g.T)
        se = np.sqrt(np.diag(np.linalg.inv(a.T @ a) @ s @ np.linalg.inv(a.T @ a)))
        for k, term in enumerate(("intercept", "f1", "f2")):
            assert rows[e, term].coef == pytest.approx(beta[k], rel=1e-6) and rows[e, term].se == pytest.approx(se[k], rel=1e-6)


def test_signal_gate_controls_false_discoveries(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(60):
        good, noise = rng.normal(size=20), rng.normal(size=(4, 20))
        y = 0.5 * good + rng.normal(size=20)
        rows += [(e, day(t), float(y[e]), float(good[e]), *map(float, noise[:, e]), None) for e in range(20)]
    df = spark.createDataFrame(rows, "entity int, dt date, y double, good double, n0 double, n1 double, n2 double, n3 double, nothing double")
    names = ["good", "n0", "n1", "n2", "n3", "nothing"]
    got = {r.signal: r for r in I.signal_gate(df, names, "y", "2021-01-01").collect()}
    scored = [got[n] for n in names[:5]]
    p = sorted(r.p for r in scored)
    cut = max((k for k in range(5) if p[k] <= 0.05 * (k + 1) / 5), default=-1)
    assert {r.signal for r in scored if r.admitted} == {r.signal for r in scored if cut >= 0 and r.p <= p[cut]} and got["good"].admitted
    assert got["nothing"].status == "unscored" and not got["nothing"].admitted
    assert all(r.p == pytest.approx(I.student_p(r.t_hac, r.n_dates - 1)) for r in scored)
    with pytest.raises(ValueError):
        I.signal_gate(df, names, "y", "2020-01-15")


def test_stepwise(spark):
    rng = np.random.default_rng(3)
    x = {"strong": rng.normal(0.6, 1, 100), "weak": rng.normal(0.1, 1, 100), "none": rng.normal(0, 1, 100)}
    df = spark.createDataFrame([(n, day(t), float(v[t])) for n, v in x.items() for t in range(100)], "rival string, dt date, x double")
    got = {r.rival: r for r in I.stepwise(df, "x", "dt", "rival", replicates=99, seed=5).collect()}
    rng = np.random.default_rng(5)
    draws = [Z.stationary_indices(100, 5.0, rng) for _ in range(99)]
    boot = {n: np.array([(v[i].mean() - v.mean()) / (v[i].std(ddof=1) / 10) for i in draws]) for n, v in x.items()}
    t = {n: v.mean() / (v.std(ddof=1) / 10) for n, v in x.items()}
    left, step = sorted(x, key=lambda n: -t[n]), 0
    while left:
        step += 1
        most = np.max([boot[n] for n in left], axis=0)
        critical = np.quantile(most, 0.95)
        done = t[left[0]] <= critical
        for n in left if done else left[:1]:
            r = got[n]
            assert r.t == pytest.approx(t[n]) and r.critical == pytest.approx(critical) and r.step == step and r.p == pytest.approx((most >= t[n]).mean()) and r.rejected == (not done)
        left = [] if done else left[1:]
    assert got["strong"].rejected


def test_sharpe_difference(spark, panel, wide):
    df = panel.withColumn("m", F.avg("r").over(R.PANEL.section))
    r = I.sharpe_difference(df.where("entity = 2"), "r", "m", "dt", ["entity"], replicates=50, seed=9).first()
    ok = np.isfinite(wide[:, 2])
    a, b = wide[ok, 2], np.nanmean(wide, axis=1)[ok]
    sharpe = lambda v: v.mean() / (v.std() + 1e-12) * math.sqrt(252)
    rng = np.random.default_rng(9)
    draws = np.array([sharpe(a[i]) - sharpe(b[i]) for i in (Z.stationary_indices(len(a), 5.0, rng) for _ in range(50))])
    delta = sharpe(a) - sharpe(b)
    assert r.delta == pytest.approx(delta) and r.p == pytest.approx((abs(draws - draws.mean()) >= abs(delta) - 1e-15).mean()) and r.low == pytest.approx(np.quantile(draws, 0.025))


def test_style_is_the_best_mix(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(60, 3))
    y = 0.7 * f[:, 0] + 0.3 * f[:, 2] - 0.2 * f[:, 1] + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("a", float(y[t]), *map(float, f[t])) for t in range(60)], "k string, y double, f0 double, f1 double, f2 double")
    r = I.style(df, "y", ["f0", "f1", "f2"], ["k"]).first()
    grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 201) for b in np.linspace(0, 1 - a, 201)]
    best = min(grid, key=lambda c: ((y - f @ c) ** 2).sum())
    np.testing.assert_allclose(r.loadings, best, atol=0.01)
    assert sum(r.loadings) == pytest.approx(1) and min(r.loadings) >= 0


def test_breadth(spark, panel, wide):
    c = pd.DataFrame(wide).corr().to_numpy()
    pairs = Z.pairwise_correlation(panel, "r", "dt", "entity")
    r, e = I.breadth(pairs, 5).first(), I.entropy_breadth(pairs).first()
    lam = np.linalg.eigvalsh(c)
    rho = c[np.triu_indices(5, 1)].mean()
    p = lam / lam.sum()
    assert r.by_eigenvalues == pytest.approx(lam.sum() ** 2 / (lam**2).sum()) and r.by_mean == pytest.approx(5 / (1 + 4 * max(rho, 0))) and e.by_entropy == pytest.approx(math.exp(-(p * np.log(p)).sum()))


# weights


def test_online_portfolios(spark, panel, wide):
    x = 1 + np.nan_to_num(wide)
    shares = lambda v: np.maximum(v, 0) / np.maximum(v, 0).sum()
    for method in ("eg", "pamr", "olmar"):
        got, w = matrix(G.online_portfolio(panel, "r", method=method), "weight"), np.full(5, 0.2)
        for t in range(80):
            np.testing.assert_allclose(got[t], w, atol=1e-9)
            if method == "eg":
                w = shares(w * np.exp(0.05 * x[t] / (w @ x[t])))
            elif method == "pamr":
                d = x[t] - x[t].mean()
                w = shares(w - max(0, w @ x[t] - 0.5) / (d @ d + 1 / 1000) * d)
            else:
                a = x[max(0, t - 4) : t + 1].mean(0)
                d = a - a.mean()
                w = shares(w + max(0, 10 - w @ a) / (d @ d) * d) if d @ d >= 1e-12 else w


def test_universal_portfolio(spark, panel, wide):
    got, x = matrix(G.online_portfolio(panel, "r", method="universal", samples=200, seed=3), "weight"), 1 + np.nan_to_num(wide)
    mixes = np.random.default_rng(3).dirichlet(np.ones(5), size=200)
    for t in (0, 1, 40, 79):
        wealth = np.prod(mixes @ x[:t].T, axis=1) if t else np.ones(200)
        np.testing.assert_allclose(got[t], wealth @ mixes / wealth.sum() if t else 0.2, atol=1e-9)


def test_minimum_variance_of_two(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, [0.01, 0.03], (100, 2))
    df = spark.createDataFrame([(e, day(t), float(v[t, e])) for t in range(100) for e in range(2)], "entity int, dt date, r double")
    w = {r.entity: r.weight for r in G.optimised(df, "r", spark.createDataFrame([(day(100),)], "dt date"), least=20).collect()}
    cov = np.cov(v, rowvar=False)
    cov = 0.9 * cov + 0.1 * np.eye(2) * np.trace(cov) / 2
    first = (cov[1, 1] - cov[0, 1]) / (cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    assert w[0] == pytest.approx(first) and w[1] == pytest.approx(1 - first)


def test_capped_path(spark):
    rng = np.random.default_rng(4)
    want = rng.normal(size=(12, 3))
    df = spark.createDataFrame([(e, day(t), float(want[t, e])) for t in range(12) for e in range(3)], "entity int, dt date, weight double")
    got, held = matrix(L.capped_path(df, 0.5), "weight"), np.zeros(3)
    for t in range(12):
        d = want[t] - held
        held = held + d * min(1, 0.5 / abs(d).sum())
        np.testing.assert_allclose(got[t], held, atol=1e-12)


def test_garch_timing(spark):
    rng = np.random.default_rng(5)
    iv = 0.2 + rng.normal(0, 0.02, (30, 3))
    df = spark.createDataFrame([(e, day(t), float(iv[t, e])) for t in range(30) for e in range(3)], "entity int, dt date, iv double")
    got = matrix(L.option_baseline(df, "garch_vol_timing", delta=None, history=12), "weight")
    for t in range(11, 30):
        raw = []
        for e in range(3):
            s = iv[t - 11 : t + 1, e]
            c = np.diff(s, prepend=s[0])
            h = np.var(c) + 1e-8
            for v in c[:-1]:
                h = max(1e-6 + 0.08 * v * v + 0.9 * h, 1e-12)
            raw.append(-math.tanh((s[-1] - (s.mean() + math.sqrt(h))) * 10) / 3)
        np.testing.assert_allclose(got[t], np.array(raw) / (np.abs(raw).sum() + 1e-12), atol=1e-9)
    with pytest.raises(KeyError):
        L.option_baseline(df, "timed_long_gamma")


def test_ridge_of_two_signals(spark):
    rng = np.random.default_rng(6)
    s, r = rng.normal(size=(20, 4, 2)), rng.normal(size=(20, 4))
    df = spark.createDataFrame([(e, day(t), float(r[t, e]), *map(float, s[t, e])) for t in range(20) for e in range(4)], "entity int, dt date, r double, a double, b double")
    got = matrix(L.ridge_composite(df, ["a", "b"], "r", l2=0.5), "weight")
    for t in (0, 1, 2, 3, 10, 19):
        score = np.zeros(4)
        if t >= 2:
            x = np.concatenate([np.column_stack([np.ones(4), s[k]]) for k in range(t - 1)])
            y = np.concatenate([r[k + 1] for k in range(t - 1)])
            c = np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y)
            score = c[0] + s[t - 1] @ c[1:]
        np.testing.assert_allclose(got[t], np.exp(score) / np.exp(score).sum(), atol=1e-9)


# experts


@pytest.fixture(scope="module")
def losses(spark):
    x = np.random.default_rng(8).random((25, 3))
    return x, spark.createDataFrame([("abc"[e], day(t), float(x[t, e])) for t in range(25) for e in range(3)], "expert string, dt date, loss double")


def _share(w, alpha):
    return (1 - alpha) * w + alpha * (w.sum() - w) / (len(w) - 1)


@pytest.mark.parametrize("method", ["hedge", "fixed_share", "variable_share", "boa", "page_hinkley", "adahedge", "flip_flop"])
def test_mixers(spark, losses, method):
    x, df = losses
    names = ["a", "b", "c"]
    made = X.flip_flop(df, "loss", "dt", "expert", names) if method == "flip_flop" else Z.mix_experts(df, "loss", "dt", "expert", names, method)
    got, w, gap, held, drift = matrix(made, "weight", columns="expert"), np.full(3, 1 / 3), 0.0, 0, 0.0
    for t in range(25):
        total = x[:t].sum(0)
        leaders = (total <= total.min() + 1e-15) / (total <= total.min() + 1e-15).sum()
        ada = leaders if gap <= 0 else np.exp(-math.log(3) / gap * (total - total.min())) / np.exp(-math.log(3) / gap * (total - total.min())).sum()
        expected = {"adahedge": ada, "flip_flop": (ada + leaders) / 2, "page_hinkley": np.eye(3)[held] if t else np.full(3, 1 / 3)}.get(method, w)
        np.testing.assert_allclose(got[t], expected, atol=1e-9)
        eta = math.log(3) / gap if gap > 0 else math.inf
        gap += max(0, ada @ x[t] - (x[t][ada > 0].min() if eta == math.inf else -math.log(ada @ np.exp(-eta * x[t])) / eta))
        if t:
            drift = max(0, drift + x[t, held] - x[t].mean() - 1e-4)
            if drift > 0.02:
                order = np.argsort(x[: t + 1].sum(0))
                held, drift = int(order[0] if order[0] != held else order[1]), 0.0
        if method == "boa":
            w = w * np.exp(-0.5 * x[t] * (1 + 0.5 * x[t]))
        else:
            w = w * np.exp(-0.5 * x[t])
            if method == "fixed_share":
                w = _share(w / w.sum(), 0.05)
            elif method == "variable_share":
                w = w / w.sum()
                keep = 0.95 ** x[t]
                w = keep * w + (((1 - keep) * w).sum() - (1 - keep) * w) / 2
        w = w / w.sum()


def test_best_path_against_every_path(spark, losses):
    x, df = losses
    few = df.where(F.col("dt") < F.lit(day(7)))
    for k in (0, 1, 2, 6):
        got = matrix(X.best_path(few, "loss", "dt", "expert", ["a", "b", "c"], k), "weight", columns="expert")
        paths = [p for p in itertools.product(range(3), repeat=7) if sum(a != b for a, b in itertools.pairwise(p)) <= k]
        best = min(sum(x[t, i] for t, i in enumerate(p)) for p in paths)
        assert (got.sum(1) == 1).all() and (got * x[:7]).sum() == pytest.approx(best)
        assert (np.abs(np.diff(got.argmax(1))) > 0).sum() <= k


def test_hysteresis_and_sleeping(spark):
    r = np.random.default_rng(9).normal(0.001, 0.02, (40, 3))
    df = spark.createDataFrame([("abc"[e], day(t), float(r[t, e]), t % 4 == 0) for t in range(40) for e in range(3)], "expert string, dt date, r double, hot boolean")
    got = matrix(X.hysteresis(df, "r", "dt", "expert", ["a", "b", "c"], "b", 10, 0.5, 5), "weight", columns="expert")
    held = 1
    for t in range(40):
        if t < 10:
            np.testing.assert_allclose(got[t], 1 / 3)
            continue
        w = r[t - 10 : t]
        s = w.mean(0) / w.std(0, ddof=1) * math.sqrt(252)
        if held != 1:
            held = 1 if s[held] < s[1] else held
        else:
            best = max((0, 2), key=lambda j: s[j])
            held = best if s[best] > s[1] + 0.5 else 1
        assert got[t].argmax() == held and got[t].max() == 1
    got = matrix(X.sleeping_share(df, "r", "hot", "dt", "expert", ["a", "b", "c"]), "weight", columns="expert")
    ell = -np.log(1 + r)
    w = np.full(6, 1 / 6)
    for t in range(40):
        np.testing.assert_allclose(got[t], w[:3] + w[3:], atol=1e-9)
        past = ell[:t]
        span = past.max() - past.min() if t else 0
        x = np.tile(np.clip((ell[t] - past.min()) / span, 0, 1) if span > 0 else np.full(3, 0.5), 2)
        awake = [i for i in range(6) if t == 0 or (i >= 3) == ((t - 1) % 4 == 0)]
        own = {i: w[i] * math.exp(-0.5 * x[i]) for i in awake}
        pool = sum((1 - 0.95 ** x[i]) * own[i] for i in awake)
        for i in awake:
            w[i] = 0.95 ** x[i] * own[i] + (pool - (1 - 0.95 ** x[i]) * own[i]) / (len(awake) - 1)
        w = w / w.sum()


# universes


def test_average_linkage_by_definition():
    rng = np.random.default_rng(1)
    for n, k in ((2, 1), (7, 3), (12, 4), (12, 12)):
        d = rng.random((n, n))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        groups = [[i] for i in range(n)]
        while len(groups) > k:
            a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: np.mean([d[i, j] for i in groups[p[0]] for j in groups[p[1]]]))
            groups[a] += groups.pop(b)
        label = N.average_linkage(d, k)
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in range(k)} == {frozenset(g) for g in groups}


def test_quotas_trim_repair_and_packing():
    scores = pd.DataFrame({"trend": [2, 1, 0, 0, 0.6, 0], "reversal": 0.0, "carry": 0.0, "defensive": 0.0, "lottery": [0, 0, 3, 2, 0, 0], "illiquid": [0, 0, 0, 0, 0, 1.0], "within_rank": [1, 2, 3, 4, 5, 6.0]}, index=list("abcdef"))
    primary, members, short = N.fill_quotas(scores, {"lottery": 1, "trend": 2, "core": 1, "illiquid": 2}, {"a": 1, "b": 1, "c": 2, "d": 2, "e": 3, "f": 4}, 1)
    assert primary == {"f": "illiquid", "c": "lottery", "a": "trend", "e": "trend"} and short["illiquid"] == 1 and short["core"] == 1 and members["trend"] == ["a", "e"]
    rng = np.random.default_rng(0)
    residual = pd.DataFrame(rng.normal(0, [1, 1, 5, 4, 1, 1], (50, 6)), columns=list("abcdef"))
    trimmed = N.trim_lottery({"a": "core", "c": "lottery", "d": "lottery", "e": "trend"}, residual, 0.3, ["b", "f"])
    assert "c" not in trimmed and trimmed["b"] == "core" and N.variance_share(list(trimmed), [n for n, s in trimmed.items() if s == "lottery"], residual) <= 0.3
    out, rounds = N.repair({"a": "core", "b": "trend"}, {"a": 1.0, "b": 2.0}, ["c", "d"], lambda p: "d" in p, {"b": 1, "c": 1, "d": 2}, 1)
    assert out == {"b": "trend", "d": "core"} and rounds == 1
    assert N.capped_change([1, 2, 3, 4], [3, 4, 5, 6], 0.25, {6: 2.0, 5: 1.0, 1: 3.0}) == [3, 4, 6, 1]
    assert N.capped_change([], [3, 1], 0.1) == [3, 1] and N.packed({"x": 2, "y": 1, "z": 2}, ["z", "x", "y"]) == [("y", 0), ("x", 1), ("z", 1)]
    value, ok = N.transfer_coefficient(np.array([1.0, 2.0, 4.0]), lambda w: w / 2)
    assert value == pytest.approx(1) and ok and N.transfer_coefficient(np.ones(3), lambda w: w)[0] == 0


def test_selectors_choose_for_each_rebalance(spark, panel, wide):
    when = spark.createDataFrame([(day(60),), (day(75),)], "dt date")
    for name in N.SELECTORS:
        rows = N.select_by(panel, "r", when, name, k=2, least=10).toPandas()
        assert rows.groupby("rebalance").entity.nunique().tolist() == [2, 2]
    v = wide[:60]
    assert sorted(N.select_by(panel, "r", when, "clusters", k=2, least=10).where(F.col("rebalance") == F.lit(day(60))).toPandas().entity) == N.central_members(v, 2)
    assert N.select_by(panel, "r", when, "clusters", least=1000).count() == 0


def test_diverse_universe(spark, panel, wide):
    got = G.spread_out(panel, "r", spark.createDataFrame([(day(79),)], "dt date"), k=3, least=10).toPandas().sort_values("slot").entity.tolist()
    v = wide[:79]
    corr = np.corrcoef(np.nan_to_num(v), rowvar=False)
    chosen = [int(np.isfinite(v).sum(0).argmax())]
    while len(chosen) < 3:
        chosen.append(min((i for i in range(5) if i not in chosen), key=lambda i: max(corr[i, j] for j in chosen)))
    assert got == chosen


def test_text_vectors(spark):
    texts = ["a a b", "b c", "a d", None]
    rows = T.tfidf(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", 1 << 16).orderBy("i").collect()
    weight = lambda n: math.log((4 + 1) / (n + 1))
    assert sorted(rows[0].tfidf.values.tolist()) == pytest.approx(sorted([2 * weight(2), weight(2)]))
    assert sorted(x for x in rows[1].tfidf.values.tolist() if x) == pytest.approx([weight(2)]) and not any(rows[3].tfidf.values.tolist()[1:])
