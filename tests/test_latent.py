"""Latent states and factors, compositions and whole universes."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import latent as A
from lodestar.operators import universe as N


def day(k: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def test_two_states_are_found():
    rng = np.random.default_rng(0)
    state, x = 0, []
    states = []
    for _ in range(3000):
        state = state if rng.random() > 0.03 else 1 - state
        states.append(state)
        x.append(rng.normal(0.1, 0.5) if state == 0 else rng.normal(-0.2, 2.0))
    _, moves, mean, var = A.fit_two_states(np.array(x))
    np.testing.assert_allclose(np.sqrt(var), [0.5, 2.0], rtol=0.1)
    np.testing.assert_allclose(moves, [[0.97, 0.03], [0.03, 0.97]], atol=0.02)
    np.testing.assert_allclose(mean, [0.1, -0.2], atol=0.15)


def test_filter_uses_the_past_only(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(0, 4, 60), rng.normal(0, 1, 40)])
    frame = lambda v: spark.createDataFrame([(0, day(t), float(a)) for t, a in enumerate(v)], "k int, dt date, x double")
    got = A.state_filter(frame(x), "x", "dt", "k", 100, 10).toPandas().sort_values("dt").probability.to_numpy(float)
    start, moves, mean, var = A.fit_two_states(x[:100])
    now = None
    for t in range(110):
        density = np.exp(-((x[t] - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var)
        now = (start if now is None else now @ moves) * density
        now = now / now.sum()
        if t >= 100:
            assert got[t] == pytest.approx(now[1], abs=1e-9)
    assert np.isnan(got[:100]).all() and got[160:205].mean() > 0.8
    later = x.copy()
    later[200:] = 9.0
    again = A.state_filter(frame(later), "x", "dt", "k", 100, 10).toPandas().sort_values("dt").probability.to_numpy(float)
    np.testing.assert_array_equal(got[:200], again[:200])


def test_characteristic_factors(spark):
    rng = np.random.default_rng(2)
    g = np.linalg.qr(rng.normal(size=(3, 2)))[0]
    f = rng.normal(0.3, [2.0, 0.5], (60, 2))
    rows = []
    for t in range(60):
        z = rng.normal(size=(30, 3))
        r = z @ g @ f[t] + rng.normal(0, 0.01, 30)
        rows += [(e, day(t), float(r[e]), *map(float, z[e])) for e in range(30)]
    df = spark.createDataFrame(rows, "entity int, dt date, r double, a double, b double, c double")
    loadings, factors = A.characteristic_factors(df, "r", ["a", "b", "c"], 2)
    np.testing.assert_allclose(loadings @ loadings.T, g @ g.T, atol=1e-2)
    np.testing.assert_allclose(loadings.T @ loadings, np.eye(2), atol=1e-9)
    left = A.characteristic_residuals(df, "r", ["a", "b", "c"], loadings, factors).agg(F.stddev("residual")).first()[0]
    assert left < 0.02


def test_implied_volatility_inverts_the_formula(spark):
    n = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    rows = []
    for s, k, y, v, call in [(100, 90, 0.5, 0.2, True), (100, 120, 1.0, 0.6, False), (50, 50, 0.1, 0.05, True)]:
        d1 = (math.log(s / k) + (0.01 + v * v / 2) * y) / (v * math.sqrt(y))
        c = s * n(d1) - k * math.exp(-0.01 * y) * n(d1 - v * math.sqrt(y))
        rows.append((c if call else c - s + k * math.exp(-0.01 * y), float(s), float(k), y, 0.01, call, v))
    rows.append((200.0, 100.0, 90.0, 0.5, 0.01, True, None))
    df = spark.createDataFrame(rows, "p double, s double, k double, y double, r double, c boolean, v double")
    assert "implied_volatility" in A.register_functions(spark)
    df.createOrReplaceTempView("quotes_of_a_test")
    got = spark.sql("SELECT v, implied_volatility(p, s, k, y, r, c) AS iv FROM quotes_of_a_test").collect()
    assert all(r.iv == pytest.approx(r.v, abs=1e-7) for r in got[:3]) and (got[3].iv is None or math.isnan(got[3].iv))
    assert spark.sql("SELECT student_p(2.0D, 11L)").first()[0] == pytest.approx(0.0733880348, abs=1e-8)


def test_soft_composition(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in np.concatenate([rng.normal(-4, 1, (40, 2)), rng.normal(4, 1, (40, 2))])] + [(None, 4.0)]
    out = A.soft_composition(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 2).collect()
    c = np.array([r.composition for r in out])
    np.testing.assert_allclose(c.sum(1), 1)
    assert len(set(c[:40].argmax(1))) == 1 and len(set(c[40:80].argmax(1))) == 1 and c[0].argmax() != c[79].argmax()


def test_universe_of_a_date(spark):
    rng = np.random.default_rng(4)
    rows = []
    for t in range(120):
        mk = rng.normal(0, 0.01)
        for e in range(24):
            rows.append((e, day(t), float(mk + rng.normal(0, 0.02)), mk, float(1 + e % 3), 1e6 * (1 + e), float(rng.random()), 0.2, 0.25, 0.01 * e))
    df = spark.createDataFrame(rows, "entity int, dt date, r double, mk double, beta double, adv double, illiq double, iv double, hv double, skew double")
    signals = {"iv": "iv", "hv": "hv", "skew": "skew", "term": "iv", "skewness": "skew"}
    spec = N.Spec(k=8, quotas=(("trend", 2), ("lottery", 2), ("core", 4)), communities=4, most_of_community=24, illiquid_share=0.2, adv_floor=2.5e6, lottery_cap=0.9)
    args = (df, "2020-04-15", ["mk"], "beta", "adv", "illiq", signals)
    out, stages = N.choose_universe(*args, spec=spec)
    assert len(out) == 8 == out.entity.nunique() and out.slot.tolist() == list(range(8)) and out.shard.is_monotonic_increasing
    assert [s for s, _ in stages] == ["pool", "volume", "illiquidity", "coverage", "chosen"] and stages[0][1] == 24 and stages[1][1] == 22
    assert (out.entity >= 2).all() and not (set(out.entity) - set(range(24)))
    late = df.withColumn("r", F.when(F.col("dt") > F.lit(dt.date(2020, 4, 15)), 9.0).otherwise(F.col("r")))
    pd.testing.assert_frame_equal(out, N.choose_universe(late, *args[1:], spec=spec)[0])  # nothing after the date counts
    held = [n for n in range(2, 24) if n not in set(out.entity)][:8]
    kept, _ = N.choose_universe(*args, spec=spec, incumbent=held)
    assert len(set(kept.entity) - set(held)) <= int(0.3 * 8)
    with pytest.raises(ValueError):
        N.choose_universe(*args, spec=N.Spec(k=23))
