"""Tests of the findings of round 2: they failed before."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(i))


def test_f22_long_part_keys_as_in_sql(spark, tmp_path):
    part = pd.DataFrame({"p_partkey": [7, 123456, 1199999, 1200003], "p_brand": ["Brand#12"] * 4, "p_type": ["PROMO"] * 4, "p_size": [66, 1, 11, 50]}).astype({"p_partkey": "int64", "p_size": "int32"})
    part.to_parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["scalar_rules"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    assert [tuple(r) for r in got] == con.execute(f"FROM ({entry.oracle_sql()['scalar_rules']}) ORDER BY p_partkey").fetchall()


@pytest.mark.parametrize("width", [3, 40, 10**6])
def test_f21_overall_quantiles_hold_a_band_only(spark, width):
    from lodestar.operators import cross_section as X

    rng = np.random.default_rng(0)
    for v in (rng.normal(size=2000).tolist() + [None] * 7, [1.0] * 900 + [2.0] * 100, [5.0], [float(i % 7) for i in range(500)]):
        df = spark.createDataFrame([(x,) for x in v], "x double")
        shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
        np.testing.assert_allclose(X.overall_quantiles(df, "x", shares, width), np.quantile([x for x in v if x is not None], shares), rtol=1e-12)
    assert X.overall_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_f18_linkage_takes_square_time():
    import time

    from lodestar.operators import universe as N

    def plain(d, k):
        n, d = len(d), d.copy()
        np.fill_diagonal(d, np.inf)
        size, label = np.ones(n), np.arange(n)
        for _ in range(n - k):
            i, j = sorted(divmod(int(np.argmin(d)), n))
            d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i, i] = np.inf
            d[j] = d[:, j] = np.inf
            label[label == j] = i
            size[i] += size[j]
        return np.unique(label, return_inverse=True)[1]

    rng = np.random.default_rng(1)
    for digits in (1, 2, 15):  # with many ties, with some, with none
        d = np.round(rng.random((70, 70)), digits)
        d = (d + d.T) / 2
        for k in (1, 4, 30):
            assert (N.average_linkage(d, k) == plain(d, k)).all()
    v = rng.normal(size=(60, 3000))
    start = time.process_time()
    assert len(N.central_members(v, 10)) == 10
    assert time.process_time() - start < 15


@pytest.fixture(scope="module")
def many(spark):
    """4,200 names of 12 returns each, as a parquet path's worth of rows."""
    rng = np.random.default_rng(3)
    e, t = np.meshgrid(np.arange(4200), np.arange(12), indexing="ij")
    pdf = pd.DataFrame({"entity": e.ravel(), "dt": [day(i) for i in t.ravel()], "r": rng.normal(0, 0.02, e.size)})
    return spark.createDataFrame(pdf, "entity long, dt date, r double").cache()


def test_f19_communities_of_more_than_4096_names(spark, many):
    from pyspark.sql import functions as F

    from lodestar.operators import universe as N

    got = N.communities(many, "r", F.lit("x")).toPandas()
    assert len(got) == 4200 and set(got.community) == set(range(8))


def test_f17_a_pool_of_more_than_2000_names(spark, many):
    from pyspark.sql import functions as F

    from lodestar.operators import universe as N

    df = many.withColumns({"m": F.sin(F.dayofyear("dt")), "beta": F.col("r") * 2, "adv": F.col("entity") + 1.0, "illiq": F.abs("r"), "s": F.rand(1)})
    signals = {n: "s" for n in ("iv", "hv", "skew", "term", "skewness")}
    spec = N.Spec(k=12, quotas=(("trend", 4), ("lottery", 4), ("core", 4)), most_of_community=4000)
    out, stages = N.choose_universe(df, str(day(11)), ["m"], "beta", "adv", "illiq", signals, spec=spec)
    assert len(out) == 12 and stages[0] == ("pool", 4200) and stages[-2][1] > 2000


def test_f10_correlations_by_blocks(spark):
    from lodestar.operators import pairs as B
    from lodestar.operators import statistics as Z

    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.02, (23, 30))
    v[rng.random(v.shape) < 0.5] = np.nan
    v[3] = np.where(np.isfinite(v[3]), 0.1, np.nan)  # doesn't vary
    v[5, 0], v[6, :4] = 1e9, 0.3  # an outlier most others don't share
    corr, n = B.correlations(v, v)[0]
    for i in range(23):
        for j in range(23):
            both = np.isfinite(v[i]) & np.isfinite(v[j])
            a, b = v[i, both], v[j, both]
            assert n[i, j] == both.sum()
            if len(a) > 1 and np.ptp(a) and np.ptp(b):
                assert corr[i, j] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-8)
            else:
                assert np.isnan(corr[i, j])
    df = spark.createDataFrame([(i, day(t), float(v[i, t])) for i in range(23) for t in range(30) if np.isfinite(v[i, t])], "e int, d date, x double")
    plans = Z.pairwise_correlation(df, "x", "d", "e")._jdf.queryExecution().toString()
    assert "Join" not in plans  # no product of rows
    held = B.series(df, "x", "d", "e")
    got = B.by_blocks(held, "e", B.correlations, "corr double, n long", 7).toPandas()
    assert (got.a < got.b).all() and not got.duplicated(["a", "b"]).any()
    whole = {(i, j): n[i, j] for i in range(23) for j in range(i + 1, 23) if n[i, j]}
    assert {(r.a, r.b): r.n for r in got.itertuples()} == whole


def test_f4_entropy_of_more_than_4096_names(spark):
    from lodestar.operators import inference as I

    n = 4100
    pairs = spark.range(n - 1).selectExpr("id as a", "id + 1 as b", "if(id % 2 = 0, 0.5D, null) as corr")
    r = I.entropy_breadth(pairs, names=10).first()
    p = np.array([1.5, 0.5] * (n // 2)) / n
    assert r.entities == n and r.by_entropy == pytest.approx(np.exp(-(p * np.log(p)).sum()))


def test_f5_to_f9_portfolios_hold_a_block_of_names(spark, monkeypatch):
    from lodestar.operators import baselines as L
    from lodestar.operators import sequential as G

    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.05, (60, 9))
    v[rng.random(v.shape) < 0.3] = np.nan
    v[:, 4], v[0], v[31] = np.nan, np.nan, np.nan
    rows = [(f"n{e}", day(t), None if np.isnan(v[t, e]) else float(v[t, e])) for t in range(60) for e in range(9)]
    df = spark.createDataFrame(rows, "entity string, dt date, r double")
    x, size = 1 + np.nan_to_num(v), []
    monkeypatch.setattr(G, "NAMES", 4)
    shares = lambda w: np.maximum(w, 0) / np.maximum(w, 0).sum()
    mixes = np.random.default_rng(0).dirichlet(np.ones(9), size=50)
    for method in G.ONLINE:
        got = G.online_portfolio(df, "r", method=method, samples=50).toPandas()
        assert len(got) == 540 and not got.duplicated(["dt", "entity"]).any()
        got, w = got.pivot(index="dt", columns="entity", values="weight").to_numpy(), np.full(9, 1 / 9)
        for t in range(60):
            np.testing.assert_allclose(got[t], w, atol=1e-12)
            if method == "eg":
                w = shares(w * np.exp(0.05 * x[t] / (w @ x[t])))
            elif method == "bah":
                w = shares(w * x[t])
            elif method == "universal":
                wealth = np.prod(mixes @ x[: t + 1].T, axis=1)
                w = shares(wealth / wealth.sum() @ mixes)
            else:
                a = x[t] if method == "pamr" else x[max(0, t - 4) : t + 1].mean(0)
                d = a - a.mean()
                if method == "pamr":
                    w = shares(w - max(0, w @ a - 0.5) / (d @ d + 1 / 1000) * d)
                elif d @ d >= 1e-12:
                    w = shares(w + max(0, 10 - w @ a) / (d @ d) * d)
    got = L.capped_path(df, 0.05, "r").toPandas().pivot(index="dt", columns="entity", values="weight").to_numpy()
    own, paths = np.zeros(9), L.capped_path(df.crossJoin(spark.range(2)), 0.05, "r", ["id"])
    for t in range(60):
        step = np.nan_to_num(v[t]) - own
        own = own + step * min(1, 0.05 / max(np.abs(step).sum(), 1e-15))
        np.testing.assert_allclose(got[t], own, atol=1e-12)
    assert paths.count() == 1080
