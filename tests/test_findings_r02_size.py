"""Tests of round 2's findings on size: no task is given all names of a window, or whole series by the thousand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(i))


@pytest.fixture(scope="module")
def values():
    """90 dates by 23 names: gaps, a date without values, a name with few, one that doesn't vary, two alike, an outlier."""
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.03, (90, 1)) * rng.random(23) + rng.normal(0.001, 0.02, (90, 23))
    v[rng.random(v.shape) < 0.3] = np.nan
    v[40], v[5:, 7], v[:, 9], v[3, 11] = np.nan, np.nan, 0.0, 1e6
    v[:, 13] = v[:, 12]
    return v


@pytest.fixture(scope="module")
def rows(spark, values):
    t, e = np.meshgrid(np.arange(90), np.arange(23), indexing="ij")
    pdf = pd.DataFrame({"entity": [f"n{x:02d}" for x in e.ravel()], "dt": [day(i) for i in t.ravel()], "r": values.ravel()})
    df = spark.createDataFrame(pdf.astype({"r": object}).where(pdf.notna(), None), "entity string, dt date, r double")
    return df.repartition(3).cache()


@pytest.fixture
def when(spark):
    return spark.createDataFrame([(day(60),), (day(0),), (day(89),), (day(60),)], "dt date")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    from lodestar.operators import sequential, windows

    def whole(*a, **b):
        raise AssertionError("a window of all names goes to one task")

    monkeypatch.setattr(sequential, "trailing_blocks", whole)
    monkeypatch.setattr(windows, "NAMES", 4)
    monkeypatch.setattr(windows, "TASK", 8)


def window(values, end, days, least):
    """Dates with any value by names with enough of them, missing ones 0; these names' places."""
    v = values[max(0, end - days) : end]
    v = v[np.isfinite(v).any(1)]
    keep = np.flatnonzero(np.isfinite(v).sum(0) >= least)
    return np.nan_to_num(v[:, keep]), keep, np.isfinite(v[:, keep]).sum(0)


@pytest.mark.parametrize("method", ["min_variance", "max_diversification", "mean_variance"])
def test_f13_to_f15_optimised_weights_by_blocks(spark, rows, values, when, method):
    from lodestar.operators import sequential as G

    got = G.optimised(rows, "r", when, method, days=50, least=10).toPandas()
    assert set(got.rebalance) == {day(60), day(89)}
    for end in (60, 89):
        v, keep, _ = window(values, end, 50, 10)
        k = len(keep)
        cov = np.cov(v, rowvar=False)
        cov = 0.9 * cov + 0.1 * np.eye(k) * np.trace(cov) / k
        b = {"min_variance": np.ones(k), "max_diversification": np.sqrt(np.diag(cov)), "mean_variance": v.mean(0)}[method]
        w = np.maximum(np.linalg.solve(cov, b), 0)
        own = got[got.rebalance == day(end)].sort_values("entity")
        assert own.entity.tolist() == [f"n{i:02d}" for i in keep]
        np.testing.assert_allclose(own.weight, w / w.sum(), rtol=1e-7, atol=1e-12)
    flat = rows.selectExpr("entity", "dt", "if(r is null, null, 0D) as r")
    assert G.optimised(flat, "r", when, method, days=50, least=10).selectExpr("bool_and(weight > 0 and weight < 0.1)").first()[0]


def test_f3_spread_out_names_by_blocks(spark, rows, values, when):
    from lodestar.operators import sequential as G

    got = G.spread_out(rows, "r", when, k=6, days=50, least=10).toPandas()
    assert set(got.rebalance) == {day(60), day(89)} and len(got) == 12
    for end in (60, 89):
        v, keep, n = window(values, end, 50, 10)
        with np.errstate(all="ignore"):
            corr = np.round(np.nan_to_num(np.corrcoef(v, rowvar=False)), 12)
        chosen = [int(n.argmax())]
        while len(chosen) < 6:
            near = corr[:, chosen].max(1)
            near[chosen] = np.inf
            chosen.append(int(near.argmin()))
        own = got[got.rebalance == day(end)].sort_values("slot")
        assert own.entity.tolist() == [f"n{keep[i]:02d}" for i in chosen]
    few = G.spread_out(rows.where("entity < 'n03'"), "r", when, k=6, days=50, least=10)
    assert few.count() == 6 and G.spread_out(rows, "r", when, least=1000).count() == 0


def test_f11_tail_universe_by_blocks(spark, rows, values, when):
    from lodestar.operators import universe as N

    got = N.select_by(rows, "r", when, "tail_hypergraph", k=4, days=50, least=10).toPandas()
    assert set(got.rebalance) == {day(60), day(89)}
    for end in (60, 89):
        v, keep, _ = window(values, end, 50, 10)
        own = got[got.rebalance == day(end)].sort_values("slot")
        assert own.slot.tolist() == [0, 1, 2, 3] and own.entity.tolist() == [f"n{keep[i]:02d}" for i in sorted(N.dense_set(*N.tail_hypergraph(v), 4))]
    assert N.select_by(rows, "r", when, "tail_hypergraph", least=1000).count() == 0


def test_f6_to_f8_series_reach_python_in_pieces(spark, rows, values):
    from lodestar.operators import sequential as G
    from lodestar.operators.pairs import series

    lone = rows.unionByName(spark.createDataFrame([("none", day(1), None)], rows.schema))
    held = series(lone, "r", "dt", "entity")
    flat = G.points(held).toPandas()
    assert len(flat) == np.isfinite(values).sum() + 1  # a row a value: no row grows with the series
    times = np.sort(flat.t[flat.x.notna()].unique())
    for step in (1, 7, 100, 10**6):
        for size in (1, 4, 100):
            made = list(G.parts((flat.iloc[i : i + step] for i in range(0, len(flat), step)), "entity", times, size))
            assert max(len(n) for n, _ in made) <= size
            names, v = np.concatenate([n for n, _ in made]), np.concatenate([v for _, v in made])
            assert sorted(names) == [*(f"n{i:02d}" for i in range(23)), "none"]
            some = np.isfinite(values).any(1)
            np.testing.assert_array_equal(v[np.argsort(names)][:23], values[some].T)
            assert np.isnan(v[names == "none"]).all()
