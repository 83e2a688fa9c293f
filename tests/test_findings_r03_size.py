"""Tests of what is open of round 3's findings, by disk: they failed before."""

from __future__ import annotations

import datetime as dt

import numpy as np


def test_f4_pairs_of_equal_series_lie_in_runs(spark):
    from lodestar.operators import statistics as Z

    rng = np.random.default_rng(6)
    v = rng.normal(size=(20, 12))
    names = rng.permutation(20 * 60)
    rows = [(int(e), dt.date(2020, 1, 1) + dt.timedelta(days=t), float(v[e % 20, t])) for e in names for t in range(12)]
    df = spark.createDataFrame(rows, "e int, d date, x double").repartition(7)
    got = Z.pairwise_correlation(df, "x", "d", "e", digits=6).coalesce(1).toPandas()
    assert len(got) == 1200 * 1199 // 2 and (got.a < got.b).all() and not got.duplicated(["a", "b"]).any() and (got.n == 12).all()
    np.testing.assert_allclose(got["corr"], np.round(np.corrcoef(v), 6)[got.a % 20, got.b % 20], atol=1e-9)
    changes = {c: (got[c].diff() != 0).mean() for c in ("b", "corr")}
    assert changes["b"] < 0.05 and changes["corr"] < 0.001  # what a columnar file holds in few bytes


def test_f4_a_series_is_written_once_and_shuffled_twice_before(spark, monkeypatch):
    import __spark_entry__ as entry
    from lodestar.operators import pairs as B
    from lodestar.operators import statistics as Z

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])
        return real(df)

    real = B.cut
    monkeypatch.setattr(B, "cut", seen)
    monkeypatch.setattr(Z, "cut", seen)
    entry.queries()["pairwise_correlation"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 2


def test_f4_returns_are_the_panels(spark):
    from lodestar.plans.registry import panel_frame, returns_frame

    a, b = panel_frame(spark, "/root/testdata/sf0.001").select("entity", "dt", "r"), returns_frame(spark, "/root/testdata/sf0.001")
    assert a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count()
