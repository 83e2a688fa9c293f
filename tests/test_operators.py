"""Operators on small fixtures."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.functions import scalars as K
from lodestar.operators import cross_section as X
from lodestar.operators import pit, portfolio, reshape, screens, statistics, validation
from lodestar.panel import PANEL
from lodestar.sources import lake
from lodestar.streaming import events


def day(k: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    rows = [(e, day(t), float(x) if rng.random() > 0.05 else None) for e in range(6) for t, x in enumerate(rng.normal(0, 0.02, 60))]
    return spark.createDataFrame(rows, "entity int, dt date, r double")


def test_gates(spark, panel):
    rows = panel.select("entity", "dt", "r", R.gated(F.col("r"), 5, R.mean).alias("full"), R.gated(F.col("r"), 5, R.mean, "half").alias("half"), R.gated(F.col("r"), 5, R.mean, "any").alias("any")).toPandas().sort_values(["entity", "dt"])
    for _, g in rows.groupby("entity"):
        w = g.r.rolling(5, min_periods=1)
        whole = np.arange(len(g)) >= 4
        for name, least in (("full", 5), ("half", 2), ("any", 1)):
            expected = w.mean().where((w.count() >= least) & whole)
            np.testing.assert_allclose(g[name], expected, atol=1e-12, equal_nan=True)


def test_future_doesnt_change_the_past(spark, panel):
    columns = {"hv": R.volatility(F.col("r"), 10), "z": R.expanding_z(F.col("r")), "m": R.log_return(F.col("r"), 5), "f": R.forward_fill("r", 3)}
    a = panel.withColumns(columns).where(F.col("dt") <= F.lit(day(40))).toPandas()
    later = F.col("dt") > F.lit(day(40))
    b = panel.withColumn("r", F.when(later, F.lit(9.0)).otherwise(F.col("r"))).withColumns(columns).where(~later).toPandas()
    keys = ["entity", "dt"]
    pd.testing.assert_frame_equal(a.sort_values(keys).reset_index(drop=True), b.sort_values(keys).reset_index(drop=True))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_asof_against_pandas(spark, strict, keyed):
    rng = random.Random(3)
    left = pd.DataFrame({"k": [rng.randrange(3) for _ in range(80)], "t": pd.to_datetime([day(rng.randrange(300)) for _ in range(80)]), "i": range(80)}).sort_values("t")
    right = pd.DataFrame({"k": [rng.randrange(3) for _ in range(60)], "t": pd.to_datetime([day(rng.randrange(300)) for _ in range(60)]), "v": [float(i) for i in range(60)]})
    right = right.groupby(["k", "t"] if keyed else ["t"], as_index=False).v.max().sort_values("t")
    by = ["k"] if keyed else None
    expected = pd.merge_asof(left, right[["k", "t", "v"] if keyed else ["t", "v"]], on="t", by=by, allow_exact_matches=not strict).set_index("i").v
    l, r = spark.createDataFrame(left).withColumn("t", F.col("t").cast("date")), spark.createDataFrame(right).withColumn("t", F.col("t").cast("date"))
    got = pit.asof_join(l, r, "t", by, ["v"], strict=strict).toPandas().set_index("i").v
    np.testing.assert_allclose(got.sort_index(), expected.sort_index(), equal_nan=True)


def test_asof_null_times(spark):
    l = spark.createDataFrame([(1, None), (1, day(3))], "k int, t date")
    r = spark.createDataFrame([(1, day(1), 5.0), (1, None, 7.0)], "k int, t date, v double")
    assert sorted((x.t, x.v) for x in pit.asof_join(l, r, "t", ["k"], ["v"]).collect() if x.t) == [(day(3), 5.0)]
    assert [x.v for x in pit.asof_join(l, r, "t", ["k"], ["v"]).collect() if x.t is None] == [None]


def test_ranks_and_legs(spark):
    df = spark.createDataFrame([(e, day(0), float(v) if v is not None else None) for e, v in enumerate([3, 1, 1, None, 5, 2, 9, 8, 7, 6, 4])], "entity int, dt date, x double")
    got = {r.entity: (r.o, r.s) for r in df.select("entity", X.ordinal_rank("x").alias("o"), X.average_rank_share("x").alias("s")).collect()}
    assert got[1][0] == 1 and got[2][0] == 2 and got[3] == (None, None) and got[1][1] == got[2][1] == 0.15
    w = {r.entity: r.weight for r in X.leg_weights(df, "x").collect()}
    assert sum(w.values()) == 0 and w[6] == 0.5 and w[1] == -0.5


def test_persistent(spark):
    states = "aaabaabbbbaa"
    df = spark.createDataFrame([(0, day(i), s) for i, s in enumerate(states)], "entity int, dt date, s string")
    got = "".join(r.label for r in reshape.persistent(df, "s", 3).orderBy("dt").collect())
    held, run, out = states[0], 0, ""
    for i, s in enumerate(states):
        run = run + 1 if i and s == states[i - 1] else 1
        held = s if run >= 3 else held
        out += held
    assert got == out


def test_screens_count_null_as_failed(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, 1.0)], "e int, v double")
    row = screens.attrition(df, {"big": F.col("v") > 2}, "e").first()
    assert (row.n_base, row.fail_big, row.n_retained, row.n_entities) == (3, 2, 1, 1)


def test_folds_never_train_near_a_test(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(300)], "dt date")
    got = validation.cpcv_folds(dates, 6, 2, 10, 10).toPandas()
    assert got.fold.nunique() == 15
    for _, f in got.groupby("fold"):
        test = {(d - day(0)).days for d in f[f.role == "test"].dt}
        assert all(not ({t - k for k in range(-10, 11)} & test) for t in ((d - day(0)).days for d in f[f.role == "train"].dt))


def test_bootstrap_is_repeatable(spark, panel):
    a, b = (statistics.bootstrap_interval(panel, "r", "dt", "entity").toPandas().sort_values("entity").reset_index(drop=True) for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert (a.low < a.high).all()


@pytest.mark.parametrize("method", ["adahedge", "hedge", "fixed_share", "variable_share", "page_hinkley"])
def test_experts(spark, method):
    losses = spark.createDataFrame([(day(t), e, float((e == "b") ^ (t < 10))) for t in range(40) for e in ("a", "b", "c")], "dt date, e string, loss double")
    got = statistics.mix_experts(losses, "loss", "dt", "e", ["a", "b", "c"], method).toPandas()
    assert np.allclose(got.groupby("dt").weight.sum(), 1)


def test_costs_and_turnover(spark):
    df = spark.createDataFrame([(0, day(0), 0.5), (0, day(1), 0.2), (1, day(0), 0.5), (1, day(1), 0.8)], "entity int, dt date, weight double")
    rows = portfolio.costs(df).orderBy("dt").collect()
    assert rows[0].turnover == 0.5 and abs(rows[1].turnover - 0.3) < 1e-12


def test_normal_cdf(spark):
    from statistics import NormalDist

    xs = [x / 10 for x in range(-60, 61)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(K.normal_cdf(F.col("x"))).collect()]
    assert max(abs(a - NormalDist().cdf(x)) for a, x in zip(got, xs, strict=True)) < 2e-7


def test_replacing_years(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    first = spark.createDataFrame([("2020-01-05", 1.0), ("2021-01-05", 2.0), ("x", 3.0)], "date string, v double")
    assert lake.replace_years(first, path, "date") == {"rows": 2, "rejects": 1}
    lake.replace_years(spark.createDataFrame([("2021-03-01", 5.0), ("2021-03-02", 6.0)], "date string, v double"), path, "date")
    assert {r.year: r["count"] for r in spark.read.parquet(path).groupBy("year").count().collect()} == {2020: 1, 2021: 2}
    with pytest.raises(ValueError, match="shrink"):
        lake.replace_years(spark.createDataFrame([("2021-05-01", 1.0)], "date string, v double"), path, "date")
    with pytest.raises(FileNotFoundError):
        lake.require(spark, f"file://{tmp_path}/nothing")


def test_stream_equals_batch(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    rows = [(i, (base + pd.Timedelta(minutes=7 * i)).to_pydatetime(), i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    batch.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = events.windowed(events.read_stream(spark, f"file://{tmp_path}/in", batch.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.windowed(batch).collect()))


@pytest.mark.parametrize("method", ["eg", "pamr", "olmar"])
def test_online_weights_are_portfolios(spark, panel, method):
    from lodestar.operators import sequential

    got = sequential.online_portfolio(panel, "r", panel.select("entity").distinct(), method).toPandas()
    assert np.allclose(got.groupby("dt").weight.sum(), 1) and (got.weight > -1e-12).all()
    assert (got[got.dt == got.dt.min()].weight.round(12) == round(1 / 6, 12)).all()


@pytest.mark.parametrize("method", ["min_variance", "max_diversification", "mean_variance", "hierarchical"])
def test_optimised_weights_use_the_past_only(spark, panel, method):
    from lodestar.operators import sequential

    at = spark.createDataFrame([(day(50),)], "dt date")
    get = lambda df: sequential.optimised(df, "r", at, method, least=20).toPandas().sort_values("entity").weight.to_numpy()
    w = get(panel)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    later = panel.withColumn("r", F.when(F.col("dt") >= F.lit(day(50)), F.lit(5.0)).otherwise(F.col("r")))
    np.testing.assert_allclose(get(later), w)


def test_past_percentile(spark):
    from lodestar.operators import sequential

    values = [3.0, 1.0, None, 3.0, 2.0]
    df = spark.createDataFrame([(0, day(i), v) for i, v in enumerate(values)], "entity int, dt date, x double")
    got = sequential.past_percentile(df, "x").toPandas().sort_values("dt").percentile.tolist()
    np.testing.assert_allclose(got, [np.nan, 0.0, np.nan, 1.0, 1 / 3], equal_nan=True)


def test_turbulence_by_blocks_over_all_entities(spark):
    from lodestar.operators import sequential

    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.02, (150, 15))
    v[:, 14] *= 5
    v[rng.random(v.shape) < 0.02] = np.nan
    v[rng.random(150) < 0.5, 13] = np.nan
    v[0] = np.nan
    df = spark.createDataFrame([(e, day(t), None if np.isnan(v[t, e]) else float(v[t, e])) for t in range(150) for e in range(15)], "entity int, dt date, r double")
    got = sequential.turbulence(df, "r", window=70, least=30, block=16).toPandas().sort_values("dt")
    m, expected = v[1:], []  # the first date has no value
    for t in range(149):
        past = m[max(0, t - 70) : t]
        use = np.isfinite(m[t]) & (np.isfinite(past).mean(0) > 0.9) if t >= 30 else np.zeros(15, bool)
        past = past[:, use][np.isfinite(past[:, use]).all(1)]
        d = m[t, use] - past.mean(0) if use.any() else None
        expected.append(d @ np.linalg.pinv(np.atleast_2d(np.cov(past.T))) @ d / use.sum() if use.any() and len(past) > max(15, use.sum() + 1) else np.nan)
    assert got.dt.tolist() == [day(t) for t in range(1, 150)] and np.isfinite(expected).sum() > 100
    np.testing.assert_allclose(got.turbulence.to_numpy(float), expected, rtol=1e-8)


def test_reality_check_over_blocks_of_trials(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.02, (40, 300))
    v[:, 299] += 0.006
    df = spark.createDataFrame([(e, day(t), float(v[t, e])) for t in range(40) for e in range(300) if (t + e) % 7], "entity int, dt date, r double")
    v[(np.arange(40)[:, None] + np.arange(300)) % 7 == 0] = 0.0
    mean, sd = v.mean(0), v.std(0) + 1e-12
    centre = np.where(np.sqrt(40) * mean / sd >= -np.sqrt(2 * np.log(np.log(40))), mean, 0.0)
    boot = [v[statistics.stationary_indices(40, 5.0, np.random.default_rng([0, r]))].mean(0) for r in range(99)]
    white, hansen = np.mean([(b - mean).max() >= mean.max() for b in boot]), np.mean([((b - centre) / sd).max() >= max((mean / sd).max(), 0.0) for b in boot])
    got = statistics.reality_check(df, "r", "dt", "entity", replicates=99).first()
    assert (round(got.white_p, 9), round(got.hansen_p, 9), got.replicates) == (round(float(white), 9), round(float(hansen), 9), 99)
