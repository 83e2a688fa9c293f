"""Tests of the findings of round 3: they failed before."""

from __future__ import annotations

import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pytest


def day(i: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(i))


def packed(v):
    """Rows of values by dates as the operators hold them."""
    from lodestar.operators.clusters import Packed

    at = [np.flatnonzero(row) for row in v]
    return Packed.of(at, [row[i] for row, i in zip(v, at, strict=True)], v.shape[1])


def plain(v, k):
    """Average linkage of rows by 1 less their absolute correlation, pair by pair."""
    z = v - v.mean(1, keepdims=True)
    z[(v == v[:, :1]).all(1)] = 0
    length = np.sqrt((z * z).sum(1, keepdims=True))
    z = np.divide(z, length, out=np.zeros_like(z), where=length > 0)
    d = 1 - np.abs(z @ z.T)
    base, label = d.copy(), np.arange(len(d))
    while len(np.unique(label)) > k:
        kinds = np.unique(label)
        pairs = [(round(base[np.ix_(label == a, label == b)].mean(), 12), a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :]]
        _, a, b = min(pairs)
        label[label == b] = a
    np.fill_diagonal(base, 0.0)
    return np.unique(label, return_inverse=True)[1], base


@pytest.fixture(scope="module")
def many():
    """40 rows over 30 dates: gaps, equal rows, one less than another's negative, one that doesn't vary, three without values."""
    rng = np.random.default_rng(8)
    v = rng.normal(0, 0.02, (40, 30)) * (rng.random((40, 30)) < 0.7)
    v[20:30] = v[5:15]
    v[30], v[31], v[32], v[33:36] = v[5], -v[5], 0.01, 0.0
    return v


@pytest.mark.parametrize(("room", "rows", "columns"), [(4096, 256, 1024), (6, 3, 7), (2, 2, 40), (1, 64, 5)])
def test_f1_f2_f3_linkage_without_a_matrix_of_all_names(monkeypatch, many, room, rows, columns):
    from lodestar.operators import clusters as C

    monkeypatch.setattr(C, "ROOM", room)
    monkeypatch.setattr(C, "ROWS", rows)
    monkeypatch.setattr(C, "COLUMNS", columns)
    some = many[:33]  # rows that don't vary tie with each other
    for k in (1, 2, 3, 8, 15, 30, 33):
        label, d = plain(some, k)
        np.testing.assert_array_equal(C.clustered(packed(some), k)[0], label)
        lead = []
        for c in range(label.max() + 1):
            members = np.flatnonzero(label == c)
            lead.append(int(members[np.round(d[np.ix_(members, members)].mean(1), 12).argmin()]))
        assert C.central(packed(some), k) == sorted(lead)
    assert len(set(C.clustered(packed(many), 9)[0])) == 9
    first, own = C.alike(packed(many))
    assert len(first) == 28 and len(set(own[[5, 20, 30, 31]])) == 1 and len(set(own[32:36])) == 4


def test_f1_f2_f3_memory_of_linkage(monkeypatch):
    from lodestar.operators import clusters as C

    monkeypatch.setattr(C, "ROOM", 300)
    rng = np.random.default_rng(2)
    for v in (rng.normal(size=(3000, 20)), np.tile(rng.normal(size=(300, 20)), (10, 1))):
        tracemalloc.start()
        label = C.clustered(packed(v), 10)[0]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(set(label)) == 10 and most < 3000 * 3000 * 8 / 2


def test_f1_windows_of_clusters_go_packed(spark, monkeypatch, many):
    from lodestar.operators import sequential
    from lodestar.operators import universe as N

    def whole(*a, **b):
        raise AssertionError("a window of all names goes to one task's table")

    monkeypatch.setattr(sequential, "trailing_blocks", whole)
    df = spark.createDataFrame([(f"n{i:02d}", day(t), float(v)) for i, row in enumerate(many[:33]) for t, v in enumerate(row) if v], "entity string, dt date, r double")
    when = spark.createDataFrame([(day(20),), (day(30),), (day(0),)], "dt date")
    got = N.select_by(df, "r", when, "clusters", k=5, days=50, least=3).toPandas()
    assert set(got.rebalance) == {day(20), day(30)}
    for end in (20, 30):
        own = got[got.rebalance == day(end)].sort_values("slot")
        assert own.entity.tolist() == [f"n{i:02d}" for i in N.central_members(many[:33, :end].T, 5)] and own.slot.tolist() == list(range(5))


def test_f2_communities_of_groups(spark, many):
    from pyspark.sql import functions as F

    from lodestar.operators import universe as N

    df = spark.createDataFrame([(i, day(t), float(v) if v else None) for i, row in enumerate(many) for t, v in enumerate(row)], "entity int, dt date, r double")
    got = N.communities(df.repartition(3), "r", F.dayofyear("dt") > 15, 4, 3).toPandas()
    for group, part in (("false", many[:, :15]), ("true", many[:, 15:])):
        keep = np.flatnonzero((part != 0).sum(1) >= 3)
        own = got[got.group == group].sort_values("entity")
        assert own.entity.tolist() == keep.tolist()
        if (part[keep].std(1) > 0).all():
            np.testing.assert_array_equal(own.community, plain(part[keep], 4)[0])
    lone = N.communities(df, "r", F.lit(None), 4, 0).toPandas()
    assert len(lone) == 40 and lone.group.isna().all()


def test_f3_rows_dealt_out_by_name(spark, many):
    import glob

    from pyspark.sql import functions as F

    from lodestar.session import by_key, shared_dir

    df = spark.createDataFrame([(i, day(t), float(v)) for i, row in enumerate(many) for t, v in enumerate(row)], "entity int, dt date, r double")
    files = f"{shared_dir(spark).removeprefix('file://')}/lodestar_*"
    with by_key(df, "entity", "dt") as held:
        sums = held.groupBy("entity").agg(F.sum("r").alias("s"))
        both = held.join(sums, "entity")
        assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == many.size and glob.glob(files)
    assert not glob.glob(files) and not [t for t in spark.catalog.listTables() if t.name.startswith("lodestar_")]


def test_f5_wide_tables_of_any_number_of_keys(spark):
    from lodestar.operators import reshape as S

    rows = [(day(t), f"k{k:04d}", float(t * k) if (t + k) % 3 else None) for t in range(4) for k in range(150)]
    df = spark.createDataFrame([*rows, (day(0), "k0001", -1.0)], "dt date, k string, x double")
    names = S.blocks(df, "k", 16)
    table = S.wide_blocks(df, "dt", "k", "x", names, 16)
    assert len(table.columns) == 18 and table.count() == 40
    got = {(r.dt, r.field): r.value for r in S.long_blocks(table, "dt", "k", names, "x", 16).collect()}
    whole = S.wide(df, "dt", "k", "x", [f"k{k:04d}" for k in range(150)])
    assert got == {(r.dt, r.field): r.value for r in S.long(whole, ["dt"], [c for c in whole.columns if c != "dt"]).collect()}


def test_f5_the_query_has_no_column_a_supplier(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["wide_and_back"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "px_1" not in plan


def by_definition(v):
    """Hierarchical weights of columns from their whole covariance."""
    k = v.shape[1]
    cov = np.cov(v, rowvar=False)
    cov = 0.9 * cov + 0.1 * np.eye(k) * np.trace(cov) / k
    sd = np.sqrt(np.diag(cov))
    corr = np.round(cov / np.outer(sd, sd), 12)
    order, left = [int(np.argmin(np.round(sd, 14)))], set(range(k))
    left -= set(order)
    while left:
        order.append(max(sorted(left), key=lambda j: corr[order[-1], j]))
        left.remove(order[-1])
    w, todo = np.ones(k), [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        halves, risk = (part[: len(part) // 2], part[len(part) // 2 :]), []
        for h in halves:
            iv = 1 / np.diag(cov)[h]
            iv /= iv.sum()
            risk.append(iv @ cov[np.ix_(h, h)] @ iv)
        share = 1 - risk[0] / sum(risk)
        w[halves[0]] *= share
        w[halves[1]] *= 1 - share
        todo += halves
    return w


@pytest.mark.parametrize(("room", "rows", "nearest"), [(4096, 256, 64), (4096, 4, 64), (5, 3, 2), (5, 7, 1), (1, 256, 64)])
def test_f7_hierarchical_weights_without_a_matrix_of_all_names(monkeypatch, many, room, rows, nearest):
    from lodestar.operators import clusters as C

    monkeypatch.setattr(C, "ROOM", room)
    monkeypatch.setattr(C, "ROWS", rows)
    monkeypatch.setattr(C, "NEAREST", nearest)
    monkeypatch.setattr(C, "COLUMNS", 8)
    for v in (many, many[:20], many[:1], np.tile(many[:7], (4, 1))):
        w = by_definition(v.T) if len(v) > 1 else np.ones(1)
        np.testing.assert_allclose(C.hierarchical(packed(v)), w, rtol=1e-9)


def test_f7_weights_query_goes_packed(spark, monkeypatch, many):
    from lodestar.operators import sequential as G

    def whole(*a, **b):
        raise AssertionError("a window of all names goes to one task's table")

    monkeypatch.setattr(G, "trailing_blocks", whole)
    df = spark.createDataFrame([(i, day(t), float(v)) for i, row in enumerate(many[:33]) for t, v in enumerate(row) if v], "entity int, dt date, r double")
    got = G.optimised(df, "r", spark.createDataFrame([(day(25),), (day(2),)], "dt date"), "hierarchical", days=50, least=2).toPandas()
    for end in (25, 2):
        own = got[got.rebalance == day(end)].sort_values("entity")
        v = many[:33, :end]
        keep = np.flatnonzero((v != 0).sum(1) >= 2)
        assert own.entity.tolist() == keep.tolist()
        np.testing.assert_allclose(own.weight, by_definition(v[keep].T) if end > 2 else 0, rtol=1e-9)


@pytest.fixture(scope="module")
def copied(spark):
    """60 names of which many are copies, as (entity, date, value); and their pairs' correlations by definition."""
    rng = np.random.default_rng(11)
    v = np.where(rng.random((20, 25)) < 0.6, rng.normal(size=(20, 25)), np.nan)
    v[3, np.isfinite(v[3])], v[4] = 0.5, np.where(np.arange(25) == 7, 1.0, np.nan)  # one that doesn't vary, one value
    v = np.vstack([v, v[:15], v[2:15], v[2:14]])
    rows = [(i, day(t), float(x)) for i, row in enumerate(v) for t, x in enumerate(row) if np.isfinite(x)]
    out = {}
    for i in range(60):
        for j in range(i + 1, 60):
            both = np.isfinite(v[i]) & np.isfinite(v[j])
            p, q = v[i, both], v[j, both]
            if both.any():
                out[i, j] = (np.corrcoef(p, q)[0, 1] if both.sum() > 1 and np.ptp(p) and np.ptp(q) else np.nan, both.sum())
    return spark.createDataFrame(rows, "entity int, dt date, r double").cache(), out


@pytest.mark.parametrize("block", [4, 1024])
def test_f4_pairs_of_equal_series(spark, monkeypatch, copied, block):
    from lodestar.operators import pairs as B
    from lodestar.operators import statistics as Z

    monkeypatch.setattr(B, "BLOCK", block)
    df, expected = copied
    got = Z.pairwise_correlation(df, "r", "dt", "entity").toPandas()
    assert len(got) == len(expected) and (got.a < got.b).all()
    assert {(r.a, r.b): r.n for r in got.itertuples()} == {k: n for k, (_, n) in expected.items()}
    np.testing.assert_allclose(got["corr"].to_numpy(float), [expected[a, b][0] for a, b in zip(got.a, got.b, strict=True)], atol=1e-9)


def test_f4_a_series_goes_to_few_tasks(spark, monkeypatch):
    from lodestar.operators import pairs as B

    monkeypatch.setattr(B, "BLOCK", 10)
    df = spark.createDataFrame([(i, day(t), float(i * t % 7)) for i in range(200) for t in range(3)], "e int, d date, x double")
    held = B.series(df, "x", "d", "e")
    shuffled = []
    real = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: shuffled.append(self.count()) or real(self, *a))
    assert B.by_blocks(held, "e", B.meetings, "n long").count() == 200 * 199 // 2
    assert shuffled == [200 * 5]


@pytest.mark.parametrize("names", [1, 100])
def test_f6_entropy_of_equal_series(copied, names):
    from lodestar.operators import inference as I
    from lodestar.operators import statistics as Z

    df, expected = copied
    m = np.eye(60)
    for (i, j), (c, _) in expected.items():
        m[i, j] = m[j, i] = np.nan_to_num(c)
    p = np.clip(np.linalg.eigvalsh(m), 0, None)
    p = p[p > 1e-12] / p.sum()
    pairs, weights, _ = Z.distinct_correlation(df, "r", "dt", "entity")
    assert weights.count() == 20 and pairs.count() <= 20 * 21 // 2
    r = I.entropy_breadth(pairs, names=names, weights=weights).first()
    assert r.entities == 60 and r.by_entropy == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-9)
