"""Sources, sinks, streams and cubes."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.operators import blocks as B
from lodestar.operators import pit
from lodestar.sources import lake as L
from lodestar.streaming import events


def uri(path, name="x") -> str:
    return f"file://{path}/{name}"


def test_repeated_rows_stay_repeated_in_interval_joins(spark):
    left = spark.createDataFrame([(1, dt.date(2020, 1, 5), ["a"]), (1, dt.date(2020, 1, 5), ["a"]), (1, None, []), (2, dt.date(2020, 1, 5), None), (None, dt.date(2020, 1, 5), [])], "k int, d date, tags array<string>")
    links = spark.createDataFrame([(1, dt.date(2020, 1, 1), None, 5), (1, dt.date(2020, 1, 2), dt.date(2020, 1, 9), 9)], "k int, s date, e date, score int")
    rows = pit.interval_join(left, links, "k", "d", "s", "e", [F.desc("score")]).collect()
    assert Counter((r.k, r.d, r.score) for r in rows) == Counter({(1, dt.date(2020, 1, 5), 9): 2, (1, None, None): 1, (2, dt.date(2020, 1, 5), None): 1, (None, dt.date(2020, 1, 5), None): 1})
    assert pit.interval_join(left, links, "k", "d", "s", "e", [F.desc("score")], "inner").count() == 2
    assert pit.interval_join(left.limit(0), links, "k", "d", "s", "e", [F.desc("score")]).count() == 0


def test_episodes(spark):
    ep = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2020, 1, 3)), (1, dt.date(2020, 1, 1), dt.date(2020, 1, 3)), (2, dt.date(2020, 1, 1), None), (3, dt.date(2020, 1, 1), None)], "k int, start date, end date")
    facts = spark.createDataFrame([(1, dt.date(2020, 1, 2), 4.0), (1, dt.date(2020, 2, 2), 8.0), (2, dt.date(2019, 1, 1), 3.0)], "k int, d date, v double")
    rows = pit.episode_median(ep, facts, "k", "d", "v").collect()
    assert Counter((r.k, r.median_v) for r in rows) == Counter({(1, 4.0): 2, (2, 3.0): 1, (3, None): 1})


def test_status_of_selection():
    assert pit.selection_status("2010-01-01", "2011-01-01", "oos")["status"] == "ok"
    assert pit.selection_status("2011-01-01", "2011-01-01", "train")["status"] == "in_sample"
    with pytest.raises(ValueError):
        pit.assert_point_in_time("2012-01-01", "2011-01-01", "oos")
    assert pit.universe_end("point_in_time", "2012-01-01", "2011-01-01") == "2010-12-31" and pit.universe_end("fixed", "2012-01-01", "2011-01-01") == "2012-01-01"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,v,w\n2020-01-01,1.5,x\nbad,2,y\n2020-01-03,,\n2020-01-01,9,z\n")
    df = L.read_csv(spark, uri(tmp_path, "a.csv"), all_text=True)
    assert L.pick_column(df, *L.DATE_NAMES) == "Date" and L.pick_column(df, "nope") is None
    good, bad = L.split_rejects(df, "Date")
    assert good.count() == 3 and bad.select("reject_reason").first()[0] == "bad date"
    series = L.ingest_series(spark, uri(tmp_path, "a.csv"), "s", "Date", "v", 3).collect()
    assert [(r.event_date, r.available_date, r.value, r.series_id) for r in series] == [(dt.date(2020, 1, 1), dt.date(2020, 1, 4), 9.0, "s")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in L.read_any(spark, uri(tmp_path, "b.jsonl")).collect()) == [1, 2]
    (tmp_path / "c.json").write_text(json.dumps({"name": "r", "rows": [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}], "values": [1.5, 2.5]}, indent=1))
    assert sorted(map(tuple, L.read_report(spark, uri(tmp_path, "c.json"), "rows").collect())) == [(1, "a"), (2, "b")]
    assert sorted(r[0] for r in L.read_report(spark, uri(tmp_path, "c.json"), "values").collect()) == [1.5, 2.5]
    with pytest.raises(FileNotFoundError):
        L.require(spark, uri(tmp_path, "nothing"))
    assert L.query_arrow(spark, "select 1 as a").to_pylist() == [{"a": 1}]


def test_literals_and_remote_texts(spark):
    assert L.literal("it's") == "'it''s'" and L.literal(3) == "3" and L.literal(None) == "NULL" and L.literal(dt.date(2020, 1, 2)) == "'2020-01-02'"
    assert L.statements_sql("funda", ["gvkey"], ["001"], "2020-01-01") == "SELECT gvkey FROM funda WHERE indfmt = 'INDL' AND datafmt = 'STD' AND consol = 'C' AND popsrc = 'D' AND gvkey IN ('001') AND datadate >= DATE '2020-01-01'"
    assert L.chunked([1, 2, 3], 2) == [[1, 2], [3]] and L.yearly_sql("t", [2019, 2020], ["a"]) == "SELECT a FROM t2019 UNION ALL SELECT a FROM t2020"


def test_atomic_versions_and_cache(spark, tmp_path):
    path = uri(tmp_path, "t")
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    L.write_version(df, path, ["k"], "o")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 2, "b"), (2, 1, "c")]
    L.write_version(spark.createDataFrame([(2, 5, "d", 1.0)], "k int, o int, v string, extra double"), path, ["k"], "o")
    assert sorted((r.k, r.v, r.extra) for r in spark.read.parquet(path).collect()) == [(1, "b", None), (2, "d", 1.0)]
    calls = []
    for _ in range(2):
        out = L.cached(spark, uri(tmp_path, "cache"), lambda: calls.append(1) or df, names=["a"], start="x")
    assert out.count() == 3 and calls == [1]
    done = L.materialise(spark, {"one": df, "two": df.withColumn("w", F.when(F.col("k") == 2, 1.0))}, uri(tmp_path, "families"), ["k"])
    assert {(r.family, r.field): round(r.missing, 6) for r in done.collect()} == {("one", "o"): 0, ("one", "v"): 0, ("two", "o"): 0, ("two", "v"): 0, ("two", "w"): round(2 / 3, 6)}
    L.write_strategies(df.withColumnRenamed("v", "strategy"), uri(tmp_path, "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("strategy=*")) == ["strategy=a", "strategy=b", "strategy=c"]
    assert L.flat_tables(spark, {"t": path}, uri(tmp_path, "flat")) == ["t"] and L.flat_tables(spark, {"t": path}, uri(tmp_path, "flat")) == []


def test_mirror(spark, tmp_path):
    (tmp_path / "from").mkdir()
    for n in "ab":
        (tmp_path / "from" / n).write_text(n)
    one, two = uri(tmp_path, "from"), uri(tmp_path, "to")
    assert L.mirror(spark, one, two) == {"copied": 2, "skipped": 0} and L.mirror(spark, one, two) == {"copied": 0, "skipped": 2}
    (tmp_path / "from" / "a").write_text("longer")
    assert L.mirror(spark, one, two) == {"copied": 1, "skipped": 1} and (tmp_path / "to" / "a").read_text() == "longer"


def test_replaced_years_leave_nothing_aside(spark, tmp_path):
    path = uri(tmp_path, "lake")
    make = lambda rows: spark.createDataFrame(rows, "date string, v int")
    assert L.replace_years(make([("2020-01-01", 1), ("2020-02-01", 2), ("2021-01-01", 3), ("x", 4)]), path, "date") == {"rows": 3, "rejects": 1}
    with pytest.raises(ValueError):
        L.replace_years(make([("2020-03-01", 9)]), path, "date")
    L.replace_years(make([("2020-03-01", 9)]), path, "date", force=True)
    assert sorted((r.year, r.month, r.v) for r in spark.read.parquet(path).collect()) == [(2020, 3, 9), (2021, 1, 3)]
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name or "replaced" in p.name] == []


def test_upsert_keeps_the_latest(spark, tmp_path):
    path = uri(tmp_path, "up")
    write = events.upsert_latest(spark, path, ["k"], "o")
    frame = lambda rows: spark.createDataFrame(rows, "k int, o int, v string")
    write(frame([(1, 1, "a"), (2, 5, "b"), (1, 0, "old")]), 0)
    write(frame([(1, 2, "c"), (2, 4, "late"), (3, 1, "d")]), 1)
    for _ in range(2):  # a batch that is tried again
        write(frame([(3, 1, "tie"), (4, None, "e")]), 2)
    assert {r.k: r.v for r in events.read_latest(spark, path).collect()} == {1: "c", 2: "b", 3: "tie", 4: "e"}


def test_portfolio_state_is_carried(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    rows = [("a", at(0), 0.5), ("b", at(0), -0.2), ("a", at(1), 0.7), ("a", at(2), 0.0), ("b", at(3), 0.2)]
    for k, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, "entity string, ts timestamp, weight double").coalesce(1).write.mode("append").parquet(uri(tmp_path, "in"))
        query = events.portfolio_state(spark.readStream.schema("entity string, ts timestamp, weight double").parquet(uri(tmp_path, "in")), 0.1)
        query.writeStream.format("parquet").option("path", uri(tmp_path, "out")).option("checkpointLocation", uri(tmp_path, "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.entity, r.ts): (r.days_held, round(r.total_cost, 6)) for r in spark.read.parquet(uri(tmp_path, "out")).collect()}
    assert got == {("a", at(0)): (1, 0.05), ("b", at(0)): (1, 0.02), ("a", at(1)): (2, 0.07), ("a", at(2)): (0, 0.14), ("b", at(3)): (2, 0.06)}


def test_channels():
    assert B.distinct_names(["a", "borrow_rate", "borrow_rate"]) == ["a", "borrow_rate", "borrow_rate_fee"]
    for names in (["a", "a"], ["borrow_rate"] * 3):
        with pytest.raises(ValueError):
            B.distinct_names(names)
    assert B.excluded(["liquidity", "macro"], ["hv_21", "kurt_63"], ["adv", "hv_21", "macro_x", "z"]) == {"adv", "hv_21", "macro_x"}
    for groups, channels in ((["nope"], []), ([], ["nope"])):
        with pytest.raises(ValueError):
            B.excluded(groups, channels, ["adv"])


def test_loaders(spark):
    @B.register("prices_for_a_test")
    def load(spark, folder, start, end):
        return spark.createDataFrame([(folder, start, end)], "a string, b string, c string")

    assert tuple(B.load_family("prices_for_a_test", spark, "f", "s", "e").first()) == ("f", "s", "e")
    with pytest.raises(KeyError):
        B.load_family("none", spark, "f", "s", "e")
    with pytest.raises(ValueError):
        B.register("prices_for_a_test")(load)


def test_stems(spark):
    df = spark.createDataFrame([(1, 0.5, None, 2.0)], "dt int, ret_0 double, ret_1 double, val_0 double")
    assert B.stem_matrix(df, "ret", 2).first().ret == [0.5, None] and B.stem_matrix(df, "ret", 2, fill=0.0).first().ret == [0.5, 0.0]
    row = B.marks(df, 2, 1, "ret", "val").first()
    assert row.labels == [0.5, 0.0, 2.0] and row.is_option == [True, True, False]
    with pytest.raises(ValueError):
        B.stem_matrix(df, "ret", 3)


def test_first_text(spark):
    from lodestar.functions import scalars as K

    df = spark.createDataFrame([(None, " ", "c"), ("a", "b", None), (None, None, None)], "x string, y string, z string")
    assert [r[0] for r in df.select(K.first_text(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["c", "a", None]
    q = spark.createDataFrame([("2020-01-02", 1.0, 3.0), ("nope", None, 2.0)], "d string, bid double, ask double")
    assert [tuple(r) for r in q.select(K.day(F.col("d")), K.mid(F.col("bid"), F.col("ask")), K.half_spread(F.col("bid"), F.col("ask"))).collect()] == [(dt.date(2020, 1, 2), 2.0, 1.0), (None, None, None)]
