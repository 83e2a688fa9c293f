"""Geometry of purged combinatorial cross-validation and walk-forward folds."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_dates(dates: DataFrame, groups: int = 6, time: str = "dt") -> DataFrame:
    """(dt, idx, group): contiguous groups with edges floor(k n / groups)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    idx = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)) - 1
    # the group of index i is the greatest k with floor(k n / S) <= i
    return dates.select(time).distinct().select(time, idx.alias("idx"), n.alias("n")).withColumn("group", F.floor((F.col("idx") * groups + groups - 1) / F.col("n"))).select(time, "idx", "n", F.least(F.when(F.floor(F.col("group") * F.col("n") / groups) <= F.col("idx"), F.col("group")).otherwise(F.col("group") - 1), F.lit(groups - 1)).cast("int").alias("group"))


def cpcv_folds(dates: DataFrame, groups: int = 6, test: int = 2, purge: int = 21, embargo: int = 21, time: str = "dt") -> DataFrame:
    """(fold, dt, role): every combination of test groups; train dates near a test group are purged or embargoed, dropped here."""
    spark = dates.sparkSession
    table = spark.createDataFrame([(f, list(c)) for f, c in enumerate(combinations(range(groups), test))], "fold int, tests array<int>")
    placed = grouped_dates(dates, groups, time)
    edges = placed.groupBy("group").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    bounds = table.select("fold", F.explode("tests").alias("group")).join(F.broadcast(edges), "group").groupBy("fold").agg(F.collect_list(F.struct("group", "low", "high")).alias("b"))
    crossed = placed.crossJoin(F.broadcast(bounds))  # groups choose test copies of the calendar
    in_test = F.exists("b", lambda x: x["group"] == F.col("group"))
    near = F.exists("b", lambda x: (F.col("idx") >= x["low"] - purge) & (F.col("idx") <= x["high"] + embargo))
    role = F.when(in_test, "test").when(~near, "train")
    return crossed.select("fold", time, "group", role.alias("role")).where("role is not null")


def cpcv_paths(groups: int, test: int, spark) -> DataFrame:
    """(path, group, fold): path p takes for each group the p-th fold that tests it."""
    rows = [(f, g) for f, c in enumerate(combinations(range(groups), test)) for g in c]
    table = spark.createDataFrame(rows, "fold int, group int")
    return table.select((F.row_number().over(Window.partitionBy("group").orderBy("fold")) - 1).alias("path"), "group", "fold")


def walk_forward(dates: DataFrame, folds: int = 5, share: float = 0.15, time: str = "dt") -> DataFrame:
    """(fold, dt, role): test blocks laid back to back before the end, training on everything before each."""
    n = F.col("n")
    placed = grouped_dates(dates, 1, time)
    block = F.greatest(F.lit(10), F.round(n * share / folds)).cast("int")
    crossed = placed.crossJoin(F.broadcast(dates.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))))
    start = n - block * (folds - F.col("fold"))
    role = F.when((F.col("idx") >= start) & (F.col("idx") < start + block), "test").when(F.col("idx") < start, "train")
    return crossed.select("fold", time, role.alias("role")).where("role is not null")


def reselect_purge(dates: DataFrame, reselect: Column, radius: int = 21, time: str = "dt") -> DataFrame:
    """(dt, idx, purged): dates no more than ``radius`` rows from one on which the universe is chosen anew."""
    everything = Window.partitionBy(F.lit(0)).orderBy(time)  # a row for each date
    near = F.max(F.coalesce(reselect, F.lit(False)).cast("int")).over(everything.rowsBetween(-radius, radius)) == 1
    return dates.select(time, (F.row_number().over(everything) - 1).alias("idx"), near.alias("purged"))


def reconstruct_paths(fold_pnl: DataFrame, dates: DataFrame, groups: int = 6, test: int = 2, pnl: str = "pnl", time: str = "dt") -> DataFrame:
    """(path, dt, fold, pnl) of held-out profits (fold, dt, pnl): each path takes each group of dates from the fold assigned to it.

    A date that its fold has no profit for is there with a null.
    """
    placed = grouped_dates(dates, groups, time).select(time, "group")
    paths = cpcv_paths(groups, test, dates.sparkSession)
    spine = placed.join(F.broadcast(paths), "group")
    return spine.join(fold_pnl.select("fold", time, pnl), ["fold", time], "left").select("path", time, "fold", pnl)


def path_sharpes(paths: DataFrame, pnl: str = "pnl", periods: int = 252) -> DataFrame:
    """Per path: days, missing days, mean, and the annual Sharpe ratio (population deviation + 1e-12)."""
    x = F.col(pnl)
    return paths.groupBy("path").agg(F.count(x).alias("n_days"), F.count_if(x.isNull()).alias("n_missing"), F.avg(x).alias("mean_pnl"), (F.avg(x) / (F.stddev_pop(x) + 1e-12) * periods**0.5).alias("sharpe"))


def summarise_paths(rated: DataFrame) -> DataFrame:
    """One row: the distribution of the paths' Sharpe ratios."""
    s = F.col("sharpe")
    q = lambda p: F.percentile(s, F.lit(p))
    return rated.agg(F.count(F.lit(1)).alias("n_paths"), F.avg(s).alias("sharpe_mean"), F.stddev_pop(s).alias("sharpe_std"), q(0.05).alias("sharpe_p05"), q(0.5).alias("sharpe_median"), q(0.95).alias("sharpe_p95"), F.avg((s > 0).cast("double")).alias("positive_path_rate"))


def run_folds(df: DataFrame, folds: DataFrame, trainer: Callable, schema: str, time: str = "dt") -> DataFrame:
    """Applies ``trainer(fold, train, test)`` (pandas frames in, one out with ``schema``) to every fold; folds run in parallel.

    A fold's train and test rows are one task's.
    """
    rows = df.join(F.broadcast(folds.select("fold", time, "role")), time)

    def run(pdf):
        fold = int(pdf["fold"].iloc[0])
        own = pdf.drop(columns=["fold", "role"])
        return trainer(fold, own[pdf["role"] == "train"], own[pdf["role"] == "test"])

    return rows.groupBy("fold").applyInPandas(run, schema)
