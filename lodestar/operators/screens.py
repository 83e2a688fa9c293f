"""Named quality screens, attrition reports and arbitrage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Screens = dict[str, Column]


def passes(screens: Screens) -> Column:
    """All screens hold; a null verdict counts as failed."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in screens.values()), F.lit(True))


def attrition(df: DataFrame, screens: Screens, entity: str) -> DataFrame:
    """One row, in one pass: rows, failures of each screen alone, rows that pass all, and their entities."""
    fails = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"fail_{k}") for k, c in screens.items()]
    every = passes(screens)
    return df.agg(F.count(F.lit(1)).alias("n_base"), *fails, F.count_if(every).alias("n_retained"), F.countDistinct(F.when(every, F.col(entity))).alias("n_entities"))


def funnel(df: DataFrame, screens: Screens) -> DataFrame:
    """A row for each screen in order: rows in, out and dropped. One aggregate, then unpivoted."""
    sofar, outs = F.lit(True), []
    for c in screens.values():
        sofar &= F.coalesce(c, F.lit(False))
        outs.append(F.count_if(sofar))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.array(*outs).alias("outs"))
    names = F.array(*(F.lit(k) for k in screens))
    rows = one.select("n", "outs", F.posexplode(names).alias("stage", "screen"))
    n_in = F.when(F.col("stage") == 0, F.col("n")).otherwise(F.get("outs", F.col("stage") - 1))
    return rows.select("stage", "screen", n_in.alias("n_in"), F.get("outs", F.col("stage")).alias("n_out"), (n_in - F.get("outs", F.col("stage"))).alias("n_dropped"))


def calendar_violations(surface: DataFrame, keys: list[str], group: list[str], tenor: str, vol: str, eps: float = 1e-8) -> DataFrame:
    """Per key, how often total variance falls with tenor within a group."""
    w = F.col(vol) * F.col(vol) * F.col(tenor) / 365.0
    rows = surface.where((F.col(tenor) > 0) & F.col(vol).isNotNull()).withColumn("__w", w)
    before = F.lag("__w").over(Window.partitionBy(*keys, *group).orderBy(tenor))
    return rows.withColumn("__v", F.col("__w") + eps < before).where("__v").groupBy(*keys).agg(F.count(F.lit(1)).alias("violations"))


def butterfly_violations(chain: DataFrame, keys: list[str], group: list[str], strike: str, price: str, tie: list[str], eps: float = 1e-8) -> DataFrame:
    """Per key, adjacent strike triples whose price isn't convex; the first row of a strike counts."""
    once = Window.partitionBy(*keys, *group, strike).orderBy(*tie)
    rows = chain.where(F.col(strike).isNotNull() & F.col(price).isNotNull()).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    w = Window.partitionBy(*keys, *group).orderBy(strike)
    k1, c1 = F.col(strike), F.col(price)
    k2, c2, k3, c3 = F.lead(strike, 1).over(w), F.lead(price, 1).over(w), F.lead(strike, 2).over(w), F.lead(price, 2).over(w)
    gap = (k3 - k2) * c1 - (k3 - k1) * c2 + (k2 - k1) * c3
    return rows.withColumn("__gap", gap).where(F.col("__gap") <= -eps).groupBy(*keys).agg(F.count(F.lit(1)).alias("violations"))


def without(df: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(bad.select(*keys).distinct(), keys, "left_anti")


def no_later_event(df: DataFrame, events: DataFrame, key: str, time: str, event_time: str, days: int) -> DataFrame:
    """Adds whether no event of the key falls in (time, time + days]; by the next event's date, not by a range join."""
    own = df.select(key, F.col(time).alias("__t")).distinct().withColumn("__side", F.lit(0)).withColumn("__e", F.lit(None).cast("date"))
    other = events.select(key, F.col(event_time).cast("date").alias("__t"), F.lit(-1).alias("__side"), F.col(event_time).cast("date").alias("__e"))
    w = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    nearest = own.unionByName(other).withColumn("__next", F.min("__e").over(w)).where("__side = 0")
    flags = nearest.select(key, F.col("__t").alias("__d"), (F.col("__next").isNull() | (F.datediff("__next", "__t") > days)).alias("clear"))
    return df.join(flags.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & (F.col(time) == F.col("__d")), "left").select(*df.columns, "clear")


def liquidity_bands(df: DataFrame, entity: str, value: str, bands: tuple[float, float] = (1 / 3, 2 / 3), floor: float = 0.0) -> DataFrame:
    """Median by entity, those above the floor ranked with average ties and put into three bands."""
    medians = df.groupBy(entity).agg(F.percentile(value, F.lit(0.5)).alias("median")).where(F.col("median") >= floor)
    everything = Window.partitionBy(F.lit(0))
    ties = F.count(F.lit(1)).over(Window.partitionBy("median"))
    share = (F.rank().over(Window.partitionBy(F.lit(0)).orderBy("median")) + (ties - 1) / 2) / F.count(F.lit(1)).over(everything)
    return medians.withColumn("share", share).withColumn("band", F.when(F.col("share") <= bands[0], "low").when(F.col("share") <= bands[1], "middle").otherwise("high"))


def coverage(df: DataFrame, entity: str, value: str, least: float, periods: int) -> DataFrame:
    """Entities that have a value on at least a share of the periods."""
    return df.groupBy(entity).agg((F.count(value) / F.lit(periods)).alias("coverage")).where(F.col("coverage") >= least)


def quality_counts(df: DataFrame, bid: str, ask: str) -> DataFrame:
    b, a = F.col(bid), F.col(ask)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(b.isNull() | a.isNull()).alias("missing"), F.count_if(a < b).alias("crossed"), F.count_if(a == b).alias("locked"), F.count_if(b <= 0).alias("no_bid"))
