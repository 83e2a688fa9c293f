"""Wide and long forms, slots, grids, sampling dates and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.panel import PANEL, UNBOUNDED, Panel


def wide(df: DataFrame, index: str, key: str, value: str, keys: list, stem: str | None = None) -> DataFrame:
    """One column for each of the given keys; the last of several values wins by size. Keys are stated, so one pass is enough."""
    out = df.groupBy(index).pivot(key, keys).agg(F.max(value))
    return out.select(index, *(F.col(f"`{k}`").alias(f"{stem or value}_{k}") for k in keys))


def long(df: DataFrame, index: list[str], columns: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """Rows of (index, field, value) without missing values."""
    return df.unpivot(index, columns, name, value).where(F.col(value).isNotNull())


def wide_blocks(df: DataFrame, index: str, key: str, value: str, names: DataFrame, size: int = 64) -> DataFrame:
    """``wide`` for any number of keys: a row for each index and block of ``size`` keys, with columns ``c0``, ``c1``, ... of its keys.

    ``names`` has (key, block, place), as ``blocks`` makes it; a row with some value of a block is enough for the block to be there.
    """
    rows = df.select(index, key, value).join(F.broadcast(names), key).repartition(index, "block")
    return rows.groupBy(index, "block").agg(*(F.max(F.when(F.col("place") == i, F.col(value))).alias(f"c{i}") for i in range(size)))


def blocks(keys: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, block, place): keys in order, ``size`` to a block."""
    n = F.row_number().over(Window.orderBy(key)) - 1  # a row a key
    return keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__n", n).select(key, F.floor(F.col("__n") / size).cast("int").alias("block"), (F.col("__n") % size).alias("place"))


def long_blocks(table: DataFrame, index: str, key: str, names: DataFrame, stem: str, size: int = 64, name: str = "field", value: str = "value") -> DataFrame:
    """Rows of (index, field, value) of ``wide_blocks`` without missing values; fields are ``wide``'s columns."""
    fields = names.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", F.concat(F.lit(f"{stem}_"), F.col(key).cast("string"))))).alias("__names"))
    cells = F.array(*(F.struct(F.lit(i).alias("place"), F.col(f"c{i}").alias(value)) for i in range(size)))
    held = table.select(index, "block", F.explode(F.filter(cells, lambda c: c[value].isNotNull())).alias("__c"))
    return held.join(F.broadcast(fields), "block").select(index, F.element_at("__names", F.col("__c.place")).alias(name), F.col(f"__c.{value}").alias(value))


def grid(dates: DataFrame, entities: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Every date with every entity, and the row if there is one. Dates and entities are dimensions, not facts."""
    return dates.crossJoin(F.broadcast(entities)).join(df, keys, "left")


def slots(df: DataFrame, score: str, k: int, panel: Panel = PANEL) -> DataFrame:
    """The k entities with the largest score of each date, by slot from 0; empty slots are absent."""
    w = Window.partitionBy(panel.time).orderBy(F.desc(score), panel.entity)
    return df.where(F.col(score).isNotNull()).withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < k)


def gather(slotted: DataFrame, df: DataFrame, values: list[str], panel: Panel = PANEL) -> DataFrame:
    """Values of each slot's occupant; 0 where it has none."""
    joined = slotted.select(panel.time, "slot", panel.entity).join(df.select(panel.time, panel.entity, *values), [panel.time, panel.entity], "left")
    return joined.withColumns({v: F.coalesce(v, F.lit(0.0)) for v in values})


def last_of(period: str, time: str = "dt", by: list[str] | None = None) -> Column:
    """True on the last date seen in each month or week (Monday to Sunday)."""
    w = Window.partitionBy(*(by or []), F.date_trunc(period, time))
    return F.col(time) == F.max(time).over(w)


def every_nth(time: str, n: int, anchor: int = 0, by: list[str] | None = None) -> Column:
    return F.pmod(F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(time)) - 1 - anchor, F.lit(n)) == 0


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a stated order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def islands(df: DataFrame, flag: Column, panel: Panel = PANEL) -> DataFrame:
    """A row for each run of true rows of an entity: first and last time, and length."""
    whole, hits = panel.series, F.coalesce(flag, F.lit(False))
    numbered = df.withColumn("__hit", hits).withColumn("__all", F.row_number().over(whole))
    run = F.col("__all") - F.row_number().over(Window.partitionBy(panel.entity, "__hit").orderBy(panel.time))
    return numbered.withColumn("__run", run).where("__hit").groupBy(panel.entity, "__run").agg(F.min(panel.time).alias("first"), F.max(panel.time).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def state_runs(df: DataFrame, state: str, panel: Panel = PANEL) -> DataFrame:
    """Adds ``switched`` and ``days_in_state`` (1 on the first row of a state)."""
    switched = F.coalesce(F.col(state) != F.lag(state).over(panel.series), F.lit(False))
    numbered = df.withColumn("switched", switched).withColumn("__run", F.sum(F.col("switched").cast("long")).over(panel.series.rowsBetween(UNBOUNDED, 0)))
    return numbered.withColumn("days_in_state", F.row_number().over(Window.partitionBy(panel.entity, "__run").orderBy(panel.time))).drop("__run")


def persistent(df: DataFrame, state: str, run: int = 10, name: str = "label", panel: Panel = PANEL) -> DataFrame:
    """The state that last held for ``run`` rows in a row; before that, the first state seen.

    A state takes over on the run-th row in a row of it, so a row's label is the state of the latest row on which a run
    has become that long: a forward fill, not a loop.
    """
    counted = state_runs(df, state, panel)
    first = F.first(state).over(panel.series.rowsBetween(UNBOUNDED, 0))
    held = F.last(F.when(F.col("days_in_state") >= run, F.col(state)), ignorenulls=True).over(panel.series.rowsBetween(UNBOUNDED, 0))
    return counted.withColumn(name, F.coalesce(held, first)).drop("switched", "days_in_state")


def observation(df: DataFrame, channels: list[str], rows: int, panel: Panel = PANEL) -> DataFrame:
    """The last ``rows`` rows of all channels as one array, oldest first; null until there are so many."""
    w = panel.trailing(rows)
    packed = F.flatten(F.collect_list(F.array(*(F.coalesce(c, F.lit(0.0)) for c in channels))).over(w))
    return df.withColumn("observation", F.when(F.count(F.lit(1)).over(w) == rows, packed))


def jaccard(df: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    both, any_ = F.count_if(a & b), F.count_if(a | b)
    return df.groupBy(*by).agg(F.try_divide(both, any_).alias("jaccard"), both.alias("n_both"))


def set_turnover(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Per date, entities that came and went since the date before."""
    sets = df.groupBy(panel.time).agg(F.array_sort(F.collect_set(panel.entity)).alias("now"))
    before = F.coalesce(F.lag("now").over(Window.orderBy(panel.time)), F.array().cast(sets.schema["now"].dataType))
    return sets.withColumn("was", before).select(panel.time, F.size(F.array_except("now", "was")).alias("came"), F.size(F.array_except("was", "now")).alias("went"), F.size("now").alias("held"))


def head_summary(df: DataFrame, by: list[str], medians: dict[str, str], counts: dict[str, Column], kinds: str) -> DataFrame:
    """Per group: rows, medians, conditional counts, and a map from each kind to its number of rows."""
    own = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(c, F.lit(0.5)).alias(n) for n, c in medians.items()), *(F.count_if(c).alias(n) for n, c in counts.items()))
    each = df.where(F.col(kinds).isNotNull()).groupBy(*by, kinds).agg(F.count(F.lit(1)).alias("__n"))
    maps = each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kinds, "__n")))).alias("counts"))
    return own.join(maps, by, "left")


def bridge_coverage(df: DataFrame, bridge: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, those whose key the bridge has, and their share."""
    marked = df.join(bridge.select(*keys).distinct().withColumn("__in", F.lit(True)), keys, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count("__in").alias("bridged"), F.try_divide(F.count("__in"), F.count(F.lit(1))).alias("share"))


def one_hot(df: DataFrame, group: str, k: int = 11) -> DataFrame:
    """Adds ``<group>_0`` to ``<group>_(k-1)``: 1 for the k most frequent groups in order, ties by name. A row for each group is ranked."""
    ranked = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", F.row_number().over(Window.orderBy(F.desc("__n"), group)) - 1).where(F.col("__k") < k)
    out = df.join(F.broadcast(ranked.select(group, "__k")), group, "left")
    return out.select(*df.columns, *(F.coalesce((F.col("__k") == i).cast("int"), F.lit(0)).alias(f"{group}_{i}") for i in range(k)))


def short_interest(releases: DataFrame, dates: DataFrame, entities: DataFrame, value: str, name: str = "ratio", panel: Panel = PANEL) -> DataFrame:
    """(entity, dt, ratio) on every date: the last release of those that fall on one of the dates. Releases between dates are
    lost, as they would be in a table indexed by the dates."""
    last = releases.groupBy(panel.entity, panel.time).agg(F.max(value).alias("__v"))
    whole = grid(dates, entities, last, [panel.time, panel.entity])
    return whole.select(panel.entity, panel.time, F.last("__v", ignorenulls=True).over(panel.expanding()).alias(name))


def aligned_mask(dates: DataFrame, mask: DataFrame, schema: int, flag: str = "mask", time: str = "dt", least: int = 3) -> DataFrame:
    """(dt, mask) of a sealed mask on some dates, false where it has none; masks of an older schema are refused."""
    if schema < least:
        raise ValueError(f"schema {schema}, at least {least} is needed")
    sealed = mask.groupBy(time).agg(F.bool_or(flag).alias(flag))
    return dates.select(time).distinct().join(sealed, time, "left").select(time, F.coalesce(flag, F.lit(False)).alias(flag))


def coverage_mask(is_option: Column, label: Column, feature: Column, spot: Column | None = None) -> Column:
    """Option slots need a feature and a label, stock slots a label and, if given, a spot."""
    stock = label.isNotNull() if spot is None else label.isNotNull() & spot.isNotNull()
    return F.when(is_option, label.isNotNull() & feature.isNotNull()).otherwise(stock)


def fixed_slots(slots_: DataFrame, dates: DataFrame, members: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """(dt, slot, entity, valid) of slots that keep their occupants: valid on the dates on which the occupant is a member."""
    every = dates.select(panel.time).distinct().crossJoin(F.broadcast(slots_.select("slot", panel.entity)))
    own = members.select(panel.time, panel.entity).distinct().withColumn("valid", F.lit(True))
    return every.join(own, [panel.time, panel.entity], "left").withColumn("valid", F.coalesce("valid", F.lit(False))).select(panel.time, "slot", panel.entity, "valid")
