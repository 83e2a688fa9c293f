"""Point-in-time joins: as-of, nearest, interval, and what is known at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.panel import UNBOUNDED


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, values: list[str] | None = None, right_on: str | None = None, strict: bool = False, tolerance: int | None = None, stamp: str | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (before it, if ``strict``), by key; unmatched stay, with nulls.

    Both sides are laid in one sequence by key and time, and the last right row is carried along: one shuffle, no range
    join. Right rows with a null time are left out; of several at one time the one with the greatest values counts.
    ``tolerance`` in days bounds the age; ``stamp`` names a column for the right row's time. Without ``by``, the right
    side is one series, and time is cut into ranges by ``asof_series`` instead.
    """
    by, right_on = by or [], right_on or on
    values = values or [c for c in right.columns if c not in by and c != right_on]
    if not by:
        return asof_series(left, right, on, values, right_on, strict, tolerance, stamp)
    first = F.lit(1 if strict else 0)
    r = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__t"), first.alias("__side"), F.struct(F.col(right_on).alias("at"), *values).alias("__v"))
    keep = [c for c in left.columns if c not in by]
    own = left.select(*by, F.col(on).alias("__t"), (1 - first).alias("__side"), F.struct(*keep).alias("__l"))
    both = own.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col("__t").asc_nulls_first(), "__side", F.col("__v").asc_nulls_first()).rowsBetween(UNBOUNDED, 0)
    seen = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__l is not null")
    return _matched(seen.select(*by, "__l.*", "__v"), on, values, tolerance, stamp, left.columns)


def _matched(df: DataFrame, on: str, values: list[str], tolerance: int | None, stamp: str | None, columns: list[str]) -> DataFrame:
    ok = F.col("__v").isNotNull() & F.col(on).isNotNull()
    if tolerance is not None:
        ok &= F.datediff(F.col(on), F.col("__v.at")) <= tolerance
    extra = [F.when(ok, F.col("__v.at")).alias(stamp)] if stamp else []
    return df.select(*columns, *(F.when(ok, F.col(f"__v.{v}")).alias(v) for v in values), *extra)


def asof_series(left: DataFrame, right: DataFrame, on: str, values: list[str], right_on: str, strict: bool = False, tolerance: int | None = None, stamp: str | None = None) -> DataFrame:
    """As-of join to one series: the series becomes intervals [t, next t), joined by month and range."""
    r = right.where(F.col(right_on).isNotNull()).groupBy(F.col(right_on).alias("__at")).agg(F.max(F.struct(*values)).alias("__s"))
    moments = left.select(F.col(on).alias("__t")).where("__t is not null").distinct()
    marks = moments.select("__t", F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(r.schema["__s"].dataType).alias("__s")).unionByName(r.select(F.col("__at").alias("__t"), F.lit(1 if strict else 0).alias("__side"), "__s"))
    # months in parallel, and what is carried into each month from those before: a row for each month
    month = F.trunc(F.col("__t").cast("date"), "month")
    within = Window.partitionBy("__m").orderBy("__t", "__side").rowsBetween(UNBOUNDED, 0)
    held = F.when(F.col("__s").isNotNull(), F.struct(F.col("__t").alias("at"), "__s.*"))
    laid = marks.withColumn("__m", month).withColumn("__v", F.last(held, ignorenulls=True).over(within))
    ends = laid.groupBy("__m").agg(F.max(held).alias("__end"))
    carried = ends.select("__m", F.last("__end", ignorenulls=True).over(Window.orderBy("__m").rowsBetween(UNBOUNDED, -1)).alias("__before"))
    known = laid.where(F.col("__s").isNull()).join(carried, "__m").select("__t", F.coalesce("__v", "__before").alias("__v"))
    joined = left.join(known, left[on] == known["__t"], "left")
    return _matched(joined, on, values, tolerance, stamp, left.columns)


def lagged(df: DataFrame, time: str, days: int, name: str = "available") -> DataFrame:
    """Adds the date from which a release may be used."""
    return df.withColumn(name, F.date_add(F.col(time).cast("date"), days))


def nearest_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tolerance: int = 5) -> DataFrame:
    """The right row closest in days within the tolerance; the earlier of two equally close. Keys and time are unique on the right."""
    back = asof_join(left, right, on, by, values, stamp="__b")
    ahead = right.select(*by, F.expr(f"date_sub(date'9999-01-01', datediff({on}, date'1970-01-01'))").alias("__r"), F.col(on).alias("__f"), *(F.col(v).alias(f"__f_{v}") for v in values))
    mirrored = back.withColumn("__r", F.expr(f"date_sub(date'9999-01-01', datediff({on}, date'1970-01-01'))"))
    both = asof_join(mirrored, ahead, "__r", by, ["__f", *(f"__f_{v}" for v in values)])
    db, df_ = F.datediff(on, "__b"), F.datediff("__f", on)
    use_back = (db <= tolerance) & (df_.isNull() | (df_ > tolerance) | (db <= df_))
    use_ahead = df_ <= tolerance
    return both.select(*left.columns, *(F.when(use_back, F.col(v)).when(use_ahead, F.col(f"__f_{v}")).alias(v) for v in values), F.when(use_back, -db).when(use_ahead, df_).alias("days_off"))


def interval_join(left: DataFrame, links: DataFrame, by: str, on: str, start: str, end: str, order: list[Column], how: str = "left") -> DataFrame:
    """The best link whose [start, end] holds the date; an open end is null. ``order`` ranks links; the first wins.

    ``order`` may name the links' columns with the prefix "r.". The best link is found for each distinct key and date and joined back, so repeated rows of ``left`` stay repeated and its
    other columns may be of any type. ``how``: left or inner.
    """
    extra = [c for c in links.columns if c != by]
    moments = left.select(F.col(by).alias("__k"), F.col(on).alias("__t")).where("__k is not null and __t is not null").distinct()
    hit = (F.col("__k") == F.col(f"r.{by}")) & (F.col("__t") >= F.col(f"r.{start}")) & (F.col(f"r.{end}").isNull() | (F.col("__t") <= F.col(f"r.{end}")))
    ranked = moments.join(links.alias("r"), hit).withColumn("__rank", F.row_number().over(Window.partitionBy("__k", "__t").orderBy(*order))).where("__rank = 1")
    best = ranked.select("__k", "__t", *(F.col(c).alias(f"__r_{c}") for c in extra))
    joined = left.join(best, (left[by] == F.col("__k")) & (left[on] == F.col("__t")), how)
    return joined.select(*(left[c] for c in left.columns), *(F.col(f"__r_{c}").alias(c) for c in extra))


def members_at(members: DataFrame, date: Column, start: str = "start_date", end: str = "end_date", member: str = "member") -> DataFrame:
    return members.where((F.col(start) <= date) & (F.col(end).isNull() | (F.col(end) >= date))).select(member).distinct()


def expand_membership(calendar: DataFrame, members: DataFrame, date: str, member: str, start: str, end: str) -> DataFrame:
    """(date, member) for every calendar date within an interval: intervals are opened to their dates, then met with the calendar."""
    last = calendar.agg(F.max(date).alias("__last"))
    opened = members.crossJoin(F.broadcast(last)).where(F.col(start) <= F.coalesce(end, "__last"))
    days = opened.select(member, F.explode(F.sequence(F.col(start), F.least(F.coalesce(end, "__last"), F.col("__last")))).alias(date))
    return days.join(calendar.select(date), date).select(date, member).distinct()


def value_a_year_ago(df: DataFrame, entity: str, time: str, value: str, days: int = 365, tolerance: int = 90) -> DataFrame:
    """Adds the value closest to so many days before, within the tolerance; the earlier of two equally close."""
    past = df.select(entity, F.date_add(F.col(time), days).alias(time), F.col(value).alias("__past"))
    found = nearest_join(df, past.where("__past is not null").groupBy(entity, time).agg(F.max("__past").alias("__past")), time, [entity], ["__past"], tolerance)
    return found.select(*df.columns, F.col("__past").alias(f"{value}_year_ago"))


def calendar(start: str, end: str, spark, business_days: bool = False, name: str = "dt") -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(name))
    return days.where(F.dayofweek(name).between(2, 6)) if business_days else days


def latest_version(log: DataFrame, keys: list[str], knowledge: str, as_of: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """The row known last for each key, of those known by ``as_of``."""
    known = log if as_of is None else log.where(F.col(knowledge) <= as_of)
    w = Window.partitionBy(*keys).orderBy(F.desc(knowledge), *(F.desc(t) for t in tie or []))
    return known.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def exact_else_asof(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str) -> DataFrame:
    """The value of the same date, or else the last before; missing values don't count."""
    return asof_join(left, right.where(F.col(value).isNotNull()), on, by, [value])


def in_interval(df: DataFrame, spans: DataFrame, by: str, on: str, start: str, end: str, values: dict[str, Column]) -> DataFrame:
    """``spans`` with aggregates of the rows of ``df`` within each span (ends included; an open end is null) by key.

    Equal spans share a result. Spans without a row keep null.
    """
    keys = spans.select(by, start, end).distinct()
    hit = (df[by] == keys[by]) & (df[on] >= keys[start]) & (keys[end].isNull() | (df[on] <= keys[end]))
    found = keys.join(df, hit).groupBy(keys[by].alias("__k"), keys[start].alias("__s"), keys[end].alias("__e")).agg(*(c.alias(n) for n, c in values.items()))
    same = spans[by].eqNullSafe(F.col("__k")) & spans[start].eqNullSafe(F.col("__s")) & spans[end].eqNullSafe(F.col("__e"))
    return spans.join(found, same, "left").select(*(spans[c] for c in spans.columns), *values)


def episode_median(episodes: DataFrame, df: DataFrame, by: str, on: str, value: str, start: str = "start", end: str = "end", name: str | None = None) -> DataFrame:
    """Adds the median of a value within each episode, or over the key's whole history where it has none there."""
    name = name or f"median_{value}"
    mid = F.percentile(value, F.lit(0.5))
    inside = in_interval(df.where(F.col(value).isNotNull()), episodes, by, on, start, end, {"__m": mid})
    whole = df.groupBy(F.col(by).alias("__w")).agg(mid.alias("__a"))
    return inside.join(whole, F.col(by) == F.col("__w"), "left").select(*episodes.columns, F.coalesce("__m", "__a").alias(name))


def episode_latest(episodes: DataFrame, df: DataFrame, by: str, on: str, values: list[str], end: str = "end") -> DataFrame:
    """Adds the values of the last row at or before each episode's end."""
    return asof_join(episodes, df, end, [by], values, on)


def spine(facts: DataFrame, first: DataFrame, second: DataFrame, outer: str, middle: str, inner: str, columns: list[str], width: int = 6) -> DataFrame:
    """Facts keyed by ``outer`` (zero-padded) carried over two distinct link tables to ``inner``: kept where the second has the link."""
    from lodestar.functions.scalars import padded_key

    pad = lambda df: df.withColumn(outer, padded_key(F.col(outer).cast("string"), width))
    missing = [c for c in columns if c not in facts.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    thin = pad(facts.select(outer, *columns))
    up = pad(first).select(outer, F.col(middle).try_cast("long").alias(middle)).distinct()
    down = second.select(F.col(middle).try_cast("long").alias(middle), inner).distinct()
    return thin.join(up, outer, "left").join(down, middle)


def read_filled(log: DataFrame, keys: list[str], event: str, knowledge: str, as_of: Column, start: str, end: str, values: list[str], rates: list[str] | None = None) -> DataFrame:
    """What was known of a series on each business day or event day from start to end, filled forwards only.

    The latest version of each event by ``as_of`` counts. Days on which a value other than a rate is still missing are
    dropped; rates that haven't begun are 0. One series of days: a row each.
    """
    rates = rates or []
    known = latest_version(log, [*keys, event], knowledge, as_of).select(F.col(event).cast("date").alias("__d"), *values)
    known = known.where(F.col("__d") <= F.lit(end).cast("date"))
    days = calendar(start, end, log.sparkSession, True, "__d")
    every = known.select("__d").union(days).distinct().join(known, "__d", "left")
    w = Window.orderBy("__d").rowsBetween(UNBOUNDED, 0)
    filled = every.select("__d", *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values)).where(F.col("__d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for v in values:
        filled = filled.where(F.col(v).isNotNull()) if v not in rates else filled.withColumn(v, F.coalesce(v, F.lit(0.0)))
    return filled.withColumnRenamed("__d", event)


def wide_macro(log: DataFrame, series: str, event: str, available: str, value: str, names: list[str], start: str, end: str) -> DataFrame:
    """A row for each day from start to end with the last released value of each named series on it."""
    days = calendar(start, end, log.sparkSession, False, "dt")
    every = days.crossJoin(F.broadcast(log.sparkSession.range(1).select(F.explode(F.array(*(F.lit(n) for n in names))).alias(series))))
    latest = log.where(F.col(series).isin(*names)).groupBy(series, F.col(available).cast("date").alias("__a")).agg(F.max_by(value, event).alias(value))
    found = asof_join(every, latest, "dt", [series], [value], "__a")
    return found.groupBy("dt").pivot(series, names).agg(F.max(value))


def selection_status(universe_end: str, eval_start: str, phase: str) -> dict[str, str | bool]:
    """Whether a universe was chosen before it is judged; dates are ISO strings. Training phases may overlap, others not."""
    late = universe_end >= eval_start
    return {"universe_end": universe_end, "eval_start": eval_start, "phase": phase, "point_in_time": not late, "status": "ok" if not late else "in_sample" if phase == "train" else "look_ahead"}


def assert_point_in_time(universe_end: str, eval_start: str, phase: str) -> None:
    if selection_status(universe_end, eval_start, phase)["status"] == "look_ahead":
        raise ValueError(f"the universe ends on {universe_end}, at or after the start of evaluation, {eval_start}")


def universe_end(mode: str, requested: str, eval_start: str, fold_reselect: bool = False) -> str:
    """The last date that selection may see: as requested for "fixed", the day before evaluation for "point_in_time"."""
    from datetime import date, timedelta

    if mode == "fixed" or (mode == "fold" and fold_reselect):
        return requested
    if mode == "point_in_time":
        return min(requested, (date.fromisoformat(eval_start) - timedelta(days=1)).isoformat())
    raise ValueError(f"unknown mode {mode!r}" if mode != "fold" else "selection within folds has to be allowed")
