"""Operators over the entities of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.panel import PANEL, Panel, clip, correlation, ratio
from lodestar.session import cut


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, panel: Panel = PANEL) -> DataFrame:
    """Clips each column to its quantiles of the date. One aggregate by date, joined back; dates are few beside rows."""
    cuts = df.groupBy(panel.time).agg(*(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"__{c}") for c in columns))
    joined = df.join(cuts, panel.time)
    return joined.select(*(F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__{c}")[0]), F.col(f"__{c}")[1])).alias(c) if c in columns else F.col(c) for c in df.columns))


def overall_quantiles(df: DataFrame, column: str, shares: list[float], width: int = 100_000) -> list[float | None]:
    """Exact interpolated quantiles of a whole column, null if it has no values.

    Each rank is enclosed by bounds that a sketch proposes and counts confirm or narrow, until the values between them are at
    most ``width`` or all alike. Only those are sorted, so no task holds the column.
    """
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = v.count()
    if n == 0:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    at: dict[int, float] = {}
    band, below = v, 0  # the values still in question, and how many lie before them
    for first in ranks:
        while first not in at:
            size = band.count()
            if size <= width:
                kept = sorted((r[0] for r in band.collect()), key=lambda x: (x != x, x))  # NaN is the largest, as in ORDER BY
                at |= {r: kept[r - below] for r in ranks if below <= r < below + size}
                break
            share, slack = (first - below) / size, max(width / size / 8, 1e-6)
            low, high = band.agg(F.percentile_approx("v", [max(share - slack, 0.0), min(share + slack, 1.0)], max(10_000, int(4 / slack)))).first()[0]
            c = band.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") == low), F.count_if((F.col("v") > low) & (F.col("v") < high)), F.count_if(F.col("v") == high)).first()
            edges = [below, below + c[0], below + c[0] + c[1], below + c[0] + c[1] + c[2], below + sum(c)]
            at |= {r: low for r in ranks if edges[1] <= r < edges[2]}
            if high > low:
                at |= {r: high for r in ranks if edges[3] <= r < edges[4]}
            if first < edges[1]:
                band = band.where(F.col("v") < low)
            elif first >= edges[4]:
                band, below = band.where(F.col("v") > high), edges[4]
            elif first not in at:
                band, below = band.where((F.col("v") > low) & (F.col("v") < high)), edges[2]
        band, below = v, 0
    return [at[int(p)] + (p - int(p)) * (at[min(int(p) + 1, n - 1)] - at[int(p)]) if p > int(p) else at[int(p)] for p in places]


def winsorize_all(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clips each column to its quantiles over the whole frame, which look ahead: for reports, not for features.

    The frame is written to the shared folder once, as it is read several times.
    """
    df = cut(df)
    cuts = {c: [F.lit(q).cast("double") for q in overall_quantiles(df, c, [low, high])] for c in columns}
    clipped = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), cuts[c][0]), cuts[c][1]))
    return df.select(*(clipped(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def exposure_inputs(df: DataFrame, columns: list[str], panel: Panel = PANEL) -> DataFrame:
    """Columns clipped to the date's quantiles, missing ones 0."""
    return winsorize(df, columns, panel=panel).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def zscore(x: Column, bound: float | None = 3.0, panel: Panel = PANEL) -> Column:
    """Population z of the date; a spread below 1e-12 counts as 1."""
    sd = F.stddev_pop(x).over(panel.section)
    z = (x - F.avg(x).over(panel.section)) / F.when(sd < 1e-12, 1.0).otherwise(sd)
    return z if bound is None else clip(z, -bound, bound)


def normalise(df: DataFrame, columns: list[str], panel: Panel = PANEL) -> DataFrame:
    """The law of the engine: clip to the 1 % and 99 % quantiles, z-score, clip to 3."""
    clipped = winsorize(df, columns, panel=panel)
    return clipped.withColumns({c: zscore(F.col(c), panel=panel) for c in columns})


def ordinal_rank(x: str, panel: Panel = PANEL, within: Column | None = None) -> Column:
    """1 for the least, ties by entity; null values have no rank."""
    keys = [panel.time, F.col(x).isNull()] + ([within] if within is not None else [])
    return F.when(F.col(x).isNotNull(), F.row_number().over(Window.partitionBy(*keys).orderBy(x, panel.entity)))


def average_rank_share(x: str, panel: Panel = PANEL) -> Column:
    """Average-tie rank by the number of values."""
    keys = Window.partitionBy(panel.time, F.col(x).isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(panel.time, F.col(x)))
    return F.when(F.col(x).isNotNull(), (F.rank().over(keys.orderBy(x)) + (ties - 1) / 2) / F.count(F.lit(1)).over(keys))


def leg_weights(df: DataFrame, x: str, q: int = 5, name: str = "weight", panel: Panel = PANEL) -> DataFrame:
    """1/m for the top and -1/m for the bottom n // q, on dates with 2 q values at least; 0 elsewhere."""
    n = F.count(x).over(panel.section)
    m = F.greatest(F.floor(n / q), F.lit(1))
    rank = ordinal_rank(x, panel)
    weight = F.when(rank.isNull() | (n < 2 * q), 0.0).when(rank > n - m, 1 / m).when(rank <= m, -1 / m).otherwise(0.0)
    return df.withColumn(name, weight)


def long_short(df: DataFrame, x: str, label: str, q: int = 5, panel: Panel = PANEL) -> DataFrame:
    """Daily return of the legs: yesterday's characteristic on yesterday's label, both as of their own row."""
    legs = leg_weights(df, x, q, "__w", panel)
    return legs.groupBy(panel.time).agg(F.sum(F.col("__w") * F.coalesce(label, F.lit(0.0))).alias("pnl"), F.sum((F.col("__w") != 0).cast("long")).alias("names"))


def decile_long_short(df: DataFrame, x: str, r: str, n: int = 10, panel: Panel = PANEL) -> DataFrame:
    """Top less bottom mean of the next row's return, by ordinal rank share of the date."""
    marked = df.withColumn("__next", F.lead(r).over(panel.series)).where(F.col(x).isNotNull())
    count = F.count(F.lit(1)).over(panel.section)
    share = ratio(ordinal_rank(x, panel) - 1, count - 1)
    legs = marked.withColumn("__share", share)
    top, bottom = F.avg(F.when(F.col("__share") >= 1 - 1 / n, F.col("__next"))), F.avg(F.when(F.col("__share") <= 1 / n, F.col("__next")))
    return legs.groupBy(panel.time).agg((top - bottom).alias("spread"), F.count("__next").alias("n"))


def information_coefficient(df: DataFrame, x: str, label: str, least: int = 5, panel: Panel = PANEL) -> DataFrame:
    """Correlation of ordinal ranks by date, over rows that have both."""
    both = df.where(F.col(x).isNotNull() & F.col(label).isNotNull())
    ranked = both.withColumns({"__x": ordinal_rank(x, panel), "__y": ordinal_rank(label, panel)})
    return ranked.groupBy(panel.time).agg(correlation("__x", "__y").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ic_decay(df: DataFrame, x: str, r: str, horizons: tuple[int, ...] = (1, 3, 6, 12), panel: Panel = PANEL) -> DataFrame:
    """Mean rank correlation with the return so many rows later; one pass, a row for each horizon and date first."""
    led = df.withColumn("__a", F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead(r, h).over(panel.series).alias("y")) for h in horizons)))
    ahead = led.select(panel.time, panel.entity, x, F.inline("__a"))
    both = ahead.where(F.col(x).isNotNull() & F.col("y").isNotNull())
    rank = lambda c: F.row_number().over(Window.partitionBy(panel.time, "horizon").orderBy(c, panel.entity))
    daily = both.withColumns({"__x": rank(x), "__y": rank("y")}).groupBy("horizon", panel.time).agg(correlation("__x", "__y").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return daily.groupBy("horizon").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("dates"))


def fama_macbeth(df: DataFrame, x: str, label: str, least: int = 5, panel: Panel = PANEL) -> DataFrame:
    """Slopes of the daily regressions: their mean, t-statistic and number."""
    slopes = df.where(F.col(x).isNotNull() & F.col(label).isNotNull()).groupBy(panel.time).agg(F.regr_slope(label, x).alias("slope"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    s = F.col("slope")
    return slopes.agg(F.avg(s).alias("mean_slope"), ratio(F.avg(s), F.stddev_samp(s) / F.sqrt(F.count(s))).alias("t"), F.count(s).alias("dates"))


def orthogonalise(df: DataFrame, columns: list[str], panel: Panel = PANEL) -> DataFrame:
    """Gram-Schmidt by date: each column less its regression on each column before it, one after the other."""
    out = df
    for k, c in enumerate(columns):
        for b in columns[:k]:
            w = panel.section
            slope = ratio(F.covar_pop(c, b).over(w), F.var_pop(F.when(F.col(c).isNotNull(), F.col(b))).over(w))
            mean_c, mean_b = F.avg(F.when(F.col(b).isNotNull(), F.col(c))).over(w), F.avg(F.when(F.col(c).isNotNull(), F.col(b))).over(w)
            out = out.withColumn(c, F.col(c) - mean_c - F.coalesce(slope, F.lit(0.0)) * (F.col(b) - mean_b))
    return out


def relative_to_group(x: str, group: str, panel: Panel = PANEL) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(panel.time, group))


def exposures(df: DataFrame, weight: str, columns: list[str], panel: Panel = PANEL) -> DataFrame:
    return df.groupBy(panel.time).agg(*(F.sum(F.col(weight) * F.coalesce(c, F.lit(0.0))).alias(f"exposure_{c}") for c in columns))


def group_hhi(df: DataFrame, weight: str, group: str, panel: Panel = PANEL) -> DataFrame:
    """Sum of squares of the absolute weight of each group, as a share of all."""
    held = df.groupBy(panel.time, group).agg(F.sum(F.abs(weight)).alias("__g"))
    return held.groupBy(panel.time).agg(ratio(F.sum(F.col("__g") * F.col("__g")), F.pow(F.sum("__g"), 2)).alias("hhi"))


def frequent_groups(df: DataFrame, group: str, k: int = 11) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(k)


def best_of(scores: dict[str, Column], margin: float = 0.25, otherwise: str = "mixed") -> Column:
    """The name of the largest score if it leads the next by the margin."""
    ranked = F.sort_array(F.array(*(F.struct((-F.coalesce(v, F.lit(-1e300))).alias("s"), F.lit(k).alias("name")) for k, v in scores.items())))
    return F.when(ranked[1]["s"] - ranked[0]["s"] >= margin, ranked[0]["name"]).otherwise(otherwise)
