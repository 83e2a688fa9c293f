"""Statistics of return series: HAC tests, alphas, false discoveries, overfitting, bootstraps and expert mixing.

Sums go through grouped aggregates. Where a step needs the state before it, or random draws, one series at a time goes
through an Arrow grouped map; series are strategies, each no longer than the calendar.
"""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.pairs import BLOCK, SHARES, by_blocks, correlations, distinct, meetings, series
from lodestar.panel import UNBOUNDED, correlation, ratio
from lodestar.session import cut


def hac_mean(df: DataFrame, x: str, time: str, by: str) -> DataFrame:
    """Mean, Newey-West standard error and t of each series; lags floor(4 (n / 100)^(2 / 9)). More than 64 lags fail."""
    w, whole = Window.partitionBy(by).orderBy(time), Window.partitionBy(by)
    rows = df.where(F.col(x).isNotNull()).select(by, time, x).withColumns({"__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(whole), "__e": F.col(x) - F.avg(x).over(whole)})
    lags = rows.withColumn("__l", F.floor(4 * F.pow(F.col("__n") / 100, F.lit(2 / 9))).cast("int"))
    # each row's product with those up to L rows before it, by a window array of bounded length
    most = F.when(F.col("__l") > 64, F.raise_error("a series is too long for the lags held").cast("int")).otherwise(F.col("__l"))
    past = F.collect_list("__e").over(w.rowsBetween(-64, 0))
    terms = lags.withColumn("__past", F.reverse(past)).withColumn(
        "__s", F.aggregate(F.sequence(F.lit(0), F.least(most, F.size("__past") - 1)), F.lit(0.0), lambda a, j: a + F.when(j == 0, 1.0).otherwise(2 * (1 - j / (most + 1))) * F.col("__e") * F.get("__past", j))
    )
    out = terms.groupBy(by).agg(F.avg(x).alias("mean"), F.first("__n").alias("n"), F.sum("__s").alias("__sum"))
    se = F.sqrt(F.greatest(F.col("__sum") / F.col("n"), F.lit(1e-24)) / F.col("n"))
    return out.select(by, "n", "mean", se.alias("se"), (F.col("mean") / se).alias("t"))


def alpha(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Intercept, slope and R² of one factor."""
    return df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def multi_alpha(df: DataFrame, y: str, factors: list[str], by: str) -> DataFrame:
    """Least squares on several factors: the products are summed in one aggregate, the small systems solved row by row."""
    xs = [F.lit(1.0), *map(F.col, factors)]
    k = len(xs)
    full = df.where(F.col(y).isNotNull())
    for f in factors:
        full = full.where(F.col(f).isNotNull())
    sums = full.groupBy(by).agg(F.array(*(F.sum(xs[i] * xs[j]) for i in range(k) for j in range(k))).alias("xx"), F.array(*(F.sum(c * F.col(y)) for c in xs)).alias("xy"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.array(a, float).reshape(k, k), np.array(b, float), rcond=None)[0].tolist() for a, b in zip(xx, xy, strict=True)])

    return sums.select(by, "n", solve("xx", "xy").alias("c")).select(by, "n", F.col("c")[0].alias("alpha"), *(F.col("c")[i + 1].alias(f"beta_{f}") for i, f in enumerate(factors)))


def false_discovery(df: DataFrame, p: str, rate: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: adds adjusted p and whether it is a discovery. One row per test, so one ordered window."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(p))
    raw = df.withColumn("__raw", F.col(p) * n / rank)
    adjusted = F.least(F.min("__raw").over(Window.partitionBy(F.lit(0)).orderBy(p).rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))
    return raw.withColumn("adjusted", adjusted).withColumn("discovery", F.col("adjusted") <= rate).drop("__raw")


def overfitting_probability(df: DataFrame, x: str, time: str, trial: str, blocks: int = 8) -> DataFrame:
    """Share of half-combinations of blocks whose best trial in sample ranks below the median out of sample."""
    dates = df.select(time).distinct()  # the calendar alone is ranked in one task, not the facts
    everything = Window.partitionBy(F.lit(0))
    dates = dates.select(time, F.floor((F.row_number().over(everything.orderBy(time)) - 1) * blocks / F.count(F.lit(1)).over(everything)).cast("int").alias("__b"))
    placed = df.join(F.broadcast(dates), time)
    sums = placed.groupBy(trial, "__b").agg(F.count(x).alias("c"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    halves = df.sparkSession.createDataFrame([(i, b, b in c) for i, c in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)], "combo int, __b int, inside boolean")
    total = sums.join(F.broadcast(halves), "__b").groupBy("combo", trial, "inside").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("c")
    sharpe = total.withColumn("sharpe", mean / (F.sqrt(F.greatest(F.col("q") / F.col("c") - mean * mean, F.lit(0.0))) + 1e-12))
    both = sharpe.groupBy("combo", trial).agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("ins"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("out"))
    n = F.count(F.lit(1)).over(Window.partitionBy("combo"))
    best = both.withColumns({"best": F.row_number().over(Window.partitionBy("combo").orderBy(F.desc("ins"), trial)), "w": F.row_number().over(Window.partitionBy("combo").orderBy("out", trial)) / (n + 1)}).where("best = 1")
    return best.agg(F.avg((F.col("w") < 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("combos"))


def signed_rank(df: DataFrame, x: str, by: str) -> DataFrame:
    """Wilcoxon's statistic with average ties, zeros left out, and its normal z."""
    rows = df.where((F.col(x) != 0) & F.col(x).isNotNull()).withColumn("__a", F.abs(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, "__a"))
    rank = F.rank().over(Window.partitionBy(by).orderBy("__a")) + (ties - 1) / 2
    sums = rows.withColumn("__r", rank).groupBy(by).agg(F.sum(F.when(F.col(x) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return sums.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def deflated_sharpe(df: DataFrame, x: str, by: str) -> DataFrame:
    """Probabilistic Sharpe ratio of each series against the greatest expected of as many trials."""
    v = F.col(x)
    m = [F.sum(F.pow(v, F.lit(float(k)))) / F.count(v) for k in (1, 2, 3, 4)]
    s = df.groupBy(by).agg(F.count(v).alias("n"), *(c.alias(f"m{k + 1}") for k, c in enumerate(m)))
    mean, var = F.col("m1"), F.col("m2") - F.col("m1") * F.col("m1")
    c3 = F.col("m3") - 3 * mean * F.col("m2") + 2 * F.pow(mean, F.lit(3.0))
    c4 = F.col("m4") - 4 * mean * F.col("m3") + 6 * mean * mean * F.col("m2") - 3 * F.pow(mean, F.lit(4.0))
    n = F.col("n")
    g1, g2 = c3 / F.pow(var, F.lit(1.5)), c4 / (var * var)
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g2 - 3) + 6) + 3
    rated = s.select(by, "n", (mean / (F.sqrt(var) + 1e-12)).alias("sr"), skew.alias("skew"), kurt.alias("kurt"))
    everything = Window.partitionBy(F.lit(0))
    rated = rated.withColumns({"__v": F.var_pop("sr").over(everything), "__k": F.count(F.lit(1)).over(everything)})

    @F.pandas_udf("double")
    def probability(sr: pd.Series, n: pd.Series, skew: pd.Series, kurt: pd.Series, v: pd.Series, k: pd.Series) -> pd.Series:
        normal, out = NormalDist(), []
        for a, b, c, d, e, f in zip(sr, n, skew, kurt, v, k, strict=True):
            z = (1 - np.euler_gamma) * normal.inv_cdf(1 - 1 / f) + np.euler_gamma * normal.inv_cdf(1 - 1 / (f * math.e)) if f > 1 else 0.0
            out.append(normal.cdf((a - math.sqrt(e) * z) * math.sqrt(b - 1) / math.sqrt(max(1 - c * a + (d - 1) / 4 * a * a, 1e-12))))
        return pd.Series(out)

    return rated.select(by, "n", "sr", "skew", "kurt", probability("sr", "n", "skew", "kurt", "__v", "__k").alias("dsr"))


def stationary_indices(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """One resampled path: runs of geometric length that wrap around."""
    restart = rng.random(n) < 1 / block
    restart[0] = True
    starts = rng.integers(0, n, n)
    run = np.maximum.accumulate(np.where(restart, np.arange(n), 0))
    return (starts[run] + np.arange(n) - run) % n


def bootstrap_interval(df: DataFrame, x: str, time: str, by: str, block: float = 5.0, replicates: int = 499, seed: int = 0, least: int = 10) -> DataFrame:
    """2.5 % and 97.5 % quantiles of the mean of block-resampled series; null for short ones."""

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(time)[x].dropna().to_numpy()
        if len(v) < least:
            return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(v)], "low": [np.nan], "high": [np.nan]})
        rng = np.random.default_rng(seed)
        means = [v[stationary_indices(len(v), block, rng)].mean() for _ in range(replicates)]
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(v)], "low": [low], "high": [high]})

    kind = dict(df.dtypes)[by]
    return df.select(by, time, x).groupBy(by).applyInPandas(resampled, f"{by} {kind}, n long, low double, high double")


def reality_check(df: DataFrame, x: str, time: str, trial: str, block: float = 5.0, replicates: int = 499, seed: int = 0) -> DataFrame:
    """White's reality check and Hansen's studentised version over all trials; a missing return counts as 0.

    All trials are resampled alike, so a replicate is how often it draws each date: blocks of trials multiply by these
    counts in parallel and the greatest of all blocks is taken. Only the calendar and the counts are on the driver.
    """
    dates = sorted(r[0] for r in df.select(time).distinct().collect())
    n, parts = len(dates), -(-df.select(trial).distinct().count() // 256)
    drawn = np.array([np.bincount(stationary_indices(n, block, np.random.default_rng([seed, r])), minlength=n) for r in range(replicates)], np.float64)
    held = df.sparkSession.sparkContext.broadcast((pd.Index(dates), drawn))

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        index, counts = held.value
        code, names = pd.factorize(pdf[trial])
        v = np.zeros((n, len(names)))
        v[index.get_indexer(pdf[time]), code] = pdf["__x"].fillna(0.0)
        mean, sd, b = v.mean(0), v.std(0) + 1e-12, counts @ v / n
        centre = np.where(math.sqrt(n) * mean / sd >= -math.sqrt(2 * math.log(math.log(max(n, 3)))), mean, 0.0)
        found = {"white": (b - mean).max(1), "hansen": ((b - centre) / sd).max(1), "white_of": mean.max(), "hansen_of": (mean / sd).max()}
        return pd.DataFrame({"r": np.arange(replicates)} | {k: math.sqrt(n) * m for k, m in found.items()})

    cells = df.groupBy(time, trial).agg(F.avg(x).cast("double").alias("__x")).withColumn("__part", F.pmod(F.xxhash64(trial), F.lit(max(parts, 1))))
    most = cells.groupBy("__part").applyInPandas(resampled, "r long, white double, hansen double, white_of double, hansen_of double").groupBy("r").agg(*(F.max(c).alias(c) for c in ("white", "hansen", "white_of", "hansen_of")))
    share = lambda c: F.avg(c.cast("double"))
    return most.agg(share(F.col("white") >= F.col("white_of")).alias("white_p"), share(F.col("hansen") >= F.greatest("hansen_of", F.lit(0.0))).alias("hansen_p"), F.count(F.lit(1)).alias("replicates"))


def unit_losses(df: DataFrame, loss: str, time: str, expert: str) -> DataFrame:
    """Losses scaled to [0, 1] by the range of all experts on strictly earlier dates; 0.5 without a range."""
    daily = df.groupBy(time).agg(F.min(loss).alias("__l"), F.max(loss).alias("__h"))
    w = Window.orderBy(time).rowsBetween(UNBOUNDED, -1)
    past = daily.select(time, F.min("__l").over(w).alias("__l"), F.max("__h").over(w).alias("__h"))
    scaled = ratio(F.col(loss) - F.col("__l"), F.col("__h") - F.col("__l"))
    return df.join(past, time).select(*df.columns, F.when(scaled.isNull(), 0.5).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).alias("unit_loss"))


def log_loss(r, floor: float = 1e-6):
    return -F.ln(F.greatest(1 + r, F.lit(floor)))


def follow_the_leader(df: DataFrame, loss: str, time: str, expert: str) -> DataFrame:
    """Equal weights on the experts with the least cumulative loss before the date; all of them on the first."""
    cum = F.coalesce(F.sum(loss).over(Window.partitionBy(expert).orderBy(time).rowsBetween(UNBOUNDED, -1)), F.lit(0.0))
    led = df.withColumn("__c", cum)
    best = F.col("__c") <= F.min("__c").over(Window.partitionBy(time)) + 1e-15
    return led.withColumn("weight", F.when(best, 1.0).otherwise(0.0) / F.count_if(best).over(Window.partitionBy(time))).drop("__c")


def mix_experts(df: DataFrame, loss: str, time: str, expert: str, experts: list[str], method: str = "adahedge", by: str | None = None, rate: float = 0.5, share: float = 0.05) -> DataFrame:
    """Weights of each date, before its losses are seen: adahedge, hedge, fixed_share, variable_share, boa or page_hinkley;
    eg takes returns in place of losses.

    Sequential in time, so a grouped map over one matrix of dates by experts for each value of ``by``.
    """
    n = len(experts)

    def walk(losses: np.ndarray) -> np.ndarray:
        w, out = np.full(n, 1 / n), np.zeros_like(losses)
        total, gap, drift, held = np.zeros(n), 0.0, 0.0, 0
        for t, x in enumerate(losses):
            if method == "adahedge":
                low = total.min()
                w = (total <= low + 1e-15).astype(float) if gap <= 0 else np.exp(-math.log(n) / gap * (total - low))
                w /= w.sum()
            elif method == "page_hinkley":
                w = np.eye(n)[held] if t else np.full(n, 1 / n)
            out[t] = w
            total = total + x
            if method == "adahedge":
                eta = math.log(n) / gap if gap > 0 else math.inf
                mixed = x[w > 0].min() if eta == math.inf else x.min() - math.log(float(w @ np.exp(-eta * (x - x.min())))) / eta
                gap += max(0.0, float(w @ x) - mixed)
            elif method == "page_hinkley":
                if t:
                    drift = max(0.0, drift + x[held] - x.mean() - 1e-4)
                if drift > 0.02:  # the least cumulative loss, or the next if that is held already
                    order = np.argsort(total, kind="stable")
                    held, drift = int(order[0] if order[0] != held or n == 1 else order[1]), 0.0
            elif method == "boa":
                w = w * np.exp(-rate * x * (1 + rate * x))
                w /= w.sum()
            elif method == "eg":  # losses are returns here
                w = w * np.exp(rate * (1 + x) / max(float(w @ (1 + x)), 1e-12))
                w /= w.sum()
            else:
                w = w * np.exp(-rate * (x - x.min()))
                w /= w.sum()
                if method == "fixed_share" and n > 1:
                    w = (1 - share) * w + share * (1 - w) / (n - 1)
                elif method == "variable_share" and n > 1:
                    keep = (1 - share) ** x
                    pool = float((w * (1 - keep)).sum())
                    w = w * keep + (pool - w * (1 - keep)) / (n - 1)
                w = np.maximum(w, 0)
                w /= w.sum()
        return out

    def mixed_frame(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=time, columns=expert, values=loss, aggfunc="last").reindex(columns=experts).sort_index()
        out = pd.DataFrame(walk(table.fillna(table.max().max()).to_numpy()), index=table.index, columns=experts).stack().rename("weight").reset_index()
        out.columns = [time, expert, "weight"]
        return out.assign(**({by: pdf[by].iloc[0]} if by else {}))[[*([by] if by else []), time, expert, "weight"]]

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ([by] if by else []) + [time, expert]) + ", weight double"
    slim = df.select(*([by] if by else []), time, expert, loss).withColumn("__all", F.lit(0))
    return slim.groupBy(by or "__all").applyInPandas(mixed_frame, schema)


def garch(df: DataFrame, r: str, time: str, by: str, omega: float = 1e-6, a: float = 0.05, b: float = 0.9) -> DataFrame:
    """Recursive variance h = omega + a r² + b h of each series, started at its first squared return: a fold of arrays."""
    listed = df.where(F.col(r).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(time, r))).alias("s"))
    start = F.pow(F.col("s")[0][r], 2)
    last = F.aggregate("s", start, lambda h, x: omega + a * x[r] * x[r] + b * h)
    return listed.select(by, F.size("s").alias("n"), last.alias("variance"))


def garch_path(df: DataFrame, x: str, time: str, by: str, history: int, name: str = "forecast", omega: float = 1e-6, a: float = 0.08, b: float = 0.9) -> DataFrame:
    """Adds the root of the recursive variance of the changes of ``x`` over the last ``history`` rows, the first change being 0.

    A fold over an array of at most ``history`` entries; it starts at the variance of the first 20 changes (or tenth of them).
    """
    w = Window.partitionBy(by).orderBy(time).rowsBetween(-(history - 1), 0)
    held = df.withColumn("__v", F.collect_list(x).over(w))
    n = F.size("__v")
    held = held.withColumn("__c", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, 0.0).otherwise(F.get("__v", i) - F.get("__v", i - 1))))
    held = held.withColumn("__f", F.slice("__c", F.lit(1), F.greatest(F.lit(20), F.floor(n / 10).cast("int"))))
    total = lambda f: F.aggregate("__f", F.lit(0.0), lambda s, v: s + f(v))
    mean = total(lambda v: v) / F.size("__f")
    held = held.withColumn("__h", F.when(n > 5, F.greatest(total(lambda v: v * v) / F.size("__f") - mean * mean, F.lit(0.0))).otherwise(1e-4) + 1e-8)
    last = F.aggregate(F.slice("__c", 1, F.greatest(n - 1, F.lit(0))), F.col("__h"), lambda h, v: F.greatest(omega + a * v * v + b * h, F.lit(1e-12)))
    return held.withColumn(name, F.sqrt(last)).drop("__v", "__c", "__f", "__h")


def distinct_correlation(df: DataFrame, x: str, time: str, entity: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, weights, members): ``pairwise_correlation`` of one name of each set of equal series, and of it with itself;
    (entity, w) of these names, w being the set's size; (__first, __all) of the sets."""
    held, members = distinct(series(df, x, time, entity), entity)
    made = by_blocks(held.drop("w"), entity, correlations, "corr double, n long", own=True)
    return made.withColumn("corr", F.nanvl("corr", F.lit(None).cast("double"))), held.select(entity, "w"), members


def pairwise_correlation(df: DataFrame, x: str, time: str, entity: str, entities: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, corr, n) over common dates of every two entities, or of those in a stated set. The result has a row for each
    pair; it comes from matrix products of blocks of distinct series, and pairs of equal ones are written out after them.

    ``digits``: of ``corr``, rounded before that. Rows of two sets of equal series follow each other, one name after another
    with the other set's in order, so that a columnar file holds them in few bytes.
    """
    few = df if entities is None else df.join(F.broadcast(entities), entity, "left_semi")
    made, weights, members = distinct_correlation(few, x, time, entity)
    if digits is not None:
        made = made.withColumn("corr", F.round("corr", digits) + 0.0)
    if not weights.where("w > 1").limit(1).count():
        return made.where("a < b")
    if weights.count() <= BLOCK * SHARES:  # few rows that become many
        made = made.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = F.broadcast(members.select("__first", F.array_sort("__all")))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = made.select("corr", "n", F.inline(ways)).join(sets.toDF("a", "__a"), "a").join(sets.toDF("b", "__b"), "b")
    rows = both.select("__a", "corr", "n", F.explode("__b").alias("b")).select(F.explode("__a").alias("a"), "b", "corr", "n")
    return rows.where("a < b")


def tail_dependence(df: DataFrame, x: str, time: str, entity: str, entities: DataFrame | None = None, level: float = 0.9) -> DataFrame:
    """Symmetric shares of joint exceedance of each series' own rank quantile, for pairs that exceed it together at all."""
    few = (df if entities is None else df.join(F.broadcast(entities), entity, "left_semi")).where(F.col(x).isNotNull())
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(x, time))
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    hit = few.withColumn("__u", rank / (n + 1)).where(F.col("__u") > level).select(time, entity)
    size = hit.groupBy(entity).agg(F.count(F.lit(1)).alias("c"))
    pairs = by_blocks(cut(series(hit.withColumn("__u", F.lit(1.0)), "__u", time, entity)), entity, meetings, "both long")
    return pairs.join(size.toDF("a", "ca"), "a").join(size.toDF("b", "cb"), "b").select("a", "b", "both", ((F.col("both") / F.col("ca") + F.col("both") / F.col("cb")) / 2).alias("tail_dependence"))
