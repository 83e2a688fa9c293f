"""Choosing a universe: liquidity, clusters, tail hypergraphs, residual communities, sleeves, quotas, swaps and packing.

Scores and correlations over all names are DataFrames. Choices that look at what is already chosen (quotas, trims, swaps,
caps on change) run over a row of scores for each candidate of one rebalance, as plain functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.clusters import Packed, central, clustered, grouped, merges
from lodestar.operators.pairs import series
from lodestar.panel import PANEL, Panel, finite, ratio
from lodestar.session import by_key, cut

#: Sleeves, and the order in which their quotas are filled.
SLEEVES = ("trend", "reversal", "carry", "defensive", "lottery", "illiquid", "core")
FILL_ORDER = ("illiquid", "lottery", "defensive", "carry", "reversal", "trend", "core")


def liquid(df: DataFrame, x: str, k: int, panel: Panel = PANEL) -> DataFrame:
    """The k entities with the best coverage of all dates, then the least volatility (population)."""
    dates = df.select(panel.time).distinct().count()
    rated = df.groupBy(panel.entity).agg((F.count(x) / F.lit(float(dates))).alias("coverage"), F.stddev_pop(x).alias("vol"))
    inverse = F.when(F.col("vol") > 0, 1 / F.col("vol")).otherwise(0.0)
    return rated.withColumn("inverse_vol", inverse).orderBy(F.desc("coverage"), F.desc("inverse_vol"), panel.entity).limit(k)


def eligible(df: DataFrame, signals: list[str], last: Column, days: int = 63, least: int = 21, volume: str | None = None, floor: float = 0.0, most_missing: float = 1.0, panel: Panel = PANEL) -> DataFrame:
    """Entities with at least ``least`` values of every signal on the last ``days`` dates up to ``last``, and, if a volume is
    given, a mean of at least the floor and no more than a share of it missing."""
    dates = df.select(panel.time).where(F.col(panel.time) <= last).distinct()
    recent = dates.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(panel.time)))).where(F.col("__r") <= days)
    rows = df.join(F.broadcast(recent.select(panel.time)), panel.time)
    held = [F.count(s).alias(f"n_{s}") for s in signals]
    if volume:
        held += [F.avg(volume).alias("mean_volume"), (1 - F.count(volume) / F.lit(float(days))).alias("missing")]
    out = rows.groupBy(panel.entity).agg(*held)
    for s in signals:
        out = out.where(F.col(f"n_{s}") >= least)
    return out.where((F.coalesce("mean_volume", F.lit(0.0)) >= floor) & (F.col("missing") <= most_missing)) if volume else out


def less_illiquid(df: DataFrame, x: str, share: float = 0.1, panel: Panel = PANEL) -> DataFrame:
    """Entities whose median illiquidity isn't among the highest ``share``."""
    m = df.groupBy(panel.entity).agg(F.percentile(x, F.lit(0.5)).alias("median")).where("median is not null")
    cut = m.agg(F.percentile("median", F.lit(1 - share)).alias("__cut"))
    return m.crossJoin(F.broadcast(cut)).where(F.col("median") <= F.col("__cut")).drop("__cut")


def average_linkage(distance: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Cluster of each item, numbered by first member: nearest pairs of clusters by mean distance are merged until k are left.

    The merged distances follow from the parts', so a merge costs a row; ties go to the first pair. With ``own`` the distances
    are overwritten instead of copied.
    """
    n = len(distance)
    d = distance if own and distance.dtype == float else distance.astype(float)
    label = np.arange(n)
    for i, j, _ in merges(d, k, np.ones(n)):
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def central_members(v: np.ndarray, k: int) -> list[int]:
    """One column of each of k clusters by absolute correlation: that with the least mean distance to its cluster. Missing values count as 0."""
    if v.shape[1] <= 1:
        return list(range(min(k, v.shape[1])))
    z = np.nan_to_num(v).T
    at = [np.flatnonzero(row) for row in z]
    return central(Packed.of(at, [row[i] for row, i in zip(z, at, strict=True)], len(v)), k)


def dense_set(edge: np.ndarray, score: np.ndarray, k: int) -> list[int]:
    """Greedy: the best score first, then whatever has the most weight to those chosen, among the 2 k best scores."""
    pool = list(np.argsort(-score, kind="stable")[: max(2 * k, k)])
    chosen = [max(pool, key=lambda i: score[i])]
    pool.remove(chosen[0])
    while len(chosen) < k and pool:
        best = max(pool, key=lambda i: (edge[i, chosen].sum(), score[i]))
        chosen.append(best)
        pool.remove(best)
    return [int(i) for i in chosen]


def tail_hypergraph(v: np.ndarray, level: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric tail dependence of columns, and each column's joint exceedance with the mean of all."""
    t = len(v)
    rank = lambda a: np.argsort(np.argsort(a, axis=0, kind="stable"), axis=0, kind="stable") + 1.0
    over = rank(v) / (t + 1) > level
    joint = over.T.astype(float) @ over
    lam = joint / np.maximum(over.sum(0), 1)[:, None]
    edge = (lam + lam.T) / 2
    np.fill_diagonal(edge, 0.0)
    top = rank(v.mean(1)) / (t + 1) > level
    return edge, (over & top[:, None]).sum(0) / max(top.sum(), 1)


#: Selectors by name: a window of returns (dates by names), and how many names; places of those chosen.
SELECTORS: dict[str, Callable[[np.ndarray, int], list[int]]] = {
    "clusters": central_members,
    "liquidity": lambda v, k: sorted(sorted(range(v.shape[1]), key=lambda i: (-np.isfinite(v[:, i]).mean(), np.nanstd(v[:, i]) if np.nanstd(v[:, i]) > 0 else np.inf))[:k]),
    "tail_hypergraph": lambda v, k: sorted(dense_set(*tail_hypergraph(np.nan_to_num(v)), k)),
}


def select_by(df: DataFrame, x: str, rebalances: DataFrame, selector: str | Callable, k: int = 10, days: int = 365, least: int = 40, panel: Panel = PANEL) -> DataFrame:
    """(rebalance, slot, entity): a selector applied to the strictly earlier rows of each rebalance date; dates run in parallel.

    Clusters and the tail hypergraph take a series once for all rebalances; a window of clusters is one task's values, without a
    matrix of all names. For other selectors a window is one task's table.
    """
    from lodestar.operators.sequential import trailing_blocks
    from lodestar.operators.windows import by_window, tails, windows

    if selector == "tail_hypergraph":
        return tails(windows(df, x, rebalances, days, least, panel), k, 0.9, dense_set)
    if selector == "clusters":

        def centres(names: np.ndarray, p: Packed) -> pd.DataFrame:
            places = central(p, min(k, len(p)))
            return pd.DataFrame({"slot": range(len(places)), panel.entity: names[places]})

        return by_window(windows(df, x, rebalances, days, least, panel), centres, f"slot int, {panel.entity} {dict(df.dtypes)[panel.entity]}")
    choose = SELECTORS[selector] if isinstance(selector, str) else selector

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=panel.time, columns=panel.entity, values=x, aggfunc="last").sort_index().sort_index(axis=1)
        m = m.loc[:, m.notna().sum() >= least]
        if not m.shape[1]:
            return pd.DataFrame(columns=["rebalance", "slot", panel.entity])
        places = choose(m.to_numpy(float), min(k, m.shape[1]))
        return pd.DataFrame({"rebalance": pdf["rebalance"].iloc[0], "slot": range(len(places)), panel.entity: m.columns[places]})

    kinds = dict(df.dtypes)
    return trailing_blocks(df, x, rebalances, days, panel).groupBy("rebalance").applyInPandas(chosen, f"rebalance {kinds[panel.time]}, slot int, {panel.entity} {kinds[panel.entity]}")


def residuals(df: DataFrame, r: str, factors: list[str], panel: Panel = PANEL) -> DataFrame:
    """Adds ``residual`` of each entity's regression on the factors over the frame; null for fewer rows than coefficients and two."""
    k = len(factors) + 1
    full = df.where(F.col(r).isNotNull())
    for f in factors:
        full = full.where(F.col(f).isNotNull())
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in factors)]
    sums = full.groupBy(panel.entity).agg(F.array(*(F.sum(a * b) for a in x for b in x)).alias("__a"), F.array(*(F.sum(a * F.col(r)) for a in x)).alias("__b"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k + 2)

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(np.linalg.pinv(np.array(m, float).reshape(k, k)) @ np.array(v, float)).tolist() for m, v in zip(a, b, strict=True)])

    fit = sums.select(panel.entity, solve("__a", "__b").alias("__c"))
    c = F.col("__c")
    return df.join(fit, panel.entity, "left").withColumn("residual", F.col(r) - sum((c[i] * x[i] for i in range(k)), F.lit(0.0))).drop("__c")


def communities(df: DataFrame, x: str, groups: Column, n: int = 8, least: int = 5, panel: Panel = PANEL) -> DataFrame:
    """(group, entity, community): clusters of entities by the absolute correlation of a residual, for each group of rows.

    A group's values are one task's, without a matrix of all names. Names with fewer than ``least`` values are left out; with 0,
    those without any are part, as far from all others as can be.
    """
    kind = dict(df.dtypes)[panel.entity]
    rows = df.select(groups.cast("string").alias("group"), panel.entity, panel.time, finite(F.col(x).cast("double")).alias(x))
    held = series(rows, x, panel.time, panel.entity, ["group"]).where(F.size("t") >= least)

    def labelled(group: str | None, pdf: pd.DataFrame) -> pd.DataFrame:
        t, v = pdf["t"].tolist(), pdf["x"].tolist()
        times = np.unique(np.concatenate(t))
        label = clustered(Packed.of([np.searchsorted(times, i) for i in t], v, len(times)), n)[0]
        return pd.DataFrame({"group": group, panel.entity: pdf[panel.entity], "community": label})

    count = held.sparkSession.conf.get("spark.sql.shuffle.partitions")
    lying = held.repartition(int(count), "group").sortWithinPartitions("group", panel.entity)
    return lying.mapInPandas(lambda batches: grouped(batches, "group", labelled), f"group string, {panel.entity} {kind}, community int")


def sleeve_scores(df: DataFrame, residual: str, beta: str, adv: str, signals: dict[str, str], panel: Panel = PANEL) -> DataFrame:
    """A row for each entity: six style z-scores and the rank within sleeves, from rows up to one date.

    ``signals`` names columns for iv, hv, skew, term and skewness, whose last values count (0 where there is none). Trend is
    the residual sum of the last 252 rows without the newest 21, reversal the negative of those 21.
    """
    newest = Window.partitionBy(panel.entity).orderBy(F.desc(panel.time))
    last = lambda c: F.coalesce(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(panel.time))), F.lit(0.0))
    rows = df.withColumn("__i", F.row_number().over(newest)).withColumn("__e", F.coalesce(residual, F.lit(0.0)))
    within = lambda low, high: F.when(F.col("__i").between(low, high), F.col("__e"))
    raw = rows.groupBy(panel.entity).agg(
        F.coalesce(F.sum(within(22, 252)), F.lit(0.0)).alias("trend"), (-F.sum(within(1, 21))).alias("reversal"), F.stddev_samp(within(1, 63)).alias("sigma"), F.max_by(beta, panel.time).alias("beta"),
        F.percentile(adv, F.lit(0.5)).alias("adv"), *(last(c).alias(f"__{n}") for n, c in signals.items()),
    )
    whole = Window.partitionBy(F.lit(0))  # a row for each entity of the pool

    def z(c: Column) -> Column:
        sd = F.stddev_pop(c).over(whole)
        return F.coalesce(F.when(sd >= 1e-12, (c - F.avg(c).over(whole)) / sd), F.lit(0.0))

    ties = F.count(F.lit(1)).over(Window.partitionBy("adv"))
    share = (F.rank().over(Window.partitionBy(F.lit(0)).orderBy("adv")) + (ties - 1) / 2) / F.count(F.lit(1)).over(whole)
    s = lambda n: F.col(f"__{n}")
    one = raw.withColumns({"__c": s("iv") - s("hv"), "__l": F.coalesce("sigma", F.lit(0.0)) + F.abs(s("skew")), "__q": -share, "__zs": z(F.col("sigma")), "__zb": z(F.col("beta")),
                           "__i": z(F.abs(s("hv") - s("iv"))) + z(F.abs(s("skew"))) + z(F.abs(s("term"))) + z(F.abs(s("skewness"))), "trend": z(F.col("trend")), "reversal": z(F.col("reversal"))})
    two = one.withColumns({"carry": z(F.col("__c")), "defensive": z((-F.col("__zs") - F.col("__zb")) / 2), "lottery": z(F.col("__l")), "illiquid": z(F.col("__q")), "__zt": z(F.abs("trend")), "__zi": z(F.col("__i"))})
    out = two.withColumn("within_rank", 0.4 * F.col("__zs") + 0.3 * F.col("__zi") + 0.3 * F.col("__zt"))
    return out.select(panel.entity, *SLEEVES[:-1], "within_rank", F.col("sigma"))


def fill_quotas(scores: pd.DataFrame, quotas: dict[str, int], community: dict, most: int, stratum: dict | None = None, targets: dict[str, float] | None = None, k: int | None = None) -> tuple[dict, dict, dict]:
    """(primary sleeve by name, members by sleeve, shortfall by sleeve): sleeves in FILL_ORDER take their best names.

    ``scores`` is indexed by name. A style sleeve considers names whose best style it is, by score and rank within; core takes
    the rest by rank. A community may be taken ``most`` times, a stratum up to its target share and one name. Members of a
    sleeve are also those chosen whose z in it is above 0.5.
    """
    styles = [c for c in SLEEVES[:-1] if c in scores.columns]
    best, total = scores[styles].idxmax(axis=1), k or sum(quotas.values())
    primary: dict = {}
    short, taken, strata = {}, Counter(), Counter()
    for sleeve in FILL_ORDER:
        want = int(quotas.get(sleeve, 0))
        pool = scores if sleeve == "core" else scores[best == sleeve]
        order = ["within_rank"] if sleeve == "core" else [sleeve, "within_rank"]
        got = 0
        for name in pool.sort_values(order, ascending=False, kind="stable").index:
            if got >= want:
                break
            own = (stratum or {}).get(name)
            full = own is not None and targets is not None and (strata[own] + 1) / total > targets.get(own, 1.0) + 1 / total
            if name in primary or taken[community.get(name, -1)] >= most or full:
                continue
            primary[name] = sleeve
            taken[community.get(name, -1)] += 1
            strata[own] += 1
            got += 1
        short[sleeve] = max(0, want - got)
    members = {s: [n for n, p in primary.items() if p == s or (s in styles and scores.at[n, s] > 0.5)] for s in SLEEVES}
    return primary, members, short


def variance_share(chosen: list, part: list, residual: pd.DataFrame) -> float:
    """Share of the variance of the equal-weight portfolio of the chosen that a part of them would have alone."""
    names = [c for c in chosen if c in residual.columns]
    if not names or len(residual) < 2:
        return 0.0
    cov = np.atleast_2d(np.cov(residual[names].fillna(0.0).to_numpy(float), rowvar=False))
    w = np.full(len(names), 1 / len(names))
    own = np.where([n in set(part) for n in names], w, 0.0)
    whole = w @ cov @ w
    return float(own @ cov @ own / whole) if whole > 1e-18 else 0.0


def trim_lottery(primary: dict, residual: pd.DataFrame, cap: float, refill: list | None = None) -> dict:
    """Takes lottery names away, the most volatile first, until their variance share is within the cap; the next unused
    candidate comes in as core for each."""
    out, spare = dict(primary), [n for n in refill or [] if n not in primary]
    sd = residual.std(axis=0)
    while True:
        lottery = [n for n, s in out.items() if s == "lottery"]
        if not lottery or variance_share(list(out), lottery, residual) <= cap + 1e-12:
            return out
        del out[max(lottery, key=lambda n: sd.get(n, 0.0))]
        if spare:
            out[spare.pop(0)] = "core"


def repair(primary: dict, rank: dict, candidates: list, passes: Callable[[dict], bool], community: dict, most: int, rounds: int = 10) -> tuple[dict, int]:
    """Swaps the lowest-ranked name for the next candidate whose community has room, until the gates pass."""
    out = dict(primary)
    for done in range(rounds):
        if passes(out):
            return out, done
        worst = min(out, key=lambda n: (rank.get(n, 0.0), list(out).index(n)))
        rest = Counter(community.get(n, -1) for n in out if n != worst)
        new = next((c for c in candidates if c not in out and rest[community.get(c, -1)] < most), None)
        if new is None:
            return out, done + 1
        sleeve = out.pop(worst)
        out[new] = sleeve
    return out, rounds


def capped_change(held: list, proposed: list, cap: float, rank: dict | None = None) -> list:
    """At most floor(cap * k) new names: those kept, then newcomers by rank, then former ones by rank, then what was proposed."""
    if not held:
        return list(proposed)
    k, room = len(held), int(np.floor(cap * len(held) + 1e-12))
    order = lambda n: (-(rank or {}).get(n, 0.0), n not in set(held), n)
    out = [n for n in held if n in set(proposed)]
    out += sorted((n for n in proposed if n not in set(held)), key=order)[: min(room, k - len(out))]
    out += sorted((n for n in held if n not in out), key=order)[: max(0, k - len(out))]
    return out[:k]


def packed(community: dict, names: list) -> list[tuple]:
    """(name, shard) by community and name: communities lie together, and are numbered in order."""
    order = sorted(names, key=lambda n: (community.get(n, -1), n))
    shard = {c: i for i, c in enumerate(sorted({community.get(n, -1) for n in names}))}
    return [(n, shard[community.get(n, -1)]) for n in order]


def packed_frame(df: DataFrame, entity: str, community: str) -> DataFrame:
    """Adds ``slot`` and ``shard``: names of a community lie together."""
    w = Window.orderBy(community, entity)  # a row for each name of a universe
    return df.withColumns({"slot": F.row_number().over(w) - 1, "shard": F.dense_rank().over(Window.orderBy(community)) - 1})


def ridge_signal(df: DataFrame, residual: str, shrink: float = 1.0, panel: Panel = PANEL) -> DataFrame:
    """(entity, signal): mean residuals drawn towards their mean."""
    m = df.groupBy(panel.entity).agg(F.coalesce(F.avg(residual), F.lit(0.0)).alias("__m"))
    return m.select(panel.entity, ((F.col("__m") + shrink * F.avg("__m").over(Window.partitionBy(F.lit(0)))) / (1 + shrink)).alias("signal"))


def transfer_coefficient(signal: np.ndarray, project: Callable[[np.ndarray], np.ndarray], floor: float = 0.3) -> tuple[float, bool]:
    """Correlation of wished-for weights (demeaned, absolute sum 1) with what a projection leaves of them, and whether it reaches the floor."""
    w = signal - signal.mean()
    w = w / np.abs(w).sum() if np.abs(w).sum() > 1e-12 else w
    left = project(w)
    out = float(np.corrcoef(w, left)[0, 1]) if w.std() > 1e-15 and left.std() > 1e-15 else 0.0
    return (out, out >= floor) if np.isfinite(out) else (0.0, False)


def participation(df: DataFrame, weight: str, adv: str, books: tuple[float, ...], spread_bps: float = 5.0, impact: float = 0.5, panel: Panel = PANEL) -> DataFrame:
    """(book, cost, most_participation): spread and square-root impact of trading into the weights at each size of the book."""
    sizes = F.explode(F.array(*(F.lit(float(b)) for b in books))).alias("book")
    rows = df.select(F.abs(F.coalesce(weight, F.lit(0.0))).alias("__w"), F.col(adv).alias("__v"), sizes)
    part = F.when(F.col("__v") > 0, F.col("__w") * F.col("book") / F.col("__v")).otherwise(F.col("__w"))
    return rows.groupBy("book").agg((spread_bps / 1e4 * F.sum("__w") + impact / 1e4 * F.sum(F.sqrt(part))).alias("cost"), F.max(part).alias("most_participation"))


def masked_members(df: DataFrame, members: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Values of entities that aren't members on the date become missing; rows stay."""
    marked = df.join(members.select(*keys).distinct().withColumn("__in", F.lit(True)), keys, "left")
    return marked.select(*(F.when(F.col("__in"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def far_from_equal(paths: DataFrame, by: str, l1: str, least: float) -> DataFrame:
    """Leaves out strategies whose mean distance from equal weights is below ``least``."""
    keep = paths.groupBy(by).agg(F.avg(l1).alias("__d")).where(F.col("__d") >= least).select(by)
    return paths.join(keep, by, "left_semi")


def reported_returns(df: DataFrame, adjusted: str, reported: str, first: int = 3, tolerance: float = 1e-4, panel: Panel = PANEL) -> DataFrame:
    """(entity, checked, off, worst): returns implied by adjusted prices against reported ones, on each entity's first rows."""
    implied = ratio(F.col(adjusted), F.lag(adjusted).over(panel.series)) - 1
    rows = df.withColumns({"__d": F.abs(implied - F.col(reported))}).where("__d is not null").withColumn("__i", F.row_number().over(panel.series)).where(F.col("__i") <= first)
    return rows.groupBy(panel.entity).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("__d") > tolerance).alias("off"), F.max("__d").alias("worst"))


@dataclass(frozen=True)
class Spec:
    """What a universe of k names has to look like."""

    k: int = 30
    quotas: tuple[tuple[str, int], ...] = (("trend", 5), ("reversal", 4), ("carry", 4), ("defensive", 5), ("lottery", 3), ("illiquid", 3), ("core", 6))
    communities: int = 8
    most_of_community: int = 8
    adv_floor: float = 0.0
    illiquid_share: float = 0.1
    lottery_cap: float = 0.25
    change_cap: float = 0.3
    lookback: int = 252
    transfer_floor: float = 0.0


def _chosen(rows: DataFrame, stages: list, put: Callable, until: Column, factors: list[str], beta: str, adv: str, illiquidity: str, signals: dict[str, str], r: str, required: list[str] | None, spec: Spec, project: Callable | None, panel: Panel) -> tuple:
    """(sleeve by chosen name, community by name, scores, stages) of ``choose_universe``."""

    def narrowed(name: str, keep: DataFrame) -> DataFrame:
        kept = cut(keep.select(panel.entity))
        stages.append((name, kept.count()))
        return rows.join(kept, panel.entity, "left_semi")

    medians = rows.groupBy(panel.entity).agg(F.percentile(adv, F.lit(0.5)).alias("m")).where(F.col("m") >= spec.adv_floor)
    rows = narrowed("volume", medians)
    rows = narrowed("illiquidity", less_illiquid(rows, illiquidity, spec.illiquid_share, panel))
    rows = narrowed("coverage", eligible(rows, required or [r], until, 63, 5, panel=panel))
    if stages[-1][1] < spec.k:
        raise ValueError(f"{stages[-1][1]} names are left, {spec.k} are needed: {stages}")
    newest = Window.partitionBy(panel.entity).orderBy(F.desc(panel.time))
    recent = residuals(rows, r, factors, panel).withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= spec.lookback)
    recent = put(recent.select(*dict.fromkeys([panel.entity, panel.time, "residual", beta, adv, *signals.values()])))
    scores = sleeve_scores(recent, "residual", beta, adv, signals, panel).toPandas().set_index(panel.entity).sort_index()
    grouped = communities(recent, "residual", F.lit("all"), spec.communities, 0, panel).toPandas()
    community = dict(zip(grouped[panel.entity].tolist(), grouped["community"].tolist(), strict=True))
    primary, _, _ = fill_quotas(scores, dict(spec.quotas), community, spec.most_of_community, k=spec.k)
    ranked = scores.sort_values("within_rank", ascending=False, kind="stable").index.tolist()
    taken = Counter(community[n] for n in primary)
    for n in ranked:  # quotas that couldn't be met are made up by rank
        if len(primary) < spec.k and n not in primary and taken[community[n]] < spec.most_of_community:
            primary[n] = "core"
            taken[community[n]] += 1
    if len(primary) < spec.k:
        raise ValueError(f"{len(primary)} of {spec.k} names could be chosen: {spec.communities} communities of {spec.most_of_community} at most")
    primary = dict(list(primary.items())[: spec.k])
    spare = [n for n in ranked if n not in primary][: sum(s == "lottery" for s in primary.values())]
    known = recent.where(F.col("residual").isNotNull())
    dates = sorted(row[0] for row in known.select(panel.time).distinct().collect())
    table = known.where(F.col(panel.entity).isin([*primary, *spare])).select(panel.entity, panel.time, "residual").toPandas()
    table = table.pivot_table(index=panel.time, columns=panel.entity, values="residual", aggfunc="last").reindex(index=dates, columns=[*primary, *spare])
    primary = trim_lottery(primary, table, spec.lottery_cap, ranked)
    if project is not None:
        mean = known.groupBy(panel.entity).agg(F.avg("residual").alias("m")).toPandas().set_index(panel.entity)["m"].reindex(scores.index).fillna(0.0)
        passes = lambda chosen: transfer_coefficient(mean[list(chosen)].to_numpy(), project, spec.transfer_floor)[1]
        primary, _ = repair(primary, scores["within_rank"].to_dict(), ranked, passes, community, spec.most_of_community)
        if not passes(primary):
            raise ValueError("the transfer gate isn't passed after swaps")
    return primary, community, scores, stages


def choose_universe(df: DataFrame, as_of: str, factors: list[str], beta: str, adv: str, illiquidity: str, signals: dict[str, str], r: str = "r", required: list[str] | None = None, spec: Spec = Spec(), project: Callable[[np.ndarray], np.ndarray] | None = None, incumbent: list | None = None, panel: Panel = PANEL) -> tuple[pd.DataFrame, list[tuple[str, int]]]:
    """The universe of an as-of date, with its sleeves, communities and slots, and the names left after each stage.

    Floors on volume, illiquidity and coverage, residuals on factors and style scores are DataFrames over the whole panel up
    to the date, which is dealt out by name once; communities are one task's values of the pool that is left. A row of scores for each of its names comes to the
    driver, and the residuals of those chosen and of as many spare ones as may take a lottery name's place. There, quotas, the
    lottery budget, the transfer gate with swaps, the cap on change and packing choose one name after another.
    """
    until = F.lit(as_of).cast("date")
    needed = dict.fromkeys([panel.entity, panel.time, r, *factors, beta, adv, illiquidity, *signals.values(), *(required or [])])
    with ExitStack() as held:
        put = lambda d: held.enter_context(by_key(d, panel.entity, panel.time))
        rows = put(df.where(F.col(panel.time) <= until).select(*needed))  # each stage reads it
        stages = [("pool", rows.select(panel.entity).distinct().count())]
        primary, community, scores, stages = _chosen(rows, stages, put, until, factors, beta, adv, illiquidity, signals, r, required, spec, project, panel)
    names = capped_change(incumbent, list(primary), spec.change_cap, scores["within_rank"].to_dict()) if incumbent else list(primary)
    stages.append(("chosen", len(names)))
    slots = packed(community, names)
    out = pd.DataFrame({panel.entity: [n for n, _ in slots], "slot": range(len(slots)), "shard": [c for _, c in slots]})
    return out.assign(sleeve=[primary.get(n, "core") for n in out[panel.entity]], community=[community.get(n, -1) for n in out[panel.entity]]), stages
