"""Trailing windows of rebalance dates over all names, a block of names at a time.

A series is read once for all rebalances. What a window needs of all names is a sum over blocks (a matrix of its dates, a
vector, the best few names), so no task has a window's names, and no matrix has a row and a column a name. Missing values of
a window are 0; its dates are those on which any name has a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.clusters import Packed, grouped
from lodestar.operators.pairs import instant, moment, series
from lodestar.operators.sequential import NAMES, parts, points
from lodestar.panel import Panel, finite
from lodestar.session import cut

#: Names of a task that adds up matrices of dates: so many at least.
TASK = 4096
#: Digits in which correlations are compared, so that equal series tie and the first name wins.
DIGITS = 12


@dataclass(frozen=True)
class Windows:
    """Series, all their instants, and for each rebalance its instant and the places of its window's first date and of the one after its last."""

    held: DataFrame
    times: np.ndarray
    spans: list[tuple[int, int, int]]
    least: int
    panel: Panel
    kinds: tuple[str, str]

    def rows(self, made: Callable, columns: str) -> DataFrame:
        """Frames that ``made`` yields from an iterator of (rebalance's place, names, values by dates, numbers of values)."""
        times, spans, least, entity, size = self.times, self.spans, self.least, self.panel.entity, NAMES

        def blocks(batches):
            for own, v in parts(batches, entity, times, size):
                have = np.isfinite(v)
                v[~have] = 0.0
                for i, (_, low, high) in enumerate(spans):
                    n = have[:, low:high].sum(1)
                    keep = (n >= least) if high > low else np.zeros(len(own), bool)
                    if keep.any():
                        yield i, own[keep], v[keep, low:high], n[keep]

        return points(self.held, self.panel).mapInPandas(lambda batches: made(blocks(batches)), columns)

    def dated(self, df: DataFrame, *columns: str) -> DataFrame:
        """(rebalance, columns) of rows with a rebalance's place ``i``."""
        at = F.array(*(F.lit(t) for t, _, _ in self.spans))
        return df.select(moment(at[F.col("i")], self.kinds[0]).alias("rebalance"), *columns)


def windows(df: DataFrame, x: str, rebalances: DataFrame, days: int, least: int, panel: Panel) -> Windows:
    """The strictly earlier rows within so many days of each rebalance date. One row a date and a rebalance reaches the driver."""
    kinds = dict(df.dtypes)
    kind = kinds[panel.time]
    held = cut(series(df.select(panel.entity, panel.time, finite(F.col(x).cast("double")).alias(x)), x, panel.time, panel.entity))
    times = np.array(sorted(r[0] for r in held.select(F.explode("t")).distinct().collect()), dtype=np.int64)
    at = rebalances.select(F.col(panel.time).cast(kind)).where(F.col(panel.time).isNotNull()).distinct()
    at = at.withColumn("__from", F.date_sub(panel.time, days).cast(kind)).select(instant(df.select(panel.time), panel.time).alias("to"), F.col("__from").alias(panel.time))
    at = at.select("to", instant(df.select(panel.time), panel.time).alias("from")).collect()
    spans = sorted((int(to), int(np.searchsorted(times, begin)), int(np.searchsorted(times, to))) for to, begin in at)
    return Windows(held, times, spans, least, panel, (kind, kinds[panel.entity]))


def by_window(w: Windows, made: Callable[[np.ndarray, Packed], pd.DataFrame], columns: str) -> DataFrame:
    """(rebalance, columns): frames ``made`` from a window's names in order and their values. A task has a window's values at once."""
    entity, kind, spans = w.panel.entity, w.kinds[1], w.spans

    def packed(blocks):
        for i, own, v, _ in blocks:
            at = [np.flatnonzero(row).astype(np.int32) for row in v]
            yield pd.DataFrame({"i": i, entity: own, "at": [a.tobytes() for a in at], "x": [row[a].tobytes() for row, a in zip(v, at, strict=True)]})

    def whole(i: int, pdf: pd.DataFrame) -> pd.DataFrame:
        _, low, high = spans[i]
        p = Packed.of([np.frombuffer(b, np.int32) for b in pdf["at"]], [np.frombuffer(b) for b in pdf["x"]], high - low)
        return made(pdf[entity].to_numpy(), p).assign(i=i)

    rows = w.rows(packed, f"i int, {entity} {kind}, at binary, x binary")
    lying = rows.repartition(max(1, len(spans)), "i").sortWithinPartitions("i", entity)
    done = lying.mapInPandas(lambda batches: grouped(batches, "i", whole), f"{columns}, i int")
    return w.dated(done, *(c.split()[0] for c in columns.split(", ")))


def _centred(v: np.ndarray) -> np.ndarray:
    """Rows less their means; rows that don't vary are 0."""
    z = v - v.mean(1, keepdims=True)
    z[(v == v[:, :1]).all(1)] = 0.0
    return z


def _unit(v: np.ndarray) -> np.ndarray:
    z = _centred(v)
    length = np.sqrt((z * z).sum(1, keepdims=True))
    return np.divide(z, length, out=z, where=length > 0)


def furthest(w: Windows, k: int) -> DataFrame:
    """(rebalance, slot, entity): the name with most values first, then k - 1 times that whose greatest correlation with those
    chosen is least. A pass over all names for each; the chosen ones' windows are what goes from one to the next."""
    entity, kind = w.panel.entity, w.kinds[1]
    chosen: list[list] = [[] for _ in w.spans]
    taken: list[list] = [[] for _ in w.spans]
    for _ in range(k):
        units = [np.array(c).T for c in taken]

        def best(blocks, units=units, chosen=chosen):
            found: dict = {}
            for i, own, v, n in blocks:
                if chosen[i]:
                    key = np.round((_unit(v) @ units[i]).max(1), DIGITS) + 0.0
                    key[np.isin(own, np.array(chosen[i], own.dtype))] = np.inf
                else:
                    key = -n.astype(float)
                at = np.flatnonzero(key == key.min())
                j = at[own[at].argmin()]
                if np.isfinite(key[j]) and (i not in found or (key[j], own[j]) < found[i][:2]):
                    found[i] = (key[j], own[j], v[j].copy())
            yield pd.DataFrame([(i, *f) for i, f in found.items()], columns=["i", "key", entity, "v"])

        rows = w.rows(best, f"i int, key double, {entity} {kind}, v array<double>")
        rows = rows.groupBy("i").agg(F.min(F.struct("key", entity, "v")).alias("s")).select("i", "s.*").collect()
        for r in rows:
            chosen[r["i"]].append(r[entity])
            taken[r["i"]].append(_unit(np.array([r["v"]]))[0])
        if not rows:
            break
    out = [(i, slot, name) for i, names in enumerate(chosen) for slot, name in enumerate(names)]
    return w.dated(w.held.sparkSession.createDataFrame(out, f"i int, slot int, {entity} {kind}"), "slot", entity)


def tails(w: Windows, k: int, level: float, dense_set: Callable) -> DataFrame:
    """(rebalance, slot, entity): ``dense_set`` of the 2 k names that most often exceed their level together with the mean of all.

    Two passes: the mean of all names by dates, then each name's score and exceedances. The best of a task's names go on.
    """
    entity, kind, spans = w.panel.entity, w.kinds[1], w.spans

    def sums(blocks):
        total, count = {}, {}
        for i, own, v, _ in blocks:
            total[i] = total.get(i, 0.0) + v.sum(0)
            count[i] = count.get(i, 0) + len(own)
        for i, t in total.items():
            yield pd.DataFrame({"i": i, "at": np.arange(len(t)), "total": t, "n": count[i]})

    means = w.rows(sums, "i int, at int, total double, n long").groupBy("i", "at").agg((F.sum("total") / F.sum("n")).alias("m")).toPandas().sort_values(["i", "at"])

    def over(v: np.ndarray) -> np.ndarray:
        """Of each row, the values whose rank (ties by date) is above the level."""
        t = v.shape[1]
        high = np.argsort(v, axis=1, kind="stable")[:, (np.arange(t) + 1.0) / (t + 1) > level]
        out = np.zeros(v.shape, bool)
        np.put_along_axis(out, high, True, axis=1)
        return out

    # sums in another order differ in their last digits, which shouldn't rank dates
    top = {i: over(np.round(m["m"].to_numpy()[None] / max(np.abs(m["m"]).max(), 1e-300), DIGITS))[0] for i, m in means.groupby("i")}

    def scored(blocks):
        best: dict = {}
        for i, own, v, _ in blocks:
            o = over(v)
            new = pd.DataFrame({entity: own, "score": (o & top[i]).sum(1), "over": [x.tobytes() for x in o]})
            best[i] = pd.concat([best[i], new] if i in best else [new]).sort_values(["score", entity], ascending=[False, True]).head(2 * k)
        for i, b in best.items():
            yield b.assign(i=i)[["i", entity, "score", "over"]]

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", entity], ascending=[False, True], ignore_index=True)
        o = np.stack([np.frombuffer(x, bool) for x in pdf["over"]]).astype(float)
        share = o @ o.T / np.maximum(o.sum(1), 1)[:, None]
        edge = (share + share.T) / 2
        np.fill_diagonal(edge, 0.0)
        names = pdf[entity].iloc[dense_set(edge, pdf["score"].to_numpy(float), min(k, len(pdf)))].sort_values()
        return pd.DataFrame({"i": pdf["i"].iloc[0], "slot": range(len(names)), entity: names.to_numpy()})

    first = Window.partitionBy("i").orderBy(F.desc("score"), entity)
    pool = w.rows(scored, f"i int, {entity} {kind}, score long, over binary").withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= 2 * k).drop("__r")
    return w.dated(pool.groupBy("i").applyInPandas(chosen, f"i int, slot int, {entity} {kind}"), "slot", entity)


def optimal(w: Windows, method: str) -> DataFrame:
    """(rebalance, entity, weight): non-negative shares of the inverse of the shrunk covariance times ones, deviations or means.

    The covariance of k names over t dates is s Z'Z + c I with Z centred, dates by names. Its inverse times b is
    (b - Z'(c / s I + ZZ')^-1 Zb) / c, so sums over names of t by t and t numbers do instead of a k by k matrix: one pass for
    the variances and ZZ', one for Zb where b needs the shrinkage, one for the weights. The sums reach the driver by rebalance.
    """
    entity, kind = w.panel.entity, w.kinds[1]
    t = [high - low for _, low, high in w.spans]

    def target(z: np.ndarray, v: np.ndarray, shrink: float) -> np.ndarray:
        if method == "min_variance":
            return np.ones(len(v))
        return v.mean(1) if method == "mean_variance" else np.sqrt(0.9 * (z * z).sum(1) / (v.shape[1] - 1) + shrink)

    def moments(blocks):
        sums: dict = {}
        for i, _, v, _ in blocks:
            if t[i] > 2:
                z = _centred(v)
                own = (len(v), (z * z).sum() / (t[i] - 1), z.T @ z)
                sums[i] = tuple(a + b for a, b in zip(sums[i], own, strict=True)) if i in sums else own
        for i, (n, var, zz) in sums.items():
            yield pd.DataFrame({"i": [i], "n": [n], "var": [var], "zz": [zz[np.triu_indices(t[i])].tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        zz = np.sum([np.frombuffer(x) for x in pdf["zz"]], axis=0)
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "n": pdf["n"].sum(), "var": pdf["var"].sum(), "zz": [zz.tobytes()]})

    def vectors(blocks):
        sums: dict = {}
        for i, _, v, _ in blocks:
            if t[i] > 2:
                z = _centred(v)
                sums[i] = sums.get(i, 0.0) + target(z, v, shrink[i]) @ z
        for i, zb in sums.items():
            yield pd.DataFrame({"i": i, "at": np.arange(len(zb)), "zb": zb})

    names = w.held.count()
    few = Windows(w.held.coalesce(max(1, -(-names // TASK))), w.times, w.spans, w.least, w.panel, w.kinds)  # a matrix a task and rebalance
    schema = "i int, n long, var double, zz binary"
    sums_ = few.rows(moments, schema).groupBy("i").applyInPandas(added, schema).toLocalIterator()
    zz, shrink = {}, {}
    for r in sums_:
        full = np.zeros((t[r["i"]],) * 2)
        full[np.triu_indices(len(full))] = np.frombuffer(r["zz"])
        zz[r["i"]] = full + np.triu(full, 1).T
        shrink[r["i"]] = 0.1 * r["var"] / r["n"]
    zb = w.rows(vectors, "i int, at int, zb double").groupBy("i", "at").agg(F.sum("zb").alias("zb")).toPandas().sort_values(["i", "at"])
    rest = {}
    for i, b in zb.groupby("i"):
        ratio = shrink[i] * (t[i] - 1) / 0.9
        rest[i] = np.linalg.solve(zz[i] + ratio * np.eye(t[i]), b["zb"].to_numpy()) if shrink[i] > 0 else None

    def weights(blocks):
        for i, own, v, _ in blocks:
            x = np.zeros(len(own))
            if t[i] > 2:
                z = _centred(v)
                x = np.ones(len(own)) if rest[i] is None else np.maximum(target(z, v, shrink[i]) - z @ rest[i], 0.0) / shrink[i]
            yield pd.DataFrame({"i": i, entity: own, "raw": x})

    made = w.rows(weights, f"i int, {entity} {kind}, raw double")
    whole = Window.partitionBy("i")
    share = F.when(F.sum("raw").over(whole) > 0, F.col("raw") / F.sum("raw").over(whole)).otherwise(1 / F.count(F.lit(1)).over(whole))
    short = [i for i, n in enumerate(t) if n <= 2]
    return w.dated(made.withColumn("weight", F.when(F.col("i").isin(short), F.lit(0.0)).otherwise(share) if short else share), entity, "weight")
