"""Statistics of every two series from matrix products of blocks: a task has two blocks, and no product of rows is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.clusters import grouped
from lodestar.session import cut

#: Series in a block of products; shares of the series that tasks have two of, and series in one at most.
BLOCK, SHARES, MOST = 1024, 5, 16384


def instant(df: DataFrame, time: str) -> Column:
    """A date or timestamp as a number."""
    kind = dict(df.dtypes)[time]
    return F.unix_date(time) if kind == "date" else F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.col(time)


def moment(t: Column, kind: str) -> Column:
    """The date or timestamp that ``instant`` made a number of."""
    return F.date_from_unix_date(t.cast("int")) if kind == "date" else F.timestamp_micros(t).cast(kind) if kind.startswith("timestamp") else t.cast(kind)


def series(df: DataFrame, x: str, time: str, entity: str, by: list[str] | None = None) -> DataFrame:
    """(by, entity, t, x): a row for each entity (of each group) with its instants and its values that aren't missing, in order."""
    keys = [*(by or []), entity]
    rows = df.where(F.col(time).isNotNull() & F.col(entity).isNotNull()).select(*keys, F.when(F.col(x).isNotNull(), F.struct(instant(df, time).alias("t"), F.col(x).cast("double").alias("x"))).alias("__p"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("__p")).alias("__p")).select(*keys, F.col("__p.t").alias("t"), F.col("__p.x").alias("x"))


def dense(t: pd.Series, x: pd.Series, times: np.ndarray) -> np.ndarray:
    """Series by instants; NaN where there is none."""
    out = np.full((len(t), len(times)), np.nan)
    size = [len(v) for v in t]
    if sum(size):
        out[np.repeat(np.arange(len(t)), size), np.searchsorted(times, np.concatenate(list(t)))] = np.concatenate(list(x))
    return out


def by_blocks(held: DataFrame, entity: str, made: Callable[[np.ndarray, np.ndarray], Iterator], columns: str, block: int | None = None, own: bool = False) -> DataFrame:
    """(a, b, columns) for a < b, or a <= b with ``own``: ``made`` gets two blocks of series and gives a matrix for each column, and which pairs have a row.

    A task has two of some SHARES shares of the series (more, where a share would be above MOST), so a series is shuffled so
    often; products are of blocks of BLOCK of them.
    """
    n = held.count()
    parts = max(1, -(-n // (block or min(MOST, max(BLOCK, -(-n // SHARES))))))
    step, kind = min(BLOCK, block or BLOCK), dict(held.dtypes)[entity]
    mine = F.pmod(F.xxhash64(entity), F.lit(parts)).cast("int")
    rows = held.withColumn("__own", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("__pair", F.least("__own", "__other") * parts + F.greatest("__own", "__other")).drop("__other")
    names = ["a", "b", *(c.split()[0] for c in columns.split(", "))]

    def products(pair: int, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        i, j = divmod(int(pair), parts)
        left, right = (pdf[pdf["__own"] == k].sort_values(entity, ignore_index=True) for k in (i, j))
        for low in range(0, len(left), step):
            one = left[low : low + step]
            for at in range(low if i == j else 0, len(right), step):
                two = right[at : at + step]
                times = np.unique(np.concatenate([np.asarray(v) for v in (*one["t"], *two["t"])]))
                values, keep = made(dense(one["t"], one["x"], times), dense(two["t"], two["x"], times))
                if i == j and low == at:
                    keep = np.triu(keep, 0 if own else 1)
                a, b = one[entity].to_numpy(), two[entity].to_numpy()
                p, q = np.nonzero(keep)
                swap = a[p] > b[q]
                yield pd.DataFrame(dict(zip(names, [np.where(swap, b[q], a[p]), np.where(swap, a[p], b[q]), *(v[p, q] for v in values)], strict=True)))

    lying = rows.repartition(parts * (parts + 1) // 2, "__pair").sortWithinPartitions("__pair")
    return lying.mapInPandas(lambda batches: grouped(batches, "__pair", products), f"a {kind}, b {kind}, {columns}")


def distinct(held: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(one of each set of equal series: the first name and how many they are, ``w``; (first, entity) of all names)."""
    sets = cut(held.groupBy("t", "x").agg(F.min(entity).alias("__first"), F.collect_list(entity).alias("__all")))
    return sets.select(F.col("__first").alias(entity), "t", "x", F.size("__all").alias("w")), sets.select("__first", "__all")


def correlations(v: np.ndarray, w: np.ndarray) -> tuple:
    """Correlations of rows over common columns and how many these are; NaN where one doesn't vary there.

    Sums of centred rows give them; where a variance keeps less than seven digits of its sum of squares, the pair is done again
    from its own means.
    """
    def parts(x: np.ndarray) -> tuple:
        have = np.isfinite(x)
        k = np.maximum(have.sum(1), 1)[:, None]
        c = np.where(have, x - np.where(have, x, 0.0).sum(1)[:, None] / k, 0.0)
        sd = np.sqrt((c * c).sum(1)[:, None] / k)
        return have.astype(float), np.divide(c, sd, out=c, where=sd > 0)

    (m, x), (l, y) = parts(v), parts(w)
    n = m @ l.T
    with np.errstate(all="ignore"):
        sx, sy, xx, yy = x @ l.T, m @ y.T, (x * x) @ l.T, m @ (y * y).T
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        corr = (x @ y.T - sx * sy / n) / np.sqrt(vx * vy)
    doubt = (n > 0) & ~((vx > 1e-7 * xx) & (vy > 1e-7 * yy))
    corr[n < 2] = np.nan
    for i, j in zip(*np.nonzero(doubt & (n > 1)), strict=True):
        both = np.isfinite(v[i]) & np.isfinite(w[j])
        a, b = v[i, both], w[j, both]
        a, b = a - a.mean() if np.ptp(a) else a * 0, b - b.mean() if np.ptp(b) else b * 0
        size = np.sqrt(a @ a) * np.sqrt(b @ b)
        corr[i, j] = a @ b / size if size > 0 else np.nan
    return (corr, n.astype(np.int64)), n > 0


def meetings(v: np.ndarray, w: np.ndarray) -> tuple:
    """In how many columns rows both have a value."""
    n = np.isfinite(v).astype(np.float32) @ np.isfinite(w).astype(np.float32).T
    return (n.astype(np.int64),), n > 0
