"""Mixers of experts beyond losses alone: leaders by trailing Sharpe ratio, sleeping copies, flip-flop, and the best path in hindsight.

Leaders are windows and ranks by date. What carries weights from date to date is a grouped map over one matrix of dates by
experts, of which there are few.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import rolling as R
from lodestar.operators.statistics import follow_the_leader, log_loss, mix_experts, unit_losses
from lodestar.panel import Panel


def flip_flop(df: DataFrame, loss: str, time: str, expert: str, experts: list[str]) -> DataFrame:
    """The mean of AdaHedge's and the leader's weights on each date."""
    one = mix_experts(df, loss, time, expert, experts, "adahedge").withColumnRenamed("weight", "__a")
    two = follow_the_leader(df, loss, time, expert).select(time, expert, F.col("weight").alias("__f"))
    return one.join(two, [time, expert]).select(time, expert, ((F.col("__a") + F.col("__f")) / 2).alias("weight"))


def trailing_sharpe(df: DataFrame, r: str, time: str, expert: str, lookback: int, least: int = 20) -> DataFrame:
    """Adds ``score``: the annual Sharpe ratio (sample deviation; 0 without spread) of the ``lookback`` rows before each row, and ``seen``, rows before it."""
    panel = Panel(expert, time)
    t = R.Trailing(F.col(r), lookback, 1, panel)
    score = F.when(t.n >= max(least, 2), F.when(t.sd() <= 1e-15, 0.0).otherwise(t.mean / t.sd() * 252**0.5))
    return df.withColumns({"score": score, "seen": F.row_number().over(panel.series) - 1})


def rolling_leader(df: DataFrame, r: str, time: str, expert: str, lookback: int, least: int = 20) -> DataFrame:
    """(dt, expert, weight): all on the best trailing Sharpe ratio, ties to the first expert; equal weights before ``lookback``
    rows or where none has a ratio."""
    scored = trailing_sharpe(df, r, time, expert, lookback, least)
    section = Window.partitionBy(time)
    usable = F.when((F.col("seen") >= lookback) & F.col("score").isNotNull(), F.col("score"))
    ranked = scored.withColumn("__s", usable).withColumn("__r", F.row_number().over(section.orderBy(F.col("__s").desc_nulls_last(), expert)))
    any_ = F.count("__s").over(section) > 0
    return ranked.select(time, expert, F.when(~any_, 1 / F.count(F.lit(1)).over(section)).otherwise((F.col("__r") == 1).cast("double")).alias("weight"))


def held_leader(df: DataFrame, r: str, time: str, expert: str, lookback: int, hold: int, least: int = 20) -> DataFrame:
    """As rolling_leader, but reviewed every ``hold`` rows only; equal weights before the first review."""
    panel = Panel(expert, time)
    scored = trailing_sharpe(df, r, time, expert, lookback, least)
    review = (F.col("seen") > 0) & (F.pmod("seen", F.lit(hold)) == 0)
    section = Window.partitionBy(time)
    ranked = scored.withColumn("__s", F.when(review, F.col("score")))
    place = F.row_number().over(section.orderBy(F.col("__s").desc_nulls_last(), expert))
    equal = 1 / F.count(F.lit(1)).over(section)
    chosen = ranked.withColumn("__w", F.when(review, F.when(F.count("__s").over(section) == 0, equal).otherwise((place == 1).cast("double"))).when(F.col("seen") == 0, equal))
    return chosen.select(time, expert, F.last("__w", ignorenulls=True).over(panel.series.rowsBetween(Window.unboundedPreceding, 0)).alias("weight"))


def _matrix_map(df: DataFrame, columns: list[str], time: str, expert: str, experts: list[str], walk) -> DataFrame:
    """(time, expert, weight) from ``walk`` of the matrices of some columns, dates by experts."""

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = [pdf.pivot_table(index=time, columns=expert, values=c, aggfunc="last", dropna=False).reindex(columns=experts).sort_index() for c in columns]
        out = walk(*(t.to_numpy(float) for t in tables))
        return pd.DataFrame({time: np.repeat(tables[0].index.to_numpy(), len(experts)), expert: np.tile(np.array(experts, object), len(tables[0])), "weight": out.ravel()})

    kinds = dict(df.dtypes)
    slim = df.select(time, expert, *(F.col(c).cast("double").alias(c) for c in columns)).withColumn("__all", F.lit(0))
    return slim.groupBy("__all").applyInPandas(mapped, f"{time} {kinds[time]}, {expert} {kinds[expert]}, weight double")


def hysteresis(df: DataFrame, r: str, time: str, expert: str, experts: list[str], core: str, lookback: int = 126, margin: float = 0.25, least: int = 20) -> DataFrame:
    """Equal weights for ``lookback`` dates, then the core expert, which is left only for one whose trailing Sharpe ratio is
    better by the margin, and returned to when the one held falls below the core's."""
    if core not in experts:
        raise ValueError(f"{core!r} is none of the experts")
    scored = trailing_sharpe(df, r, time, expert, lookback, least)
    home, n = experts.index(core), len(experts)

    def walk(score: np.ndarray) -> np.ndarray:
        out, held = np.full(score.shape, 1 / n), home
        for t in range(lookback, len(score)):
            s = score[t]
            if held != home:
                if not (np.isfinite(s[held]) and np.isfinite(s[home])) or s[held] < s[home]:
                    held = home
            elif np.isfinite(s[home]):
                others = [j for j in range(n) if j != home and np.isfinite(s[j])]
                if others and s[best := max(others, key=lambda j: s[j])] > s[home] + margin:
                    held = best
            out[t] = np.eye(n)[held]
        return out

    return _matrix_map(scored, ["score"], time, expert, experts, walk)


def sleeping_share(df: DataFrame, r: str, turbulent: str, time: str, expert: str, experts: list[str], alpha: float = 0.05, eta: float = 0.5) -> DataFrame:
    """Variable-Share over a calm and a turbulent copy of each expert; an expert's weight is that of both.

    The copies of yesterday's regime are awake (all on the first date): they alone take losses and share among themselves;
    the others' mass is frozen. Losses are those of log wealth, scaled by what was seen before.
    """
    losses = unit_losses(df.withColumn("__loss", log_loss(F.col(r))), "__loss", time, expert).withColumn("__t", F.col(turbulent).cast("double"))
    n = len(experts)

    def walk(loss: np.ndarray, hot: np.ndarray) -> np.ndarray:
        flags = np.nan_to_num(hot[:, 0]) > 0
        w, out = np.full(2 * n, 1 / (2 * n)), np.zeros((len(loss), n))
        for t, x in enumerate(loss):
            out[t] = w[:n] + w[n:]
            awake = np.ones(2 * n, bool) if t == 0 else np.repeat([not flags[t - 1], flags[t - 1]], n)
            x = np.tile(np.nan_to_num(x, nan=0.5), 2)[awake]
            own = w[awake] * np.exp(-eta * x)
            keep = (1 - alpha) ** x
            pool = ((1 - keep) * own).sum()
            new = w.copy()
            new[awake] = keep * own + (pool - (1 - keep) * own) / (awake.sum() - 1)
            w = new / new.sum()
        return out

    return _matrix_map(losses, ["unit_loss", "__t"], time, expert, experts, walk)


def best_path(df: DataFrame, loss: str, time: str, expert: str, experts: list[str], switches: int) -> DataFrame:
    """(dt, expert, weight): the path of one expert a date with the least loss among those that switch so often at most; hindsight."""

    def walk(x: np.ndarray) -> np.ndarray:
        t_len, n = x.shape
        k = min(switches, t_len - 1)
        cost = np.full((k + 1, n), math.inf)
        cost[0] = x[0]
        came = np.zeros((t_len, k + 1, n), int)  # the expert before
        for t in range(1, t_len):
            new = cost + x[t]
            came[t] = np.arange(n)
            for s in range(1, k + 1):
                order = np.argsort(cost[s - 1], kind="stable")
                other = np.where(np.arange(n) == order[0], order[1] if n > 1 else order[0], order[0])
                change = cost[s - 1][other] + x[t]
                better = change < new[s]
                new[s] = np.where(better, change, new[s])
                came[t, s] = np.where(better, other, came[t, s])
            cost = new
        s, i = divmod(int(np.argmin(cost)), n)
        out = np.zeros((t_len, n))
        for t in range(t_len - 1, -1, -1):
            out[t, i] = 1.0
            before = came[t, s, i]
            s, i = (s - 1, before) if t and before != i else (s, i)
        return out

    return _matrix_map(df, [loss], time, expert, experts, walk)


def regret_bound(experts: int, switches: int, dates: int) -> float:
    """(k + 1) ln n + k ln T."""
    return (switches + 1) * math.log(experts) + switches * math.log(max(dates, 1))
