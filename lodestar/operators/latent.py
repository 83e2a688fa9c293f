"""Latent states and factors: a two-state filter walked forward, characteristic factors by alternating least squares,
soft compositions, and volatilities implied by prices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.panel import PANEL, Panel


def fit_two_states(x: np.ndarray, rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, moves, means, variances) of a Gaussian hidden Markov model by Baum-Welch; the second state is the more volatile one.

    It begins with the halves of the values nearest to and furthest from their median.
    """
    far = np.abs(x - np.median(x)) > np.median(np.abs(x - np.median(x)))
    mean = np.array([x[~far].mean(), x[far].mean()])
    var = np.array([x[~far].var(), x[far].var()]) + 1e-12
    start, moves, before = np.full(2, 0.5), np.array([[0.95, 0.05], [0.05, 0.95]]), -math.inf
    for _ in range(rounds):
        density = np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var) + 1e-300
        ahead, scale = np.empty((len(x), 2)), np.empty(len(x))
        now = start * density[0]
        for t in range(len(x)):
            now = (ahead[t - 1] @ moves if t else start) * density[t]
            scale[t] = now.sum()
            ahead[t] = now / scale[t]
        back = np.ones((len(x), 2))
        for t in range(len(x) - 2, -1, -1):
            back[t] = moves @ (density[t + 1] * back[t + 1]) / scale[t + 1]
        state = ahead * back
        state /= state.sum(1, keepdims=True)
        pairs = (ahead[:-1, :, None] * moves * (density[1:] * back[1:] / scale[1:, None])[:, None, :]).sum(0)
        start, moves = state[0], pairs / pairs.sum(1, keepdims=True)
        mean = (state * x[:, None]).sum(0) / state.sum(0)
        var = (state * (x[:, None] - mean) ** 2).sum(0) / state.sum(0) + 1e-12
        total = np.log(scale).sum()
        if abs(total - before) < tolerance:
            break
        before = total
    order = np.argsort(var)
    return start[order], moves[np.ix_(order, order)], mean[order], var[order]


def state_filter(df: DataFrame, x: str, time: str, by: str, window: int = 756, step: int = 21, threshold: float = 0.5) -> DataFrame:
    """(by, dt, probability, turbulent): the filtered probability of the more volatile state, from models fitted on the ``window``
    rows before each ``step`` rows only. Null before the first model and for missing values. A series is one task's."""
    kinds = dict(df.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        v, out = pdf["__x"].to_numpy(float), np.full(len(pdf), np.nan)
        for end in range(window, len(v), step):
            train = v[end - window : end]
            train = train[np.isfinite(train)]
            if len(train) < 20 or train.std() < 1e-12:
                continue
            start, moves, mean, var = fit_two_states(train)
            now = None
            for value in train:
                density = np.exp(-((value - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var) + 1e-300
                now = (start if now is None else now @ moves) * density
                now /= now.sum()
            for t in range(end, min(end + step, len(v))):
                if np.isfinite(v[t]):
                    density = np.exp(-((v[t] - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var) + 1e-300
                    now = now @ moves * density
                    now /= now.sum()
                    out[t] = now[1]
        return pd.DataFrame({by: pdf[by], time: pdf[time], "probability": out})

    slim = df.select(by, time, F.col(x).cast("double").alias("__x"))
    found = slim.groupBy(by).applyInPandas(walk, f"{by} {kinds[by]}, {time} {kinds[time]}, probability double")
    p = F.nanvl("probability", F.lit(None).cast("double"))
    return found.select(by, time, p.alias("probability"), (p > threshold).alias("turbulent"))


def characteristic_factors(df: DataFrame, r: str, characteristics: list[str], factors: int = 3, rounds: int = 200, panel: Panel = PANEL) -> tuple[np.ndarray, DataFrame]:
    """Instrumented principal components: loadings are linear in characteristics, r = z' G f + e. Returns G and (dt, f0, f1, ...).

    All that the alternating least squares need are each date's sums of z z' and z r, one aggregate over the panel; what reaches
    the driver is a row for each date. G has orthonormal columns, factors are ordered by variance and have positive means.
    """
    k = len(characteristics)
    full = df.where(F.col(r).isNotNull())
    for c in characteristics:
        full = full.where(F.col(c).isNotNull())
    z = [F.col(c).cast("double") for c in characteristics]
    rows = full.groupBy(panel.time).agg(F.array(*(F.sum(a * b) for a in z for b in z)).alias("w"), F.array(*(F.sum(a * F.col(r)) for a in z)).alias("x")).orderBy(panel.time).toPandas()
    w, x = np.array(rows["w"].tolist()).reshape(-1, k, k), np.array(rows["x"].tolist())
    values, vectors = np.linalg.eigh(x.T @ x)
    g = vectors[:, ::-1][:, :factors]
    for _ in range(rounds):
        f = np.stack([np.linalg.pinv(g.T @ a @ g) @ (g.T @ b) for a, b in zip(w, x, strict=True)])
        left = np.einsum("tij,tk,tl->ikjl", w, f, f).reshape(k * factors, k * factors)
        new = (np.linalg.pinv(left) @ np.einsum("ti,tk->ik", x, f).ravel()).reshape(k, factors)
        new, _ = np.linalg.qr(new)
        done = np.abs(new @ new.T - g @ g.T).max() < 1e-10
        g = new
        if done:
            break
    f = np.stack([np.linalg.pinv(g.T @ a @ g) @ (g.T @ b) for a, b in zip(w, x, strict=True)])
    _, _, turn = np.linalg.svd(f - f.mean(0), full_matrices=False)
    f, g = f @ turn.T, g @ turn.T
    sign = np.where(f.mean(0) < 0, -1.0, 1.0)
    table = pd.DataFrame(f * sign, columns=[f"f{i}" for i in range(factors)])
    table.insert(0, panel.time, rows[panel.time])
    return g * sign, df.sparkSession.createDataFrame(table)


def characteristic_residuals(df: DataFrame, r: str, characteristics: list[str], loadings: np.ndarray, factors: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Adds ``residual``: the return less what characteristics, loadings and the date's factors make of it."""
    names = [c for c in factors.columns if c != panel.time]
    joined = df.join(F.broadcast(factors), panel.time, "left")
    fitted = sum((F.col(c) * float(loadings[i, j]) * F.col(n) for i, c in enumerate(characteristics) for j, n in enumerate(names)), F.lit(0.0))
    return joined.withColumn("residual", F.col(r) - fitted).drop(*names)


def soft_composition(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """Adds ``composition``: probabilities of k Gaussian components over standardised columns, missing values as 0."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    packed = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__v").transform(ready)
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(packed).transform(packed)
    model = GaussianMixture(featuresCol="__s", k=k, seed=seed, probabilityCol="__p", predictionCol="__c").fit(scaled)
    return model.transform(scaled).withColumn("composition", vector_to_array("__p")).select(*df.columns, "composition")


_ERF = np.vectorize(math.erf)


@F.pandas_udf(T.DoubleType())
def implied_volatility(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, is_call: pd.Series) -> pd.Series:
    """The volatility at which the Black-Scholes formula gives a European price, by bisection over 1e-4 to 5; NaN outside its bounds."""
    p, s, k, y, r = (x.to_numpy(float) for x in (price, spot, strike, years, rate))
    call = is_call.fillna(True).to_numpy(bool)

    def value(v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            d1 = (np.log(s / k) + (r + v * v / 2) * y) / (v * np.sqrt(y))
            n1, n2 = (0.5 * (1 + _ERF(np.nan_to_num(d) / math.sqrt(2))) for d in (d1, d1 - v * np.sqrt(y)))
            worth = s * n1 - k * np.exp(-r * y) * n2
            return np.where(call, worth, worth - s + k * np.exp(-r * y))

    low, high = np.full(len(p), 1e-4), np.full(len(p), 5.0)
    ok = (s > 0) & (k > 0) & (y > 0) & (value(low) <= p) & (p <= value(high))
    for _ in range(60):
        mid = (low + high) / 2
        under = value(mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return pd.Series(np.where(ok, (low + high) / 2, np.nan))


def register_functions(spark) -> list[str]:
    """Makes the library's own functions callable from SQL; their names."""
    from lodestar.operators.inference import student_p_column

    functions = {"implied_volatility": implied_volatility, "student_p": student_p_column}
    for name, f in functions.items():
        spark.udf.register(name, f)
    return sorted(functions)
