"""Grid lookups, skews, term slopes and model-free moments of volatility surfaces."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.panel import ratio


def node(value: str, **at) -> Column:
    """The value at a grid node: the largest positive one of the rows that match."""
    here = reduce(lambda a, b: a & b, (F.col(k) == v for k, v in at.items()))
    return F.max(F.when(here & (F.col(value) > 0), F.col(value)))


def nearest(value: str, x: str, target: float, where: Column | None = None, tie: str | None = None) -> Column:
    """The value whose x is closest to the target."""
    key = F.struct(F.abs(F.col(x) - target).alias("d"), *([F.col(tie)] if tie else []))
    ok = F.col(value).isNotNull() & F.col(x).isNotNull() & (F.lit(True) if where is None else where)
    return F.min_by(F.when(ok, F.col(value)), F.when(ok, key))


def signals(df: DataFrame, keys: list[str], tenor: str, delta: str, flag: str, vol: str, tenors: tuple = (30, 91, 365), deltas: tuple = (25, 50, 75)) -> DataFrame:
    """Level, skew, slope, convexity, spread, dispersion and quality of each key, in one aggregate."""
    near, far = tenors[0], tenors[-1]
    low, at, high = deltas
    call = lambda t, d: node(vol, **{tenor: t, delta: d, flag: "C"})
    put = lambda t, d: node(vol, **{tenor: t, delta: d, flag: "P"})
    v = F.col(vol)
    return df.groupBy(*keys).agg(
        call(near, at).alias("level"), (put(near, low) - call(near, low)).alias("skew"), (call(far, at) - call(near, at)).alias("term_slope"),
        (put(near, low) + call(near, low) - 2 * call(near, at)).alias("convexity"), (call(near, at) - put(near, at)).alias("call_put_spread"),
        ratio(F.stddev_samp(v), F.avg(v)).alias("dispersion"), (F.count_if(v > 0) / F.count(F.lit(1))).alias("quality"),
    )


def contract_integrals(df: DataFrame, keys: list[str], strike: str, price: str, forward: str, spot: str | None = None, flag: str | None = None) -> DataFrame:
    """``(keys, v, w, x, s, points)``: trapezoid integrals over out-of-the-money options, puts below the cutoff, calls above.

    The cutoff is the forward, or the spot (if given) where fewer than four options lie outside the forward; with fewer than
    two there is no integral. An option at the cutoff is on neither side. Weights are by the log distance from the forward.
    With ``flag`` (P or C) a strike may have one row of each kind; without, each row is taken for the side it lies on.
    """
    k, f = F.col(strike), F.col(forward)
    rows = df.where((k > 0) & (F.col(price) >= 0) & (f > 0))
    put = F.lit(True) if flag is None else F.col(flag) == "P"
    call = F.lit(True) if flag is None else F.col(flag) == "C"
    outside = lambda at: (put & (k < at)) | (call & (k > at))
    if spot:
        enough = F.count_if(outside(f)).over(Window.partitionBy(*keys)) >= 4
        rows = rows.withColumn("__at", F.when(enough, f).otherwise(F.col(spot)))
    else:
        rows = rows.withColumn("__at", f)
    rows = rows.where(outside(F.col("__at"))).withColumn("__below", k < F.col("__at"))
    below, x = F.col("__below"), F.when(F.col("__below"), F.ln(f / k)).otherwise(F.ln(k / f))
    weights = {
        "v": F.when(below, 2 * (1 + x)).otherwise(2 * (1 - x)) / (k * k),
        "w": F.when(below, -(6 * x + 3 * x * x)).otherwise(6 * x - 3 * x * x) / (k * k),
        "x": F.when(below, 12 * x * x + 4 * F.pow(x, F.lit(3.0))).otherwise(12 * x * x - 4 * F.pow(x, F.lit(3.0))) / (k * k),
    }
    w = Window.partitionBy(*keys, "__below").orderBy(strike, price)
    for name, weight in weights.items():
        rows = rows.withColumn(f"__{name}", weight * F.col(price))
    step = F.lead(strike).over(w) - k
    for name in weights:
        rows = rows.withColumn(f"__a_{name}", step * (F.col(f"__{name}") + F.lead(f"__{name}").over(w)) / 2)
    two = F.count(F.lit(1)) >= 2
    return rows.groupBy(*keys).agg(*(F.when(two, F.coalesce(F.sum(f"__a_{n}"), F.lit(0.0))).alias(n) for n in weights), F.count(F.lit(1)).alias("points"))


def moments(integrals: DataFrame, years: Column, rate: Column, least: int = 2) -> DataFrame:
    """Annualised variance, skewness and excess kurtosis from the integrals; null unless V and the variance are positive."""
    e = F.exp(rate * years)
    mu = e - 1 - e * (F.col("v") / 2 + F.col("w") / 6 + F.col("x") / 24)
    var = e * F.col("v") - mu * mu
    ok = (F.col("points") >= least) & (F.col("v") > 0) & (var > 0)
    skew = (e * F.col("w") - 3 * mu * e * F.col("v") + 2 * F.pow(mu, F.lit(3.0))) / F.pow(var, F.lit(1.5))
    kurt = (e * F.col("x") - 4 * mu * e * F.col("w") + 6 * mu * mu * e * F.col("v") - 3 * F.pow(mu, F.lit(4.0))) / (var * var) - 3
    return integrals.withColumns({"mfiv": F.when(ok, var / years), "mfis": F.when(ok, skew), "mfik": F.when(ok, kurt)})


def squared_svix(df: DataFrame, keys: list[str], strike: str, price: str, spot: str, flag: str, least: int = 5) -> DataFrame:
    """``(keys, svix2)``: the trapezoid of 2 price / strike squared over puts below and calls above the spot, as one curve."""
    k = F.col(strike)
    rows = df.where((k > 0) & (F.col(price) >= 0) & (((F.col(flag) == "P") & (k < F.col(spot))) | ((F.col(flag) == "C") & (k > F.col(spot)))))
    w = Window.partitionBy(*keys).orderBy(strike, flag, price)
    rows = rows.withColumn("__y", 2 * F.col(price) / (k * k))
    area = (F.lead(strike).over(w) - k) * (F.col("__y") + F.lead("__y").over(w)) / 2
    out = rows.withColumn("__a", area).groupBy(*keys).agg(F.sum("__a").alias("__s"), F.count(F.lit(1)).alias("__n"))
    return out.select(*keys, F.when((F.col("__n") >= least) & (F.col("__s") >= 0), F.col("__s")).alias("svix2"))


def inferred_spot(tenor: str, delta: str, strike: str, near: int = 30, at: float = 50) -> Column:
    """Aggregate: the median strike at the money of the near tenor, or of all strikes."""
    here = (F.col(tenor) == near) & (F.abs(F.col(delta)) == at)
    return F.coalesce(F.percentile(F.when(here, F.col(strike)), F.lit(0.5)), F.percentile(strike, F.lit(0.5)))


@dataclass(frozen=True)
class Grid:
    """Columns and nodes of a surface that signals are read from."""

    tenor: str = "days"
    delta: str = "delta"
    flag: str = "cp_flag"
    vol: str = "impl_volatility"
    strike: str = "impl_strike"
    premium: str = "impl_premium"
    spread: str = "dispersion"
    near: int = 30
    far: int = 365
    at: int = 50
    put_wing: int = 20
    wings: tuple[tuple[int, int], tuple[int, int]] = ((25, 20), (75, 80))
    pair_tenors: tuple[int, ...] = (30, 60, 91)
    pair_deltas: tuple[int, ...] = (20, 25, 30, 40, 50)
    points: int = 374
    sign: int = -1  # puts have deltas of this sign


def surface_signals(df: DataFrame, entity: str, time: str, grid: Grid = Grid(), hv: str | None = None, option_volume: str | None = None, equity_volume: str | None = None, borrow: str | None = None, rate: float = 0.0) -> DataFrame:
    """All signals of a surface for each entity and date, then those across dates and entities.

    Levels and spreads come from one wide aggregate, model-free moments and the squared SVIX from strike windows at the near
    and far tenors, with the spot inferred from strikes. ``hv``, volumes and ``borrow`` are columns that are constant within
    an entity's date. Then each date's demeaned SVIX, changes of at-the-money volatility since the row before, and changes of
    slope and skew over five rows.
    """
    g, keys = grid, [entity, time]
    flag = F.upper(F.substring(F.trim(g.flag), 1, 1))
    rows = df.withColumn("__f", flag)
    node_ = lambda t, d, f: node(g.vol, **{g.tenor: t, g.delta: d if f == "C" else g.sign * d, "__f": f})
    call = lambda t, d: node_(t, d, "C")
    put = lambda t, d: node_(t, d, "P")
    positive = F.col(g.vol) > 0

    def near_call(d: int) -> Column:
        ok = (F.col(g.tenor) == g.near) & (F.col("__f") == "C") & positive & F.col(g.delta).isNotNull()
        closest = F.min_by(F.when(ok, F.col(g.vol)), F.when(ok, F.struct(F.abs(F.col(g.delta) - d).alias("d"), F.col(g.delta))))
        return F.coalesce(call(g.near, d), closest)

    wing = lambda pair: F.coalesce(*(near_call(d) for d in pair))
    pairs = [call(t, d) - put(t, d) for t in g.pair_tenors for d in g.pair_deltas]
    mean = lambda cols: F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), sum((c.isNotNull().cast("double") for c in cols), F.lit(0.0)))
    once = {n: F.max(c) for n, c in (("__hv", hv), ("__ov", option_volume), ("__ev", equity_volume), ("__bo", borrow)) if c}
    made = rows.groupBy(*keys).agg(
        (put(g.near, g.put_wing) - call(g.near, g.at)).alias("iv_skew"), (call(g.far, g.at) - call(g.near, g.at)).alias("iv_term_slope"), (wing(g.wings[0]) + wing(g.wings[1]) - 2 * call(g.near, g.at)).alias("iv_convexity"),
        mean(pairs).alias("vol_spread"), mean([call(g.near, g.at), put(g.near, g.at)]).alias("atm"), call(g.near, g.at).alias("atm_call"), put(g.near, g.at).alias("atm_put"),
        F.avg(F.when(positive, F.col(g.spread))).alias("dispersion"), (F.count_if(positive) / F.lit(float(g.points))).alias("quality"), inferred_spot(g.tenor, g.delta, g.strike, g.near, g.at).alias("spot"), *(c.alias(n) for n, c in once.items()),
    )
    spots = made.select(*keys, "spot").where("spot > 0")
    for tenor, name in ((g.near, "near"), (g.far, "far")):
        chain = rows.where((F.col(g.tenor) == tenor) & F.col(g.strike).isNotNull() & F.col(g.premium).isNotNull()).join(spots, keys).withColumn("__fw", F.col("spot") * F.exp(F.lit(rate * tenor / 365.0)))
        chain = chain.where((F.col(g.strike) > 0) & (F.col(g.premium) >= 0)).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__all >= 4")
        m = moments(contract_integrals(chain, keys, g.strike, g.premium, "__fw", "spot", "__f"), F.lit(tenor / 365.0), F.lit(rate))
        made = made.join(m.select(*keys, *(F.col(c).alias(f"{c}_{name}") for c in ("mfiv", "mfis", "mfik"))), keys, "left")
        if name == "near":
            made = made.join(squared_svix(chain, keys, g.strike, g.premium, "spot", "__f"), keys, "left")
    none = F.lit(None).cast("double")
    col = lambda n: F.col(n) if n in once else none
    made = made.withColumns({
        "vmp": F.when((col("__hv") > 0) & (F.col("atm") > 0), F.ln(col("__hv")) - F.ln("atm")), "vrp": F.col("mfiv_near") - col("__hv"), "rns_term_spread": F.col("mfis_far") - F.col("mfis_near"),
        "os_ratio": F.when(col("__ev") > 0, col("__ov") / col("__ev")), "borrow_rate": col("__bo"),
    })
    series = Window.partitionBy(entity).orderBy(time)
    since = lambda c, n: F.col(c) - F.lag(c, n).over(series)
    return made.withColumns({
        "mw_xs": 0.5 * (F.col("svix2") - F.avg("svix2").over(Window.partitionBy(time))), "d_iv_call": since("atm_call", 1), "d_iv_put": since("atm_put", 1), "d_iv_term_slope_5": since("iv_term_slope", 5), "d_iv_skew_5": since("iv_skew", 5),
    }).drop(*once, "atm_call", "atm_put", "atm", "spot")


def image(df: DataFrame, keys: list[str], row: str, column: str, value: str, rows: list, columns: list) -> DataFrame:
    """A nested array of rows by columns for each key, the largest value of a node, null where there is none."""
    cells = df.groupBy(*keys, row, column).agg(F.max(value).alias("__v"))
    listed = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", row, column), "__v"))).alias("__m"))
    grid = F.array(*(F.array(*(F.try_element_at("__m", F.lit(f"{r}|{c}")) for c in columns)) for r in rows))
    return listed.select(*keys, grid.alias("image"))
