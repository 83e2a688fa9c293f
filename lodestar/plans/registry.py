"""The registered queries, each with SQL of the same meaning for the oracle where SQL can express it.

Operators are bound to the driver's tables: the daily panel is a supplier's line items of a day, contracts are groups of
parts, releases and rates are orders and events. Doubles are rounded on both sides, as sums differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Rounds every double column; 0.0 added so that zero has one sign."""
    return df.select(*((F.round(c, own.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def panel_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel with its return ``r``."""
    from lodestar.functions.rolling import pct_change

    price = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.lit(100.0)  # exact, whatever the order
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        F.sum("l_quantity").alias("volume"), cents.alias("value"), (cents / F.sum("l_quantity")).alias("px"), F.max(price).alias("hi"),
        F.min(price).alias("lo"), F.avg(price).alias("op"), F.avg("l_tax").alias("spread"), F.avg("l_discount").alias("disc"), F.count(F.lit(1)).alias("n"),
    )
    return daily.withColumn("r", pct_change("px"))


def returns_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, dt, r) of the daily panel. Line items are dealt out by entity once: its days, returns and series need no other shuffle."""
    from lodestar.functions.rolling import pct_change

    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("dt"), "l_quantity", cents)
    daily = rows.repartition("entity").groupBy("entity", "dt").agg((F.sum("cents") / F.lit(100.0) / F.sum("l_quantity")).alias("px"))
    return daily.select("entity", "dt", pct_change("px").alias("r"))


PANEL_SQL = """WITH base AS (
 SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS dt, SUM(l_quantity) AS volume, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE AS value,
  SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE / SUM(l_quantity) AS px, MAX(l_extendedprice / l_quantity) AS hi, MIN(l_extendedprice / l_quantity) AS lo,
  AVG(l_extendedprice / l_quantity) AS op, AVG(l_tax) AS spread, AVG(l_discount) AS disc, COUNT(*) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, px / NULLIF(LAG(px) OVER (PARTITION BY entity ORDER BY dt), 0) - 1 AS r FROM base)"""


def win(rows: int, shift: int = 0, key: str = "entity") -> str:
    """The frame of a trailing window in SQL."""
    frame = f"{rows - 1 + shift} PRECEDING AND " + (f"{shift} PRECEDING" if shift else "CURRENT ROW")
    return f"(PARTITION BY {key} ORDER BY dt ROWS BETWEEN {frame})"


def gate(value: str, x: str, rows: int, least: int, shift: int = 0, full: bool = True) -> str:
    """A gated window value in SQL."""
    w = win(rows, shift)
    whole = f" AND COUNT(*) OVER {w} = {rows}" if full else ""
    return f"CASE WHEN COUNT({x}) OVER {w} >= {least}{whole} THEN {value} OVER {w} END"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from lodestar.plans import baselines, further, inference, point_in_time, portfolios, sections, series, sourcing, surfaces, tests_of_skill, universes, warehouse  # noqa: F401
