"""Structured Streaming forms of the event aggregates; each takes a batch or a streaming frame with a ``ts`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark([key]) if events.isStreaming else marked.dropDuplicates([key])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling or sliding window and event type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def upsert_latest(spark: SparkSession, path: str, keys: list[str], order: str):
    """A foreachBatch sink that keeps the latest row of each key, the greatest by ``order``; equal ones: the newer batch.

    Each batch is merged with the version before and written as a version of its own, named by its number; a repeated batch
    replaces its version, so the sink is exact after failures. ``read_latest`` reads the newest one.
    """

    def write(batch: DataFrame, number: int) -> None:
        have = [v for v in _versions(spark, path) if v < number]
        rows = batch.withColumn("__new", F.lit(1))
        if have:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={max(have)}").withColumn("__new", F.lit(0)), allowMissingColumns=True)
        best = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.desc("__new"))
        kept = rows.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank", "__new")
        kept.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of complete versions."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(at(f"{path}/{n}/_SUCCESS")))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={max(_versions(spark, path))}")


def portfolio_state(trades: DataFrame, cost: float = 5e-4):
    """A streaming portfolio: for each entity its weight, rows held and cost so far, carried from batch to batch.

    ``trades``: entity string, ts timestamp, weight double. One row out for each row in, in the order of ``ts`` within a batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = "entity string, ts timestamp, weight double, days_held long, total_cost double"

    def step(key, frames, state):
        weight, held, total = state.get if state.exists else (0.0, 0, 0.0)
        for pdf in frames:
            out = []
            for ts, w in pdf.sort_values("ts")[["ts", "weight"]].itertuples(index=False):
                total += abs(w - weight) * cost
                held = held + 1 if w != 0 and weight != 0 else int(w != 0)
                weight = w
                out.append((key[0], ts, w, held, total))
            yield pd.DataFrame(out, columns=["entity", "ts", "weight", "days_held", "total_cost"])
        state.update((float(weight), int(held), float(total)))

    return trades.groupBy("entity").applyInPandasWithState(step, schema, "weight double, held long, total double", "append", GroupStateTimeout.NoTimeout)
