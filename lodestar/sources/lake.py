"""Reading and writing the lake: partitioned Parquet with schema drift, tolerant CSV, rejects, frozen schemas, audits."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, path: str) -> str:
    """Fails closed where a lake isn't there."""
    if not exists(spark, path):
        raise FileNotFoundError(f"nothing at {path}")
    return path


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, years: tuple[int, int] | None = None, ids: list | None = None, id_column: str = "secid", dates: tuple[str, str] | None = None, date_column: str = "date") -> DataFrame:
    """A hive-partitioned scan by column name; year bounds prune folders, ids and dates are pushed into the files."""
    df = spark.read.option("mergeSchema", True).parquet(require(spark, path))
    if years:
        df = df.where(F.col("year").between(*years))
    if ids is not None:
        df = df.where(F.col(id_column).isin(ids))
    if dates:
        df = df.where(F.col(date_column).between(*(F.lit(d).cast("date") for d in dates)))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def pick_column(df: DataFrame, *names: str) -> str | None:
    """The first of some names that the frame has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


#: Names under which sources keep their date.
DATE_NAMES = ("date", "dt", "datadate", "trade_date", "public_date", "caldt", "observation_date")


def read_csv(spark: SparkSession, path: str, all_text: bool = False, sample: float = 0.1, schema=None) -> DataFrame:
    """Permissive CSV: short rows are padded, what doesn't parse becomes null and is kept as text in ``_corrupt``."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("maxCharsPerColumn", 10 << 20).option("enforceSchema", False)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.csv(path) if all_text else reader.option("inferSchema", True).option("samplingRatio", sample).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: Parquet, CSV, JSON lines or ORC."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": lambda: read_csv(spark, path), "json": lambda: read_json_lines(spark, path), "jsonl": lambda: read_json_lines(spark, path), "orc": lambda: spark.read.orc(path)}
    return readers.get(kind, lambda: spark.read.parquet(path))()


def literal(value) -> str:
    """An SQL literal of a number, a text (quotes doubled) or a date."""
    if isinstance(value, bool) or value is None:
        return {True: "TRUE", False: "FALSE", None: "NULL"}[value]
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def read_jdbc(spark: SparkSession, url: str, query: str, chunks: list[list] | None = None, column: str = "secid", **options) -> DataFrame:
    """A remote query; with chunks of ids, one partition reads each chunk."""
    if not chunks:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    where = [f"{column} IN ({', '.join(literal(x) for x in c)})" for c in chunks]
    return spark.read.jdbc(url, f"({query}) q", predicates=where, properties=options)


def split_rejects(df: DataFrame, date_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a date, and the others with a reason."""
    date = F.col(date_column).try_cast("date")
    reason = F.when(F.col(date_column).isNull() | (F.trim(F.col(date_column).cast("string")) == ""), "missing date").otherwise("bad date")
    return df.where(date.isNotNull()).withColumn(date_column, date), df.where(date.isNull()).withColumn("reject_reason", reason)


def write_partitioned(df: DataFrame, path: str, date_column: str | None, mode: str = "overwrite") -> None:
    """Zstandard Parquet by year and month of the date; flat if there is no date column."""
    if date_column is None:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return
    dated = df.withColumns({"year": F.year(date_column), "month": F.month(date_column)}).where("year is not null")
    dated.repartition("year", "month").sortWithinPartitions("year", "month", date_column).write.mode(mode).partitionBy("year", "month").option("compression", "zstd").parquet(path)


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Casts to a frozen schema, null where a value doesn't fit; fails if a frozen column is missing."""
    missing = [c for c in schema if c not in df.columns]
    if missing:
        raise ValueError(f"columns went missing: {missing}")
    return df.select(*(F.col(c).try_cast(t).alias(c) for c, t in schema.items()), *(c for c in df.columns if c not in schema))


def replace_years(df: DataFrame, path: str, date_column: str, force: bool = False) -> dict[str, int]:
    """Replaces the years of ``df`` in the lake after its rows are accounted for; refuses to shrink a year unless forced.

    New years are written aside and counted first. A year changes places by two renames, the old one away and the new one in,
    and is deleted only when all years are in place; after a crash in between, the old year is whole beside the lake.
    """
    spark = df.sparkSession
    good, bad = split_rejects(df, date_column)
    new = {r[0]: r[1] for r in good.groupBy(F.year(date_column)).count().collect()}
    rejected = bad.count()
    if exists(spark, path):
        old_frame = spark.read.option("mergeSchema", True).parquet(path)
        old = {r[0]: r[1] for r in old_frame.groupBy("year").count().collect()}
        shrunk = {y: (old[y], n) for y, n in new.items() if n < old.get(y, 0)}
        if shrunk and not force:
            raise ValueError(f"years would shrink: {shrunk}")
        good = conform(good, {c: t for c, t in old_frame.dtypes if c not in ("year", "month")})
    dated = good.withColumns({"year": F.year(date_column), "month": F.month(date_column)})
    name = uuid.uuid4().hex
    staging, aside = f"{path.rstrip('/')}.staging-{name}", f"{path.rstrip('/')}.replaced-{name}"
    dated.write.option("compression", "zstd").partitionBy("year", "month").parquet(staging)
    written = spark.read.parquet(staging).count() if new else 0
    if written != sum(new.values()):
        raise OSError(f"{written} of {sum(new.values())} rows were written to {staging}")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    fs.mkdirs(at(aside))
    for year in new:  # whole years change places, so that no month of an old one stays
        target = at(f"{path}/year={year}")
        if fs.exists(target) and not fs.rename(target, at(f"{aside}/year={year}")):
            raise OSError(f"year {year} could not be moved away")
        if not fs.rename(at(f"{staging}/year={year}"), target):
            fs.rename(at(f"{aside}/year={year}"), target)
            raise OSError(f"year {year} could not be put in place; it is whole in {staging}")
    fs.delete(at(staging), True)
    fs.delete(at(aside), True)
    return {"rows": sum(new.values()), "rejects": rejected}


def audit(df: DataFrame, date_column: str) -> DataFrame:
    """Rows, first and last date by year."""
    return df.groupBy(F.year(date_column).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min(date_column).alias("first"), F.max(date_column).alias("last"))


def health(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share missing, share of values that aren't 0, variance, and whether it is dead."""
    rows = df.unpivot([], columns, "field", "value")
    v = F.col("value")
    out = rows.groupBy("field").agg((1 - F.count(v) / F.count(F.lit(1))).alias("missing"), F.avg((v != 0).cast("double")).alias("nonzero"), F.var_pop(v).alias("variance"))
    return out.withColumn("dead", F.coalesce(F.col("variance") < 1e-16, F.lit(True)) | (F.col("missing") > 0.95))


def overlay(base: DataFrame, extra: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left-joins vendor columns onto a table, replacing stale ones."""
    return base.drop(*columns).join(extra.select(*keys, *columns), keys, "left")


def fingerprint(**request) -> str:
    """A name for the result of a request."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]


def query_arrow(spark: SparkSession, sql: str):
    """The result of any SQL as an Arrow table on the driver."""
    return spark.sql(sql).toArrow()


def price_frame(df: DataFrame, close: str = "close", factor: str = "cfadj", time: str = "date", start: str | None = None, end: str | None = None) -> DataFrame:
    """Typed prices within dates, with ``adj_close``: the close by its adjustment factor, 1 where that is missing."""
    out = df.withColumns({time: F.col(time).try_cast("date"), close: F.col(close).try_cast("double"), factor: F.col(factor).try_cast("double")}).where(F.col(time).isNotNull())
    out = out.where(F.col(time) >= F.lit(start).cast("date")) if start else out
    out = out.where(F.col(time) <= F.lit(end).cast("date")) if end else out
    return out.withColumn("adj_close", F.col(close) * F.coalesce(factor, F.lit(1.0)))


def returns_matrix(df: DataFrame, calendar: DataFrame, ids: list, entity: str, time: str, r: str, lead: int = 400) -> DataFrame:
    """(dt, entity, r, lead_in): a row for each stated id on each date of the calendar, a missing return where there is none, and
    rows of the ``lead`` days before the calendar marked as lead-in. Returns are never carried forward."""
    own = df.where(F.col(entity).isin(ids)).select(entity, F.col(time).cast("date").alias("dt"), F.col(r).try_cast("double").alias("r")).groupBy(entity, "dt").agg(F.max("r").alias("r"))
    days = calendar.select(F.col(calendar.columns[0]).cast("date").alias("dt")).distinct()
    first = days.agg(F.min("dt").alias("__first"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(i) for i in ids)).cast(f"array<{dict(df.dtypes)[entity]}>")).alias(entity))
    inside = days.crossJoin(F.broadcast(names)).join(own, [entity, "dt"], "left").withColumn("lead_in", F.lit(False))
    before = own.crossJoin(F.broadcast(first)).where((F.col("dt") < F.col("__first")) & (F.col("dt") >= F.date_sub("__first", lead))).drop("__first").withColumn("lead_in", F.lit(True))
    return inside.select("dt", entity, "r", "lead_in").unionByName(before.select("dt", entity, "r", "lead_in"))


def macro_frame(state: DataFrame, dispersion: DataFrame, rates: list[str], time: str = "date") -> DataFrame:
    """State and dispersion by date, filled forwards only; dates on which anything but a rate is missing go, missing rates are 0."""
    from pyspark.sql import Window

    joined = state.join(dispersion, time, "left")
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)  # a row for each date
    values = [c for c in joined.columns if c != time]
    out = joined.select(time, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in values))
    for c in values:
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0))) if c in rates else out.where(F.col(c).isNotNull())
    return out


def lagged_candidates(df: DataFrame, calendar: DataFrame, names: dict[str, list[str]], time: str = "date", least: int = 10) -> DataFrame:
    """For each output name, the first candidate column that is there, on the calendar's dates, a date late; null for a series
    with fewer than ``least`` values."""
    from pyspark.sql import Window

    have = {c.lower(): c for c in df.columns}
    found = {out: next((have[c.lower()] for c in options if c.lower() in have), None) for out, options in names.items()}
    dates = calendar.select(F.col(calendar.columns[0]).cast("date").alias("dt")).distinct()
    values = df.select(F.col(time).try_cast("date").alias("dt"), *(F.col(c).try_cast("double").alias(o) for o, c in found.items() if c)).where("dt is not null")
    w, whole = Window.orderBy("dt"), Window.partitionBy(F.lit(0))  # a row for each date
    late = dates.join(values, "dt", "left").select("dt", *((F.lag(o).over(w) if c else F.lit(None).cast("double")).alias(o) for o, c in found.items()))
    return late.select("dt", *(F.when(F.count(o).over(whole) >= least, F.col(o)).alias(o) for o in found))


def decimal_factors(df: DataFrame, columns: list[str], time: str = "date", sample: tuple[str, ...] = ("Mkt-RF", "SMB", "HML", "Mom")) -> DataFrame:
    """Factor returns as decimals: all columns are divided by 100 if the median absolute value of the first well-known one is
    above 0.5, which daily percentages are and decimals aren't."""
    known = next((c for c in columns if c in sample), None)
    typed = df.select(time, *(F.col(c).try_cast("double").alias(c) for c in columns))
    if known is None:
        return typed
    unit = typed.agg(F.when(F.percentile(F.abs(F.col(f"`{known}`")), F.lit(0.5)) > 0.5, 100.0).otherwise(1.0).alias("__unit"))
    return typed.crossJoin(F.broadcast(unit)).select(time, *((F.col(f"`{c}`") / F.col("__unit")).alias(c) for c in columns))


def read_report(spark: SparkSession, path: str, field: str, schema: str | None = None) -> DataFrame:
    """A row for each element of an array in JSON reports of one document a file."""
    reader = spark.read.option("multiLine", True)
    found = (reader.schema(schema) if schema else reader).json(path)
    return found.select(F.explode(field).alias("__x")).select("__x.*") if "struct" in found.schema[field].dataType.simpleString() else found.select(F.explode(field).alias(field))


def rates_overlay(rates: DataFrame, quotes: DataFrame, instruments: dict[str, tuple[str, bool]], time: str = "date", name: str = "ric", yields: str = "YLDTOMAT", fixing: str = "FIXING_1", stamp: str = "asof_ts") -> DataFrame:
    """Rates with a column for each instrument, its yield or (if so stated) its fixing and else its yield, and the first stamp of
    the date. Columns of the same names in ``rates`` are replaced; dates that only the quotes have are added."""
    y, f = F.col(yields).try_cast("double"), F.col(fixing).try_cast("double")
    cells = [F.first(F.when(F.col(name) == i, F.coalesce(f, y) if prefer else y), ignorenulls=True).alias(c) for i, (c, prefer) in instruments.items()]
    wide = quotes.groupBy(time).agg(*cells, F.min(stamp).alias("rates_asof"))
    return rates.drop(*(c for c, _ in instruments.values()), "rates_asof").join(wide, time, "full_outer")


def write_atomic(df: DataFrame, path: str) -> None:
    """Writes aside, then puts the folder in place by renames: readers see the old table or the new one."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    staging, aside = f"{path.rstrip('/')}.staging-{name}", f"{path.rstrip('/')}.replaced-{name}"
    df.write.option("compression", "zstd").parquet(staging)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(aside)):
        raise OSError(f"{path} could not be moved away")
    if not fs.rename(at(staging), at(path)):
        if had:
            fs.rename(at(aside), at(path))
        raise OSError(f"{path} could not be put in place; it is whole in {staging}")
    if had:
        fs.delete(at(aside), True)


def mirror(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Copies the files of a folder that the target lacks or has in another size or with an older time; counts both."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    one, two = at(source).getFileSystem(conf), at(target).getFileSystem(conf)
    two.mkdirs(at(target))
    done = {"copied": 0, "skipped": 0}
    for f in one.listStatus(at(source)):
        if not f.isFile():
            continue
        to = at(f"{target}/{f.getPath().getName()}")
        if two.exists(to) and two.getFileStatus(to).getLen() == f.getLen() and two.getFileStatus(to).getModificationTime() >= f.getModificationTime():
            done["skipped"] += 1
            continue
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one, f.getPath(), two, to, False, True, conf)
        done["copied"] += 1
    return done


def write_version(df: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Adds rows to a versioned symbol: of each key the last by ``order`` stays; a changed schema rewrites the whole."""
    from lodestar.operators.reshape import dedupe

    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        df = old.unionByName(df, allowMissingColumns=True) if old.dtypes == df.dtypes or set(old.columns) <= set(df.columns) else df
    write_atomic(dedupe(df, keys, [F.col(order).desc_nulls_last()]), path)


def materialise(spark: SparkSession, families: dict[str, DataFrame], folder: str, keys: list[str]) -> DataFrame:
    """Writes each family as Parquet and returns ``(family, field, rows, missing)``: the share of missing values of each column."""
    out = None
    for name, df in families.items():
        write_atomic(df, f"{folder}/{name}")
        made = spark.read.parquet(f"{folder}/{name}")
        fields = [c for c in made.columns if c not in keys]
        n = F.count(F.lit(1))
        counts = made.agg(n.alias("rows"), F.array(*(F.struct(F.lit(c).alias("field"), (1 - F.count(c) / F.nullif(n, F.lit(0))).alias("missing")) for c in fields)).alias("f"))
        rows = counts.select(F.lit(name).alias("family"), "rows", F.inline("f")).select("family", "field", "rows", "missing")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_strategies(df: DataFrame, folder: str, by: str = "strategy") -> None:
    """One folder of Parquet for each strategy."""
    df.repartition(by).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(folder)


def ingest_series(spark: SparkSession, path: str, series: str, time: str, value: str, lag_days: int) -> DataFrame:
    """(event_date, available_date, value, series_id) of a CSV: undateable rows and missing values go, the last row of a date stays."""
    raw = read_csv(spark, path, all_text=True).withColumn("__i", F.monotonically_increasing_id())
    rows = raw.select(F.col(time).try_cast("date").alias("event_date"), F.col(value).try_cast("double").alias("value"), "__i").where("event_date is not null and value is not null")
    last = rows.groupBy("event_date").agg(F.max_by("value", "__i").alias("value"))
    return last.select("event_date", F.date_add("event_date", lag_days).alias("available_date"), "value", F.lit(series).alias("series_id"))


def flat_tables(spark: SparkSession, sources: dict[str, str], folder: str) -> list[str]:
    """Writes each source that isn't there yet as flat Parquet; the names of those written."""
    done = []
    for name, path in sources.items():
        if not exists(spark, f"{folder}/{name}"):
            write_atomic(read_any(spark, require(spark, path)), f"{folder}/{name}")
            done.append(name)
    return done


def cached(spark: SparkSession, folder: str, make, **request) -> DataFrame:
    """The stored result of a request, or else ``make()`` stored under the request's fingerprint."""
    path = f"{folder}/{fingerprint(**request)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        write_atomic(make(), path)
    return spark.read.parquet(path)


# texts of remote queries; read_jdbc runs them where there is a server, any SQL session where the tables are at hand

#: The filters of standard annual and quarterly statements.
STATEMENT_FILTERS = {"indfmt": "INDL", "datafmt": "STD", "consol": "C", "popsrc": "D"}


def select_sql(table: str, columns: list[str], equal: dict | None = None, ids: tuple[str, list] | None = None, dates: tuple[str, str | None, str | None] | None = None, extra: str | None = None) -> str:
    """A filtered select; conditions are joined by AND, values quoted."""
    where = [f"{c} = {literal(v)}" for c, v in (equal or {}).items()]
    if ids:
        where.append(f"{ids[0]} IN ({', '.join(map(literal, ids[1]))})")
    if dates:
        where += [f"{dates[0]} {op} DATE {literal(d)}" for op, d in ((">=", dates[1]), ("<=", dates[2])) if d]
    where += [extra] if extra else []
    return f"SELECT {', '.join(columns)} FROM {table}" + (f" WHERE {' AND '.join(where)}" if where else "")


def statements_sql(table: str, columns: list[str], keys: list | None = None, start: str | None = None, end: str | None = None, key: str = "gvkey", time: str = "datadate") -> str:
    """Annual or quarterly statements in the standard format."""
    return select_sql(table, columns, STATEMENT_FILTERS, (key, keys) if keys else None, (time, start, end) if start or end else None)


def links_sql(table: str, columns: list[str], kinds: tuple[str, str] | None = None, allowed: list[str] | None = None) -> str:
    """A link table, of some kinds of links if stated."""
    return select_sql(table, columns, ids=(kinds[0], allowed) if kinds and allowed else None)


def yearly_sql(prefix: str, years: list[int], columns: list[str], ids: tuple[str, list] | None = None, extra: str | None = None) -> str:
    """One select over tables that are named by year."""
    return " UNION ALL ".join(select_sql(f"{prefix}{y}", columns, ids=ids, extra=extra) for y in years)


def chunked(ids: list, size: int) -> list[list]:
    return [ids[k : k + size] for k in range(0, len(ids), size)]
