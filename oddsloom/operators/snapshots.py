"""Price snapshots: append rows, read series, keep and report what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_ROWS, LEGACY_ROWS, TOP_OUTCOMES = 2500, 500, 3


def snapshot_rows(markets: DataFrame, top: int = TOP_OUTCOMES) -> DataFrame:
    """Per market its ``top`` outcomes by percentage, index = rank from 0, and one legacy row with the best price.

    Markets have ``id, volume`` and ``outcomes`` (array of ``percentage, k, name, price``, k the place in the feed).
    """
    best = F.slice(F.array_sort("outcomes", lambda a, b: F.when(a.percentage > b.percentage, -1).when(a.percentage < b.percentage, 1).when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)), 1, top)
    sorted_ = markets.select("id", "volume", best.alias("best"))
    each = sorted_.select("id", "volume", F.posexplode("best").alias("outcome_index", "o"))
    each = each.select("id", "volume", "outcome_index", F.col("o.name").alias("outcome_name"), F.col("o.price").alias("price"), F.col("o.percentage").alias("outcome_percentage"))
    legacy = sorted_.select("id", "volume", F.lit(None).cast("int").alias("outcome_index"), F.lit(None).cast("string").alias("outcome_name"), F.get("best", F.lit(0)).price.alias("price"), F.lit(None).cast("double").alias("outcome_percentage"))
    return each.unionByName(legacy)


def append(rows: DataFrame, path: str, recorded_at: Column) -> None:
    """Appends a batch to the table of snapshots, one folder a day."""
    rows.withColumn("recorded_at", recorded_at).withColumn("day", F.to_date("recorded_at")).write.mode("append").partitionBy("day").parquet(path)


def oldest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The oldest ``n`` rows of each market, in order of time and outcome."""
    w = Window.partitionBy("market_id").orderBy("recorded_at", *by)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def outcome_series(df: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """Points of each outcome: percentage, else price times 100; rows without either are left out.

    The name is the first one among the outcome's rows, from its first valid row on, else ``Outcome n``.
    """
    rows = oldest(df.filter("outcome_index IS NOT NULL"), n, "outcome_index")
    value = F.coalesce("outcome_percentage", F.col("outcome_price") * 100)
    valid = rows.withColumn("value", value).filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("recorded_at").isNotNull())
    w = Window.partitionBy("market_id", "outcome_index").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    name = F.coalesce(F.nullif(F.first("outcome_name").over(w), F.lit("")), F.concat(F.lit("Outcome "), F.col("outcome_index") + 1))
    return valid.select("market_id", "outcome_index", name.alias("outcome_name"), "recorded_at", "value")


def series_arrays(points: DataFrame) -> DataFrame:
    """The same nested: one row an outcome with its points in order."""
    return points.groupBy("market_id", "outcome_index").agg(F.first("outcome_name").alias("outcome_name"), F.array_sort(F.collect_list(F.struct("recorded_at", "value"))).alias("data"))


def first_outcome(points: DataFrame) -> DataFrame:
    """The series of each market's lowest outcome index."""
    low = points.groupBy("market_id").agg(F.min("outcome_index").alias("outcome_index"))
    return points.join(low, ["market_id", "outcome_index"])


def legacy_series(df: DataFrame, n: int = LEGACY_ROWS) -> DataFrame:
    """Prices of the oldest rows as percentages; a null price is 0, and values up to 1 are scaled (1 is then 100)."""
    price = F.coalesce("price", F.lit(0.0))
    return oldest(df, n, "event_id").select("market_id", "event_id", "recorded_at", F.when(price > 1, price).otherwise(price * 100).alias("value"))


def since(df: DataFrame, as_of: Column, interval: str | None, time: str = "recorded_at") -> DataFrame:
    """Rows of the last ``interval`` (an SQL interval; None is all time)."""
    return df if interval is None else df.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {interval}"))


def latest(df: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy("market_id").orderBy(F.desc("recorded_at"), F.desc("event_id"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def survivors(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    if days < 1:
        raise ValueError("at least one day is kept")
    return df.filter(F.col("recorded_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def retention_report(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row: what a clean-up deletes, what remains, and where it cuts."""
    cut = as_of - F.expr(f"INTERVAL {days} DAYS")
    return df.agg(F.count_if(F.col("recorded_at") < cut).alias("deleted"), F.count_if(F.col("recorded_at") >= cut).alias("remaining"), F.max(cut).alias("cutoff"))


def rewrite_survivors(spark, path: str, out: str, as_of: Column, days: int) -> DataFrame:
    """Writes what survives beside the table and returns the report; whole days before the cut are never read."""
    table = spark.read.parquet(path)
    kept = survivors(table.filter(F.col("day") >= F.to_date(as_of - F.expr(f"INTERVAL {days} DAYS"))), as_of, days)
    kept.write.mode("overwrite").partitionBy("day").parquet(out)
    return retention_report(table, as_of, days)


def stats(df: DataFrame, as_of: Column) -> DataFrame:
    """One row: rows, markets, first and last time, span in whole days up, rows older than a week."""
    span = F.unix_micros(F.max("recorded_at")) - F.unix_micros(F.min("recorded_at"))
    return df.agg(
        F.count("*").alias("n"),
        F.count_distinct("market_id").alias("markets"),
        F.min("recorded_at").alias("first_at"),
        F.max("recorded_at").alias("last_at"),
        F.ceil(span / F.lit(86400e6)).alias("days"),
        F.count_if(F.col("recorded_at") < as_of - F.expr("INTERVAL 7 DAYS")).alias("older_than_week"),
    )


def per_day(df: DataFrame, days: int = 7) -> DataFrame:
    return df.groupBy(F.to_date("recorded_at").alias("day")).count().withColumnRenamed("count", "n").orderBy(F.desc("day")).limit(days)


def capacity(df: DataFrame, budget_bytes: float = 450 * 1024 * 1024, options: tuple[int, ...] = (1, 3, 7, 14, 30)) -> DataFrame:
    """Size of each retention option: bytes a row (payload with overhead), rows a day, and the days that the budget holds."""
    span = (F.unix_micros(F.max("recorded_at")) - F.unix_micros(F.min("recorded_at"))) / F.lit(86400e6)
    base = df.agg(F.avg(F.length("data") * 1.2 + 200).alias("row_bytes"), (F.count("*") / F.greatest(F.ceil(span), F.lit(1))).alias("rows_per_day"))
    base = base.withColumn("max_days", F.floor(F.floor(F.lit(float(budget_bytes)) / F.col("row_bytes")) / F.col("rows_per_day")).cast("long"))
    each = base.withColumn("days", F.explode(F.array_distinct(F.concat(F.array(*(F.lit(d).cast("long") for d in options)), F.array("max_days")))))
    return each.withColumn("option_bytes", F.col("days") * F.col("rows_per_day") * F.col("row_bytes"))


def spline_controls(points: DataFrame, key: list[str], time: str, value: str, tension: float = 6.0) -> DataFrame:
    """Bezier control points between neighbours, from the points before and after them; ends repeat themselves."""
    w = Window.partitionBy(*key).orderBy(time, "event_id")
    at = lambda c, k: F.lag(c, -k).over(w)
    out = points
    for axis, c in (("x", time), ("y", value)):
        here = F.col(c)
        before, after = F.coalesce(at(c, -1), here), at(c, 1)
        beyond = F.coalesce(at(c, 2), after)
        out = out.withColumns({f"{axis}2": after, f"c1{axis}": here + (after - before) / tension, f"c2{axis}": after - (beyond - here) / tension})
    return out.filter("x2 IS NOT NULL")


def time_ticks(df: DataFrame, time: str, n: int = 7) -> DataFrame:
    """``n`` equally spaced times from the first to the last, in microseconds."""
    ends = df.agg(F.unix_micros(F.min(time)).alias("lo"), F.unix_micros(F.max(time)).alias("hi"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tick"), "lo", "hi").select("tick", F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("tick") / F.lit(float(n - 1))).alias("at_micros"))


def slim(data: Column, fields: list[str]) -> Column:
    """A JSON payload with the named fields alone."""
    return F.to_json(F.struct(*(F.get_json_object(data, f"$.{f}").alias(f) for f in fields)))


def insert_metrics(rows: DataFrame) -> DataFrame:
    """One row on a batch of snapshots: rows, markets, rows of outcomes."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct("market_id").alias("markets"), F.count_if(F.col("outcome_index").isNotNull()).alias("outcome_rows"))


def report_json(report: DataFrame, done_at: Column) -> DataFrame:
    """A retention report as one JSON text, with success flag and time."""
    fields = [F.lit(True).alias("success"), "deleted", "remaining", F.col("cutoff").cast("string").alias("cutoff"), done_at.cast("string").alias("timestamp")]
    return report.select(F.to_json(F.struct(*fields)).alias("report"))


def payload_size(df: DataFrame, sample: int = 10) -> DataFrame:
    """Average length of the payloads of the first ``sample`` rows, and the megabytes that all rows would have at that."""
    some = df.orderBy("event_id").limit(sample).agg(F.avg(F.coalesce(F.length("data"), F.lit(0))).alias("mean_length"))
    rows = df.agg(F.count("*").alias("n")).scalar()
    return some.select("mean_length", (F.col("mean_length") * rows / (1024 * 1024)).alias("megabytes"))
