"""The table of price snapshots as files: its layout, retention in place, and a collector whose replays change nothing.

The table has a folder for each day and platform. In a folder, files hold ranges of (market, time, outcome) and are
sorted by them, so that a read of some markets and times opens the folders of its days, and in them the files and row
groups whose smallest and largest values take them in. Batches of a collector have folders of their own in there.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from oddsloom.sources import shared

ORDER = ("market_id", "recorded_at", "outcome_index")
#: What identifies a snapshot's series.
SERIES = ("market_id", "outcome_index")


def _laid_out(rows: DataFrame, *folders: str) -> DataFrame:
    """Rows in ranges of folder and order, sorted: a folder of many rows has several files, each of a range."""
    rows = rows.withColumn("day", F.to_date("recorded_at"))
    return rows.repartitionByRange("day", *folders, *ORDER).sortWithinPartitions("day", *folders, *ORDER)


def _metrics(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """What a batch holds, counted while it is written. A market has one row without an outcome."""
    seen = Observation()
    none = F.col("outcome_index").isNull()
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(none).alias("markets"), F.count_if(~none).alias("outcome_rows")), seen


def write(rows: DataFrame, path: str, mode: str = "append") -> dict[str, int]:
    """Writes snapshots (``platform, market_id, outcome_index, recorded_at``, and more) and returns ``n, markets, outcome_rows`` of them.

    Rows without a time lie in a folder of their own. The counts are made by the scan that writes.
    """
    out, seen = _metrics(_laid_out(rows, "platform"))
    out.write.mode(mode).partitionBy("day", "platform").parquet(path)
    return seen.get


def read(spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None, platform: str | None = None, markets: list | None = None) -> DataFrame:
    """Snapshots from ``since`` on and before ``until``, of a platform and of some markets; days that are not asked for are not listed."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.filter((F.col("day") >= F.to_date(since)) & (F.col("recorded_at") >= since))
    if until is not None:
        rows = rows.filter((F.col("day") <= F.to_date(until)) & (F.col("recorded_at") < until))
    if platform is not None:
        rows = rows.filter(F.col("platform") == platform)
    if markets is not None:
        rows = rows.filter(F.col("market_id").isin(markets))
    return rows


def retain(spark: SparkSession, path: str, as_of: datetime, days: int) -> dict[str, object]:
    """Deletes, in place, what is older than ``days`` before ``as_of``; returns ``deleted, remaining, cutoff``.

    Whole days before the cut are dropped as folders. Of the cut's day only folders with rows on both sides of the cut
    are written anew, each replaced by what of it survives; all other files stay as they are. Doing it again changes
    nothing. Rows without a time are kept, as no cut is after them. Days, and ``as_of``, are in the session's time zone.
    """
    if days < 1:
        raise ValueError("at least one day is kept")
    cut = as_of - timedelta(days=days)
    table = spark.read.parquet(path)
    parts = [c for c in ("platform", "batch") if c in table.columns]
    day = F.lit(str(cut.date())).cast("date")
    whole, last = F.col("day") < day, F.col("day") == day
    old = F.col("recorded_at") < F.lit(cut.isoformat(" ")).cast("timestamp")
    gone = table.filter(whole).groupBy("day").count().collect()
    cells = table.filter(last).groupBy("day", *parts).agg(F.count_if(old).alias("old"), F.count_if(~old).alias("kept")).collect()
    split = [r for r in cells if r.old and r.kept]
    if split:
        mine = spark.createDataFrame([tuple(r[c] for c in ("day", *parts)) for r in split], table.select("day", *parts).schema)
        same = [table[c].eqNullSafe(mine[c]) for c in ("day", *parts)]
        kept = table.filter(last & ~old).join(F.broadcast(mine), same, "left_semi").select(*table.columns)
        _laid_out(kept, *parts).select(*table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", *parts).parquet(path)
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    named = lambda r: "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else escaped(str(r[c]))}" for c in parts)
    for r in cells:
        if r.old and not r.kept:
            shared.remove(spark, f"{path}/day={r.day}/{named(r)}")
    for r in gone:
        shared.remove(spark, f"{path}/day={r.day}")
    spark.catalog.refreshByPath(path)
    deleted = sum(r["count"] for r in gone) + sum(r.old for r in cells)
    return {"deleted": deleted, "remaining": spark.read.schema(table.schema).parquet(path).count(), "cutoff": cut}


def latest(rows: DataFrame, *ties: str) -> DataFrame:
    """The last row of each series; of equal times the one with the largest ``ties``."""
    last = F.max_by(F.struct(*rows.columns), F.struct("recorded_at", *ties))
    return rows.groupBy(*SERIES).agg(last.alias("row")).select("row.*")


def read_latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of a table of last rows, or the newest before a batch; None if there is none."""
    versions = sorted(int(f.removeprefix("version=")) for f in shared.folders(spark, path) if f.startswith("version="))
    for v in reversed(versions):
        if (before is None or v < before) and shared.exists(spark, f"{path}/version={v}/_SUCCESS"):
            return spark.read.parquet(f"{path}/version={v}")
    return None


def write_batch(rows: DataFrame, batch: int, path: str, latest_path: str, *ties: str, kept: int = 2) -> dict[str, int]:
    """Writes a collector's batch and brings the table of last rows up to date; the same batch again leaves both as they are.

    A batch's rows lie in folders of its number, which a replay replaces. Last rows are a version for each batch, made of
    the newest version before it, so a replay makes the same version; one that was not finished is never read. Rows that
    come late are kept, and are last only if nothing of their series is newer. ``kept`` versions stay.
    """
    spark = rows.sparkSession
    out, seen = _metrics(_laid_out(rows.withColumn("batch", F.lit(batch)), "platform", "batch"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "platform", "batch").parquet(path)
    before = read_latest(spark, latest_path, batch)
    both = rows if before is None else before.select(*rows.columns).unionByName(rows)
    latest(both, *ties).write.mode("overwrite").parquet(f"{latest_path}/version={batch}")
    for f in shared.folders(spark, latest_path):
        if f.startswith("version=") and int(f.removeprefix("version=")) <= batch - kept:
            shared.remove(spark, f"{latest_path}/{f}")
    return seen.get


def collect(rows: DataFrame, path: str, latest_path: str, checkpoint: str, *ties: str, told: Callable[[int, dict[str, int]], None] | None = None):
    """Starts a query that writes what a stream has, batch by batch, and then stops; ``told`` gets each batch's counts."""

    def run(batch: DataFrame, number: int) -> None:
        metrics = write_batch(batch, number, path, latest_path, *ties)
        if told is not None:
            told(number, metrics)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
