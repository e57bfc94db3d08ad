"""Queries over snapshots that were written as files: reads of a range, retention in place, a collector's last rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import snapshot_store as store
from oddsloom.plans import relations as rel
from oddsloom.plans.queries import AS_OF
from oddsloom.plans.registry import query
from oddsloom.sources.shared import new_path

_STORED = f"SELECT *, CASE market_id % 3 WHEN 0 THEN 'Polymarket' WHEN 1 THEN 'Kalshi' ELSE 'PredictIt' END AS platform FROM ({rel.SNAPSHOT}) s"
_COLUMNS = "event_id, market_id, platform, outcome_index, price"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "snapshots")
    store.write(rel.relation(spark, sf_dir, _STORED), path)
    return path


@query(
    f"""SELECT {_COLUMNS} FROM ({_STORED}) x WHERE recorded_at >= TIMESTAMP '2024-01-10 06:00:00' AND recorded_at < TIMESTAMP '2024-01-20 18:00:00'
      AND platform = 'Kalshi' AND market_id IN (SELECT user_id FROM events WHERE event_id % 10 = 0)"""
)
def snapshot_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some markets of a platform in a range of time, read back from the table's files."""
    time = lambda t: F.lit(t).cast("timestamp")
    rows = store.read(spark, _stored(spark, sf_dir), time("2024-01-10 06:00:00"), time("2024-01-20 18:00:00"), "Kalshi")
    some = rel.relation(spark, sf_dir, "SELECT DISTINCT user_id AS market_id FROM events WHERE event_id % 10 = 0")
    return rows.join(some, "market_id", "left_semi").select(*_COLUMNS.split(", "))


@query(f"SELECT {_COLUMNS} FROM ({_STORED}) x WHERE recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY OR recorded_at IS NULL")
def retention_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in the table's files after retention, done twice."""
    path = _stored(spark, sf_dir)
    for _ in range(2):
        store.retain(spark, path, datetime.datetime.fromisoformat(AS_OF), 20)
    return spark.read.parquet(path).select(*_COLUMNS.split(", "))


@query(f"SELECT {_COLUMNS} FROM ({_STORED}) x QUALIFY row_number() OVER (PARTITION BY market_id, outcome_index ORDER BY recorded_at DESC, event_id DESC) = 1")
def collector_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each series after a collector has taken in the stream of events."""
    path = new_path(spark, "collector")
    arrived = rel.relation(spark, sf_dir, _STORED)
    # Snapshots arrive in files of some days each, and not in order.
    arrived.repartition(4, F.pmod(F.datediff(F.to_date("recorded_at"), F.lit("2024-01-01")), F.lit(8))).write.parquet(f"{path}/arrived")
    rows = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/arrived")
    store.collect(rows, f"{path}/rows", f"{path}/latest", f"{path}/checkpoint", "event_id").awaitTermination()
    last = store.read_latest(spark, f"{path}/latest")
    return (arrived if last is None else last).select(*_COLUMNS.split(", "))
