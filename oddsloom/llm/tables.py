"""Inputs, and tables that a job writes and reads again in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch at most: texts go to Python workers and back a few MB at a time.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: A key of more rows than this, and than a 50,000th of all, is hot: there are fewer than 50,000 of them.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="oddsloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/oddsloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Deletes tables of this application that ``frames`` read and nothing needs any more: what was made of them is written."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/oddsloom-{spark.sparkContext.applicationId}/" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key and in ``n`` how many rows have it (an estimate will do).

    Hot keys are broadcast, so their rows stay where they are; all others are joined as Spark likes. ``table`` is read
    three times: it should be a written one, or small.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(table.filter(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)))
    cold = table.filter(F.col(n) <= max(HOT_ROWS, total // HOT_KEYS))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` in batches small enough for long texts. Sets the session's batch limits, as Spark reads them when a job starts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)
