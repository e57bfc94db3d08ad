"""The files of snapshots: what reads open, what retention leaves alone, and what a replayed batch changes."""

import datetime
import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import snapshot_store as store

SCHEMA = "event_id long, market_id long, platform string, outcome_index int, recorded_at timestamp, price double"
START = datetime.datetime(2024, 1, 1)


def rows(spark, n=4000, first=0):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") * 641) % (5 * 86_400))
    base = spark.range(first, first + n)
    index = F.when(F.col("id") % 4 == 3, F.lit(None)).otherwise(F.col("id") % 4).cast("int")
    return base.select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("market_id"), F.concat(F.lit("p"), F.col("id") % 2).alias("platform"), index.alias("outcome_index"), at.alias("recorded_at"), (F.col("id") / 7).alias("price"))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def content(df):
    return sorted(map(str, df.select("event_id", "market_id", "outcome_index", "recorded_at", "price", "platform").collect()))


def test_counts_come_with_the_write(spark, tmp_path):
    got = store.write(rows(spark), f"{tmp_path}/t")
    assert got == {"n": 4000, "markets": 1000, "outcome_rows": 3000}
    assert content(spark.read.parquet(f"{tmp_path}/t")) == content(rows(spark))


def test_reads_open_few_files(spark, tmp_path):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40", "spark.sql.maxMetadataStringLength": "2000"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        store.write(rows(spark), f"{tmp_path}/t")
        reads_open_few_files(spark, f"{tmp_path}/t")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def reads_open_few_files(spark, path):
    got = store.read(spark, path, F.lit(START + datetime.timedelta(days=1)), F.lit(START + datetime.timedelta(days=2, hours=3)), "p1", [5, 7])
    text = plan(got)
    filters = {k: text.split(f"{k}: [")[1].split("], ")[0] for k in ("PartitionFilters", "PushedFilters")}
    assert "day" in filters["PartitionFilters"] and "platform" in filters["PartitionFilters"]
    assert "In(market_id, [5,7" in filters["PushedFilters"] and "GreaterThanOrEqual(recorded_at" in filters["PushedFilters"]
    every = rows(spark).filter(F.col("recorded_at").between(START + datetime.timedelta(days=1), START + datetime.timedelta(days=2, hours=2, minutes=59, seconds=59)) & (F.col("platform") == "p1") & F.col("market_id").isin(5, 7))
    assert content(got) == content(every) and every.count() > 5
    # The files of a folder follow each other, so a market lies in few of them.
    several = 0
    for folder in glob.glob(f"{path}/day=*/platform=*"):
        spans = []
        for f in glob.glob(f"{folder}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            column = meta.schema.names.index("market_id")
            spans += [(s.min, s.max) for s in (meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups))]
        assert all(a[1] <= b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
        several += len(spans) > 2
    assert several > 5


@pytest.mark.parametrize("hours", [0, 7, 24])
def test_retention_in_place(spark, tmp_path, hours):
    path = f"{tmp_path}/t"
    late = rows(spark, 40, 9000).withColumn("recorded_at", F.lit(None).cast("timestamp"))
    store.write(rows(spark).unionByName(late), path)
    before = files(path)
    as_of = START + datetime.timedelta(days=4, hours=hours)
    cut = as_of - datetime.timedelta(days=2)
    want = rows(spark).unionByName(late).filter((F.col("recorded_at") >= cut) | F.col("recorded_at").isNull())
    report = store.retain(spark, path, as_of, 2)
    assert report == {"deleted": 4040 - want.count(), "remaining": want.count(), "cutoff": cut}
    assert content(spark.read.parquet(path)) == content(want)
    after = files(path)
    day = f"day={cut.date()}"
    assert all(after[f] == t for f, t in before.items() if day not in f and f in after)
    assert {f for f in before if f"day={cut.date()}" not in f and f not in after} == {f for f in before if "day=20" in f and f.split("day=")[1][:10] < str(cut.date())}
    assert store.retain(spark, path, as_of, 2) == report | {"deleted": 0}
    assert files(path) == after
    with pytest.raises(ValueError):
        store.retain(spark, path, as_of, 0)


def test_folders_without_survivors_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    early = rows(spark, 10).withColumns({"recorded_at": F.lit(START), "platform": F.lit("gone: a/b")})
    store.write(early.unionByName(rows(spark, 10).withColumns({"recorded_at": F.lit(START + datetime.timedelta(hours=9)), "platform": F.lit("stays")})), path)
    before = files(path)
    assert store.retain(spark, path, START + datetime.timedelta(days=1, hours=8), 1)["deleted"] == 10
    assert files(path) == {f: t for f, t in before.items() if "platform=stays" in f}


def test_replays_change_nothing(spark, tmp_path):
    path, last = f"{tmp_path}/t", f"{tmp_path}/latest"
    parts = [rows(spark, 1000, 1000 * k) for k in range(3)]
    for k, p in enumerate(parts):
        store.write_batch(p, k, path, last, "event_id")
        store.write_batch(p, k, path, last, "event_id")
    assert content(spark.read.parquet(path)) == content(rows(spark, 3000))
    want = {}
    for r in sorted(rows(spark, 3000).collect(), key=lambda r: (r.recorded_at, r.event_id)):
        want[r.market_id, r.outcome_index] = str(r)
    assert {(r.market_id, r.outcome_index): str(r) for r in store.read_latest(spark, last).collect()} == want
    # A batch that broke off after its rows were written, and a version that was never finished.
    os.remove(f"{last}/version=2/_SUCCESS")
    assert store.read_latest(spark, last).count() == store.read_latest(spark, last, 2).count()
    store.write_batch(parts[2], 2, path, last, "event_id")
    assert {(r.market_id, r.outcome_index): str(r) for r in store.read_latest(spark, last).collect()} == want
    assert sorted(os.listdir(last)) == ["version=1", "version=2"]
    late = rows(spark, 50).withColumns({"recorded_at": F.lit(START - datetime.timedelta(days=9)), "event_id": F.col("event_id") + 10**6})
    store.write_batch(late, 3, path, last, "event_id")
    assert {(r.market_id, r.outcome_index): str(r) for r in store.read_latest(spark, last).collect()} == want and spark.read.parquet(path).count() == 3050


def test_a_stream_that_starts_again(spark, tmp_path):
    source, path, last, told = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/latest", {}
    run = lambda: store.collect(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), path, last, f"{tmp_path}/check", "event_id", told=lambda k, m: told.update({k: m})).awaitTermination()
    rows(spark, 500).select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(source)
    run()
    rows(spark, 700, 500).select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition(2).write.mode("append").parquet(source)
    run()
    run()
    assert content(spark.read.parquet(path)) == content(rows(spark, 1200)) and sum(m["n"] for m in told.values()) == 1200
    # The last batch was done, but its commit was lost.
    os.remove(sorted(glob.glob(f"{tmp_path}/check/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))[-1])
    for f in glob.glob(f"{tmp_path}/check/commits/.*.crc"):
        os.remove(f)
    run()
    assert content(spark.read.parquet(path)) == content(rows(spark, 1200))
    assert store.read_latest(spark, last).count() == rows(spark, 1200).select("market_id", "outcome_index").distinct().count()


def test_no_rows(spark, tmp_path):
    none = rows(spark).limit(0)
    assert store.write(none, f"{tmp_path}/t") == {"n": 0, "markets": 0, "outcome_rows": 0}
    assert store.write_batch(none, 0, f"{tmp_path}/b", f"{tmp_path}/latest")["n"] == 0
    assert store.read_latest(spark, f"{tmp_path}/latest").count() == 0 and store.read_latest(spark, f"{tmp_path}/nothing") is None
