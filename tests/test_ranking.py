"""Ranks by sampled ranges against windows over whole groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.operators import ranking


@pytest.fixture(params=[(1024, 32_768), (16, 64), (9, 4000), (1, 1)])
def ranges(request, monkeypatch):
    monkeypatch.setattr(ranking, "RANGES", request.param[0])
    monkeypatch.setattr(ranking, "SAMPLED", request.param[1])
    return request.param[0]


def markets(spark, n=3000):
    volume = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 2 == 0, 0.0).otherwise(F.floor(F.rand(3) * 50).cast("double"))
    platform = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("p"), F.col("id") % 11))
    return spark.range(n).select("id", platform.alias("platform"), volume.alias("volume")).repartition(5, "id")


def test_ranks_are_those_of_windows(spark, ranges):
    m = markets(spark)
    got = {r.id: r["rank"] for r in ranking.rank_by_ranges(m, "platform", -F.col("volume"), "id").collect()}
    want = m.withColumn("rank", F.row_number().over(Window.partitionBy("platform").orderBy(F.desc_nulls_first("volume"), "id")))
    assert got == {r.id: r["rank"] for r in want.collect()}


def test_ranges_are_even_and_no_group_is_whole(spark):
    m = markets(spark, 20_000)
    key = F.struct(F.col("platform").alias("g"), -F.col("volume"), "id")
    cut = ranking._splitters(m.select(key.alias("k"))).scalar()
    sizes = [r["count"] for r in m.withColumn("cut", cut).groupBy("platform", ranking._range_of(key, F.col("cut")).alias("range")).count().collect()]
    assert max(sizes) <= 5 * 20_000 / ranking.RANGES and len(sizes) <= ranking.RANGES + 10


def test_shares_and_phases(spark, ranges):
    m = markets(spark).filter("platform IS NOT NULL")
    got = {r.id: r.share for r in ranking.proportional_merge(m, "platform", F.col("id")).collect()}
    w = Window.partitionBy("platform")
    want = m.withColumn("share", (F.row_number().over(w.orderBy("id")) - 0.5) / F.count("*").over(w))
    assert got == {r.id: r.share for r in want.collect()}
    order = ["hot", "p0", "p3"]
    rows = sorted(ranking.interleaved(m, "platform", order, 4, F.col("id")).collect(), key=lambda r: (r.phase, r.round, r.turn))
    queues = {p: sorted(r.id for r in m.collect() if r.platform == p) for p in order}
    plain = [queues[p].pop(0) for _ in range(4) for p in order if queues[p]]
    while any(queues.values()):
        plain += [queues[p].pop(0) for p in order if queues[p]]
    assert [r.id for r in rows] == plain


def test_empty_table(spark, ranges):
    assert ranking.rank_by_ranges(markets(spark, 0), "platform", "id").collect() == []
