"""Ranking, mixing and deduplicating markets. ``ord`` is the order in which rows arrived; it breaks every tie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.expressions import bound


def rank_in(df: DataFrame, by: list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per(df: DataFrame, by: list[str], n: int | Column, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps a group's best per task before it shuffles."""
    return rank_in(df, by, *order, name="__rank").filter(F.col("__rank") <= n).drop("__rank")


def round_robin(df: DataFrame, platform: str, platform_order: list[str], limit: int, *order: Column | str) -> DataFrame:
    """Markets of all platforms in turn, best first: adds ``round`` and ``place`` (from 1). Platforms outside the order are left out.

    At most ``limit`` rows of a platform can get a place, so no more of them leave the per-platform ranking.
    """
    turn = F.coalesce(*(F.when(F.col(platform) == p, k) for k, p in enumerate(platform_order)))
    ranked = rank_in(df.withColumn("__turn", turn).filter("__turn IS NOT NULL"), [platform], *order, name="round").filter(F.col("round") <= limit)
    first = ranked.orderBy("round", "__turn").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy("round", "__turn"))).drop("__turn")


def round_robin_tail(df: DataFrame, platform: str, platform_order: list[str], limit: int, *order: Column | str) -> DataFrame:
    """``round_robin`` and, behind it, the rows of other platforms that it did not take, best first, up to ``limit`` in all."""
    taken = round_robin(df, platform, platform_order, limit, *order).select("id", "place")
    rest = df.join(taken.select("id"), "id", "left_anti").orderBy(*order).limit(limit).withColumn("k", F.row_number().over(Window.orderBy(*order)))
    head = taken.select("id", F.lit(0).alias("tail"), F.col("place").alias("k"))
    both = head.unionByName(rest.select("id", F.lit(1).alias("tail"), "k")).orderBy("tail", "k").limit(limit)
    return both.select("id", F.row_number().over(Window.orderBy("tail", "k")).alias("place"))


def interleaved(df: DataFrame, platform: str, platform_order: list[str], rounds: int, *keys: Column | str) -> DataFrame:
    """All rows in two phases: adds ``phase, round, turn``, the key to sort by. ``keys`` rise with the rank.

    The first phase takes one row of each platform in turn, for at most ``rounds`` rounds and a third of the largest
    platform's; the second takes what is left the same way, also of no other platforms.
    """
    turn = F.coalesce(*(F.when(F.col(platform) == p, k) for k, p in enumerate(platform_order)))
    ranked = rank_by_ranges(df.withColumn("turn", turn).filter("turn IS NOT NULL"), platform, *keys, name="round")
    largest = df.groupBy(platform).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    ranked = ranked.withColumn("__rounds", F.least(F.lit(rounds), F.ceil(largest / len(platform_order))))
    late = F.col("round") > F.col("__rounds")
    return ranked.withColumn("phase", F.when(late, 1).otherwise(0)).withColumn("round", F.when(late, F.col("round") - F.col("__rounds")).otherwise(F.col("round"))).drop("__rounds")


#: Ranges that rows are dealt into for their ranks, and rows that the bounds of the ranges are taken from.
RANGES, SAMPLED = 1024, 32_768
#: Bounds that are searched together, after every so many of them have been.
BLOCK = 32


def _splitters(keys: DataFrame) -> DataFrame:
    """One row: ``all``, at most ``RANGES`` bounds between keys (column ``k``), equally far apart in up to ``SAMPLED`` different keys, and every so many of them, ``heads``.

    The keys are those whose hashes have a fixed remainder, so the same rows have the same bounds, and a task sends few.
    """
    every = F.greatest(F.floor(keys.agg(F.count("*")).scalar() / (2 * SAMPLED)), F.lit(1))
    some = keys.filter(F.pmod(F.xxhash64("k"), every) == 0).distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLED)
    line = some.agg(F.array_sort(F.collect_list("k")).alias("k"), F.ceil(F.count("*") / RANGES).cast("int").alias("step"))
    bounds = F.filter("k", lambda _, place: place % F.greatest("step", F.lit(1)) == 0)
    line = line.select(F.array_distinct(bounds).alias("all"))
    return line.select(F.struct("all", F.filter("all", lambda _, place: place % BLOCK == 0).alias("heads")).alias("splitters"))


def _range_of(key: Column, splitters: Column) -> Column:
    """How many of the sorted bounds are at most ``key``, found in a block of bounds and then inside the block."""
    def of(k: Column, cut: Column) -> Column:
        upto = lambda some: F.size(F.filter(some, lambda s: s <= k))
        inside = lambda block: F.slice(cut["all"], (block - 1) * BLOCK + 1, BLOCK)
        return bound(lambda block: F.when(block == 0, 0).otherwise((block - 1) * BLOCK + upto(inside(block))), upto(cut["heads"]))

    return bound(of, key, splitters)


def rank_by_ranges(df: DataFrame, by: str, *keys: Column | str, name: str = "rank") -> DataFrame:
    """Ranks in each group from 1 by rising ``keys``, without a task that holds a group.

    Bounds sampled from all rows cut the order of (group, keys) into ranges. Rows are numbered in their range, and the
    rows of the ranges before it are added: of ranges there are at most ``RANGES`` and one more a group. The bounds only
    decide how even ranges are. Rows of equal keys are ranked in any order, in one range. The order must be of values
    that rise as they rank: a falling number is given negated.
    """
    key = F.struct(F.col(by).alias("g"), *(k if isinstance(k, Column) else F.col(k) for k in keys))
    rows = df.withColumn("__k", key)
    cut = _splitters(rows.select(F.col("__k").alias("k"))).scalar()
    rows = rows.withColumn("__cut", cut).withColumn("__range", _range_of(F.col("__k"), F.col("__cut"))).drop("__cut")
    sizes = rows.groupBy(by, "__range").agg(F.count("*").alias("__size"))
    past = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias("__by"), F.col("__range").alias("__of"), F.coalesce(F.sum("__size").over(past), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__range").orderBy("__k"))
    ranked = rows.withColumn("__row", inside).join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")))
    return ranked.withColumn(name, F.col("__row") + F.col("__before")).drop("__k", "__range", "__by", "__of", "__before", "__row")


def proportional_merge(df: DataFrame, platform: str, *keys: Column | str) -> DataFrame:
    """Platforms merged so that each prefix holds them in proportion: adds ``share``, the key to sort by. ``keys`` rise with the rank."""
    sizes = df.groupBy(F.col(platform).alias("__p")).agg(F.count("*").alias("__n"))
    ranked = rank_by_ranges(df, platform, *keys, name="__r").join(sizes, F.col(platform).eqNullSafe(F.col("__p")))
    return ranked.withColumn("share", (F.col("__r") - 0.5) / F.col("__n")).drop("__n", "__r", "__p")


def dedupe_first(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key; only keys and one row per task and key are shuffled."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(key, "__row.*")


def dedupe_last(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The last row of each key, in the place of the first: adds ``first_ord``."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row"), F.min(order).alias("first_ord"))
    return best.select(key, "__row.*", "first_ord")


def with_fillers(scored: DataFrame, markets: DataFrame, limit: int) -> DataFrame:
    """Scored markets by score and volume; if there are fewer than ``limit``, the largest others after them."""
    head = scored.orderBy(F.desc("score"), F.desc("volume"), "id").limit(limit).select("id", "volume", "score", F.lit(0).alias("tail"))
    rest = markets.join(scored.select("id"), "id", "left_anti").orderBy(F.desc("volume"), "id").limit(limit).select("id", "volume", F.lit(0).alias("score"), F.lit(1).alias("tail"))
    return head.unionByName(rest).orderBy("tail", F.desc("score"), F.desc("volume"), "id").limit(limit)


def volume_bucket(volume: Column) -> Column:
    return F.when(volume >= 10000, "high").when(volume >= 1000, "medium").when(volume > 0, "low")
