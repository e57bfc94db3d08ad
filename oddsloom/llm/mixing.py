"""Mixing sources to target weights along a curriculum that varies in time.

Every source has a target in tokens and a schedule: the rate at which training asks for its tokens at time t in
[0, 1]. A rate ``1 + ramp * (2 t - 1)`` integrates to ``(1 - ramp) t + ramp t**2``, the share of the target that
is due by t. A document's place in its source's token line, divided by the target, is put through the inverse of that
integral: that is its training position, and the mix is the documents sorted by position over ranges.

Token lines are prefix sums in two levels: over hash buckets of a source, then inside each bucket, so a source that
holds a third of all rows is dealt over ``BUCKETS`` groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.tables import written

#: Hex digits of the hash that name a bucket; 16**3 buckets a source.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float, ramps: tuple[float, ...]) -> DataFrame:
    """Adds ``weight, ramp, target`` to rows of ``no_source, source, source_size`` (one per source).

    ``share`` times all sizes is shared out by weight; a target stops at ``most`` times its source's size and the rest
    goes on to the others. In order of size over weight the capped sources come first, so running sums find the level.
    """
    cycle = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.col("rank") - 1, F.lit(len(xs))) + 1).cast("int"))
    everything = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("no_source", "source")))
    s = s.withColumns({"weight": cycle([float(w) for w in weights]), "ramp": cycle([float(r) for r in ramps]), "cap": F.col("source_size") * F.lit(float(most))})
    s = s.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everything))
    line = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "rank")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(past), F.lit(0.0))))
    s = s.withColumn("free", F.col("cap") >= F.col("weight") * F.col("level")).withColumn("place", F.row_number().over(line))
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("place"))).over(everything)
    s = s.withColumn("due", level * F.col("weight"))
    return s.select("no_source", "source", "source_size", "weight", "ramp", F.when(F.col("free"), F.col("due")).otherwise(F.col("cap")).alias("target"))


def due_at(share: Column, ramp: Column) -> Column:
    """Inverse of the integrated schedule: the time by which ``share`` of the target is asked for."""
    a = F.lit(1.0) - ramp
    root = F.sqrt(a * a + 4 * ramp * share)
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / (a + root))


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    ramps: tuple[float, ...] = (0.5, 0.0, -0.5),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken, positions``.

    A source's documents lie on its token line in order of a hash of their identifiers, once per pass; a pass of a
    document is taken if its middle lies before the target. ``positions`` has the training position of each pass.
    Null texts have size 0 and are taken in no pass unless the target lies beyond them; a null source is a source of
    its own, last in order. Rows that repeat count each. An empty table gives an empty plan; extra columns are ignored.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slim = docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("size"), h.alias("h"))
    slim = written(slim, "sizes").withColumn("bucket", F.substring("h", 1, DIGITS))
    buckets = slim.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("in_bucket"))
    to_here = Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("before", F.sum("in_bucket").over(to_here) - F.col("in_bucket")).drop("in_bucket")
    sources = targets(slim.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")), weights, share, most, ramps)
    line = Window.partitionBy("no_source", "source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.withColumn("start", F.sum("size").over(line) - F.col("size"))
    rows = rows.join(buckets, ["no_source", "source", "bucket"]).join(sources, ["no_source", "source"])
    middle = F.col("before") + F.col("start") + F.col("size") / F.lit(2.0)
    passes = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    taken = F.filter(F.transform(passes, lambda p: p * F.col("source_size") + middle), lambda x: x < F.col("target"))
    rows = rows.withColumn("offsets", taken)
    return rows.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.size("offsets") * F.col("size")).alias("taken"),
        F.transform("offsets", lambda x: due_at(F.when(F.col("target") > 0, x / F.col("target")).otherwise(F.lit(0.0)), F.col("ramp"))).alias("positions"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, in ranges of training position; a document of two passes comes twice.

    Rows that repeat an identifier are dealt the passes of all of them one by one. Names that begin with ``__mix`` are taken.
    """
    per_id = plan(docs, **options).groupBy("doc_id").agg(F.flatten(F.collect_list("positions")).alias("__mix_all"), F.count("*").alias("__mix_rows"))
    at = per_id.withColumnRenamed("doc_id", "__mix_id")
    rows = docs.join(at, docs["doc_id"].eqNullSafe(at["__mix_id"]))
    mine = Window.partitionBy("__mix_id").orderBy("__mix_id")
    share = F.filter("__mix_all", lambda x, i: i % F.col("__mix_rows") == F.col("__mix_k") - 1)
    rows = rows.withColumn("__mix_k", F.row_number().over(mine)).withColumn("__mix_at", F.explode(share))
    return rows.repartitionByRange("__mix_at").sortWithinPartitions("__mix_at", "doc_id").select(*docs.columns)
