"""Pages of a feed as they came: events under several names, and pages or events that are broken, as Variant values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a page may have its events: it is their list itself, or has it under a name; the first that is a list counts.
PLACES = {"array": "$", "data": "$.data", "events": "$.events"}


def _list(page: Column, path: str) -> Column:
    return F.try_variant_get(page, path, "array<variant>")


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, shape, events`` of pages (``page_id, page``): ``array``, ``data`` or ``events`` by where the list is, ``other`` without one, ``corrupt`` if it is no JSON.

    ``events`` are Variant values, none for the last two. A null page is corrupt.
    """
    rows = pages.select("page_id", F.try_parse_json("page").alias("v"))
    rows = rows.select("page_id", "v", *(_list(F.col("v"), path).alias(f"__{name}") for name, path in PLACES.items()))
    shape = F.when(F.col("v").isNull(), "corrupt")
    for name in PLACES:
        shape = shape.when(F.col(f"__{name}").isNotNull(), name)
    return rows.select("page_id", shape.otherwise("other").alias("shape"), F.coalesce(*(f"__{name}" for name in PLACES)).alias("events"))


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    each = rows.select("page_id", "shape", F.explode("events").alias("v"))
    return each.select("page_id", "shape", F.try_variant_get("v", "$", f"struct<{schema}>").alias("e"))


def events(pages: DataFrame, schema: str) -> DataFrame:
    """The events of all pages by a feed's schema. A field that does not fit is null; what is no object, or has no identifier, is left out."""
    return _typed(parsed(pages), schema).select("e.*").filter("id IS NOT NULL")


def report(pages: DataFrame, schema: str) -> DataFrame:
    """What came, one row a shape: ``shape, pages, events, dropped``; ``dropped`` of the events have no identifier or are none."""
    rows = parsed(pages)
    of_pages = rows.groupBy("shape").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.size("events"), F.lit(0))).alias("events"))
    kept = _typed(rows, schema).filter("e.id IS NOT NULL").groupBy("shape").agg(F.count("*").alias("kept"))
    return of_pages.join(kept, "shape", "left").select("shape", "pages", "events", (F.col("events") - F.coalesce("kept", F.lit(0))).alias("dropped"))
