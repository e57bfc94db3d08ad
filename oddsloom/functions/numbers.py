"""Numbers as the feeds write and label them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """Null where a number is 0, NaN or null: what a chain of fallbacks passes over."""
    return F.when((c != 0) & ~F.isnan(c), c)


def round_half_up(c: Column) -> Column:
    """Ties go up, also below zero."""
    return F.floor(c + F.lit(0.5))


def to_fixed(c: Column, digits: int) -> Column:
    """``c >= 0`` with no or one decimal, rounded on its exact binary value, exact ties up."""
    tie = F.pmod(c * (4 if digits else 2), F.lit(2.0)) == 1
    up = F.format_string(f"%.{digits}f", c)
    return F.when(tie, up).otherwise(F.regexp_replace(F.format_number(c, digits), ",", ""))


def currency_label(c: Column, zero: str = "$0") -> Column:
    """``$1.2B``, ``$1.2M``, ``$1.2K`` or whole dollars; ``zero`` for 0 and null."""
    at = lambda n, s: F.concat(F.lit("$"), to_fixed(c / n, 1), F.lit(s))
    return (
        F.when(c.isNull() | (c == 0), F.lit(zero))
        .when(c >= 1e9, at(1e9, "B"))
        .when(c >= 1e6, at(1e6, "M"))
        .when(c >= 1e3, at(1e3, "K"))
        .otherwise(F.concat(F.lit("$"), to_fixed(c, 0)))
    )


def parse_volume(text: Column) -> Column:
    """First run of digits and dots with the K, M or B that follows it after optional space; 0 where there is none."""
    digits = F.regexp_extract(text, r"(?i)([0-9.]+)\s*([KMB]?)", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)([0-9.]+)\s*([KMB]?)", 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    number = F.regexp_extract(digits, r"^(\d*\.?\d*)", 1).try_cast("double")
    return F.coalesce(number * scale, F.lit(0.0))


def cents(c: Column) -> Column:
    """Money that a feed gives in cents; 0 where it is none."""
    return F.coalesce(truthy(c.try_cast("double")), F.lit(0.0)) / 100


def confidence_tier(score: Column, high: float, medium: float, inclusive: bool = True) -> Column:
    above = (lambda t: score >= t) if inclusive else (lambda t: score > t)
    return F.when(above(high), "high").when(above(medium), "medium").otherwise("low")
