"""Help for writing Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(body: Callable[..., Column], *values: Column) -> Column:
    """``body(*values)`` with each value worked out once a row, however often ``body`` uses it, also inside its own lambdas."""
    one = F.array(F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values))))
    return F.get(F.transform(one, lambda s: body(*(s[f"v{k}"] for k in range(len(values))))), F.lit(0))


def _quoted(value: str | int | list[str]) -> str:
    if isinstance(value, list):
        return f"array({', '.join(map(_quoted, value))})"
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: list[str]) -> Column:
    """A fixed array, made by one call."""
    return F.expr(_quoted(values) if values else "cast(array() as array<string>)")


def lookup(table: dict[str, str] | dict[str, int] | dict[str, list[str]]) -> Column:
    """A fixed map, made by one call."""
    return F.expr(f"map({', '.join(f'{_quoted(k)}, {_quoted(v)}' for k, v in table.items())})")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row and then read, not worked out again by each filter or expression on them."""
    for name, value in columns.items():
        df = df.withColumn(name, F.explode(F.array(value)))
    return df
