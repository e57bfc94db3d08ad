"""Arbitrage between two prices: stakes, fees, spreads, best pairs and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEES = {"Kalshi": 0.02}


def fee_rate(platform: Column) -> Column:
    return F.coalesce(*(F.when(platform == p, r) for p, r in FEES.items()), F.lit(0.0))


def stakes(p1: Column, p2: Column, total: Column, fee1: Column, fee2: Column) -> dict[str, Column]:
    """Stakes that pay the same either way, with fees, profit and return; null where no price is above 0."""
    s = F.nullif(p1 + p2, F.lit(0.0))
    one, two, payout = total * p1 / s, total * p2 / s, total / s
    fees1, fees2 = one * fee1, two * fee2
    net = payout - total - (fees1 + fees2)
    roi = net / F.nullif(total, F.lit(0.0)) * 100
    return {"investment1": one, "investment2": two, "payout": payout, "fee1": fees1, "fee2": fees2, "total_fees": fees1 + fees2, "net_profit": net, "roi": roi, "is_valid": net > 0}


def signed_spread(kalshi: Column, poly: Column) -> Column:
    """Relative difference in percent; negative where the Kalshi leg costs more."""
    return (poly - kalshi) / F.nullif(F.least(kalshi, poly), F.lit(0.0)) * 100


def relative_spread(buy: Column, sell: Column) -> Column:
    return (sell - buy) / F.nullif(buy, F.lit(0.0)) * 100


def first_outcome_spread(a: Column, b: Column) -> Column:
    """Difference of two first prices in points; 0 unless the cheaper is below 1 and the dearer above 0."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when((lo < 1) & (hi > 0), (hi - lo) * 100).otherwise(0.0)


def best_per(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Per group the row of the largest value, the first of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def best_outcome_pair(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per ``key`` the pair of equally named outcomes of two markets with the largest relative spread.

    Both sides have ``key, name, price, k`` (place). A pair needs a spread above that of those before it; if none is
    above 0 it is the first pair.
    """
    right = b.select(key, "name", F.col("price").alias("price_b"), F.col("k").alias("k_b"))
    pairs = a.join(right, [key, "name"])
    low, high = F.least("price", "price_b"), F.greatest("price", "price_b")
    pairs = pairs.withColumns({"buy": low, "sell": high, "gain": F.greatest(F.coalesce(relative_spread(low, high), F.lit(0.0)), F.lit(0.0))})
    w = Window.partitionBy(key).orderBy(F.desc("gain"), "k", "k_b")
    return pairs.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def dashboard(df: DataFrame, spread: str, volume: str) -> DataFrame:
    """One row: opportunities, largest spread (0 if none), those of 3 or more, total volume."""
    return df.agg(
        F.count("*").alias("opportunities"),
        F.coalesce(F.max(spread), F.lit(0.0)).alias("max_spread"),
        F.count_if(F.col(spread) >= 3).alias("at_least_3"),
        F.coalesce(F.sum(volume), F.lit(0.0)).alias("total_volume"),
    )


def liquid(a: Column, b: Column, least: float) -> Column:
    """Up to 1: some liquidity on either side; above: the asked liquidity on either side."""
    return (a > 0) | (b > 0) if least <= 1 else (a >= least) | (b >= least)
