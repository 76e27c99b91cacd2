"""Discounts, price changes, comparable names and exact number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import product_name


def discount_percent(price: Column, reference: Column) -> Column:
    """(reference - price) / reference * 100; a non-positive reference is an error."""
    value = (reference - price).cast("double") / reference.cast("double") * F.lit(100.0)
    return F.when(reference > 0, value).when(
        reference <= 0, F.raise_error(F.lit("reference price must be positive")).cast("double"))


def change_percent(price: Column, previous: Column) -> Column:
    """Percent move against the previous price; unknown or zero previous gives null."""
    usable = previous.isNotNull() & (previous != 0)
    base = F.when(usable, previous.cast("double"))
    return (price - previous).cast("double") / base * F.lit(100.0)


def comparable_name(title_name: Column | None = None) -> Column:
    """Product a listing may stand for in a price comparison, or null.

    Reads the listing columns; pass ``title_name`` when the title is normalised already.
    """
    fallback = product_name(F.col("title")) if title_name is None else title_name
    gates = (
        (F.col("listing_status") == "active")
        & F.col("ai_sale_status").isin("active", "unknown")
        & (F.col("ai_scope") == "standalone")
        & ~F.coalesce(F.col("ai_reject"), F.lit(False))
        & F.coalesce(F.col("ai_is_computer_part"), F.lit(False))
        & F.coalesce(F.col("ai_usable_for_market_price"), F.lit(False))
        & F.coalesce(F.col("ai_usable_price"), F.lit(False))
        & (F.col("effective_price") > 0)
    )
    return F.when(gates, F.coalesce(
        F.nullif(F.col("ai_normalized_product_name"), F.lit("")), fallback))


def grouped(amount: Column) -> Column:
    """Thousands-separated whole number."""
    return F.format_number(amount, 0)


def won(amount: Column) -> Column:
    return F.concat(grouped(amount), F.lit(" KRW"))


def one_decimal(value: Column) -> Column:
    """``%.1f`` of the exact binary value, ties to even.

    JVM formatting rounds the shortest decimal text, which differs from the exact value
    only when that text ends in a 5 at the second decimal.  There the double is scaled by
    a power of two to a whole number and compared with the tie exactly.
    """
    size = F.abs(value)
    hundredths = F.round(size * F.lit(100.0)).cast("bigint")
    at_tie = (size == hundredths / F.lit(100.0)) & (hundredths % 10 == 5) & (size < 2.0 ** 20)
    scale = F.when(size < 1, F.lit(2.0 ** 57)).when(size < 1024, F.lit(2.0 ** 52)).otherwise(
        F.lit(2.0 ** 42))
    exact = (size * scale).cast("bigint").cast("decimal(20,0)") * F.lit(20).cast("decimal(2,0)")
    tie = (hundredths / F.lit(5)).cast("decimal(12,0)") * scale.cast("decimal(20,0)")
    below = ((hundredths - 5) / F.lit(10)).cast("bigint")
    tenths = below + F.when((exact > tie) | ((exact == tie) & (below % 2 == 1)), 1).otherwise(0)
    text = F.concat((F.floor(tenths / F.lit(10))).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))
    return F.when(at_tie, F.concat(F.when(value < 0, "-").otherwise(""), text)).otherwise(
        F.when(value.isNotNull(), F.format_string("%.1f", value)))


def percent_text(value: Column) -> Column:
    return F.concat(one_decimal(value), F.lit("%"))
