"""Bargains: comparison with reference prices, audit rows, digest and report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.money import comparable_name, discount_percent, one_decimal, percent_text, won
from ..functions.text import product_link
from ..schemas import SEARCH_MARKETPLACE
from .estimator import NAME
from .ordered import ranked


def comparable_listings(listings: DataFrame) -> DataFrame:
    """Listings that may be compared by price, with ``normalized_name``."""
    return (listings.withColumn("normalized_name", comparable_name())
            .where(F.col("normalized_name").isNotNull()))


def find_deals(listings: DataFrame, prices: DataFrame, minimum_discount_percent: float,
               tie_break: str = "id", ordered: bool = True) -> DataFrame:
    """Listings at least ``minimum_discount_percent`` below the reference price.

    ``prices`` has (normalized_product_name, price); listings without one are dropped.
    The price table grows with the products, so the join kind is left to the planner.
    """
    reference = prices.where(F.col("price").isNotNull()).select(
        F.col(NAME).alias("normalized_name"),
        F.col("price").cast("bigint").alias("reference_price"))
    named = (listings if "normalized_name" in listings.columns
             else comparable_listings(listings))
    deals = (
        named.where(F.col("effective_price").isNotNull())
        .join(reference, "normalized_name")
        .withColumn("discount_percent",
                    discount_percent(F.col("effective_price"), F.col("reference_price")))
        .where(F.col("discount_percent") >= minimum_discount_percent))
    return deals.orderBy(F.col("discount_percent").desc(), tie_break) if ordered else deals


def reference_names(listings: DataFrame) -> DataFrame:
    """Distinct comparable products of a set of listings."""
    return comparable_listings(listings).select(F.col("normalized_name").alias(NAME)).distinct()


def left_join_named(rows: DataFrame, facts: DataFrame, name: str, on: str) -> DataFrame:
    """Left join on a product name that many rows lack: those are dealt out under keys that match nothing.

    ``facts`` has the name as ``on``; a null key would send all unnamed rows to one task.
    """
    nothing = F.concat(F.lit("\0"), (F.xxhash64(*rows.columns) % 4096).cast("string"))
    keyed = rows.withColumn("_name_key", F.coalesce(F.col(name), nothing))
    return keyed.join(facts.where(F.col(on).isNotNull()).withColumnRenamed(on, "_name_key"), "_name_key", "left").drop("_name_key")


def audit_rows(listings: DataFrame, estimates: DataFrame,
               minimum_discount_percent: float) -> DataFrame:
    """Final pricing decision of every classified listing."""
    named = listings.withColumn("normalized_name", comparable_name())
    joined = left_join_named(named, estimates.select(
        NAME, F.col("price").alias("_estimate"), F.col("automatic").alias("_auto")), "normalized_name", NAME)
    compared = F.col("normalized_name").isNotNull()
    priced = compared & F.col("_estimate").isNotNull()
    discount = ((F.col("_estimate") - F.col("effective_price")).cast("double")
                / F.nullif(F.col("_estimate"), F.lit(0)).cast("double") * F.lit(100.0))
    joined = joined.withColumn("_discount", F.when(priced, discount))
    return joined.select(
        "product_id", "title", F.col("price").alias("displayed_price"),
        F.when(priced, F.col("effective_price")).alias("effective_price"), "normalized_name",
        "condition_status", F.coalesce("ai_confidence", F.lit(0.0)).alias("confidence"),
        F.when(~compared, "unavailable")
        .when(F.coalesce(F.col("_auto"), F.lit(False)), "automatic").otherwise("manual")
        .alias("reference_source"),
        F.when(priced, F.col("_estimate")).alias("reference_price"),
        F.col("_discount").alias("discount_percent"),
        F.when(~compared, "rejected")
        .when(~priced, "no_reference_price")
        .when(F.col("effective_price").isNull(), "rejected")
        .when(F.col("_discount") >= minimum_discount_percent, "bargain")
        .otherwise("below_discount_threshold").alias("final_decision"))


def audit_text(audit: DataFrame) -> DataFrame:
    """One report line per audited listing."""
    dash = F.lit("-")
    head = F.concat(F.lit("AI_LISTING | product_id="), F.coalesce("product_id", dash),
                    F.lit(" | title="), F.col("title"))
    tail = F.concat(F.lit(" | condition="), F.col("condition_status"), F.lit(" | confidence="),
                    F.format_string("%.2f", "confidence"), F.lit(" | reference_source="),
                    F.col("reference_source"))
    named = F.concat(F.lit(" | normalized="), F.coalesce("normalized_name", dash))
    decision = F.concat(F.lit(" | final_decision="), F.col("final_decision"))
    unpriced = F.concat(head, F.lit(" | price="), won(F.col("displayed_price")), named, tail,
                        F.lit(" | reference_price=- | discount_percent=-"), decision)
    full = F.concat(head, F.lit(" | displayed_price="), won(F.col("displayed_price")),
                    F.lit(" | effective_price="), won(F.col("effective_price")), named, tail,
                    F.lit(" | reference_price="), won(F.col("reference_price")),
                    F.lit(" | discount_percent="), one_decimal(F.col("discount_percent")), decision)
    return audit.withColumn("line", F.when(F.col("reference_price").isNull(), unpriced)
                            .otherwise(full))


def _shown_price() -> Column:
    """Effective price, or the listing price when there is none (or it is zero)."""
    return F.coalesce(F.nullif(F.col("effective_price"), F.lit(0)), F.col("price"))


def deal_text(deals: DataFrame) -> DataFrame:
    line = F.concat_ws(
        " | ", F.col("normalized_name"), F.concat(F.lit("displayed "), won(F.col("price"))),
        F.concat(F.lit("effective "), won(_shown_price())),
        F.concat(F.lit("reference "), won(F.col("reference_price"))),
        F.concat(percent_text(F.col("discount_percent")), F.lit(" cheaper")),
        F.coalesce("source_type", F.lit("")), F.coalesce("location", F.lit("")), F.col("url"))
    return deals.withColumn("line", line)


def estimate_text(estimates: DataFrame) -> DataFrame:
    """One report line per estimate; times print in ISO form."""
    dash = F.lit("-")
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    source = F.when(F.col("automatic"), "automatic").otherwise("manual_fallback")
    return estimates.select(
        NAME, source.alias("source"),
        F.concat_ws(
            " | ", F.lit("MARKET_PRICE"), F.col(NAME),
            F.concat(F.lit("price="), F.coalesce(won(F.col("price")), F.lit("unavailable"))),
            F.concat(F.lit("valid_observations="),
                     F.col("valid_observation_count").cast("string")),
            F.concat(F.lit("estimator="), F.col("estimator")),
            F.concat(F.lit("source="), source),
            F.concat(F.lit("oldest="),
                     F.coalesce(F.date_format("oldest_observed_at", iso), dash)),
            F.concat(F.lit("newest="),
                     F.coalesce(F.date_format("newest_observed_at", iso), dash)),
        ).alias("line"))


def pricing_sources(estimates: DataFrame) -> DataFrame:
    """Where each usable reference price came from."""
    return estimates.where(F.col("price").isNotNull()).select(
        F.col(NAME).alias("normalized_name"),
        F.when(F.col("automatic"), "automatic").otherwise("manual").alias("pricing_source"))


def digest(deals: DataFrame, sources: DataFrame, reviews: DataFrame | None = None,
           tie_break: str = "id", marketplace: str = SEARCH_MARKETPLACE,
           link_template: str = fixed.PRODUCT_LINK) -> DataFrame:
    """Digest rows, best discount first, every field as shown to the reader.

    ``reviews`` has (product_id, second_stage_confidence, reason), and marketplace where several
    are mixed; one review per key, the most confident, is shown.
    """
    missing = F.lit("Not available")
    rows = deals.join(sources.select("normalized_name", "pricing_source"),
                      "normalized_name", "left")
    if reviews is not None:
        keys = [k for k in ("marketplace", "product_id") if k in reviews.columns and k in rows.columns]
        best = reviews.groupBy(*keys).agg(
            F.max(F.struct(F.col("second_stage_confidence").alias("_second"), F.col("reason").alias("_reason"))).alias("_r"))
        rows = rows.join(best.select(*keys, "_r.*"), keys, "left")
    else:
        rows = rows.withColumns({"_second": F.lit(None).cast("double"),
                                 "_reason": F.lit(None).cast("string")})
    ordered = ranked(rows, [F.col("discount_percent").desc(), F.col(tie_break)], "position")
    return ordered.select(
        "position", "product_id", F.col("normalized_name").alias("product"),
        won(F.col("price")).alias("displayed_price"),
        won(_shown_price()).alias("effective_price"),
        won(F.col("reference_price")).alias("reference_price"),
        percent_text(F.col("discount_percent")).alias("discount"),
        F.col("condition_status").alias("condition"),
        F.coalesce(percent_text(F.col("ai_confidence") * 100), missing).alias("confidence"),
        F.coalesce(percent_text(F.col("_second") * 100), missing).alias("second_confidence"),
        F.coalesce(F.nullif(F.trim("_reason"), F.lit("")), missing).alias("review_reason"),
        F.coalesce("pricing_source", F.lit("manual")).alias("pricing_source"),
        product_link(F.col("canonical_url"), F.col("product_id"), F.col("marketplace"),
                     marketplace, link_template).alias("link"))
