"""Externally produced JSON verdicts: strict validation and fail-closed projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONDITIONS, PRICE_SOURCES, SALE_STATUSES, SCOPES
from . import fixed
from .text import exact_model, is_pricing_identity, product_name

# The closed key sets of both verdict forms and the JSON type of each key.
FIRST_KEYS = {
    "normalized_product_name": "text?", "exact_product": "flag", "condition": "text",
    "confidence": "number", "reason": "text", "scope": "text", "sale_status": "text",
    "model_mismatch": "flag", "price_bait": "flag", "hidden_price_condition": "flag",
    "displayed_price": "whole", "effective_price": "whole?", "price_source": "text",
    "price_confidence": "number", "usable_price": "flag",
}
SECOND_KEYS = {k: v for k, v in FIRST_KEYS.items() if k != "price_source"}

# How those JSON types print in a parsed document's schema text.
_SHAPES = {
    "text": "STRING", "text?": "(STRING|VOID)", "flag": "BOOLEAN", "whole": "BIGINT",
    "whole?": "(BIGINT|VOID)", "number": r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))",
}
_READ_AS = {"text": "string", "flag": "boolean", "whole": "bigint", "number": "double"}

# Fixed value: no setting may lower the first-stage confidence bar below this.
CONFIDENCE_FLOOR = 0.90


def _shape_pattern(keys: dict[str, str]) -> str:
    """Schema text of a document with exactly these keys and types (keys print sorted)."""
    return "^OBJECT<" + ", ".join(f"{k}: {_SHAPES[t]}" for k, t in sorted(keys.items())) + ">$"


def with_verdict(df: DataFrame, text: str, out: str, keys: dict[str, str]) -> DataFrame:
    """Add the verdict in column ``text`` as struct ``out``.

    The struct is null when any key, type, enumeration or range is wrong.  The text is parsed
    once; one comparison against its schema text checks the exact key set and every JSON
    type, so ``"true"`` is no boolean and ``480000.0`` no whole number.
    """
    doc = F.col("_doc")
    raw = F.struct(*[F.try_variant_get(doc, f"$.{k}", _READ_AS[t.rstrip("?")]).alias(k)
                     for k, t in keys.items()])
    shaped = F.coalesce(F.schema_of_variant(doc).rlike(_shape_pattern(keys)), F.lit(False))
    rows = df.withColumn("_doc", F.try_parse_json(F.col(text))).withColumns(
        {"_raw": F.when(shaped, raw)}).drop("_doc")
    value = F.col("_raw")
    inside = (
        value["condition"].isin(*CONDITIONS) & value["scope"].isin(*SCOPES)
        & value["sale_status"].isin(*SALE_STATUSES)
        & value["confidence"].between(0, 1) & value["price_confidence"].between(0, 1)
        & (value["displayed_price"] > 0)
        & (value["effective_price"].isNull() | (value["effective_price"] > 0)))
    if "price_source" in keys:
        inside = inside & value["price_source"].isin(*PRICE_SOURCES)
    texts = ("normalized_product_name", "reason")
    tidy = F.struct(*[(F.trim(value[k]) if k in texts else value[k]).alias(k) for k in keys])
    return rows.withColumn(out, F.when(value.isNotNull() & inside, tidy)).drop("_raw")


def with_first_verdict(df: DataFrame, text: str, out: str = "verdict") -> DataFrame:
    return with_verdict(df, text, out, FIRST_KEYS)


def with_second_verdict(df: DataFrame, text: str, out: str = "verdict") -> DataFrame:
    return with_verdict(df, text, out, SECOND_KEYS)


def verdict_name(verdict: Column) -> Column:
    """Canonical product a verdict names, or null."""
    return product_name(F.nullif(verdict["normalized_product_name"], F.lit("")))


def _is_part(verdict: Column) -> Column:
    return (verdict["scope"] == "standalone") & verdict["normalized_product_name"].isNotNull()


def verdict_rejects(verdict: Column, canonical: Column, evidenced: Column, price: Column,
                    floor: float) -> Column:
    """Any failed gate rejects; unknown counts as failed."""
    passes = (
        _is_part(verdict) & (verdict["scope"] == "standalone")
        & (verdict["condition"] == "normal") & (verdict["confidence"] >= floor)
        & canonical.isNotNull() & evidenced & is_pricing_identity(canonical)
        & (verdict["sale_status"] == "active") & verdict["exact_product"]
        & ~verdict["model_mismatch"] & ~verdict["price_bait"]
        & ~verdict["hidden_price_condition"] & verdict["usable_price"]
        & (verdict["effective_price"] > 0) & (verdict["displayed_price"] == price))
    return ~F.coalesce(passes, F.lit(False))


def applied_columns(verdict: Column, canonical: Column, title_name: Column,
                    description_name: Column, threshold: float,
                    failure: Column | str = fixed.VERDICT_REASONS["failed"]
                    ) -> dict[str, Column]:
    """Listing columns after a first-stage verdict; a null verdict fails closed.

    ``canonical`` is :func:`verdict_name`, computed once by the caller.
    """
    floor = max(CONFIDENCE_FLOOR, float(threshold))
    price = F.col("price")
    evidenced = canonical.isNotNull() & exact_model(canonical, title_name, description_name)
    given = F.nullif(verdict["normalized_product_name"], F.lit(""))
    rejected = verdict_rejects(verdict, canonical, evidenced, price, floor)
    reason = (
        F.when(given.isNotNull() & canonical.isNull(), F.concat(
            F.lit(fixed.VERDICT_REASONS["canonical"]), given))
        .when(canonical.isNotNull() & ~evidenced,
              F.lit(fixed.VERDICT_REASONS["evidence"]))
        .when(canonical.isNotNull() & ~is_pricing_identity(canonical),
              F.lit(fixed.BUCKET_REASON))
        .when(verdict["displayed_price"] != price,
              F.lit(fixed.VERDICT_REASONS["price"]))
        .when(verdict["price_bait"],
              F.lit(fixed.VERDICT_REASONS["bait"]))
        .when(verdict["hidden_price_condition"],
              F.lit(fixed.VERDICT_REASONS["hidden"]))
        .otherwise(verdict["reason"]))
    unsure = (verdict["confidence"] < floor) | canonical.isNull()
    have = verdict.isNotNull()
    message = failure if isinstance(failure, Column) else F.lit(failure)

    def pick(value: Column, missing: Column) -> Column:
        return F.when(have, value).otherwise(missing)

    unknown, no = F.lit("unknown"), F.lit(False)
    return {
        "condition_status": pick(F.when(unsure, "unknown").otherwise(verdict["condition"]),
                                 unknown),
        "ai_is_computer_part": pick(_is_part(verdict), no),
        "ai_normalized_product_name": pick(canonical, F.col("ai_normalized_product_name")),
        "ai_confidence": pick(verdict["confidence"], F.lit(0.0)),
        "ai_reject": pick(rejected, F.lit(True)),
        "ai_reason": pick(reason, message),
        "ai_scope": pick(verdict["scope"], F.col("ai_scope")),
        "ai_sale_status": pick(verdict["sale_status"], unknown),
        "ai_usable_for_market_price": pick(~rejected, no),
        "effective_price": pick(F.when(~rejected, verdict["effective_price"]),
                                F.col("effective_price")),
        "ai_usable_price": pick(verdict["usable_price"] & ~rejected, F.col("ai_usable_price")),
    }


def accepted_columns(name: Column) -> dict[str, Column]:
    """Listing columns of a rule-based accept; effective price columns stay unset."""
    priceable = is_pricing_identity(name)
    return {
        "condition_status": F.lit("normal"), "ai_is_computer_part": F.lit(True),
        "ai_normalized_product_name": name, "ai_confidence": F.lit(1.0),
        "ai_reject": ~priceable,
        "ai_reason": F.when(priceable, fixed.RULE_REASONS["accept"])
        .otherwise(fixed.BUCKET_REASON),
        "ai_scope": F.lit("standalone"), "ai_sale_status": F.lit("active"),
        "ai_usable_for_market_price": priceable,
    }


def rejected_columns(reason: Column, scope: Column) -> dict[str, Column]:
    """Listing columns of a rule-based reject during repair."""
    return {
        "ai_is_computer_part": F.lit(False), "ai_confidence": F.lit(1.0),
        "ai_reject": F.lit(True), "ai_reason": reason, "ai_scope": scope,
        "ai_sale_status": F.col("listing_status"), "ai_usable_for_market_price": F.lit(False),
    }


def reliable_content() -> Column:
    return F.coalesce((F.trim("title") != "") & (F.trim("description") != "")
                      & (F.col("price") > 0), F.lit(False))


def unreliable_columns() -> dict[str, Column]:
    """Fail-closed columns for incomplete detail content."""
    return {
        "condition_status": F.lit("unknown"), "ai_is_computer_part": F.lit(False),
        "ai_reject": F.lit(True), "ai_reason": F.lit(fixed.UNRELIABLE_REASON),
        "ai_scope": F.lit("unknown"), "ai_sale_status": F.lit("unknown"),
        "ai_usable_for_market_price": F.lit(False), "ai_usable_price": F.lit(False),
        "effective_price": F.lit(None).cast("bigint"),
    }


def _sure(threshold: float) -> Column:
    return F.coalesce(F.col("ai_confidence"), F.lit(0.0)) >= threshold


def _judged_part() -> Column:
    return F.coalesce(F.col("ai_is_computer_part"), F.lit(False))


def accepted_normal(threshold: float) -> Column:
    """Counter predicate: a classified listing that passed as a normal part."""
    return F.coalesce(
        _judged_part() & ~F.col("ai_reject") & (F.col("condition_status") == "normal")
        & F.col("ai_usable_for_market_price") & _sure(threshold), F.lit(False))


def exclusion_reason(threshold: float = 0.85, target: Column | None = None) -> Column:
    """Why a backfilled listing gives no observation, or null.

    With a ``target`` product the last test asks for exactly that product.
    """
    chain = (
        F.when(F.col("listing_status") != "active",
               F.concat(F.lit("status:"), F.col("listing_status")))
        .when(F.col("condition_status") != "normal",
              F.concat(F.lit("condition:"), F.col("condition_status")))
        .when(F.col("ai_scope") != "standalone", F.concat(F.lit("scope:"), F.col("ai_scope")))
        .when(F.col("ai_reject") | ~_judged_part(), F.lit("ai_rejected"))
        .when(~F.col("ai_usable_for_market_price"), F.lit("not_usable_for_market_price"))
        .when(~_sure(threshold), F.lit("low_confidence")))
    name = F.nullif(F.col("ai_normalized_product_name"), F.lit(""))
    if target is None:
        return chain.when(name.isNull(), F.lit("model_mismatched"))
    return chain.when(~F.col("ai_normalized_product_name").eqNullSafe(target),
                      F.lit("misclassified_product"))


def backlog_candidate(threshold: float) -> Column:
    return F.coalesce(
        (F.col("listing_status") == "active") & (F.col("ai_scope") == "standalone")
        & (F.col("condition_status") == "normal") & _judged_part() & ~F.col("ai_reject")
        & F.col("ai_usable_for_market_price") & F.col("ai_usable_price")
        & F.col("effective_price").isNotNull() & _sure(threshold)
        & F.col("ai_normalized_product_name").isNotNull(), F.lit(False))


def backlog_rejection(threshold: float, title_name: Column, description_name: Column) -> Column:
    """First failed gate of a freshly classified backlog listing, or null."""
    name = F.nullif(F.col("ai_normalized_product_name"), F.lit(""))
    return (
        F.when((F.col("listing_status") != "active") | (F.col("ai_sale_status") != "active"),
               F.lit("current_not_active"))
        .when(~_sure(threshold), F.lit("low_first_stage_confidence"))
        .when(F.col("ai_scope") != "standalone", F.lit("non_standalone"))
        .when(F.col("condition_status") != "normal", F.lit("abnormal_or_condition"))
        .when(name.isNull() | ~exact_model(name, title_name, description_name),
              F.lit("model_mismatched"))
        .when(~F.col("ai_usable_price") | F.col("effective_price").isNull(),
              F.lit("ambiguous_price"))
        .when(F.col("ai_reject") | ~_judged_part() | ~F.col("ai_usable_for_market_price"),
              F.lit("first_stage_rejected")))


def review_passes(verdict: Column, canonical: Column, threshold: float,
                  price: Column, effective_price: Column, deal_name: Column) -> Column:
    """Whether a second verdict confirms a deal on every gate."""
    return F.coalesce(
        verdict["exact_product"] & (verdict["scope"] == "standalone")
        & (verdict["condition"] == "normal") & (verdict["sale_status"] == "active")
        & ~verdict["model_mismatch"] & verdict["usable_price"] & ~verdict["price_bait"]
        & ~verdict["hidden_price_condition"] & (canonical == deal_name)
        & (verdict["displayed_price"] == price)
        & verdict["effective_price"].eqNullSafe(effective_price)
        & (verdict["price_confidence"] >= threshold)
        & (verdict["confidence"] >= threshold), F.lit(False))
