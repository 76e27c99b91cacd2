"""Joins of listings with verdict tables, second review and repair routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.money import discount_percent
from ..functions.prints import classification_fingerprint, review_fingerprint
from ..functions.text import (
    condition_status, exact_model, is_pricing_identity, joined_text, listing_scope, listing_status,
    mentions_part, product_name, rejection_reason, standalone_name)
from ..functions.verdicts import (
    accepted_columns, applied_columns, backlog_rejection, exclusion_reason, rejected_columns,
    review_passes, verdict_name, with_second_verdict)
from ..schemas import SEARCH_MARKETPLACE
from .ordered import latest_per_key

PRODUCT = ["marketplace", "product_id"]

# Columns of a stored verdict, by the name the verdict struct uses.
STORED_VERDICT = {
    "normalized_product_name": "normalized_product_name", "exact_product": "exact_product",
    "condition": "condition_status", "confidence": "confidence", "reason": "reason",
    "scope": "scope", "sale_status": "sale_status", "model_mismatch": "model_mismatch",
    "price_bait": "price_bait", "hidden_price_condition": "hidden_price_condition",
    "displayed_price": "displayed_price", "effective_price": "effective_price",
    "price_source": "price_source", "price_confidence": "price_confidence",
    "usable_price": "usable_price",
}


def with_text_names(listings: DataFrame) -> DataFrame:
    """Add the canonical names of title and description, evaluated once."""
    return listings.withColumns({"_title_name": product_name(F.col("title")),
                                 "_desc_name": product_name(F.col("description"))})


def cached_verdict(listings: DataFrame, verdicts: DataFrame, model: str, effort: str,
                   version: str, fingerprint: Column | None = None) -> DataFrame:
    """Add ``verdict``: the newest successful one for unchanged content, or null.

    Every key column is part of the join; verdicts are reduced to one row per key first,
    and those without part flag, confidence or a known scope are not usable.
    """
    print_ = classification_fingerprint() if fingerprint is None else fingerprint
    usable = verdicts.where(
        (F.col("model") == model) & (F.col("reasoning_effort") == effort)
        & (F.col("classifier_version") == version) & F.col("success"))
    # The fingerprint first: sorts then compare the key that differs, not the marketplace.
    keys = ["classification_fingerprint", *reversed(PRODUCT)]
    columns = [*STORED_VERDICT.values(), "is_computer_part"]
    newest = latest_per_key(usable, keys, "id", columns)
    newest = newest.where(F.col("is_computer_part").isNotNull()
                          & F.col("confidence").isNotNull() & (F.col("scope") != "unknown"))
    newest = newest.select(*keys, F.struct(*[
        F.col(stored).alias(name) for name, stored in STORED_VERDICT.items()]).alias("verdict"))
    rows = listings.withColumn("classification_fingerprint", print_)
    return rows.join(newest, keys, "left").select(*rows.columns, "verdict")


def failed_attempts(waiting: DataFrame, verdicts: DataFrame, model: str, effort: str, version: str) -> DataFrame:
    """Rows without a usable verdict whose newest attempt on the same content failed.

    ``waiting``: product keys and classification_fingerprint.
    """
    keys = [*PRODUCT, "classification_fingerprint"]
    tried = verdicts.where((F.col("model") == model) & (F.col("reasoning_effort") == effort)
                           & (F.col("classifier_version") == version))
    failed = latest_per_key(tried, keys, "id", ["success"]).where(~F.col("success")).select(*keys)
    return waiting.join(failed, keys, "left_semi")


def apply_verdicts(listings: DataFrame, threshold: float,
                   failure: Column | str = fixed.VERDICT_REASONS["failed"]) -> DataFrame:
    """Project listings through their ``verdict`` struct; null verdicts fail closed."""
    columns = listings.columns
    rows = listings if "_title_name" in columns else with_text_names(listings)
    rows = rows.withColumn("_canonical", verdict_name(F.col("verdict")))
    out = applied_columns(F.col("verdict"), F.col("_canonical"), F.col("_title_name"),
                          F.col("_desc_name"), threshold, failure)
    return rows.withColumns(out).select(*columns)


def _detail_rows(details: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row of detail fields per product, and its key: (marketplace, product_id) where details
    name their marketplace. Of several rows of a key the greatest counts."""
    keys = [k for k in ("marketplace", "product_id") if k in details.columns]
    fields = F.struct(
        F.trim("name").alias("_name"), F.trim("description").alias("_description"),
        F.col("price").alias("_price"), F.coalesce("saleStatus", "status").alias("_status"))
    rows = details.select(*keys, fields.alias("_d")).groupBy(*keys).agg(F.max("_d").alias("_d"))
    return rows.select(*keys, "_d.*", F.lit(True).alias("_has")), keys


def overlay_detail(candidates: DataFrame, details: DataFrame,
                   rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Candidates with title, price, description, status and condition of their details.

    Absent detail fields keep the search values, except the description; the search
    ``updated_at`` always stays, because the detail time has another precision.
    """
    d, keys = _detail_rows(details)
    keep = [c for c in candidates.columns
            if c not in ("title", "price", "description", "listing_status", "condition_status")]
    rows = candidates.join(d, keys).select(
        *keep, F.coalesce("_name", "title").alias("title"),
        F.coalesce("_price", "price").alias("price"),
        F.coalesce("_description", F.lit("")).alias("description"),
        listing_status(F.coalesce("_status", "listing_status")).alias("listing_status"))
    return rows.withColumn("condition_status", condition_status(
        F.col("title"), F.col("description"), rules))


def refresh_detail(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Overlay for the second review: a missing status means unavailable.

    Adds ``refreshed`` (a detail payload was present).
    """
    d, keys = _detail_rows(details)
    has = F.coalesce(F.col("_has"), F.lit(False))
    rows = listings.join(d, keys, "left")
    return rows.select(
        *[c for c in listings.columns if c not in ("title", "price", "description",
                                                   "listing_status")],
        F.coalesce("_name", "title").alias("title"),
        F.coalesce("_price", "price").alias("price"),
        F.when(has, F.coalesce("_description", F.lit(""))).otherwise(F.col("description"))
        .alias("description"),
        F.when(has, listing_status(F.col("_status"))).otherwise(F.col("listing_status"))
        .alias("listing_status"), has.alias("refreshed"))


def review_prechecks(deals: DataFrame, details: DataFrame, minimum_discount_percent: float,
                     threshold: float, marketplace: str = SEARCH_MARKETPLACE) -> DataFrame:
    """Deals on their current content, with the first failed pre-check (``precheck``) or null."""
    first_stage = F.coalesce(
        (F.col("listing_status") == "active") & (F.col("ai_scope") == "standalone")
        & (F.col("condition_status") == "normal") & ~F.col("ai_reject")
        & F.col("ai_is_computer_part") & F.col("ai_usable_for_market_price")
        & F.col("ai_usable_price") & F.col("effective_price").isNotNull()
        & (F.coalesce(F.col("ai_confidence"), F.lit(0.0)) >= threshold), F.lit(False))
    rows = deals.withColumns({"_first_stage": first_stage, "_listed_price": F.col("price")})
    rows = with_text_names(refresh_detail(rows, details))
    now_off = discount_percent(F.col("effective_price"), F.col("reference_price"))
    supported = (F.coalesce(F.col("marketplace") == marketplace, F.lit(False))
                 & F.col("product_id").isNotNull())
    reason = (
        F.when(~F.col("_first_stage"), fixed.REVIEW_REASONS["first_stage"])
        .when(~supported, fixed.REVIEW_REASONS["unsupported"])
        .when(F.col("discount_percent") < minimum_discount_percent,
              fixed.REVIEW_REASONS["discount"])
        .when(~F.col("refreshed"), fixed.REVIEW_REASONS["request"])
        .when(F.col("listing_status") != "active", fixed.REVIEW_REASONS["inactive"])
        .when(F.col("price") != F.col("_listed_price"),
              fixed.REVIEW_REASONS["price"])
        .when(~exact_model(F.col("normalized_name"), F.col("_title_name"), F.col("_desc_name")),
              fixed.REVIEW_REASONS["identity"])
        .when(now_off < minimum_discount_percent,
              fixed.REVIEW_REASONS["effective"]))
    return (rows.withColumn("precheck", reason)
            .withColumn("discount_percent", F.when(F.col("precheck").isNull(), now_off)
                        .otherwise(F.col("discount_percent")))
            .drop("_first_stage", "_listed_price", "_title_name", "_desc_name", "refreshed"))


def review_gate(deals: DataFrame, details: DataFrame, verdicts: DataFrame, *,
                minimum_discount_percent: float, threshold: float, model: str,
                effort: str) -> DataFrame:
    """Second review of deals: ``passed``, ``review_status`` and ``review_reason``.

    ``verdicts`` hold JSON in ``verdict_json`` keyed by product and review fingerprint; a
    missing or malformed verdict is a failed review, never a pass.
    """
    rows = review_prechecks(deals, details, minimum_discount_percent, threshold)
    rows = rows.withColumn("review_fingerprint", review_fingerprint())
    keys = [*PRODUCT, "review_fingerprint"]
    usable = verdicts.where((F.col("model") == model) & (F.col("reasoning_effort") == effort)
                            & F.col("success"))
    newest = latest_per_key(usable, keys, "id", ["verdict_json"])
    newest = with_second_verdict(newest, "verdict_json", "_verdict").drop("verdict_json")
    rows = rows.join(newest, keys, "left")
    rows = rows.withColumn("_canonical", verdict_name(F.col("_verdict")))
    ok = review_passes(F.col("_verdict"), F.col("_canonical"), threshold, F.col("price"),
                       F.col("effective_price"), F.col("normalized_name"))
    clear = F.col("precheck").isNull()
    status = (F.when(~clear, "precheck_failed").when(F.col("_verdict").isNull(), "failed")
              .when(ok, "approved").otherwise("rejected"))
    return rows.withColumns({
        "passed": clear & ok, "review_status": status,
        "review_reason": F.coalesce("precheck", "_verdict.reason",
                                    F.lit(fixed.REVIEW_REASONS["failed"])),
    }).drop("_verdict", "_canonical", "precheck")


def approved_reviews(reviews: DataFrame) -> DataFrame:
    """Newest approved review per product: confidence and reason for the digest."""
    good = reviews.where((F.col("review_status") == "approved") & F.col("success"))
    newest = latest_per_key(good, PRODUCT, "id", ["confidence", "reason"])
    return newest.select(*PRODUCT, F.col("confidence").alias("second_stage_confidence"),
                         F.coalesce("reason", F.lit("")).alias("reason"))


def review_record(reviews: DataFrame, model: str, effort: str) -> DataFrame:
    """Review outcomes in the layout of the append-only review log."""
    return reviews.select(
        *PRODUCT, F.when(F.col("review_status") == "precheck_failed", "precheck")
        .otherwise(F.col("review_fingerprint")).alias("review_fingerprint"),
        F.lit(model).alias("model"), F.lit(effort).alias("reasoning_effort"),
        "review_status", F.col("review_reason").alias("reason"),
        F.col("price").alias("reviewed_price"),
        F.col("review_status").isin("approved", "rejected").alias("success"))


# --- deterministic routing -------------------------------------------------

def cheap_decisions(listings: DataFrame) -> DataFrame:
    """Add ``cheap_scope``, ``cheap_reason`` and ``standalone_name`` from text rules alone."""
    columns = listings.columns
    rows = listings.withColumn("cheap_scope", listing_scope(F.col("title"), F.col("description")))
    text, unnamed = joined_text(F.col("title"), F.col("description")), F.lit(None).cast("string")
    rows = rows.withColumn("_early", rejection_reason(
        F.col("listing_status"), F.col("condition_status"), F.col("cheap_scope"), text, unnamed, unnamed))
    # Names only matter to rows that nothing else rejects.
    still = F.col("_early").isNull()
    rows = rows.withColumns({"_title_name": F.when(still, product_name(F.col("title"))),
                             "_desc_name": F.when(still, product_name(F.col("description")))})
    rows = rows.withColumn("cheap_reason", F.coalesce("_early", F.when(
        F.col("_title_name") != F.col("_desc_name"), F.lit(fixed.RULE_REASONS["mismatch"]))))
    return rows.select(*columns, "cheap_scope", "cheap_reason", standalone_name(
        F.col("cheap_reason"), F.col("_title_name"), F.col("_desc_name"))
        .alias("standalone_name"))


def repair_routes(listings: DataFrame,
                  rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Re-judge stored text: ``outcome`` accept / reject / review and its reason.

    The condition is classified anew; rejected rows keep that condition, rows for review
    are handed on as normal.
    """
    return _named_routes(listings, rules).drop("_title_name", "_desc_name")


def _named_routes(listings: DataFrame, rules: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """`repair_routes` with the names of both texts, which later steps need again."""
    columns = listings.columns
    fresh = condition_status(F.col("title"), F.col("description"), rules)
    rows = listings.withColumns({
        "_fresh": fresh, "_scope": listing_scope(F.col("title"), F.col("description"))})
    text = joined_text(F.col("title"), F.col("description"))
    named = F.coalesce("_title_name", "_desc_name")
    early = (
        F.when(F.col("listing_status") != "active",
               F.concat(F.lit(fixed.RULE_REASONS["status"]), F.col("listing_status")))
        .when(F.col("_scope").isNotNull(),
              F.concat(F.lit(fixed.RULE_REASONS["scope"]), F.col("_scope")))
        .when(F.col("_fresh").isin("broken", "risky"),
              F.concat(F.lit(fixed.RULE_REASONS["condition"]), F.col("_fresh")))
        .when(~mentions_part(text), F.lit(fixed.RULE_REASONS["part"])))
    rows = rows.withColumn("_early", early)
    # Names only matter to rows that nothing else rejects.
    still = F.col("_early").isNull()
    rows = rows.withColumns({"_title_name": F.when(still, product_name(F.col("title"))),
                             "_desc_name": F.when(still, product_name(F.col("description")))})
    rows = rows.withColumn("_reject", F.coalesce("_early", F.when(
        named.isNull(), F.lit(fixed.RULE_REASONS["model"])).when(
        ~is_pricing_identity(named), F.lit(fixed.BUCKET_REASON))))
    agreed = F.col("_desc_name").isNull() | (F.col("_desc_name") == F.col("_title_name"))
    accept = F.when(F.col("_reject").isNull() & (F.col("_fresh") == "normal") & agreed,
                    F.col("_title_name"))
    rows = rows.withColumn("_accept", accept)
    outcome = (F.when(F.col("_reject").isNotNull(), "reject")
               .when(F.col("_accept").isNotNull(), "accept").otherwise("review"))
    return rows.select(*columns, outcome.alias("outcome"), F.col("_reject").alias("route_reason"),
                       F.col("_accept").alias("accepted_name"), F.col("_scope").alias("route_scope"),
                       F.col("_fresh").alias("fresh_condition"), "_title_name", "_desc_name")


def repair_listings(listings: DataFrame, verdicts: DataFrame, *, threshold: float, model: str,
                    effort: str, version: str,
                    rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Repaired classification columns of every listing, with its final ``outcome``."""
    columns = listings.columns
    routed = _named_routes(listings, rules).withColumn(
        "_name", F.col("ai_normalized_product_name"))
    review = F.col("outcome") == "review"
    base = routed.withColumns({
        "condition_status": F.when(review, "normal").otherwise(F.col("fresh_condition")),
        "ai_scope": F.lit("unknown")})
    # Rows decided by rule carry no fingerprint, so they never meet a verdict.
    print_ = F.when(review, classification_fingerprint())
    judged = apply_verdicts(cached_verdict(base, verdicts, model, effort, version, print_),
                            threshold)
    bad = rejected_columns(F.col("route_reason"), F.coalesce("route_scope", F.lit("unknown")))
    bad["condition_status"] = F.col("fresh_condition")
    bad["ai_normalized_product_name"] = F.col("_name")
    good = accepted_columns(F.col("accepted_name"))
    final = judged.withColumns({
        c: F.when(F.col("outcome") == "reject", bad[c])
        .when(F.col("outcome") == "accept", good[c]).otherwise(F.col(c)) for c in good})
    return final.select(
        *columns, F.when(~review, F.col("outcome"))
        .when(F.col("ai_reject"), "reject").otherwise("accept").alias("outcome"),
        review.alias("reviewed_by_verdict"), F.col("verdict").isNotNull().alias("cache_hit"))


def repair_summary(repaired: DataFrame) -> DataFrame:
    return repaired.agg(
        F.count("*").alias("reviewed"),
        F.count_if(F.col("outcome") == "accept").alias("accepts"),
        F.count_if(F.col("outcome") == "reject").alias("rejects"),
        F.count_if(F.col("reviewed_by_verdict") & F.col("cache_hit")).alias("cache_hits"))


def exclusions(listings: DataFrame, threshold: float = 0.85,
               target: Column | None = None) -> DataFrame:
    """Listings that give no observation, with their ``reason``."""
    rows = listings.withColumn("reason", exclusion_reason(threshold, target))
    return rows.where(F.col("reason").isNotNull())


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n"))


def first_examples(excluded: DataFrame, order: Sequence[Column], count: int = 8) -> DataFrame:
    """The first few excluded rows of the report."""
    return excluded.orderBy(*order).limit(count)


def backlog_gates(listings: DataFrame, threshold: float) -> DataFrame:
    """Add ``gate``: the first failed backlog gate of a classified listing, or null."""
    columns = listings.columns
    return with_text_names(listings).select(
        *columns, backlog_rejection(threshold, F.col("_title_name"), F.col("_desc_name"))
        .alias("gate"))
