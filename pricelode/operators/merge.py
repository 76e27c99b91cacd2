"""Merge-style table maintenance: each operator returns the next version of a table.

Every merge is one equality join between the current table and one change row per key;
write the result to a new path or table version, never over the one being read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import (
    exact_model, historical_scope, is_pricing_identity, name_mismatch, product_name)
from ..functions.times import instant
from ..schemas import LISTING_STATUSES, SCOPES, SEARCH_MARKETPLACE
from .ordered import latest_per_key

PRODUCT = ["marketplace", "product_id"]
OBSERVATION_KEY = [*PRODUCT, "normalized_product_name", "observed_at"]
REBUILD_REASON = fixed.AUDIT_REASONS["rebuild"]

# Columns a processed listing brings along (identity, content, classification, price).
CONTENT = ["listing_id", "url", "title", "price", "location", "source_type", "description",
           "condition_status", "ai_is_computer_part", "ai_normalized_product_name",
           "ai_confidence", "ai_reject", "ai_reason", "source_key", "updated_at",
           "search_fingerprint", "canonical_url", "listing_status", "ai_scope",
           "ai_sale_status", "ai_usable_for_market_price"]
PRICING = ["effective_price", "ai_usable_price"]
CLASSIFICATION = ["condition_status", "ai_is_computer_part", "ai_normalized_product_name",
                  "ai_confidence", "ai_reject", "ai_reason", "ai_scope", "ai_sale_status",
                  "ai_usable_for_market_price"]


#: Of several changes of one product the newest counts.
NEWEST = ("updated_at", "id")


def old(column: str) -> Column:
    return F.col(f"t.{column}")


def new(column: str) -> Column:
    return F.col(f"s.{column}")


def one_per_key(source: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The last row of every key by ``order``, ties by a hash of the row; rows with a null key stay as they are.

    Ranks need the partitioning and sort that the merge's join needs anyway, and only the best row of
    a key leaves a task, so a key with very many rows is reduced before the shuffle.
    """
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    rest = [c for c in source.columns if c not in keys]
    last = [*(F.col(c).desc_nulls_last() for c in order), F.xxhash64(*rest).desc()] if rest else [F.lit(0)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*last))
    kept = source.where(whole).withColumn("_place", place).where("_place = 1").drop("_place")
    return kept.unionByName(source.where(~whole))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           matched: Mapping[str, Column], missing: Mapping[str, Column] | None,
           extra: Mapping[str, Column] | None = None,
           guard: Column | None = None, insert_if: Column | None = None,
           order: Sequence[str] | None = None) -> DataFrame:
    """Target rows with ``matched`` columns replaced where the source has the key.

    ``missing`` builds rows for unknown keys (None = unknown keys are ignored), ``insert_if`` limits
    which; ``guard`` limits which matched rows change.  Null keys never match.  The target is read once,
    by one join on its own key columns, so a target that is stored bucketed by them isn't shuffled.
    Of several source rows of a key the last by ``order`` counts; without ``order`` the caller gives
    one row a key.
    """
    if order is not None:
        source = one_per_key(source, keys, [c for c in order if c in source.columns])
    t = target.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.struct(*target.columns).alias("t"))
    s = source.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.struct(*source.columns).alias("s"))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & (F.col(f"_t{i}") == F.col(f"_s{i}"))
    joined = t.join(s, on, "left" if missing is None else "full_outer")
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    if insert_if is not None:
        joined = joined.where(has_t | insert_if)
    change = has_s if guard is None else has_s & guard
    out = []
    for name in target.columns:
        value = old(name)
        if name in matched:
            value = F.when(change, matched[name]).otherwise(value)
        if missing is not None:
            fresh = missing.get(name, F.lit(None))
            value = F.when(has_t, value).otherwise(fresh)
        out.append(value.cast(target.schema[name].dataType).alias(name))
    for name, value in (extra or {}).items():
        out.append(F.coalesce(value, F.lit(False)).alias(name))
    return joined.select(*out)


def _inserted(now, source: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Insert defaults: an active listing starts its activity record now."""
    active = new("listing_status") == "active"
    at = instant(now)
    row = {c: new(c) for c in columns if c in source.columns}
    given = {c: new(c) if c in source.columns else F.lit(None)
             for c in ("last_active_at", "last_active_price", "first_sold_seen_at", "id")}
    row.update({
        "id": given["id"], "first_seen_at": at, "notified_at": F.lit(None),
        "first_sold_seen_at": given["first_sold_seen_at"],
        "last_active_at": F.coalesce(given["last_active_at"], F.when(active, at)),
        "last_active_price": F.coalesce(given["last_active_price"],
                                        F.when(active, new("price"))),
    })
    return row


def _lifecycle(now, source: DataFrame, keep_given: bool = True) -> dict[str, Column]:
    status, at = new("listing_status"), instant(now)
    given_at = new("last_active_at") if keep_given and "last_active_at" in source.columns \
        else F.lit(None).cast("timestamp")
    given_price = new("last_active_price") if "last_active_price" in source.columns \
        else F.lit(None).cast("bigint")
    return {
        "last_active_at": F.when(status == "active", F.coalesce(given_at, at))
        .otherwise(old("last_active_at")),
        "last_active_price": F.when(status == "active", F.coalesce(given_price, new("price")))
        .otherwise(old("last_active_price")),
        "first_sold_seen_at": F.when(status == "sold",
                                     F.coalesce(old("first_sold_seen_at"), at))
        .otherwise(old("first_sold_seen_at")),
    }


def merge_processed(listings: DataFrame, processed: DataFrame, now) -> DataFrame:
    """Store scan results: insert new products, refresh changed ones.

    ``processed`` carries ``state`` and ``previous_price``; a notified listing becomes
    notifiable again only when an update lowers its price.  A product that is already
    stored is never touched by a row in state ``new``.
    """
    todo = processed.where(F.col("state").isin("new", "updated", "pending_ai"))
    dropped = ((new("state") == "updated") & new("previous_price").isNotNull()
               & (new("price") < new("previous_price")))
    matched = {c: new(c) for c in [*CONTENT, *PRICING]}
    matched.update(_lifecycle(now, processed))
    matched["notified_at"] = F.when(~F.coalesce(dropped, F.lit(False)), old("notified_at"))
    columns = [*PRODUCT, *CONTENT, *PRICING]
    return upsert(listings, todo, PRODUCT, matched, _inserted(now, processed, columns),
                  guard=new("state") != "new", insert_if=new("state") == "new", order=NEWEST)


def merge_backfill(listings: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Store backfill rows; notification, lifecycle and effective price stay as they are."""
    return upsert(listings, incoming, PRODUCT, {c: new(c) for c in CONTENT},
                  _inserted(now, incoming, [*PRODUCT, *CONTENT, *PRICING]), order=NEWEST)


def merge_backlog(listings: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Refresh stored rows that were never notified; nothing is inserted."""
    matched = {c: new(c) for c in [*CONTENT, *PRICING]}
    matched.update(_lifecycle(now, incoming, keep_given=False))
    return upsert(listings, incoming, PRODUCT, matched, None,
                  guard=old("notified_at").isNull(), order=NEWEST)


def merge_repair(listings: DataFrame, repaired: DataFrame) -> DataFrame:
    """Replace classification columns only."""
    return upsert(listings, repaired, ["id"], {c: new(c) for c in CLASSIFICATION}, None)


def merge_checks(listings: DataFrame, checks: DataFrame, now) -> DataFrame:
    """Apply lifecycle checks; adds ``became_sold`` for first sightings of a sale.

    Only an active check refreshes the price; a sale keeps the last active price and the
    first time it was seen sold.
    """
    active, at = new("listing_status") == "active", instant(now)
    matched = {
        "title": new("title"), "description": new("description"),
        "condition_status": new("condition_status"), "listing_status": new("listing_status"),
        "price": F.when(active, new("price")).otherwise(old("price")),
        "last_active_at": F.when(active, at).otherwise(old("last_active_at")),
        "last_active_price": F.when(active, new("price")).otherwise(
            F.coalesce(old("last_active_price"), new("price"))),
        "first_sold_seen_at": F.when(new("listing_status") == "sold",
                                     F.coalesce(old("first_sold_seen_at"), at))
        .otherwise(old("first_sold_seen_at")),
    }
    became = (old("listing_status") == "active") & (new("listing_status") == "sold")
    return upsert(listings, checks, PRODUCT, matched, None, extra={"became_sold": became}, order=NEWEST)


def mark_unavailable(listings: DataFrame, failures: DataFrame, now) -> DataFrame:
    """Terminal detail failures: stored rows become unavailable, unknown ones are added."""
    gone = failures.withColumn("listing_status", F.lit("unavailable"))
    defaults = {"description": F.lit(""), "condition_status": F.lit("unknown"),
                "ai_reject": F.lit(False), "ai_reason": F.lit(""), "ai_scope": F.lit("unknown"),
                "ai_sale_status": F.lit("unknown"), "ai_usable_for_market_price": F.lit(False),
                "ai_usable_price": F.lit(False)}
    return upsert(listings, gone, PRODUCT, {"listing_status": F.lit("unavailable")},
                  {**defaults, **_inserted(now, gone, [*PRODUCT, *CONTENT, *PRICING])}, order=NEWEST)


def error_category(http_status: Column, exception_type: Column) -> Column:
    """Stable failure class of a detail request."""
    chain = (F.when(exception_type == "ConnectTimeout", "connect_timeout")
             .when(exception_type.isin(*fixed.READ_ERRORS), "read_timeout")
             .when(exception_type.isin(*fixed.CONNECT_ERRORS), "connect_timeout"))
    return (chain.when(http_status == 429, "429")
            .when(http_status >= 500, "5xx")
            .when(http_status == 404, "404_or_unavailable")
            .when(http_status.between(400, 499), "other_4xx")
            .otherwise("unknown"))


def is_transient(category: Column) -> Column:
    return category.isin(*fixed.TRANSIENT_CATEGORIES)


def categorised(failures: DataFrame) -> DataFrame:
    category = error_category(F.col("http_status"), F.col("exception_type"))
    return (failures.withColumn("error_category", category)
            .withColumn("is_terminal", ~is_transient(F.col("error_category"))))


RETRY_IDENTITY = ["query_key", "listing_id", "title", "price", "url", "location", "source_type",
                  "source_key", "updated_at", "search_fingerprint", "canonical_url",
                  "listing_status"]


def fold_retries(retries: DataFrame, failures: DataFrame, now,
                 order: str = "failed_at") -> DataFrame:
    """Fold any number of failures per product into the retry table.

    Each failure adds one attempt; every failure after a product's first adds its own
    request retries plus one.  The newest failure decides the descriptive columns.
    """
    carried = [c for c in RETRY_IDENTITY if c in failures.columns]
    rows = categorised(failures)
    facts = [*carried, "http_status", "exception_type", "error_category", "is_terminal", "message"]
    along = F.col(order)
    folded = rows.groupBy(*PRODUCT).agg(
        F.count("*").cast("int").alias("_events"), F.sum("retry_count").alias("_retries"),
        F.max_by(F.struct(*facts), along).alias("_last"))
    folded = folded.select(*PRODUCT, "_events", "_retries",
                           *[F.col(f"_last.{c}").alias(c) for c in facts])
    at = instant(now)
    text = F.concat(new("exception_type"), F.lit(": "), new("message"))
    latest = {**{c: new(c) for c in carried},
              "last_error": text, "http_status": new("http_status"),
              "exception_type": new("exception_type"), "error_category": new("error_category"),
              "last_error_message": new("message"), "last_error_at": at,
              "is_terminal": new("is_terminal"), "updated_at_retry": at}
    matched = {**latest, "attempts": old("attempts") + new("_events"),
               "retry_count": old("retry_count") + new("_retries") + new("_events")}
    missing = {**{c: new(c) for c in PRODUCT}, **latest, "attempts": new("_events"),
               "retry_count": new("_retries") + new("_events") - 1, "created_at": at}
    return upsert(retries, folded, PRODUCT, matched, missing)


def clear_retries(retries: DataFrame, products: DataFrame) -> DataFrame:
    return retries.join(products.select(*PRODUCT), PRODUCT, "left_anti")


def due_retries(retries: DataFrame, query_key: str | None = None) -> DataFrame:
    """Retryable entries in queue order."""
    rows = retries.where(~F.col("is_terminal"))
    if query_key is not None:
        rows = rows.where(F.col("query_key") == query_key)
    return rows.orderBy("created_at", *PRODUCT)


def enqueue_work(jobs: DataFrame, candidates: DataFrame, now) -> DataFrame:
    """Queue work; an existing job restarts only when its content fingerprint changed."""
    at = instant(now)
    moved = old("classification_fingerprint") != new("classification_fingerprint")

    def on_change(value: Column, column: str) -> Column:
        return F.when(moved, value).otherwise(old(column))

    matched = {
        "classification_fingerprint": new("classification_fingerprint"),
        "state": on_change(F.lit("pending"), "state"),
        "attempts": on_change(F.lit(0), "attempts"),
        "last_error": on_change(F.lit(""), "last_error"),
        "available_at": on_change(at, "available_at"), "updated_at": at,
    }
    missing = {**{c: new(c) for c in [*PRODUCT, "classification_fingerprint"]},
               "state": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(""),
               "available_at": at, "updated_at": at}
    return upsert(jobs, candidates.where(F.col("product_id").isNotNull()), PRODUCT, matched,
                  missing)


def recover_stale(jobs: DataFrame, now, timeout_seconds: float) -> DataFrame:
    """Processing work that started before the time-out goes back to retry."""
    if timeout_seconds <= 0:
        raise ValueError("the recovery time-out must be positive")
    at = instant(now)
    cutoff = at - F.make_dt_interval(secs=F.lit(float(timeout_seconds)))
    stale = F.coalesce((F.col("state") == "processing") & (F.col("started_at") < cutoff),
                       F.lit(False))
    return jobs.withColumns({
        "last_error": F.when(stale & (F.col("last_error") == ""), fixed.AUDIT_REASONS["stale"])
        .otherwise(F.col("last_error")),
        "available_at": F.when(stale, at).otherwise(F.col("available_at")),
        "updated_at": F.when(stale, at).otherwise(F.col("updated_at")),
        "started_at": F.when(~stale, F.col("started_at")),
        "state": F.when(stale, "retry").otherwise(F.col("state")),
    })


def start_work(jobs: DataFrame, products: DataFrame, now) -> DataFrame:
    at = instant(now)
    return upsert(jobs, products.select(*PRODUCT).distinct(), PRODUCT,
                  {"state": F.lit("processing"), "attempts": old("attempts") + 1,
                   "started_at": at, "updated_at": at}, None,
                  guard=old("state").isin("pending", "retry"))


def finish_work(jobs: DataFrame, results: DataFrame, now, delay_minutes: int = 10) -> DataFrame:
    """Completed work, or a retry after the fixed delay when ``error`` is set."""
    at = instant(now)
    failed = new("error").isNotNull()
    later = at + F.make_dt_interval(mins=F.lit(delay_minutes))
    return upsert(jobs, results.select(*PRODUCT, "error"), PRODUCT, {
        "state": F.when(failed, "retry").otherwise("completed"),
        "completed_at": F.when(failed, old("completed_at")).otherwise(at),
        "started_at": F.lit(None).cast("timestamp"),
        "last_error": F.when(failed, F.substring(new("error"), 1, 1000)).otherwise(""),
        "available_at": F.when(failed, later).otherwise(old("available_at")),
        "updated_at": at}, None)


def ready_work(jobs: DataFrame, listings: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Stored listings whose work is pending or due for retry, oldest job first."""
    due = jobs.where(F.col("state").isin("pending", "retry")
                     & (F.col("available_at") <= instant(now)))
    due = due.select(*PRODUCT, F.col("updated_at").alias("job_updated_at"))
    rows = listings.join(due, PRODUCT).orderBy("job_updated_at", *PRODUCT)
    return rows if limit is None else rows.limit(limit)


def merge_watermarks(watermarks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace the mark of each source that has a new one, at second precision."""
    at = F.date_trunc("second", new("updated_at"))
    keys = ["marketplace", "source_key"]
    return upsert(watermarks, fresh, keys, {"updated_at": at},
                  {**{k: new(k) for k in keys}, "updated_at": at})


# --- observations ----------------------------------------------------------

def observable() -> Column:
    """Whether a listing may be recorded as a price observation."""
    return F.coalesce(
        F.col("product_id").isNotNull() & (F.col("listing_status") == "active")
        & (F.col("ai_scope") == "standalone") & F.col("ai_usable_for_market_price")
        & F.col("ai_usable_price") & (F.col("effective_price") > 0), F.lit(False))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str],
                     order: Sequence[Column]) -> DataFrame:
    """The incoming rows that are really new: unseen keys, first row per key."""
    columns = incoming.columns
    first = F.min_by(F.struct(*columns), F.struct(*order))
    once = incoming.groupBy(*keys).agg(first.alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in columns])
    return once.join(existing.select(*keys), list(keys), "left_anti").select(*columns)


def observe(listings: DataFrame, stored: DataFrame, observations: DataFrame, name: str,
            observed_at: Column) -> DataFrame:
    """New observations (effective price) of eligible listings under product ``name``.

    ``first_seen_at`` comes from the newest stored row; repeated keys are ignored.
    """
    seen = latest_per_key(stored, PRODUCT, "id", ["first_seen_at"])
    rows = (listings.where(observable() & F.col(name).isNotNull())
            .drop("first_seen_at").join(seen, PRODUCT))
    fresh = rows.select(
        *PRODUCT, F.col(name).alias("normalized_product_name"),
        F.col("effective_price").alias("observed_price"), observed_at.alias("observed_at"),
        "first_seen_at", F.col("updated_at").alias("source_updated_at"), "listing_id",
        F.lit(True).alias("valid"), F.lit(None).cast("string").alias("invalid_reason"))
    return insert_or_ignore(observations, fresh, OBSERVATION_KEY,
                            [F.col("observed_price"), F.col("listing_id")])


def already_observed(listings: DataFrame, observations: DataFrame, name: str) -> DataFrame:
    """Add ``observed``: any stored observation, valid or not, under the same product."""
    seen = (observations.select(*PRODUCT, F.col("normalized_product_name").alias(name))
            .distinct().withColumn("_seen", F.lit(True)))
    out = listings.join(seen, [*PRODUCT, name], "left")
    return out.select(*listings.columns, F.col("_seen").isNotNull().alias("observed"))


def history(observations: DataFrame) -> DataFrame:
    """Price history: the valid observations."""
    return observations.where(F.col("valid")).select(
        *PRODUCT, "normalized_product_name", "observed_price", "observed_at",
        "source_updated_at", F.col("id").alias("price_observation_id"))


def prune_history(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """History without rows whose observation has been invalidated."""
    bad = observations.where(~F.col("valid")).select(F.col("id").alias("price_observation_id"))
    return rows.join(bad, "price_observation_id", "left_anti").select(*rows.columns)


def audit_contamination(observations: DataFrame, listings: DataFrame, verdicts: DataFrame,
                        current_version: str) -> DataFrame:
    """Observations with their re-judged ``valid``, ``invalid_reason`` and audit columns.

    A listing judged by the current classifier version keeps its stored scope; older rows
    are scoped from their text.  Observations without a listing are left alone.
    """
    version = latest_per_key(verdicts.where("success"), PRODUCT, "id", ["classifier_version"])
    texts = listings.select(
        *PRODUCT, "listing_status", "ai_scope",
        product_name(F.col("title")).alias("_title_name"),
        product_name(F.col("description")).alias("_desc_name"),
        historical_scope(F.col("title"), F.col("description")).alias("_text_scope"))
    rows = (observations.join(texts.withColumn("_found", F.lit(True)), PRODUCT, "left")
            .join(version, PRODUCT, "left"))
    current = F.coalesce(F.col("classifier_version") == current_version, F.lit(False))
    scope = F.when(current & F.col("ai_scope").isin(*SCOPES), F.col("ai_scope")).otherwise(
        F.col("_text_scope"))
    rows = rows.withColumns({"_current": current, "scope": scope})
    status = F.col("listing_status")
    mismatch = name_mismatch(F.col("normalized_product_name"), F.col("_title_name"),
                             F.col("_desc_name"))
    reason = (
        F.when(~status.isin(*LISTING_STATUSES) | (status != "active"),
               F.concat(F.lit(fixed.AUDIT_REASONS["status"]), status))
        .when(F.col("scope") != "standalone",
              F.concat(F.lit(fixed.AUDIT_REASONS["scope"]), F.col("scope")))
        .when(mismatch, F.lit(fixed.AUDIT_REASONS["mismatch"])))
    reviewed = F.coalesce(F.col("_found"), F.lit(False))
    rows = rows.withColumns({"reviewed": reviewed, "_reason": reason})
    out = [c for c in observations.columns if c not in ("valid", "invalid_reason")]
    return rows.select(
        *out,
        F.when(F.col("reviewed"), F.col("_reason").isNull()).otherwise(F.col("valid"))
        .alias("valid"),
        F.when(F.col("reviewed"), F.col("_reason")).otherwise(F.col("invalid_reason"))
        .alias("invalid_reason"),
        "reviewed", F.when(F.col("reviewed"), F.col("scope")).alias("scope"),
        (F.col("reviewed") & ~F.col("_current")).alias("rescoped"))


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count_if("reviewed").alias("reviewed"),
        F.count_if(F.col("reviewed") & ~F.col("valid")).alias("invalidated"))


def rescope_listings(listings: DataFrame, audited: DataFrame) -> DataFrame:
    """Write the text-derived scope back to listings without a current verdict."""
    scopes = (audited.where("rescoped").groupBy(*PRODUCT)
              .agg(F.first("scope").alias("ai_scope")))
    return upsert(listings, scopes, PRODUCT, {"ai_scope": new("ai_scope")}, None)


def rebuild_qualified(confidence_threshold: float, title_name: Column,
                      description_name: Column) -> Column:
    """Whether a repaired listing may produce an observation again."""
    name = F.col("ai_normalized_product_name")
    return F.coalesce(
        is_pricing_identity(name) & (F.col("listing_status") == "active")
        & (F.col("condition_status") == "normal") & (F.col("ai_scope") == "standalone")
        & F.col("ai_is_computer_part") & ~F.col("ai_reject")
        & F.col("ai_usable_for_market_price")
        & (F.coalesce(F.col("ai_confidence"), F.lit(0.0)) >= confidence_threshold)
        & exact_model(name, title_name, description_name), F.lit(False))


def rebuild_observations(observations: DataFrame, listings: DataFrame,
                         confidence_threshold: float) -> DataFrame:
    """Invalidate everything, then re-derive observations from qualifying listings.

    A rebuilt row takes the displayed price and the listing's update time (first sighting
    when there is none), and replaces a stored row with the same natural key.
    """
    names = listings.withColumns({"_title_name": product_name(F.col("title")),
                                  "_desc_name": product_name(F.col("description"))})
    good = names.where(F.col("product_id").isNotNull() & rebuild_qualified(
        confidence_threshold, F.col("_title_name"), F.col("_desc_name")))
    at = F.coalesce("updated_at", "first_seen_at")
    derived = good.groupBy(
        *PRODUCT, F.col("ai_normalized_product_name").alias("normalized_product_name"),
        at.alias("observed_at")).agg(F.max_by(F.struct(
            "price", "first_seen_at", "updated_at", "listing_id"), "id").alias("_row"))
    derived = derived.select(
        *OBSERVATION_KEY, F.col("_row.price").alias("observed_price"),
        F.col("_row.first_seen_at").alias("first_seen_at"),
        F.col("_row.updated_at").alias("source_updated_at"),
        F.col("_row.listing_id").alias("listing_id"))
    retired = observations.withColumns({"valid": F.lit(False),
                                        "invalid_reason": F.lit(REBUILD_REASON)})
    values = {c: new(c) for c in ("observed_price", "first_seen_at", "source_updated_at",
                                  "listing_id")}
    values.update({"valid": F.lit(True), "invalid_reason": F.lit(None)})
    return upsert(retired, derived, OBSERVATION_KEY, values,
                  {**values, **{k: new(k) for k in OBSERVATION_KEY}})


# --- notification and progress ---------------------------------------------

def not_notified(deals: DataFrame, listings: DataFrame) -> DataFrame:
    """Deals whose URL has not been notified."""
    done = listings.where(F.col("notified_at").isNotNull()).select("url")
    return deals.join(done, "url", "left_anti").select(*deals.columns)


def notification_candidates(deals: DataFrame, listings: DataFrame) -> DataFrame:
    eligible = deals.where((F.col("listing_status") == "active")
                           & (F.col("ai_scope") == "standalone"))
    return not_notified(eligible, listings)


def mark_notified(listings: DataFrame, sent: DataFrame, now) -> DataFrame:
    """Listings with ``notified_at`` set for the delivered URLs; call after delivery."""
    return upsert(listings, sent.select("url").distinct(), ["url"],
                  {"notified_at": instant(now)}, None)


def unseen(candidates: DataFrame, seen: DataFrame, retries: DataFrame) -> DataFrame:
    """Candidates neither processed before nor waiting for a retry."""
    waiting = retries.where(~F.col("is_terminal")).select(*PRODUCT)
    return (candidates.where(F.col("product_id").isNotNull())
            .join(seen.select(*PRODUCT), PRODUCT, "left_anti")
            .join(waiting, PRODUCT, "left_anti").select(*candidates.columns))


def repair_candidates(listings: DataFrame, after_id: int = 0,
                      prefix: str = "all-market-price-backfill:") -> DataFrame:
    """Backfilled rows beyond a key, in key order."""
    return (listings.where((F.col("id") > after_id) & F.col("source_key").startswith(prefix))
            .orderBy("id"))


def backlog_listings(listings: DataFrame, marketplace: str = SEARCH_MARKETPLACE) -> DataFrame:
    return (listings.where((F.col("marketplace") == marketplace)
                           & F.col("notified_at").isNull() & F.col("product_id").isNotNull())
            .orderBy("id"))


def listing_by_product(listings: DataFrame, marketplace: str, product_id: str) -> DataFrame:
    return listings.where((F.col("marketplace") == marketplace)
                          & (F.col("product_id") == product_id))


def observations_of(observations: DataFrame, name: str) -> DataFrame:
    """Valid observations of one product in time order."""
    return (observations.where((F.col("normalized_product_name") == name) & F.col("valid"))
            .orderBy("observed_at"))
