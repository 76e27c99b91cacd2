"""Sale-status tracking: due rechecks, sale transitions, work-queue state, once-only alerts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.times import age_days, as_timestamp, instant
from ..schemas import SEARCH_MARKETPLACE
from .ordered import carried_last, running_total

PRODUCT = ["marketplace", "product_id"]


@dataclass(frozen=True)
class RecheckTiers:
    """Age limits (days, inclusive) and check intervals (hours)."""

    recent_age_days: float = 7
    medium_age_days: float = 30
    recent_interval_hours: float = 6
    medium_interval_hours: float = 24
    older_interval_hours: float = 72


def trackable(marketplace: str = SEARCH_MARKETPLACE) -> Column:
    return (
        (F.col("marketplace") == marketplace) & (F.col("listing_status") == "active")
        & (F.col("ai_scope") == "standalone") & (F.col("condition_status") == "normal")
        & F.col("ai_is_computer_part") & ~F.col("ai_reject")
        & F.col("ai_normalized_product_name").isNotNull() & F.col("product_id").isNotNull())


def due_rechecks(listings: DataFrame, tiers: RecheckTiers, now, limit: int | None = None,
                 marketplace: str = SEARCH_MARKETPLACE) -> DataFrame:
    """Listings whose status must be checked again, newest first.

    A time that cannot be read makes the listing due at once.
    """
    seen_kind = listings.schema["first_seen_at"].dataType
    active_kind = listings.schema["last_active_at"].dataType
    seen = as_timestamp(F.col("first_seen_at"), seen_kind)
    active_at = F.coalesce(F.col("last_active_at").cast("string"), F.lit("")) != ""
    last = F.when(active_at, as_timestamp(F.col("last_active_at"), active_kind)).otherwise(seen)
    rows = listings.where(trackable(marketplace)).withColumns({"_seen": seen, "_last": last})
    readable = F.col("_seen").isNotNull() & F.col("_last").isNotNull()
    rows = rows.withColumn("age_days", F.when(readable, age_days(F.col("_seen"), now))
                           .otherwise(0.0))
    hours = (F.when(F.col("age_days") <= tiers.recent_age_days,
                    F.lit(float(tiers.recent_interval_hours)))
             .when(F.col("age_days") <= tiers.medium_age_days,
                   F.lit(float(tiers.medium_interval_hours)))
             .otherwise(F.lit(float(tiers.older_interval_hours))))
    rows = rows.withColumn("interval_hours", hours)
    waited = F.unix_micros(instant(now)) - F.unix_micros("_last")
    due = ~readable | (waited >= F.col("interval_hours") * F.lit(3_600_000_000.0))
    rows = rows.where(due).drop("_seen", "_last").orderBy(F.col("first_seen_at").desc(), "id")
    return rows if limit is None else rows.limit(limit)


def sold_transitions(checks: DataFrame, chunk: Column, order: Sequence[Column],
                     keys: Sequence[str] = tuple(PRODUCT)) -> DataFrame:
    """Active-to-sold changes in a log of checks, with the last active price.

    ``checks`` have ``listing_status`` and ``price``; the price of a sale check is ignored.
    """
    active = F.col("listing_status") == "active"
    rows = carried_last(checks, list(keys), chunk, order, {
        "previous_status": F.col("listing_status"),
        "last_active_price": F.when(active, F.col("price"))})
    return rows.where((F.col("listing_status") == "sold")
                      & (F.col("previous_status") == "active"))


def replay_states(records: DataFrame, chunk: Column, order: Sequence[Column],
                  keys: Sequence[str] = tuple(PRODUCT)) -> DataFrame:
    """Change states of a full record log: every record against the one before it.

    Records need ``updated_at``, ``price`` and ``search_fingerprint``.
    """
    facts = F.struct(F.date_trunc("second", F.col("updated_at")).alias("at"),
                     F.col("price").alias("price"), F.col("search_fingerprint").alias("print"))
    rows = carried_last(records, list(keys), chunk, order, {"_was": facts})
    same = (F.col("_was.at").eqNullSafe(F.date_trunc("second", F.col("updated_at")))
            & F.col("_was.price").eqNullSafe(F.col("price"))
            & F.col("_was.print").eqNullSafe(F.col("search_fingerprint")))
    state = (F.when(F.col("_was").isNull(), "new").when(same, "unchanged")
             .otherwise("updated"))
    return rows.withColumns({
        "state": state,
        "previous_price": F.when(state == "updated", F.col("_was.price"))}).drop("_was")


def fold_queue(events: DataFrame, chunk: Column, now, timeout_seconds: float = 900,
               delay_minutes: int = 10) -> DataFrame:
    """Work-queue state from a log of job events (enqueue, start, finish, fail).

    Events need product keys, ``event_no`` (total order), ``kind``, ``at``,
    ``classification_fingerprint`` (enqueue) and ``error`` (fail).  Only events from a
    product's last content change on count, and a start counts only when the job was waiting.
    The last counted event then gives the state, so the fold is a few partial aggregates
    instead of a loop over a product's events.
    """
    enqueue = F.col("kind") == "enqueue"
    last = (events.where(enqueue).groupBy(*PRODUCT)
            .agg(F.max_by("classification_fingerprint", "event_no").alias("_current")))
    other = (events.where(enqueue).join(last, PRODUCT)
             .where(F.col("classification_fingerprint") != F.col("_current"))
             .groupBy(*PRODUCT).agg(F.max("event_no").alias("_other")))
    since = (events.where(enqueue).join(other, PRODUCT, "left")
             .where(F.col("event_no") > F.coalesce(F.col("_other"), F.lit(-1)))
             .groupBy(*PRODUCT).agg(F.min("event_no").alias("_since")))
    rows = (events.join(last.join(since, PRODUCT), PRODUCT)
            .where(F.col("event_no") >= F.col("_since")))
    rows = carried_last(rows, PRODUCT, chunk, [F.col("event_no")],
                        {"_before": F.when(F.col("kind") != "enqueue", F.col("kind"))})
    waiting = F.col("_before").isNull() | (F.col("_before") == "fail")
    rows = rows.where((F.col("kind") != "start") | waiting)
    along = F.col("event_no")

    def last_of(kind: str, value: str) -> Column:
        return F.max_by(value, F.when(F.col("kind") == kind, along))

    folded = rows.groupBy(*PRODUCT).agg(
        F.first("_current").alias("classification_fingerprint"),
        F.max_by("kind", F.when(~enqueue, along)).alias("_last"),
        F.count_if(F.col("kind") == "start").cast("int").alias("attempts"),
        last_of("start", "at").alias("_started"), last_of("finish", "at").alias("_finished"),
        last_of("fail", "at").alias("_failed"), last_of("fail", "error").alias("_error"),
        F.min(F.when(enqueue, F.col("at"))).alias("_queued"), F.max("at").alias("_touched"))
    at = instant(now)
    cutoff = at - F.make_dt_interval(secs=F.lit(float(timeout_seconds)))
    stale = F.coalesce((F.col("_last") == "start") & (F.col("_started") < cutoff), F.lit(False))
    state = (F.when(F.col("_last").isNull(), "pending")
             .when(F.col("_last") == "finish", "completed")
             .when((F.col("_last") == "fail") | stale, "retry").otherwise("processing"))
    later = F.col("_failed") + F.make_dt_interval(mins=F.lit(delay_minutes))
    error = F.when(F.col("_last").isin("fail", "start"),
                   F.nullif(F.substring("_error", 1, 1000), F.lit("")))
    return folded.select(
        *PRODUCT, "classification_fingerprint", state.alias("state"), "attempts",
        F.coalesce(error, F.when(stale, fixed.AUDIT_REASONS["stale"]), F.lit(""))
        .alias("last_error"),
        F.when(stale, at).otherwise(F.coalesce(later, F.col("_queued"))).alias("available_at"),
        F.when(state == "processing", F.col("_started")).alias("started_at"),
        F.col("_finished").alias("completed_at"),
        F.when(stale, at).otherwise(F.col("_touched")).alias("updated_at"))


def notify_once(deals: DataFrame, changes: DataFrame, order: str, chunk: Column,
                keys: Sequence[str] = tuple(PRODUCT)) -> DataFrame:
    """Deals that are due an alert: never alerted, or re-opened by a price drop since.

    ``deals`` and ``changes`` share a total order column (a drop comes before a deal of the
    same number).  Running drop counts split a product's deals into epochs; the first deal
    of each epoch is alerted.
    """
    drops = changes.where((F.col("state") == "updated")
                          & (F.col("price") < F.col("previous_price")))
    marks = drops.select(*keys, order, F.lit(1).alias("_drop")).unionByName(
        deals.select(*keys, order, F.lit(0).alias("_drop")))
    epochs = running_total(marks, list(keys), chunk,
                           [F.col(order), F.col("_drop").desc()], F.col("_drop"), "_epoch")
    firsts = (epochs.where(F.col("_drop") == 0).groupBy(*keys, "_epoch")
              .agg(F.min(order).alias(order)))
    return deals.join(firsts.select(*keys, order), [*keys, order], "left_semi")
