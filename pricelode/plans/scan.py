"""Incremental scan: payload pages to listings, observations, estimates and deals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.money import change_percent, comparable_name
from ..functions.times import instant, parse_iso
from ..functions.verdicts import reliable_content, unreliable_columns
from ..operators import changes, deals, estimator, merge, quality, verdict_flow
from ..operators.ordered import beside
from ..schemas import LISTING_DEFAULTS, LISTINGS, conform
from ..session import stage_table
from ..sources import search, tables
from .settings import Settings


@dataclass(frozen=True)
class ScanResult:
    records: DataFrame
    processed: DataFrame
    listings: DataFrame
    new_observations: DataFrame
    waiting: DataFrame
    estimates: DataFrame
    deals: DataFrame
    counters: DataFrame
    watermarks: DataFrame
    metrics: DataFrame
    anomaly: DataFrame
    moves: DataFrame


def candidates_of(payloads: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(accepted candidates, judged records) of a set of payload pages."""
    judged = search.judged_records(search.search_records(payloads), settings.maximum_price)
    rows = search.listings_of(judged).withColumn("updated_at", parse_iso(F.col("updated_at")))
    return rows, judged


def judged_pages(payloads: DataFrame, settings: Settings) -> DataFrame:
    """All records of the pages as stored rows: payloads are parsed once, whoever reads them."""
    judged = search.judged_records(search.search_records(payloads), settings.maximum_price)
    rows = search.record_rows(judged).withColumn("updated_at", parse_iso(F.col("updated_at")))
    return stage_table(rows, "scan-judged")


def accepted(judged: DataFrame) -> DataFrame:
    """The candidates among `judged_pages`."""
    return judged.where(F.col("reject_reason").isNull()).drop("reject_reason")


PLACE = ["source_order", "source_key", "page_no", "pos", *merge.PRODUCT]


def read_sources(rows: DataFrame, payloads: DataFrame, watermarks: DataFrame, overlap_pages: int) -> DataFrame:
    """The records a scan keeps, source after source, with ``duplicate``.

    A source stops at its watermark on the pages it really has, those without a usable record
    included; a record is a duplicate only of one kept before, of an earlier source or its own.
    The loop runs over the configured sources, not over data. It sees only what it can decide on:
    places of products with several records, and pages of sources that have a watermark. The records
    themselves are joined with its outcome once, and not at all if there is none.
    """
    if "source_order" not in rows.columns:
        rows = rows.join(payloads.select("source_key", "source_order").distinct(), "source_key")
    rows = rows.where(F.col("source_key").isNotNull())
    ranks = [F.col("source_order"), F.col("page_no"), F.col("pos")]
    several = rows.select(*merge.PRODUCT).dropna().groupBy(*merge.PRODUCT).agg(F.count("*").alias("n")).where("n > 1")
    several = stage_table(several.drop("n"), "scan-several")
    repeats = not several.isEmpty()
    marked = {r.source_key for r in watermarks.where("updated_at IS NOT NULL").select("source_key").distinct().collect()}
    if repeats:
        several = stage_table(rows.select(*PLACE).join(several, merge.PRODUCT, "left_semi").distinct(), "scan-places")
    pages = payloads.select("source_key", "source_order", "page_no").distinct()
    order = payloads.select("source_key", "source_order").distinct().orderBy("source_order").collect() \
        if repeats or marked else []
    twice = stops = seen = None
    for rank in dict.fromkeys(r.source_order for r in order):
        mine, found = F.col("source_order") == rank, None
        if repeats:
            found = changes.mark_duplicates(several.where(mine), merge.PRODUCT, ranks)
            if seen is not None:
                found = found.join(seen.withColumn("_seen", F.lit(True)), merge.PRODUCT, "left").withColumn(
                    "duplicate", F.col("duplicate") | F.coalesce("_seen", F.lit(False))).drop("_seen")
            found = stage_table(found, "scan-duplicates")
            flagged = found.where("duplicate")
            twice = flagged if twice is None else twice.unionByName(flagged)
        cut = [r.source_key for r in order if r.source_order == rank and r.source_key in marked]
        kept = found
        if cut:
            records = rows.where(mine & F.col("source_key").isin(cut)).select(*PLACE, "updated_at", "state")
            records = _flagged(records, found.where("duplicate") if repeats else None)
            here = pages.where(mine & F.col("source_key").isin(cut))
            stop = changes.pages_before_stop(records, watermarks, overlap_pages, here)
            stop = stage_table(stop.withColumn("source_order", F.lit(rank)), "scan-pages")
            stops = stop if stops is None else stops.unionByName(stop)
            if repeats:
                kept = found.where(~F.col("source_key").isin(cut)).unionByName(
                    found.join(stop, ["source_order", "source_key", "page_no"], "left_semi"))
        if repeats:
            new = kept.select(*merge.PRODUCT)
            seen = stage_table((new if seen is None else seen.unionByName(new)).distinct(), "scan-seen")
    out = _flagged(rows, twice)
    free = out.withColumn("stopped_at_watermark", F.lit(False))
    if stops is not None:
        cut = F.col("source_key").isin(*marked)
        free = free.where(~cut).unionByName(out.where(cut).join(stops, ["source_order", "source_key", "page_no"]))
    return free if twice is None and stops is None else stage_table(free, "scan-records")


def _flagged(rows: DataFrame, twice: DataFrame | None) -> DataFrame:
    """Rows with ``duplicate``: whether their place is among `twice`."""
    if twice is None:
        return rows.withColumn("duplicate", F.lit(False))
    joined = rows.join(twice.select(*PLACE, F.lit(True).alias("_twice")),
                       [rows[c].eqNullSafe(twice[c]) if c in ("page_no", "pos") else rows[c] == twice[c] for c in PLACE], "left")
    return joined.select(*[rows[c] for c in rows.columns], F.coalesce("_twice", F.lit(False)).alias("duplicate"))


def run_scan(payloads: DataFrame, details: DataFrame, listings: DataFrame,
             observations: DataFrame, verdicts: DataFrame, watermarks: DataFrame,
             manual: DataFrame | None, runs: DataFrame, *, now, settings: Settings,
             inspect: Callable[[DataFrame], DataFrame] | None = None,
             judged: DataFrame | None = None) -> ScanResult:
    """One scan over all sources.

    ``payloads``: source_key, source_order, page_no, payload.  ``inspect`` may transform the
    ``payloads``: source_key, source_order, page_no, payload; ``judged`` are their `judged_pages`,
    if the caller has them.  ``inspect`` may transform the
  Rows whose verdict is missing fail closed
    and are returned in ``waiting`` for a later verdict run.
    """
    judged = judged_pages(payloads, settings) if judged is None else judged
    rows = accepted(judged)
    if settings.record_limit is not None:
        rows = changes.limit_per_source(rows, settings.record_limit)
    # What the sources keep is read by several outputs.
    rows = stage_table(changes.candidate_state(rows, listings, verdicts), "scan-candidates")
    rows = read_sources(rows, payloads, watermarks, settings.overlap_pages)

    todo = rows.where(~F.col("duplicate") & (F.col("state") != "unchanged"))
    # Joins move the columns a search has; the other columns of a listing are added after them.
    carried = todo.select("state", "previous_price").schema.fields
    base = conform(todo, StructType([f for f in LISTINGS.fields if f.name in todo.columns] + carried), LISTING_DEFAULTS)
    detailed = verdict_flow.overlay_detail(base, details)
    if inspect is not None:
        detailed = conform(detailed.drop("state", "previous_price"), LISTINGS, LISTING_DEFAULTS).transform(inspect)
        detailed = detailed.join(todo.select(*merge.PRODUCT, "state", "previous_price"), merge.PRODUCT)
    judged_rows = verdict_flow.cached_verdict(
        detailed, verdicts, settings.model, settings.effort, settings.classifier_version)
    extra = judged_rows.select("state", "previous_price", "classification_fingerprint", "verdict").schema.fields
    judged_rows = conform(judged_rows, StructType(LISTINGS.fields + extra), LISTING_DEFAULTS)
    usable = verdict_flow.apply_verdicts(judged_rows, settings.confidence_threshold)
    reliable = reliable_content()
    blocked = {c: F.when(reliable, F.col(c)).otherwise(v) for c, v in unreliable_columns().items()}
    usable = usable.withColumn("_waiting", reliable & F.col("verdict").isNull()).drop("verdict").withColumns(blocked)
    processed = stage_table(usable.withColumn("normalized_name", comparable_name()), "scan-processed")
    waiting = processed.where("_waiting").select(*merge.PRODUCT, "classification_fingerprint")
    processed = processed.drop("_waiting", "classification_fingerprint")

    stored = merge.merge_processed(listings, processed.drop("normalized_name"), now)
    wanted = changes.should_observe(processed, observations, "normalized_name")
    fresh = stage_table(merge.observe(wanted.where("should_observe"), stored, observations,
                                      "normalized_name", instant(now)), "scan-observations")
    evidence = observations.unionByName(fresh, allowMissingColumns=True)
    # One row a product, read by deals and by each review of them.
    estimates = stage_table(estimator.estimate_prices(
        evidence, manual, now=now, names=deals.reference_names(processed),
        **settings.estimation()), "scan-estimates")
    found = deals.find_deals(processed, estimates, settings.minimum_discount_percent,
                             tie_break="product_id")

    observed = fresh.select(*merge.PRODUCT, F.lit(True).alias("observed")).distinct()
    counted = rows.join(observed, merge.PRODUCT, "left").withColumn(
        "reject_reason", F.lit(None).cast("string"))
    rejected = judged.where(F.col("reject_reason").isNotNull()).select(
        "source_key", F.lit("").alias("state"), F.lit(False).alias("duplicate"),
        "reject_reason", F.lit(False).alias("observed"))
    counters = changes.scan_counters(counted.select(*rejected.columns).unionByName(rejected))

    marks = merge.merge_watermarks(watermarks, changes.high_watermarks(processed))
    moves = processed.select(change_percent(F.col("price"), F.col("previous_price"))
                             .alias("change_percent"))
    metrics = counters.agg(
        F.coalesce(F.sum("records_fetched"), F.lit(0)).alias("search_records"),
        F.coalesce(F.sum("price_observations"), F.lit(0)).alias("valid_observations"))
    failures = verdict_flow.failed_attempts(waiting, verdicts, settings.model, settings.effort, settings.classifier_version)
    unread = payloads.where(F.col("payload").isNotNull() & F.try_parse_json("payload").isNull())
    metrics = beside(metrics, quality.prior_valid_observations(runs), processed.agg(F.count("*").alias("ai_candidates")),
                     failures.agg(F.count("*").alias("ai_failures")), unread.agg(F.count("*").alias("parsing_anomalies")))
    return ScanResult(rows, processed, stored, fresh, waiting, estimates, found, counters, marks,
                      metrics, quality.assess_anomalies(moves, metrics), moves)


@dataclass(frozen=True)
class ScanReview:
    reviewed: DataFrame
    passed: DataFrame
    log: DataFrame
    totals: DataFrame


def review_scan(result: ScanResult, details: DataFrame, reviews: DataFrame, settings: Settings) -> ScanReview:
    """Second review of a scan's deals on their current details.

    ``passed`` is empty when the scan's anomaly calls for a halt; the review log is kept either way.
    """
    reviewed = verdict_flow.review_gate(
        result.deals, details, reviews, minimum_discount_percent=settings.minimum_discount_percent,
        threshold=settings.review_threshold, model=settings.model, effort=settings.effort)
    reviewed = stage_table(reviewed, "scan-reviewed")
    metrics = stage_table(result.metrics, "scan-metrics")
    totals = stage_table(beside(metrics, quality.assess_anomalies(result.moves, metrics)), "scan-totals")
    # One row: a scan either halts or it doesn't.
    halted = bool(totals.first()["safety_halt"])
    return ScanReview(reviewed, reviewed.where(F.col("passed") & ~F.lit(halted)),
                      verdict_flow.review_record(reviewed, settings.model, settings.effort), totals)


@dataclass(frozen=True)
class ScanClosed:
    sent: DataFrame
    listings: DataFrame
    delivery: DataFrame
    run: DataFrame


def close_scan(result: ScanResult, review: ScanReview, send: Callable[[DataFrame], None], *, now,
               channel: str = "email") -> ScanClosed:
    """Deliver what passed, mark it, and write the delivery's and the run's log rows.

    Deals that were notified before aren't sent again. ``send`` is called once, with a stored table, and
    only if there is something to send; an error of it is raised before any state changes. A halted scan
    sends nothing, and its run says so.
    """
    pending = merge.notification_candidates(review.passed, result.listings)
    columns = [c for c in pending.columns if c != "first_seen_at"]
    pending = stage_table(pending.select(*columns), "scan-pending")
    count = pending.count()
    listings = result.listings
    if count:
        send(pending)
        listings = merge.mark_notified(listings, pending, now)
    at = instant(now)
    delivery = pending.agg(F.count("*").alias("listing_count")).where("listing_count > 0").select(
        F.lit(channel).alias("channel"), at.alias("delivered_at"), "listing_count")
    run = review.totals.select(
        at.alias("completed_at"), F.lit("success").alias("status"), "search_records", "valid_observations", "ai_candidates",
        "ai_failures", "safety_halt", F.array_join("reasons", ",").alias("detail"))
    return ScanClosed(pending, listings, tables.delivery_rows(delivery)[0], tables.run_rows(run))
