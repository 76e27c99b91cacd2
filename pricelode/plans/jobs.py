"""Backfill, repair, status tracking, backlog digest and review jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import discount_percent
from ..functions.text import is_pricing_identity, product_name
from ..functions.times import instant
from ..functions.verdicts import backlog_candidate, exclusion_reason
from ..operators import changes, deals, estimator, lifecycle, merge, quality, verdict_flow
from ..operators.ordered import beside
from ..session import stage_table
from .settings import Settings

NAME = estimator.NAME


@dataclass(frozen=True)
class BackfillResult:
    listings: DataFrame
    new_observations: DataFrame
    exclusions: DataFrame
    seen: DataFrame
    retries: DataFrame


def backfill(candidates: DataFrame, details: DataFrame, failures: DataFrame, listings: DataFrame,
             observations: DataFrame, verdicts: DataFrame, seen: DataFrame, retries: DataFrame,
             *, now, settings: Settings) -> BackfillResult:
    """Process every unseen candidate once, without touching notification state.

    Failed details are folded into the retry queue; permanent ones mark the listing
    unavailable and count as seen.  Re-running with the returned tables changes nothing.
    """
    rows = changes.mark_duplicates(candidates, merge.PRODUCT,
                                   [F.col("source_key"), F.col("page_no"), F.col("pos")])
    rows = merge.unseen(rows.where(~F.col("duplicate")).drop("duplicate"), seen, retries)
    detailed = verdict_flow.overlay_detail(rows, details)
    judged = verdict_flow.apply_verdicts(verdict_flow.cached_verdict(
        detailed, verdicts, settings.model, settings.effort, settings.classifier_version),
        settings.confidence_threshold)
    judged = stage_table(judged.drop("verdict", "classification_fingerprint"), "backfill")
    stored = merge.merge_backfill(listings, judged, now)
    reason = exclusion_reason(settings.confidence_threshold)
    marked = judged.withColumn("reason", reason)
    good = merge.already_observed(marked.where(F.col("reason").isNull()), observations,
                                  "ai_normalized_product_name").where(~F.col("observed"))
    fresh = merge.observe(good, stored, observations, "ai_normalized_product_name", instant(now))
    broken = merge.categorised(failures)
    final = broken.where("is_terminal")
    stored = merge.mark_unavailable(stored, final, now)
    queue = merge.clear_retries(merge.fold_retries(retries, failures, now), judged)
    done = judged.select(*merge.PRODUCT).unionByName(final.select(*merge.PRODUCT)).distinct()
    new_seen = done.join(seen.select(*merge.PRODUCT), merge.PRODUCT, "left_anti")
    return BackfillResult(stored, fresh, marked.where(F.col("reason").isNotNull()),
                          seen.select(*merge.PRODUCT).unionByName(new_seen), queue)


def backfill_report(observations: DataFrame, manual: DataFrame | None, excluded: DataFrame,
                    *, now, settings: Settings) -> dict[str, DataFrame]:
    """Per-product price evidence: estimate, both estimators, exclusions per reason."""
    return {
        "estimates": estimator.estimate_prices(observations, manual, now=now,
                                               **settings.estimation()),
        "both": estimator.estimate_both(observations, now=now,
                                        window_days=settings.window_days,
                                        half_life_days=settings.half_life_days),
        "excluded": verdict_flow.reason_counts(excluded),
    }


def configured_estimates(queries: DataFrame, observations: DataFrame, manual: DataFrame | None,
                         *, now, settings: Settings) -> DataFrame:
    """Estimates of the priceable products named by a table of search queries."""
    named = queries.select(product_name(F.col("query")).alias(NAME))
    named = named.where(is_pricing_identity(F.col(NAME))).distinct()
    return estimator.estimate_prices(observations, manual, now=now, names=named,
                                     **settings.estimation())


@dataclass(frozen=True)
class RepairResult:
    listings: DataFrame
    observations: DataFrame
    history: DataFrame
    summary: DataFrame


def repair(listings: DataFrame, observations: DataFrame, verdicts: DataFrame, *, settings: Settings,
           prefix: str = "all-market-price-backfill:") -> RepairResult:
    """Re-judge stored backfill rows, then rebuild all observations and the history."""
    todo = listings.where(F.col("source_key").startswith(prefix))
    repaired = stage_table(verdict_flow.repair_listings(
        todo, verdicts, threshold=settings.confidence_threshold, model=settings.model,
        effort=settings.effort, version=settings.classifier_version), "repair")
    stored = merge.merge_repair(listings, repaired)
    rebuilt = merge.rebuild_observations(
        observations, stored.where(F.col("source_key").startswith(prefix)),
        settings.confidence_threshold)
    rows = merge.history(rebuilt)
    summary = beside(verdict_flow.repair_summary(repaired),
                     rows.agg(F.count("*").alias("history_rows")))
    return RepairResult(stored, rebuilt, rows, summary)


def due_checks(listings: DataFrame, *, now, settings: Settings,
               limit: int | None = None) -> DataFrame:
    return lifecycle.due_rechecks(listings, settings.tiers, now, limit)


def apply_checks(listings: DataFrame, due: DataFrame, details: DataFrame, *, now) -> DataFrame:
    """Checked listings with ``became_sold``; listings without a detail stay as they are."""
    checks = verdict_flow.overlay_detail(due, details)
    return merge.merge_checks(listings, checks, now)


@dataclass(frozen=True)
class BacklogResult:
    deals: DataFrame
    rejected: DataFrame
    listings: DataFrame


def backlog_digest(listings: DataFrame, details: DataFrame, observations: DataFrame,
                   manual: DataFrame | None, verdicts: DataFrame, *, now,
                   settings: Settings) -> BacklogResult:
    """Stored, never-notified bargains re-checked on current content, with a tally per gate."""
    everything = merge.backlog_listings(listings)
    ok = backlog_candidate(settings.confidence_threshold)
    marked = everything.withColumn("_ok", ok)
    names = marked.where("_ok").select(F.col("ai_normalized_product_name").alias(NAME))
    estimates = stage_table(estimator.estimate_prices(
        observations, manual, now=now, names=names, **settings.estimation()), "backlog-prices")
    priced = deals.left_join_named(marked, estimates.select(NAME, F.col("price").alias("_reference")),
                                   "ai_normalized_product_name", NAME)
    base = F.coalesce(F.nullif("effective_price", F.lit(0)), "price")
    gate = (F.when(~F.col("_ok"), "stored_first_stage_ineligible")
            .when(F.col("_reference").isNull(), "no_trusted_reference_price")
            .when(discount_percent(base, F.col("_reference"))
                  < settings.minimum_discount_percent, "stored_below_discount_threshold"))
    first = priced.withColumn("gate", gate)
    survivors = first.where(F.col("gate").isNull()).select(*listings.columns)
    fetched = stage_table(verdict_flow.overlay_detail(survivors, details), "backlog-current")
    missing = survivors.join(fetched, merge.PRODUCT, "left_anti").select(
        F.lit("current_detail_request_failed").alias("gate"))
    gone = fetched.where(F.col("listing_status") != "active")
    judged = verdict_flow.apply_verdicts(verdict_flow.cached_verdict(
        fetched.where(F.col("listing_status") == "active"), verdicts, settings.model,
        settings.effort, settings.classifier_version), settings.confidence_threshold)
    gated = verdict_flow.backlog_gates(judged.select(*fetched.columns),
                                       settings.confidence_threshold)
    passed = gated.where(F.col("gate").isNull()).drop("gate")
    found = deals.find_deals(passed, estimates, settings.minimum_discount_percent)
    below = passed.join(found.select(*merge.PRODUCT), merge.PRODUCT, "left_anti").select(
        F.lit("below_discount_threshold").alias("gate"))
    tally = (first.where(F.col("gate").isNotNull()).select("gate").unionByName(missing)
             .unionByName(gone.select(F.lit("current_not_active").alias("gate")))
             .unionByName(gated.where(F.col("gate").isNotNull()).select("gate"))
             .unionByName(below))
    stored = merge.merge_backlog(
        listings, gone.select(*listings.columns).unionByName(
            gated.select(*listings.columns)), now)
    return BacklogResult(found, verdict_flow.reason_counts(tally, "gate"), stored)


def deliver(candidates: DataFrame, listings: DataFrame, send: Callable[[DataFrame], None],
            now) -> DataFrame | None:
    """Send the not yet notified deals once; listings are marked only after delivery.

    Returns the next listings table, or None when nothing was pending.  An error of ``send``
    is raised before any state changes.
    """
    pending = stage_table(merge.notification_candidates(candidates, listings), "pending")
    if pending.isEmpty():
        return None
    send(pending)
    return merge.mark_notified(listings, pending, now)


def status_report(listings: DataFrame, runs: DataFrame, deliveries: DataFrame,
                  verdicts: DataFrame, observations: DataFrame, jobs: DataFrame, *,
                  now) -> DataFrame:
    return quality.status_summary(listings, runs, deliveries, verdicts, observations, jobs, now)
