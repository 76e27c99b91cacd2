"""Counts, run metrics, anomaly assessment and the operational status row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import instant
from ..schemas import JOB_STATES
from .ordered import beside, look_back, numbered

# Anomaly thresholds.
WARN_PERCENT, SEVERE_PERCENT, SEVERE_COUNT = 30, 60, 3


def listing_count(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count("*").alias("n"))


def counts_by_marketplace(listings: DataFrame) -> DataFrame:
    return listings.groupBy("marketplace").agg(F.count("*").alias("n"))


def queue_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per state; the four states are always present."""
    return (jobs.where(F.col("state").isin(*JOB_STATES))
            .agg(*[F.count_if(F.col("state") == s).alias(s) for s in JOB_STATES])
            .select(F.explode(F.array(*[
                F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in JOB_STATES]))
                .alias("row"))
            .select("row.state", "row.n"))


def retry_statistics(retries: DataFrame, query_key: str | None = None) -> DataFrame:
    rows = retries if query_key is None else retries.where(F.col("query_key") == query_key)
    return rows.groupBy("error_category").agg(
        F.count_if(~F.col("is_terminal")).alias("queued_count"),
        F.count_if("is_terminal").alias("terminal_count"), F.count("*").alias("total_count"))


def latest_pricing_update(observations: DataFrame) -> DataFrame:
    return observations.agg(F.max("observed_at").alias("recent_pricing_update"))


def recent_failures(verdicts: DataFrame, now, hours: int = 24) -> DataFrame:
    since = instant(now) - F.make_dt_interval(hours=F.lit(hours))
    return verdicts.agg(F.count_if(
        ~F.col("success") & (F.col("classified_at") >= since)).alias("recent_ai_failures"))


def last_delivery(deliveries: DataFrame, listings: DataFrame) -> DataFrame:
    """Newest delivery; without any, the listings sharing the newest notification time."""
    logged = deliveries.agg(F.max_by(
        F.struct("delivered_at", "listing_count", "channel"), "id").alias("_log"))
    marked = (listings.where(F.col("notified_at").isNotNull())
              .groupBy("notified_at").agg(F.count("*").alias("n"))
              .agg(F.max(F.struct(F.col("notified_at").alias("delivered_at"),
                                  F.col("n").alias("listing_count"),
                                  F.lit("email").alias("channel"))).alias("_mark")))
    both = beside(logged, marked)
    best = F.coalesce("_log", "_mark")
    return both.select(best.alias("_best")).where(F.col("_best").isNotNull()).select("_best.*")


def last_successful_run(runs: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*runs.columns), "id")
    return (runs.where(F.col("status") == "success").agg(newest.alias("_run"))
            .where(F.col("_run").isNotNull()).select("_run.*"))


def assess_anomalies(moves: DataFrame, metrics: DataFrame) -> DataFrame:
    """One decision row: price warnings, safety halt and the evidence behind it.

    ``moves`` has ``change_percent``; ``metrics`` is one row of run counters.  Price
    movement alone never halts: independent evidence of a broken run is needed too.
    """
    size = F.abs("change_percent")
    totals = moves.where(F.col("change_percent").isNotNull()).agg(
        F.count_if(size >= WARN_PERCENT).alias("price_warnings"),
        F.count_if(size >= SEVERE_PERCENT).alias("_severe"), F.count("*").alias("_moves"))
    evidence = F.array_compact(F.array(
        F.when(F.col("search_records") == 0, "search_results_zero"),
        F.when((F.col("prior_valid_observations") >= 10)
               & (F.col("valid_observations") * 2 < F.col("prior_valid_observations")),
               "valid_observations_collapsed"),
        F.when((F.col("ai_candidates") >= 10)
               & (F.try_divide(F.col("ai_failures"), F.col("ai_candidates")) >= 0.8),
               "abnormal_ai_failure_distribution"),
        F.when(F.col("parsing_anomalies") > 0, "parsing_or_schema_anomaly")))
    broad = ((F.col("_severe") >= SEVERE_COUNT)
             & (F.col("_severe") * 2 >= F.greatest(F.lit(1), F.col("_moves"))))
    return (beside(totals, metrics).withColumn("reasons", evidence)
            .select("price_warnings", (broad & (F.size("reasons") > 0)).alias("safety_halt"),
                    "reasons"))


def prior_valid_observations(runs: DataFrame) -> DataFrame:
    """Valid observations of the last successful run, for the collapse test."""
    return runs.where(F.col("status") == "success").agg(
        F.coalesce(F.max_by("valid_observations", "id"), F.lit(0))
        .alias("prior_valid_observations"))


def verdict_telemetry(verdicts: DataFrame) -> DataFrame:
    """Calls, failures, cache hits and seconds of verdict work."""
    called = ~F.coalesce(F.col("cached"), F.lit(False))
    seconds = F.sum(F.when(called, F.col("seconds")))
    calls = F.count_if(called)
    return verdicts.agg(
        calls.alias("calls"), F.count_if(called & ~F.col("success")).alias("failures"),
        F.count_if(~called).alias("cached"),
        F.coalesce(seconds, F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.try_divide(seconds, calls), F.lit(0.0)).alias("average_seconds"))


def status_summary(listings: DataFrame, runs: DataFrame, deliveries: DataFrame,
                   verdicts: DataFrame, observations: DataFrame, jobs: DataFrame,
                   now) -> DataFrame:
    """One operational status row, built from one-row aggregates."""
    per_market = (counts_by_marketplace(listings)
                  .agg(F.sort_array(F.collect_list(F.concat_ws(
                      "=", "marketplace", F.col("n").cast("string")))).alias("_counts"))
                  .select(F.coalesce(F.nullif(F.array_join("_counts", ","), F.lit("")),
                                     F.lit("none")).alias("listing_counts")))
    run = runs.where(F.col("status") == "success").agg(
        F.max_by("completed_at", "id").alias("last_successful_scan"))
    delivered = last_delivery(deliveries, listings).agg(
        F.max("delivered_at").alias("last_notification"),
        F.coalesce(F.max("listing_count"), F.lit(0)).alias("last_notification_count"))
    queue = jobs.agg(
        *[F.count_if(F.col("state") == s).alias(f"queue_{s}") for s in JOB_STATES],
        F.count_if(F.col("state").isin("pending", "retry")).alias("pending_ai"))
    return beside(per_market, run, delivered, queue, recent_failures(verdicts, now),
                  latest_pricing_update(observations))


def work_metrics(timings: DataFrame, keys: list[str], chunk: Column,
                 order: list[Column], frame_rows: int = 20) -> DataFrame:
    """Rolling mean of the last task durations and the time left for the queued work.

    ``timings``: duration ``seconds``, ``queue_size``, ``active_workers``, ``concurrency``.
    Negative durations are not samples.
    """
    rows = numbered(timings.where(F.col("seconds") >= 0), keys, chunk, order, "row_no")
    rows = look_back(rows, keys, "row_no", frame_rows - 1,
                     {"rolling_seconds": lambda w: F.avg("seconds").over(w)})
    pending = F.col("queue_size") + F.col("active_workers")
    left = F.try_divide(pending, F.col("concurrency")) * F.col("rolling_seconds")
    return rows.withColumn("remaining_seconds", F.when(F.col("concurrency") >= 1, left))


def crawl_remaining(samples: DataFrame, keys: list[str], chunk: Column,
                    order: list[Column], sample_rows: int = 8) -> DataFrame:
    """Time left of a crawl from the throughput over the last samples, or null.

    ``samples``: clock ``at_seconds``, ``units`` done, ``completed_queries`` and
    ``total_queries``; at least three samples and one finished query are needed.
    """
    rows = numbered(samples, keys, chunk, order, "row_no")
    rows = look_back(rows, keys, "row_no", sample_rows - 1, {
        "_t0": lambda w: F.first("at_seconds").over(w),
        "_u0": lambda w: F.first("units").over(w)})
    elapsed = F.col("at_seconds") - F.col("_t0")
    rate = F.when(elapsed > 0, F.try_divide(F.col("units") - F.col("_u0"), elapsed))
    todo = F.greatest(F.lit(0), F.col("total_queries") - F.col("completed_queries"))
    per_query = F.col("units") / F.greatest(F.lit(1), F.col("completed_queries"))
    ready = (F.col("row_no") >= 3) & (F.col("completed_queries") >= 1) & (rate > 0)
    return rows.withColumn(
        "remaining_seconds", F.when(ready, F.try_divide(todo * per_query, rate))
    ).drop("_t0", "_u0")
