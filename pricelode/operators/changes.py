"""Change detection over search records: state, duplicates, limits and early stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import comparison_value
from .ordered import cut_after_run, descending_check, latest_per_key, numbered

PRODUCT = ["marketplace", "product_id"]
PAGES_PER_CHUNK = 512


def page_chunk(pages: int = PAGES_PER_CHUNK) -> Column:
    """Chunk of a paged sequence: whole groups of pages, each of bounded size."""
    return F.floor(F.col("page_no") / F.lit(pages)).cast("bigint")


def with_known(candidates: DataFrame, listings: DataFrame) -> DataFrame:
    """Add ``known``: the listing id or the URL is stored (URL alone when there is no id).

    Two equality joins instead of one disjunctive join.
    """
    ids = (listings.where(F.col("listing_id").isNotNull()).select("listing_id").distinct()
           .withColumn("_id_hit", F.lit(True)))
    urls = (listings.where(F.col("url").isNotNull()).select("url").distinct()
            .withColumn("_url_hit", F.lit(True)))
    out = candidates.join(ids, "listing_id", "left").join(urls, "url", "left")
    known = F.coalesce(F.col("_id_hit"), F.lit(False)) | F.coalesce(F.col("_url_hit"),
                                                                    F.lit(False))
    return out.select(*candidates.columns, known.alias("known"))


def candidate_state(candidates: DataFrame, listings: DataFrame,
                    verdicts: DataFrame) -> DataFrame:
    """Add ``state`` (new / updated / pending_ai / unchanged) and ``previous_price``.

    Compares with the newest stored row per product and the newest verdict's success;
    both sides are reduced to one row per product before the join.
    """
    stored = latest_per_key(
        listings.where(F.col("product_id").isNotNull()), PRODUCT, "id",
        ["updated_at", "price", "search_fingerprint", "ai_is_computer_part"])
    stored_time = listings.schema["updated_at"].dataType
    seen_time = candidates.schema["updated_at"].dataType
    stored = stored.select(
        *PRODUCT, comparison_value(F.col("updated_at"), stored_time).alias("_was_updated"),
        F.col("price").alias("_was_price"), F.col("search_fingerprint").alias("_was_print"),
        F.col("ai_is_computer_part").alias("_was_part"), F.lit(True).alias("_stored"))
    last = latest_per_key(verdicts, PRODUCT, "id", ["success"]).withColumnRenamed(
        "success", "_success")
    # Only rows without a product id ask whether their listing id or URL is stored.
    named = candidates.where(F.col("product_id").isNotNull()).withColumn("known", F.lit(False))
    unnamed = with_known(candidates.where(F.col("product_id").isNull()), listings)
    rows = named.join(stored, PRODUCT, "left").join(last, PRODUCT, "left")
    rows = rows.unionByName(unnamed, allowMissingColumns=True)
    changed = ~(
        F.col("_was_updated").eqNullSafe(comparison_value(F.col("updated_at"), seen_time))
        & F.col("_was_price").eqNullSafe(F.col("price"))
        & F.col("_was_print").eqNullSafe(F.col("search_fingerprint")))
    state = (
        F.when(F.col("product_id").isNull(),
               F.when(F.col("known"), "unchanged").otherwise("new"))
        .when(F.col("_stored").isNull(), "new")
        .when(changed, "updated")
        .when(F.col("_was_part").isNull(), "pending_ai")
        .when(~F.col("_success"), "pending_ai")
        .otherwise("unchanged"))
    rows = rows.withColumn("state", state)
    return rows.select(
        *candidates.columns, "state",
        F.when(F.col("state").isin("updated", "pending_ai"), F.col("_was_price"))
        .alias("previous_price"))


def mark_duplicates(candidates: DataFrame, keys: Sequence[str],
                    order: Sequence[Column]) -> DataFrame:
    """Add ``duplicate``: an earlier row of the run has the same keys (null never does)."""
    rank = F.struct(*order)
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    firsts = (candidates.where(complete).groupBy(*keys).agg(F.min(rank).alias("_first")))
    out = candidates.join(firsts, list(keys), "left")
    later = F.coalesce(F.col("_first") < rank, F.lit(False))
    return out.select(*candidates.columns, later.alias("duplicate"))


def limit_per_source(candidates: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` records per source, duplicates counted."""
    rows = numbered(candidates, ["source_key"], page_chunk(), [F.col("page_no"), F.col("pos")], "_place")
    return rows.where(F.col("_place") <= cap).select(*candidates.columns)


def sample_records(candidates: DataFrame, size: int) -> DataFrame:
    """The first 30 to 50 records per source, across pages."""
    if not 30 <= size <= 50:
        raise ValueError("the sample size must be from 30 to 50")
    return limit_per_source(candidates, size)


def ordering_check(records: DataFrame) -> DataFrame:
    """Per source, whether records really come newest first, also across pages."""
    return descending_check(records, ["source_key"], page_chunk(),
                            [F.col("page_no"), F.col("pos")], "updated_at")


def stop_after_known(candidates: DataFrame, listings: DataFrame, threshold: int = 3,
                     newest_first: bool = True) -> DataFrame:
    """Records read before ``threshold`` known ones in a row end a newest-first source.

    A record already met earlier in the same source counts as known.  Adds ``known`` and
    ``stopped``.
    """
    if threshold < 1:
        raise ValueError("the threshold must be at least 1")
    order = [F.col("page_no"), F.col("pos")]
    rows = with_known(candidates, listings)
    for key in ("listing_id", "url"):
        rows = mark_duplicates(rows, ["source_key", key], order)
        rows = rows.withColumn("known", F.col("known") | F.col("duplicate")).drop("duplicate")
    if not newest_first:
        return rows.withColumn("stopped", F.lit(False))
    return cut_after_run(rows, ["source_key"], page_chunk(), order, "known", threshold)


def page_facts(records: DataFrame, watermarks: DataFrame) -> DataFrame:
    """One row per (source, page): old-and-unchanged flag and running order check.

    ``records`` carry ``state`` and ``duplicate``; duplicates are skipped by the page tests
    but still count for the ordering.
    """
    marks = watermarks.select("source_key", F.col("updated_at").alias("_mark"))
    rows = records.join(marks, "source_key", "left")
    counted = ~F.col("duplicate")
    old = (F.col("updated_at") < F.col("_mark")) & (F.col("state") == "unchanged")
    local = Window.partitionBy("source_key", "page_no").orderBy("pos")
    rows = rows.withColumn("_ok", F.coalesce(
        F.last("updated_at", ignorenulls=True).over(
            local.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("updated_at"),
        F.lit(True)))
    dated = F.when(F.col("updated_at").isNotNull(), F.col("pos"))
    pages = rows.groupBy("source_key", "page_no").agg(
        (F.max("_mark").isNotNull() & (F.count("*") > 0)
         & F.coalesce(F.bool_and(F.when(counted, F.coalesce(old, F.lit(False)))),
                      F.lit(True))).alias("all_old"),
        F.bool_and("_ok").alias("_ok"), F.min_by("updated_at", dated).alias("_first"),
        F.max_by("updated_at", dated).alias("_last"))
    by_source = Window.partitionBy("source_key").orderBy("page_no")
    earlier = by_source.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_last", ignorenulls=True).over(earlier)
    pages = pages.withColumn("_ok", F.col("_ok") & F.coalesce(before >= F.col("_first"),
                                                              F.lit(True)))
    upto = by_source.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.select("source_key", "page_no", "all_old",
                        F.bool_and("_ok").over(upto).alias("monotonic"))


def stop_at_watermark(records: DataFrame, watermarks: DataFrame, overlap_pages: int = 1,
                      pages_read: DataFrame | None = None) -> DataFrame:
    """Drop pages after more than ``overlap_pages`` consecutive old, unchanged pages.

    Works on one small row per page; a run reads a configured number of pages per source.
    ``pages_read`` (source_key, page_no) adds pages without a usable record, which end a run.
    """
    kept = pages_before_stop(records, watermarks, overlap_pages, pages_read)
    return records.join(kept, ["source_key", "page_no"])


def pages_before_stop(records: DataFrame, watermarks: DataFrame, overlap_pages: int = 1,
                      pages_read: DataFrame | None = None) -> DataFrame:
    """(source_key, page_no, stopped_at_watermark) of the pages that `stop_at_watermark` keeps."""
    pages = page_facts(records, watermarks)
    if pages_read is not None:
        pages = pages_read.select("source_key", "page_no").distinct().join(
            pages, ["source_key", "page_no"], "left")
    pages = pages.withColumn(
        "_boundary", F.coalesce(F.col("all_old") & F.col("monotonic"), F.lit(False)))
    kept = cut_after_run(pages, ["source_key"], page_chunk(), [F.col("page_no")], "_boundary",
                         overlap_pages + 1)
    return kept.select("source_key", "page_no", F.col("stopped").alias("stopped_at_watermark"))


def scan_counters(records: DataFrame) -> DataFrame:
    """Per-source counters of a scan; ``records`` carry state, duplicate and reject marks."""
    counted = ~F.col("duplicate") & F.col("reject_reason").isNull()

    def states(name: str) -> Column:
        return F.count_if(counted & (F.col("state") == name))

    return records.groupBy("source_key").agg(
        F.count("*").alias("records_fetched"),
        states("new").alias("new_count"), states("updated").alias("updated_count"),
        states("pending_ai").alias("pending_ai_count"),
        states("unchanged").alias("unchanged_count"),
        F.count_if(F.col("duplicate") & F.col("reject_reason").isNull())
        .alias("duplicate_count"),
        F.count_if(F.col("reject_reason") == "over_budget").alias("over_budget_count"),
        F.count_if(F.col("reject_reason") == "irrelevant").alias("irrelevant_count"),
        F.count_if(counted & F.coalesce(F.col("observed"), F.lit(False)))
        .alias("price_observations"))


def scan_totals(counters: DataFrame) -> DataFrame:
    names = [c for c in counters.columns if c != "source_key"]
    return counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def high_watermarks(processed: DataFrame) -> DataFrame:
    """Newest update time per source among successfully processed rows."""
    return (processed.where(F.col("updated_at").isNotNull())
            .groupBy("marketplace", "source_key")
            .agg(F.date_trunc("second", F.max("updated_at")).alias("updated_at")))


def should_observe(processed: DataFrame, observations: DataFrame, name: str) -> DataFrame:
    """Add ``should_observe``: new, price moved, or never observed under that product."""
    seen = (observations.select(*PRODUCT, F.col("normalized_product_name").alias(name))
            .distinct().withColumn("_seen", F.lit(True)))
    rows = processed.join(seen, [*PRODUCT, name], "left")
    moved = ~F.col("previous_price").eqNullSafe(F.col("price"))
    wanted = (F.col(name).isNotNull() & F.col("product_id").isNotNull()
              & ((F.col("state") == "new") | moved | F.col("_seen").isNull()))
    return rows.select(*processed.columns, wanted.alias("should_observe"))
