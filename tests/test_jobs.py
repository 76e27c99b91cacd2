import dataclasses
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricelode.catalog.common import TEXTS  # noqa: F401
from pricelode.catalog import scans
from pricelode.functions.prints import classification_fingerprint, review_fingerprint
from pricelode.operators import deals, lifecycle, merge
from pricelode.plans import jobs, scan
from pricelode.plans.settings import Settings
from pricelode.schemas import (
    LISTING_DEFAULTS, LISTINGS, OBSERVATIONS, RETRIES, RUNS, VERDICT_LOG, conform, table_schema)

NOW = "2026-01-10T00:00:00Z"
AT = dt.datetime(2026, 1, 9)
SETTINGS = Settings(minimum_observations=1, model="m", effort="e", classifier_version="v",
                    maximum_price=1_000_000)


def _listings(spark, rows):
    names = sorted({k for r in rows for k in r} | {"id"})
    base = spark.createDataFrame([{n: r.get(n) for n in names} for r in rows],
                                 ", ".join(f"{n} {LISTINGS[n].dataType.simpleString()}"
                                           for n in names))
    return conform(base, LISTINGS, LISTING_DEFAULTS)


def _listing(i, **more):
    return dict({"id": i, "marketplace": "bunjang", "product_id": str(i),
                 "listing_id": f"bunjang:{i}", "url": f"u{i}", "title": "RTX 3070",
                 "description": "정상 작동 RTX 3070", "price": 300_000, "source_type":
                 "bunjang_search", "updated_at": AT, "first_seen_at": AT}, **more)


def _verdict_log(spark, rows):
    """A successful verdict for each (listing, effective price), keyed by its content."""
    facts = rows.select(
        "id", "marketplace", "product_id", classification_fingerprint().alias(
            "classification_fingerprint"), F.lit("m").alias("model"),
        F.lit("e").alias("reasoning_effort"), F.lit("v").alias("classifier_version"),
        F.lit(True).alias("success"), F.lit(True).alias("is_computer_part"),
        F.lit("RTX 3070").alias("normalized_product_name"),
        F.lit("normal").alias("condition_status"), F.lit("standalone").alias("scope"),
        F.lit("active").alias("sale_status"), F.lit(True).alias("exact_product"),
        F.col("price").alias("displayed_price"), F.col("price").alias("effective_price"),
        F.lit("both").alias("price_source"), F.lit(0.95).alias("price_confidence"),
        F.lit(True).alias("usable_price"), F.lit(0.95).alias("confidence"),
        F.lit("fine").alias("reason"), F.lit(False).alias("model_mismatch"),
        F.lit(False).alias("price_bait"), F.lit(False).alias("hidden_price_condition"))
    return conform(facts, VERDICT_LOG)


def _payload(records):
    body = {"data": {"responses": {"mainGrid": {"searchResponse": {"data": [
        {"type": "PRODUCT", "status": "SELLING", "pid": i, "name": "RTX 3070", "price": p,
         "updatedAt": u} for i, p, u in records]}}}}}
    return json.dumps(body)


def test_scan_end_to_end(spark):
    pages = [("a", 0, 0, _payload([(1, 200_000, "2026-01-09T02:00:00Z"),
                                   (2, 310_000, "2026-01-09T01:00:00Z"),
                                   (9, 5_000_000, "2026-01-09T01:00:00Z")])),
             ("b", 1, 0, _payload([(1, 200_000, "2026-01-09T02:00:00Z")]))]
    payloads = spark.createDataFrame(pages, "source_key string, source_order int, "
                                            "page_no bigint, payload string")
    details = spark.createDataFrame(
        [("1", "RTX 3070", "정상 작동 RTX 3070", 200_000, "SELLING", None),
         ("2", "RTX 3070", "정상 작동 RTX 3070", 310_000, "SELLING", None)],
        "product_id string, name string, description string, price bigint, saleStatus string, "
        "status string")
    empty = spark.createDataFrame([], LISTINGS)
    marks = spark.createDataFrame([], table_schema(
        "marketplace string, source_key string, updated_at timestamp"))
    manual = spark.createDataFrame([("RTX 3070", 400_000)],
                                   "normalized_product_name string, price bigint")
    none = spark.createDataFrame([], OBSERVATIONS)
    runs = spark.createDataFrame([], RUNS)

    first = scan.run_scan(payloads, details, empty, none, spark.createDataFrame([], VERDICT_LOG),
                          marks, manual, runs, now=NOW, settings=SETTINGS)
    assert {r["product_id"] for r in first.waiting.collect()} == {"1", "2"}
    assert first.deals.count() == 0 and first.new_observations.count() == 0
    counters = {r["source_key"]: r for r in first.counters.collect()}
    assert counters["a"]["new_count"] == 2 and counters["a"]["over_budget_count"] == 1
    assert counters["b"]["duplicate_count"] == 1
    assert {r["ai_reject"] for r in first.listings.collect()} == {True}

    judged = first.processed.withColumn("id", F.col("product_id").cast("bigint"))
    second = scan.run_scan(payloads, details, empty, none, _verdict_log(spark, judged), marks,
                           manual, runs, now=NOW, settings=SETTINGS)
    assert second.waiting.count() == 0
    assert second.new_observations.count() == 2
    assert [r["effective_price"] for r in second.deals.collect()] == []
    estimate = second.estimates.first()
    assert (estimate["price"], estimate["valid_observation_count"]) == (200_000, 2)
    assert {r["source_key"] for r in second.watermarks.collect()} == {"a"}
    assert second.anomaly.first()["safety_halt"] is False

    stored = second.listings.withColumn("id", F.col("product_id").cast("bigint"))
    third = scan.run_scan(payloads, details, stored, none, _verdict_log(spark, judged), marks,
                          manual, runs, now=NOW, settings=SETTINGS)
    assert third.processed.count() == 0


def _deal_scan(spark, halting):
    """A scan with one deal among six verdicts, whose stored prices were far higher if it must halt."""
    records = [(i, 200_000 if i == 1 else 300_000, "2026-01-09T02:00:00Z") for i in range(1, 7)]
    payloads = spark.createDataFrame([("a", 0, 0, _payload(records))], "source_key string, source_order int, "
                                                                       "page_no bigint, payload string")
    details = spark.createDataFrame([(str(i), "RTX 3070", "정상 작동 RTX 3070", p, "SELLING", None) for i, p, _ in records],
                                    "product_id string, name string, description string, price bigint, saleStatus string, status string")
    stored = _listings(spark, [_listing(i, price=4 * p, ai_is_computer_part=True) for i, p, _ in records]) if halting \
        else spark.createDataFrame([], LISTINGS)
    runs = spark.createDataFrame([(1, AT, "success", 9, 100, 9, 0, False, "")], RUNS)
    runs = runs if halting else runs.limit(0)
    tables = (spark.createDataFrame([], OBSERVATIONS), spark.createDataFrame([], VERDICT_LOG),
              spark.createDataFrame([], table_schema("marketplace string, source_key string, updated_at timestamp")))
    options = dict(now=NOW, settings=SETTINGS)
    first = scan.run_scan(payloads, details, stored, tables[0], tables[1], tables[2], None, runs, **options)
    log = _verdict_log(spark, first.processed.withColumn("id", F.col("product_id").cast("bigint")))
    return scan.run_scan(payloads, details, stored, tables[0], log, tables[2], None, runs, **options), details


@pytest.mark.parametrize("halting", [False, True])
def test_scan_ends_in_halt_review_and_once_only_delivery(spark, halting):
    result, details = _deal_scan(spark, halting)
    reviews = scans.second_verdicts(result.deals.withColumn("product_id", F.lit("4"))).withColumn("product_id", F.lit("1"))
    reviews = reviews.withColumn("review_fingerprint", F.lit(result.deals.select(review_fingerprint()).first()[0]))
    reviews = reviews.withColumns({"model": F.lit("m"), "reasoning_effort": F.lit("e")})
    review = scan.review_scan(result, details, reviews, SETTINGS)
    assert [(r.product_id, r.review_status) for r in review.reviewed.collect()] == [("1", "approved")]
    assert review.log.first()["success"] is True
    assert review.passed.count() == (0 if halting else 1)
    sent = []

    def broken(rows):
        raise OSError("down")

    if not halting:
        with pytest.raises(OSError):
            scan.close_scan(result, review, broken, now=NOW)
    closed = scan.close_scan(result, review, lambda rows: sent.append([r.product_id for r in rows.collect()]), now=NOW)
    assert sent == ([] if halting else [["1"]])
    assert closed.listings.where("notified_at IS NOT NULL").count() == len(sent) == closed.delivery.count()
    run = closed.run.first()
    assert (run.safety_halt, run.detail, run.search_records) == (halting, "valid_observations_collapsed" if halting else "", 6)
    again = scan.close_scan(dataclasses.replace(result, listings=closed.listings), review, sent.append, now=NOW)
    assert again.sent.count() == 0 and len(sent) == (0 if halting else 1)


def test_unnamed_rows_are_dealt_out_and_keep_no_price(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "id int, name string")
    facts = spark.createDataFrame([("a", 5), (None, 6)], "n string, price int")
    got = {r.id: (r.name, r.price) for r in deals.left_join_named(rows, facts, "name", "n").collect()}
    assert got == {1: ("a", 5), 2: (None, None), 3: (None, None), 4: ("b", None)}


def test_price_drop_reopens_and_rise_does_not(spark):
    stored = _listings(spark, [_listing(1, notified_at=AT), _listing(2, notified_at=AT)])
    new = stored.withColumns({
        "state": F.lit("updated"), "previous_price": F.col("price"),
        "price": F.when(F.col("id") == 1, 250_000).otherwise(350_000)})
    got = {r["id"]: r["notified_at"] for r in merge.merge_processed(stored, new, NOW).collect()}
    assert got == {1: None, 2: AT}


def test_sale_is_recorded_once(spark):
    stored = _listings(spark, [_listing(1, price=150_000, last_active_price=150_000,
                                        last_active_at=AT, ai_scope="standalone",
                                        condition_status="normal", ai_is_computer_part=True,
                                        ai_normalized_product_name="RTX 3070")])
    due = jobs.due_checks(stored, now="2026-02-10T00:00:00Z", settings=SETTINGS)
    details = spark.createDataFrame(
        [("1", "t", "d", 120_000, "SOLD", None)], "product_id string, name string, "
        "description string, price bigint, saleStatus string, status string")
    out = jobs.apply_checks(stored, due, details, now="2026-02-10T00:00:00Z")
    row = out.first()
    assert (row["listing_status"], row["became_sold"], row["price"], row["last_active_price"]) == (
        "sold", True, 150_000, 150_000)
    again = merge.merge_checks(out.drop("became_sold"), out, "2026-03-01T00:00:00Z").first()
    assert again["became_sold"] is False
    assert again["first_sold_seen_at"] == row["first_sold_seen_at"]


def test_unreadable_time_is_due_at_once(spark):
    rows = _listings(spark, [_listing(1, ai_scope="standalone", condition_status="normal",
                                      ai_is_computer_part=True,
                                      ai_normalized_product_name="x")])
    rows = rows.withColumn("first_seen_at", F.lit("soon"))
    assert lifecycle.due_rechecks(rows, lifecycle.RecheckTiers(), NOW).count() == 1


def test_audit_keeps_only_the_part(spark):
    stored = _listings(spark, [
        _listing(1), _listing(2, title="RTX 3070 세트"), _listing(3, title="RTX 3070 본체"),
        _listing(4, listing_status="sold")])
    obs = conform(stored.select(
        "id", "marketplace", "product_id", F.lit("RTX 3070").alias("normalized_product_name"),
        F.col("price").alias("observed_price"), F.col("updated_at").alias("observed_at"),
        F.lit(True).alias("valid")), OBSERVATIONS)
    audited = merge.audit_contamination(obs, stored, spark.createDataFrame([], VERDICT_LOG), "v")
    got = {r["id"]: r["valid"] for r in audited.collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert tuple(merge.audit_counts(audited).first()) == (4, 3)
    scopes = {r["id"]: r["ai_scope"] for r in merge.rescope_listings(stored, audited).collect()}
    assert scopes == {1: "standalone", 2: "bundle", 3: "complete_pc", 4: "standalone"}


def test_backfill_is_repeatable(spark):
    stored = spark.createDataFrame([], LISTINGS)
    rows = _listings(spark, [_listing(1), _listing(2), _listing(3)]).withColumns(
        {"page_no": F.lit(0), "pos": F.col("id")})
    details = rows.where("id < 3").select(
        "product_id", F.col("title").alias("name"), "description", "price",
        F.lit("SELLING").alias("saleStatus"), F.lit(None).cast("string").alias("status"))
    failures = rows.where("id = 3").select(
        "marketplace", "product_id", F.lit("q").alias("query_key"), "title", "price", "url",
        F.lit(404).alias("http_status"), F.lit("HTTPError").alias("exception_type"),
        F.lit(0).alias("retry_count"), F.lit("gone").alias("message"),
        F.lit(1).alias("failed_at"))
    log = _verdict_log(spark, rows)
    none = spark.createDataFrame([], OBSERVATIONS)
    seen = spark.createDataFrame([], table_schema("marketplace string, product_id string"))
    queue = spark.createDataFrame([], RETRIES)
    out = jobs.backfill(rows, details, failures, stored, none, log, seen, queue, now=NOW,
                        settings=SETTINGS)
    assert out.new_observations.count() == 2
    assert {r["product_id"] for r in out.seen.collect()} == {"1", "2", "3"}
    assert {r["product_id"]: r["listing_status"] for r in out.listings.collect()} == {
        "1": "active", "2": "active", "3": "unavailable"}
    retry = out.retries.first()
    assert (retry["is_terminal"], retry["error_category"]) == (True, "404_or_unavailable")
    again = jobs.backfill(rows, details, failures.limit(0), out.listings, out.new_observations
                          .withColumn("id", F.lit(1)), log, out.seen, out.retries, now=NOW,
                          settings=SETTINGS)
    assert again.new_observations.count() == 0


def test_repair_rebuilds_observations(spark):
    key = "all-market-price-backfill:x"
    stored = _listings(spark, [
        _listing(1, source_key=key), _listing(2, source_key=key, description=""),
        _listing(3, source_key=key, title="RTX 3070 노트북"), _listing(4)])
    old = conform(stored.where("id = 3").select(
        "id", "marketplace", "product_id", F.lit("RTX 3070").alias("normalized_product_name"),
        F.col("price").alias("observed_price"), F.col("updated_at").alias("observed_at"),
        F.lit(True).alias("valid")), OBSERVATIONS)
    out = jobs.repair(stored, old, spark.createDataFrame([], VERDICT_LOG), settings=SETTINGS)
    assert {r["product_id"]: r["valid"] for r in out.observations.collect()} == {
        "1": True, "3": False}
    summary = out.summary.first()
    assert (summary["reviewed"], summary["accepts"], summary["rejects"],
            summary["history_rows"]) == (3, 1, 2, 1)


def test_backlog_digest(spark):
    good = dict(ai_scope="standalone", condition_status="normal", ai_is_computer_part=True,
                ai_normalized_product_name="RTX 3070", ai_confidence=0.95, ai_reject=False,
                ai_usable_for_market_price=True, ai_usable_price=True)
    stored = _listings(spark, [
        _listing(1, effective_price=300_000, **good), _listing(2, effective_price=390_000,
                                                               price=390_000, **good),
        _listing(3), _listing(4, effective_price=300_000, **good)])
    details = stored.where("id <> 4").select(
        "product_id", F.col("title").alias("name"), "description", "price",
        F.lit("SELLING").alias("saleStatus"), F.lit(None).cast("string").alias("status"))
    manual = spark.createDataFrame([("RTX 3070", 400_000)],
                                   "normalized_product_name string, price bigint")
    out = jobs.backlog_digest(stored, details, spark.createDataFrame([], OBSERVATIONS), manual,
                              _verdict_log(spark, stored), now=NOW, settings=SETTINGS)
    assert [r["product_id"] for r in out.deals.collect()] == ["1"]
    assert {r["gate"]: r["n"] for r in out.rejected.collect()} == {
        "stored_first_stage_ineligible": 1, "stored_below_discount_threshold": 1,
        "current_detail_request_failed": 1}


def test_delivery_marks_only_after_success(spark):
    stored = _listings(spark, [_listing(1, ai_scope="standalone"), _listing(2, notified_at=AT)])
    sent = []

    def broken(rows):
        raise OSError("down")

    with pytest.raises(OSError):
        jobs.deliver(stored, stored, broken, NOW)
    out = jobs.deliver(stored, stored, lambda rows: sent.append(rows.count()), NOW)
    assert sent == [1]
    assert out.where("notified_at is null").count() == 0
    assert jobs.deliver(stored, out, lambda rows: sent.append(rows.count()), NOW) is None
