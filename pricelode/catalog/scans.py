"""Whole jobs over the given tables: a scan with its review and delivery, checks, repair, readers and logs."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions.prints import classification_fingerprint, review_fingerprint
from ..operators import changes, verdict_flow
from ..operators.estimator import NAME
from ..plans import jobs, scan
from ..plans.settings import Settings
from ..schemas import LISTING_DEFAULTS, LISTINGS, OBSERVATIONS, RUNS, VERDICT_LOG, conform, table_schema
from ..session import fresh_path, stage_table
from ..sources import search, tables
from . import common as c
from . import maintenance

NOW = "2024-02-01T00:00:00Z"
SETTINGS = Settings(model="m", effort="e", classifier_version="v", record_limit=None)
SOURCES = 3
TITLES = ("RTX 3070", "RTX 3060 Ti")


def _mod(n: int):
    return F.pmod("record_no", F.lit(n))


def _price():
    return F.floor(F.col("value") * 1000).cast("bigint") + 1


def _records(spark, sf_dir):
    e = c.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("record_no"), F.col("event_id").cast("string").alias("product_id"), "value", "event_type",
                    F.col("ts").cast("timestamp").alias("ts"),
                    F.when(F.pmod("event_id", F.lit(2)) == 0, TITLES[0]).otherwise(TITLES[1]).alias("title"))


def payloads(spark, sf_dir):
    """Search pages of sixty records each, dealt to three sources; purchases are sold, errors are advertisements.

    Ids are text: a payload's number 0 is no id, and record 0 has one.
    """
    record = F.struct(
        F.lit("PRODUCT").alias("type"), (F.col("event_type") == "error").alias("ad"), F.col("product_id").alias("pid"),
        F.col("title").alias("name"), _price().cast("string").alias("price"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"),
        F.when(F.col("event_type") == "purchase", "SOLD_OUT").otherwise("SELLING").alias("status"))
    page = F.floor(F.col("record_no") / F.lit(60)).cast("bigint")
    # A page holds at most sixty records, so each collected list is small by construction.
    pages = _records(spark, sf_dir).groupBy(page.alias("page_no")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("ts").alias("at"), record.alias("r"))), asc=False).alias("rs"))
    body = F.struct(F.struct(F.struct(F.struct(F.struct(F.transform("rs", lambda x: x["r"]).alias("data")).alias("searchResponse"))
                                               .alias("mainGrid")).alias("responses")).alias("data"))
    source = F.pmod("page_no", F.lit(SOURCES))
    return pages.select(F.concat(F.lit("q"), source.cast("string")).alias("source_key"), source.cast("int").alias("source_order"),
                        "page_no", F.to_json(body).alias("payload"))


def details(spark, sf_dir):
    """Current details of all records but every eleventh."""
    rows = _records(spark, sf_dir).where(_mod(11) != 3)
    return rows.select("product_id", F.col("title").alias("name"), F.concat(F.lit("정상 작동 "), "title").alias("description"),
                       _price().alias("price"), F.when(F.col("event_type") == "purchase", "SOLD_OUT").otherwise("SELLING")
                       .alias("saleStatus"), F.lit(None).cast("string").alias("status"))


def verdicts(spark, sf_dir, judged, found, failing: int):
    """A verdict on the content of every detailed record; so many in ten attempts failed, some are unsure."""
    base = conform(scan.accepted(judged), LISTINGS, LISTING_DEFAULTS)
    seen = verdict_flow.overlay_detail(base, found).withColumn("record_no", F.col("product_id").cast("bigint"))
    ok = _mod(10) >= failing
    facts = {
        "id": F.col("record_no"), "classification_fingerprint": classification_fingerprint(), "model": F.lit("m"),
        "reasoning_effort": F.lit("e"), "classifier_version": F.lit("v"), "success": ok, "is_computer_part": F.lit(True),
        "normalized_product_name": F.col("title"), "condition_status": F.lit("normal"), "scope": F.lit("standalone"),
        "sale_status": F.lit("active"), "exact_product": F.lit(True), "displayed_price": F.col("price"),
        "effective_price": F.col("price"), "price_source": F.lit("both"), "price_confidence": F.lit(0.95),
        "usable_price": F.lit(True), "confidence": F.when(_mod(13) == 5, F.lit(0.5)).otherwise(F.lit(0.95)),
        "reason": F.lit("fine"), "model_mismatch": F.lit(False), "price_bait": F.lit(False), "hidden_price_condition": F.lit(False)}
    return conform(seen.select("marketplace", "product_id", *(v.alias(k) for k, v in facts.items())), VERDICT_LOG)


def second_verdicts(deals):
    """A second verdict on every deal; one in four finds the price unusable, some can't be read."""
    rows = deals.withColumn("record_no", F.col("product_id").cast("bigint"))
    facts = {
        "exact_product": F.lit(True), "normalized_product_name": F.col("normalized_name"), "scope": F.lit("standalone"),
        "condition": F.lit("normal"), "sale_status": F.lit("active"), "model_mismatch": F.lit(False), "displayed_price": F.col("price"),
        "effective_price": F.col("effective_price"), "price_bait": F.lit(False), "hidden_price_condition": F.lit(False),
        "usable_price": _mod(4) != 1, "price_confidence": F.lit(0.95), "confidence": F.lit(0.95), "reason": F.lit("looks fine")}
    body = F.to_json(F.struct(*[x.alias(k) for k, x in facts.items()]), {"ignoreNullFields": "false"})
    return rows.select(F.col("record_no").alias("id"), "marketplace", "product_id", review_fingerprint().alias("review_fingerprint"),
                       F.lit("m").alias("model"), F.lit("e").alias("reasoning_effort"), F.lit(True).alias("success"),
                       F.when(_mod(9) == 7, F.lit("{}")).otherwise(body).alias("verdict_json"))


def _scanned(spark, sf_dir, halting: bool):
    """(result, details, log of sent tables) of one scan; a halting one finds all prices fallen and most attempts failed."""
    pages = stage_table(payloads(spark, sf_dir), "payloads")
    found = stage_table(details(spark, sf_dir), "details")
    judged = scan.judged_pages(pages, SETTINGS)
    log = stage_table(verdicts(spark, sf_dir, judged, found, 9 if halting else 2), "verdicts")
    stored = spark.createDataFrame([], LISTINGS)
    if halting:
        stored = conform(scan.accepted(judged).withColumns({"id": F.col("product_id").cast("bigint"), "price": F.col("price") * 4,
                                           "ai_is_computer_part": F.lit(True)}), LISTINGS, LISTING_DEFAULTS)
    marks = spark.createDataFrame([], table_schema("marketplace string, source_key string, updated_at timestamp"))
    return scan.run_scan(pages, found, stored, spark.createDataFrame([], OBSERVATIONS), log, marks, None,
                         spark.createDataFrame([], RUNS), now=NOW, settings=SETTINGS, judged=judged), found


def _closed(spark, sf_dir, halting: bool):
    result, found = _scanned(spark, sf_dir, halting)
    review = scan.review_scan(result, found, second_verdicts(result.deals), SETTINGS)
    return result, review, scan.close_scan(result, review, lambda rows: None, now=NOW)


def scan_deals(spark, sf_dir):
    result, _ = _scanned(spark, sf_dir, False)
    return result.deals.select("product_id", "normalized_name", "effective_price", "reference_price", "discount_percent")


def scan_counters(spark, sf_dir):
    return _scanned(spark, sf_dir, False)[0].counters.select(
        "source_key", "records_fetched", "new_count", "irrelevant_count", "duplicate_count", "price_observations")


def scan_review(spark, sf_dir):
    _, review, _ = _closed(spark, sf_dir, False)
    return review.reviewed.select("product_id", "passed", "review_status")


def scan_delivery(spark, sf_dir, halting: bool = False):
    """What a scan sends, by product, after halt, review and once-only delivery."""
    _, _, closed = _closed(spark, sf_dir, halting)
    return closed.listings.where("notified_at IS NOT NULL").select("product_id", "price", "notified_at")


def scan_run(spark, sf_dir, halting: bool):
    _, _, closed = _closed(spark, sf_dir, halting)
    sent = closed.sent.agg(F.count("*").alias("sent"))
    return closed.run.join(F.broadcast(sent), F.lit(True)).select(
        "search_records", "valid_observations", "ai_candidates", "ai_failures", "safety_halt", "detail", "sent")


# --- checks, rules and logs ------------------------------------------------------------------

def applied_checks(spark, sf_dir):
    """All due listings checked on their current details."""
    rows = c.listings(spark, sf_dir)
    due = jobs.due_checks(rows, now="2000-01-01T00:00:00Z", settings=SETTINGS)
    n = F.col("id")
    found = rows.where(F.pmod(n, F.lit(9)) != 4).select(
        "product_id", F.concat(F.lit("checked "), "title").alias("name"), F.lit("정상").alias("description"), (F.col("price") + 7).alias("price"),
        F.when(F.pmod(n, F.lit(3)) == 0, "SOLD").otherwise("SELLING").alias("saleStatus"), F.lit(None).cast("string").alias("status"))
    return jobs.apply_checks(rows, due, found, now=NOW).select(
        "id", "title", "price", "listing_status", "last_active_price", "first_sold_seen_at", "became_sold")


def observe_rule(spark, sf_dir):
    """New, moved or never observed: listings against observations of some of them."""
    n = F.col("id")
    rows = c.listings(spark, sf_dir).withColumns({
        "state": F.when(F.pmod(n, F.lit(5)) == 0, "new").otherwise("updated"),
        "previous_price": F.when(F.pmod(n, F.lit(7)) > 2, F.col("price")).when(F.pmod(n, F.lit(7)) > 0, F.col("price") + 1),
        "normalized_name": F.when(F.pmod(n, F.lit(8)) != 0, F.col("ai_normalized_product_name"))})
    seen = rows.select("marketplace", "product_id", F.when(F.pmod(n, F.lit(3)) == 0, "another name").otherwise(
        F.col("ai_normalized_product_name")).alias(NAME))
    return changes.should_observe(rows, seen, "normalized_name").select("id", "should_observe")


def search_fingerprints(spark, sf_dir):
    """Fingerprints of ingested records: as many as there are different (name, status) pairs."""
    judged = search.judged_records(search.search_records(payloads(spark, sf_dir)), None)
    rows = search.listings_of(judged)
    return rows.groupBy("title", "listing_status").agg(
        F.countDistinct("search_fingerprint").alias("prints"), F.count("*").alias("n"))


def manual_price_file(spark, sf_dir):
    """Prices written as the JSON file that the reader takes, and read back."""
    pairs = c.manual_prices(spark, sf_dir).where(F.col(NAME).isNotNull())
    path = fresh_path(spark, "manual-prices")
    # One object of one entry per brand; brands are a fixed, small set.
    pairs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(NAME, "price")))).alias("value")).write.text(path)
    return tables.read_manual_prices(spark, path)


def delivery_log(spark, sf_dir):
    """Delivery rows of each day: days without a purchase list nothing and are rejected."""
    days = c.event_records(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), F.pmod("record_no", F.lit(97)).alias("part")).agg(
        F.max("ts").alias("delivered_at"), F.max("record_no").alias("id"), F.count_if(F.col("event_type") == "purchase").alias("listing_count"))
    good, bad = tables.delivery_rows(days.select("id", "delivered_at", "listing_count"))
    return good.select("id", "channel", "listing_count", F.lit(True).alias("kept")).unionByName(
        bad.select("id", "channel", "listing_count", F.lit(False).alias("kept")))


def review_log(spark, sf_dir):
    _, review, _ = _closed(spark, sf_dir, False)
    return review.log.select("product_id", "review_status", "success", "reviewed_price", (F.col("review_fingerprint") == "precheck").alias("unprinted"))


def verdict_log(spark, sf_dir):
    """Attempts in log layout: one in eight failed and keeps only its error."""
    rows = c.listings(spark, sf_dir)
    n = F.col("id")
    verdict = F.struct(
        F.col("ai_normalized_product_name").alias("normalized_product_name"), F.col("condition_status").alias("condition"),
        F.col("ai_scope").alias("scope"), F.col("ai_sale_status").alias("sale_status"), F.lit(True).alias("exact_product"),
        F.lit(False).alias("model_mismatch"), F.lit(False).alias("price_bait"), F.lit(False).alias("hidden_price_condition"),
        F.col("price").alias("displayed_price"), "effective_price", F.lit("both").alias("price_source"),
        F.lit(0.9).alias("price_confidence"), F.lit(True).alias("usable_price"), F.col("ai_confidence").alias("confidence"),
        F.lit("fine").alias("reason"))
    attempts = rows.select("id", "marketplace", "product_id", F.when(F.pmod(n, F.lit(8)) != 0, verdict).alias("verdict"),
                           F.when(F.pmod(n, F.lit(8)) == 0, "timed out").alias("error"))
    return tables.verdict_rows(attempts).select("id", "success", "is_computer_part", "condition_status", "scope", "sale_status",
                                                "exact_product", "price_source", "confidence", "reason")


def source_union(spark, sf_dir):
    """U1: rows of all sources and retried items as one table, columns by name."""
    rows = c.listings(spark, sf_dir).select("id", "price", "source_key")
    keys = [f"all-market-price-backfill:{k}" for k in range(9)]
    parts = [rows.where(F.col("source_key") == k).select("source_key", "price", "id") for k in keys]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).groupBy("source_key").agg(
        F.count("*").alias("n"), F.sum("price").alias("total"), F.max("id").alias("newest"))


QUERIES = {
    "scan_deals": scan_deals, "scan_job_counters": scan_counters, "scan_review": scan_review, "scan_delivery": scan_delivery,
    "scan_delivery_halted": functools.partial(scan_delivery, halting=True), "scan_run_log": functools.partial(scan_run, halting=False),
    "scan_run_log_halted": functools.partial(scan_run, halting=True), "applied_checks": applied_checks, "observe_rule": observe_rule,
    "search_fingerprints": search_fingerprints, "manual_price_file": manual_price_file, "delivery_log": delivery_log,
    "review_log": review_log, "verdict_log": verdict_log, "source_union": source_union,
}


def _scan_sql(failing: int) -> str:
    """The scan over the event log: candidates, verdicts, observations, estimates, deals and reviews."""
    return f"""WITH ev AS (SELECT event_id AS n, CAST(event_id AS VARCHAR) AS product_id, event_type,
  CASE WHEN event_id % 2 = 0 THEN '{TITLES[0]}' ELSE '{TITLES[1]}' END AS name, CAST(floor(value * 1000) AS BIGINT) + 1 AS price,
  'q' || (CAST(floor(event_id / 60.0) AS BIGINT) % {SOURCES}) AS source_key FROM events),
cand AS (SELECT *, event_type <> 'purchase' AS active FROM ev WHERE event_type <> 'error'),
seen AS (SELECT *, n % 10 >= {failing} AS judged FROM cand WHERE n % 11 <> 3),
good AS (SELECT * FROM seen WHERE active AND judged AND n % 13 <> 5),
centre AS (SELECT name, COUNT(*) AS m, median(price) AS c FROM good GROUP BY 1),
spread AS (SELECT name, median(abs(price - c)) AS mad FROM good JOIN centre USING (name) GROUP BY 1),
used AS (SELECT g.* FROM good g JOIN centre USING (name) JOIN spread USING (name)
  WHERE m < 3 OR mad = 0 OR abs(price - c) / (1.4826 * mad) <= 3.5),
run AS (SELECT name, price, SUM(COUNT(*)) OVER (PARTITION BY name ORDER BY price ROWS UNBOUNDED PRECEDING) AS upto,
  SUM(COUNT(*)) OVER (PARTITION BY name) AS total FROM used GROUP BY name, price),
est AS (SELECT name, MIN(price) FILTER (WHERE 2 * upto >= total) AS ref, MAX(total) AS total FROM run GROUP BY 1),
deals AS (SELECT g.*, ref, CAST(ref - price AS DOUBLE) / CAST(ref AS DOUBLE) * 100.0 AS off FROM good g JOIN est USING (name)
  WHERE total >= 5 AND CAST(ref - price AS DOUBLE) / CAST(ref AS DOUBLE) * 100.0 >= 10),
reviewed AS (SELECT *, CASE WHEN n % 9 = 7 THEN 'failed' WHEN n % 4 = 1 THEN 'rejected' ELSE 'approved' END AS review_status FROM deals)"""


_AT = "TIMESTAMP '2024-02-01 00:00:00'"


def _run_sql(failing: int, halted: bool) -> str:
    # A halted scan's prices have all fallen to a quarter, so every move is severe.
    sent = "CAST(0 AS BIGINT)" if halted else "(SELECT COUNT(*) FROM reviewed WHERE review_status = 'approved')"
    detail = "'abnormal_ai_failure_distribution'" if halted else "''"
    return f"""{_scan_sql(failing)}
SELECT (SELECT COUNT(*) FROM ev) AS search_records, (SELECT COUNT(*) FROM good) AS valid_observations,
  (SELECT COUNT(*) FROM seen) AS ai_candidates, (SELECT COUNT(*) FROM seen WHERE NOT judged) AS ai_failures,
  {str(halted).upper()} AS safety_halt, {detail} AS detail, {sent} AS sent"""


SQL = {
    "scan_deals": f"""{_scan_sql(2)}
SELECT product_id, name AS normalized_name, price AS effective_price, ref AS reference_price, off AS discount_percent FROM deals""",
    "scan_job_counters": f"""{_scan_sql(2)}
SELECT e.source_key, COUNT(*) AS records_fetched, COUNT(*) FILTER (WHERE e.event_type <> 'error') AS new_count,
  COUNT(*) FILTER (WHERE e.event_type = 'error') AS irrelevant_count, CAST(0 AS BIGINT) AS duplicate_count,
  COUNT(g.n) AS price_observations FROM ev e LEFT JOIN good g ON e.n = g.n GROUP BY 1""",
    "scan_review": f"""{_scan_sql(2)}
SELECT product_id, review_status = 'approved' AS passed, review_status FROM reviewed""",
    "scan_delivery": f"""{_scan_sql(2)}
SELECT product_id, price, {_AT} AS notified_at FROM reviewed WHERE review_status = 'approved'""",
    "scan_delivery_halted": f"""{_scan_sql(9)}
SELECT product_id, price, {_AT} AS notified_at FROM reviewed WHERE FALSE""",
    "scan_run_log": _run_sql(2, False),
    "scan_run_log_halted": _run_sql(9, True),
    "review_log": f"""{_scan_sql(2)}
SELECT product_id, review_status, review_status <> 'failed' AS success, price AS reviewed_price, FALSE AS unprinted FROM reviewed""",
    "applied_checks": f"""WITH {maintenance.SQL['due_rechecks'].removeprefix('WITH ').split('SELECT id, age_days, interval_hours FROM b')[0].replace(
        'age_days <= 200 THEN 1200.0 WHEN age_days <= 900 THEN 7200.0', 'age_days <= 7 THEN 6.0 WHEN age_days <= 30 THEN 24.0').replace(
        'ELSE 28800.0', 'ELSE 72.0')}, due AS (SELECT id FROM b WHERE epoch_us(TIMESTAMP '2000-01-01') - epoch_us(last_active_at)
  >= interval_hours * 3600000000),
k AS (SELECT l.*, d.id IS NOT NULL AND l.id % 9 <> 4 AS hit, l.id % 3 = 0 AS sold FROM listings l LEFT JOIN due d ON l.id = d.id)
SELECT id, CASE WHEN hit THEN 'checked ' || title ELSE title END AS title,
  CASE WHEN hit AND NOT sold THEN price + 7 ELSE price END AS price,
  CASE WHEN hit THEN CASE WHEN sold THEN 'sold' ELSE 'active' END ELSE listing_status END AS listing_status,
  CASE WHEN hit AND NOT sold THEN price + 7 WHEN hit THEN COALESCE(last_active_price, price + 7) ELSE last_active_price END
    AS last_active_price,
  CASE WHEN hit AND sold THEN {_AT} END AS first_sold_seen_at,
  hit AND sold AND listing_status = 'active' AS became_sold FROM k""",
    "observe_rule": f"""WITH {c.LISTINGS_SQL}
SELECT id, id % 8 <> 0 AND (id % 5 = 0 OR id % 7 <= 2 OR id % 3 = 0) AS should_observe FROM listings""",
    "search_fingerprints": f"""{_scan_sql(2)}
SELECT name AS title, CASE WHEN active THEN 'active' ELSE 'sold' END AS listing_status, CAST(1 AS BIGINT) AS prints, COUNT(*) AS n
FROM cand GROUP BY 1, 2""",
    "manual_price_file": f"WITH {c.MANUAL_SQL} SELECT name AS normalized_product_name, price FROM manual",
    "delivery_log": f"""WITH {c.EVENTS_SQL}
SELECT MAX(record_no) AS id, 'email' AS channel, COUNT(*) FILTER (WHERE event_type = 'purchase') AS listing_count,
  COUNT(*) FILTER (WHERE event_type = 'purchase') > 0 AS kept FROM recs GROUP BY CAST(ts AS DATE), record_no % 97""",
    "verdict_log": f"""WITH {c.LISTINGS_SQL}
SELECT id, id % 8 <> 0 AS success, CASE WHEN id % 8 <> 0 THEN ai_scope = 'standalone' AND ai_normalized_product_name IS NOT NULL END
    AS is_computer_part, CASE WHEN id % 8 <> 0 THEN condition_status ELSE 'unknown' END AS condition_status,
  CASE WHEN id % 8 <> 0 THEN ai_scope ELSE 'unknown' END AS scope, CASE WHEN id % 8 <> 0 THEN ai_sale_status ELSE 'unknown' END AS sale_status,
  id % 8 <> 0 AS exact_product, CASE WHEN id % 8 <> 0 THEN 'both' ELSE 'unknown' END AS price_source,
  CASE WHEN id % 8 <> 0 THEN ai_confidence END AS confidence, CASE WHEN id % 8 <> 0 THEN 'fine' ELSE 'timed out' END AS reason FROM listings""",
    "source_union": f"""WITH {c.LISTINGS_SQL}
SELECT source_key, COUNT(*) AS n, CAST(SUM(price) AS BIGINT) AS total, MAX(id) AS newest FROM listings GROUP BY 1""",
}
