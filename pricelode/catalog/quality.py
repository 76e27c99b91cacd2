"""Counts, metrics, anomaly and status reports over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import change_percent
from ..functions.prints import classification_fingerprint
from ..operators import lifecycle, merge, quality
from ..operators.ordered import beside
from ..sources.tables import run_rows
from . import common as c
from .maintenance import _FAIL_SQL, _JOBS_SQL, _failures, _jobs


def _moves(spark, sf_dir):
    rows = lifecycle.replay_states(c.event_records(spark, sf_dir), F.date_trunc("day", "ts"),
                                   [F.col("ts"), F.col("record_no")])
    return rows.select("record_no", change_percent(F.col("price"), F.col("previous_price"))
                       .alias("change_percent"))


_MOVES_SQL = f"""{c.EVENTS_SQL}, w AS (SELECT *,
  lag((updated_at, price, search_fingerprint)) OVER p AS was, lag(price) OVER p AS was_price
  FROM recs WINDOW p AS (PARTITION BY product_id ORDER BY ts, record_no)),
moves AS (SELECT record_no, CASE WHEN was IS NOT NULL AND was_price <> 0 AND
  was <> (updated_at, price, search_fingerprint) THEN
  CAST(price - was_price AS DOUBLE) / CAST(was_price AS DOUBLE) * 100.0 END AS change_percent
  FROM w)"""


def price_moves(spark, sf_dir):
    return _moves(spark, sf_dir)


def _metrics(spark, sf_dir):
    e = c.event_records(spark, sf_dir)
    run = _runs(spark, sf_dir)
    return beside(e.agg(
        F.count("*").alias("search_records"),
        F.count_if(F.col("event_type") == "click").alias("valid_observations"),
        F.count_if(F.col("event_type").isin("error", "view")).alias("ai_candidates"),
        F.count_if(F.col("event_type") == "error").alias("ai_failures"),
        F.lit(0).cast("bigint").alias("parsing_anomalies"),
    ), quality.prior_valid_observations(run))


def _runs(spark, sf_dir):
    """A run log: one run per day and event type."""
    e = c.event_records(spark, sf_dir)
    return e.groupBy("updated_at", "event_type").agg(
        F.max("record_no").alias("id"), F.max("ts").alias("completed_at"),
        (F.count("*") * 1000).alias("valid_observations"),
        F.count("*").alias("search_records")).withColumn(
        "status", F.when(F.col("event_type") == "error", "failed").otherwise("success"))


_RUNS_SQL = f"""{c.EVENTS_SQL}, runs AS (SELECT MAX(record_no) AS id, MAX(ts) AS completed_at,
  COUNT(*) * 1000 AS valid_observations, COUNT(*) AS search_records,
  CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status
  FROM recs GROUP BY updated_at, event_type)"""


def anomaly(spark, sf_dir):
    out = quality.assess_anomalies(_moves(spark, sf_dir), _metrics(spark, sf_dir))
    return out.select("price_warnings", "safety_halt",
                      F.array_join("reasons", ",").alias("reasons"))


def last_run(spark, sf_dir):
    return quality.last_successful_run(_runs(spark, sf_dir)).select(
        "id", "completed_at", "valid_observations", "search_records", "status")


def queue(spark, sf_dir):
    return quality.queue_counts(_jobs(spark, sf_dir))


def retry_stats(spark, sf_dir):
    return quality.retry_statistics(merge.categorised(_failures(spark, sf_dir)), "q1")


def by_marketplace(spark, sf_dir):
    o = c.table(spark, sf_dir, "orders")
    rows = o.select(F.when(F.col("o_orderkey") % 3 == 0, "karrot").otherwise("bunjang")
                    .alias("marketplace"))
    return quality.counts_by_marketplace(rows)


def count(spark, sf_dir):
    return quality.listing_count(c.listings(spark, sf_dir))


def pricing_update(spark, sf_dir):
    return quality.latest_pricing_update(c.observations(spark, sf_dir))


def _verdict_work(spark, sf_dir):
    e = c.event_records(spark, sf_dir)
    n = F.col("record_no")
    return e.select(
        n.alias("id"), F.col("ts").alias("classified_at"),
        (F.col("event_type") != "error").alias("success"),
        (F.pmod(n, F.lit(4)) == 0).alias("cached"), F.col("price").cast("double").alias("seconds"))


def telemetry(spark, sf_dir):
    return quality.verdict_telemetry(_verdict_work(spark, sf_dir))


def failures(spark, sf_dir):
    return quality.recent_failures(_verdict_work(spark, sf_dir), "2024-01-30T12:00:00Z")


def delivery(spark, sf_dir):
    """No delivery was logged, so the newest notification time stands in."""
    e = c.event_records(spark, sf_dir)
    none = e.where(F.lit(False)).select(
        F.col("record_no").alias("id"), F.col("ts").alias("delivered_at"),
        F.col("record_no").alias("listing_count"), F.col("event_type").alias("channel"))
    return quality.last_delivery(none, c.listings(spark, sf_dir))


def status(spark, sf_dir):
    e = c.event_records(spark, sf_dir)
    deliveries = e.where(F.col("event_type") == "click").select(
        F.col("record_no").alias("id"), F.col("ts").alias("delivered_at"),
        (F.col("price") + 1).alias("listing_count"), F.lit("email").alias("channel"))
    return quality.status_summary(
        c.listings(spark, sf_dir), _runs(spark, sf_dir), deliveries, _verdict_work(spark, sf_dir),
        c.observations(spark, sf_dir), _jobs(spark, sf_dir), "2024-01-30T12:00:00Z")


def rolling(spark, sf_dir):
    e = c.event_records(spark, sf_dir)
    n = F.col("record_no")
    rows = e.select(
        F.col("event_type").alias("query_key"), n, "ts", F.col("price").cast("double")
        .alias("seconds"), F.pmod(n, F.lit(9)).alias("queue_size"),
        F.pmod(n, F.lit(3)).alias("active_workers"), F.lit(4).alias("concurrency"))
    out = quality.work_metrics(rows, ["query_key"], F.date_trunc("day", "ts"), [n])
    return out.select("record_no", "row_no", F.round("rolling_seconds", 6)
                      .alias("rolling_seconds"), F.round("remaining_seconds", 6)
                      .alias("remaining_seconds"))


def crawl(spark, sf_dir):
    e = c.event_records(spark, sf_dir)
    n = F.col("record_no")
    rows = e.select(
        F.col("event_type").alias("query_key"), n, "ts", (n * 2).cast("double").alias("at_seconds"),
        (n * 3 + F.pmod(n, F.lit(5))).alias("units"),
        F.floor(n / F.lit(1000)).alias("completed_queries"), F.lit(20).alias("total_queries"))
    out = quality.crawl_remaining(rows, ["query_key"], F.date_trunc("day", "ts"), [n])
    return out.select("record_no", F.round("remaining_seconds", 4).alias("remaining_seconds"))


def fingerprint_groups(spark, sf_dir):
    """Equal content gives equal fingerprints: distinct prints against distinct contents."""
    rows = c.listings(spark, sf_dir).withColumns({
        "price": F.pmod("id", F.lit(50)), "updated_at": F.when(F.pmod("id", F.lit(2)) == 0,
                                                               F.lit("2024-01-01"))})
    return rows.select(classification_fingerprint().alias("print")).agg(
        F.countDistinct("print").alias("contents"), F.count("*").alias("n"))


def run_log(spark, sf_dir):
    """Run-log rows as they are appended, with long details cut."""
    rows = _runs(spark, sf_dir).withColumn(
        "detail", F.repeat(F.col("event_type"), (F.pmod("id", F.lit(900))).cast("int")))
    return run_rows(rows).select("id", "status", "safety_halt", F.length("detail").cast("bigint")
                                 .alias("detail_length"))


QUERIES = {
    "run_log": run_log, "price_moves": price_moves,
    "anomaly_assessment": anomaly, "last_successful_run": last_run,
    "queue_counts": queue, "retry_statistics": retry_stats, "counts_by_marketplace": by_marketplace,
    "listing_count": count, "latest_pricing_update": pricing_update,
    "verdict_telemetry": telemetry, "recent_failures": failures, "last_delivery": delivery,
    "status_summary": status, "work_rolling_metrics": rolling, "crawl_remaining": crawl,
    "fingerprint_groups": fingerprint_groups,
}

_WORK_SQL = """work AS (SELECT ts AS classified_at, event_type <> 'error' AS success,
  record_no % 4 = 0 AS cached, CAST(price AS DOUBLE) AS seconds FROM recs)"""

SQL = {
    "run_log": f"""WITH {c.EVENTS_SQL}, r AS (SELECT MAX(record_no) AS id, event_type
  FROM recs GROUP BY updated_at, event_type)
SELECT id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status,
  FALSE AS safety_halt, least(2000, len(event_type) * (id % 900)) AS detail_length FROM r""",
    "price_moves": f"WITH {_MOVES_SQL} SELECT * FROM moves",
    "anomaly_assessment": f"""WITH {_MOVES_SQL},
runs AS (SELECT MAX(record_no) AS id, COUNT(*) * 1000 AS valid_observations,
  CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status
  FROM recs GROUP BY updated_at, event_type),
t AS (SELECT COUNT(*) FILTER (WHERE abs(change_percent) >= 30) AS warn,
  COUNT(*) FILTER (WHERE abs(change_percent) >= 60) AS severe,
  COUNT(change_percent) AS n FROM moves),
m AS (SELECT COUNT(*) AS records, COUNT(*) FILTER (WHERE event_type = 'click') AS obs,
  COUNT(*) FILTER (WHERE event_type IN ('error', 'view')) AS cand,
  COUNT(*) FILTER (WHERE event_type = 'error') AS fails FROM recs),
p AS (SELECT arg_max(valid_observations, id) AS prior FROM runs WHERE status = 'success'),
r AS (SELECT t.*, concat_ws(',', CASE WHEN records = 0 THEN 'search_results_zero' END,
  CASE WHEN prior >= 10 AND obs * 2 < prior THEN 'valid_observations_collapsed' END,
  CASE WHEN cand >= 10 AND fails / cand >= 0.8 THEN 'abnormal_ai_failure_distribution' END)
  AS reasons FROM t, m, p)
SELECT warn AS price_warnings, severe >= 3 AND severe / greatest(1, n) >= 0.5 AND reasons <> ''
  AS safety_halt, reasons FROM r""",
    "last_successful_run": f"""WITH {_RUNS_SQL} SELECT * FROM runs WHERE status = 'success'
ORDER BY id DESC LIMIT 1""",
    "queue_counts": f"""WITH {_JOBS_SQL}, s(state) AS (VALUES ('pending'), ('processing'), ('retry'),
  ('completed')) SELECT s.state, COUNT(j.id) AS n FROM s LEFT JOIN jobs j ON s.state = j.state
  GROUP BY 1""",
    "retry_statistics": f"""WITH {_FAIL_SQL}, t AS (SELECT cat, cat NOT IN ('read_timeout',
  'connect_timeout', '429', '5xx') AS terminal FROM fails WHERE query_key = 'q1')
SELECT cat AS error_category, COUNT(*) FILTER (WHERE NOT terminal) AS queued_count,
  COUNT(*) FILTER (WHERE terminal) AS terminal_count, COUNT(*) AS total_count FROM t GROUP BY 1""",
    "counts_by_marketplace": """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'karrot' ELSE 'bunjang'
  END AS marketplace, COUNT(*) AS n FROM orders GROUP BY 1""",
    "listing_count": "SELECT COUNT(*) AS n FROM orders",
    "latest_pricing_update": """SELECT MAX(l_shipdate) AS recent_pricing_update
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "verdict_telemetry": f"""WITH {c.EVENTS_SQL}, {_WORK_SQL} SELECT
  COUNT(*) FILTER (WHERE NOT cached) AS calls,
  COUNT(*) FILTER (WHERE NOT cached AND NOT success) AS failures,
  COUNT(*) FILTER (WHERE cached) AS cached, SUM(seconds) FILTER (WHERE NOT cached)
  AS total_seconds, SUM(seconds) FILTER (WHERE NOT cached)
  / COUNT(*) FILTER (WHERE NOT cached) AS average_seconds FROM work""",
    "recent_failures": f"""WITH {c.EVENTS_SQL}, {_WORK_SQL} SELECT COUNT(*) FILTER (
  WHERE NOT success AND classified_at >= TIMESTAMP '2024-01-29 12:00:00') AS recent_ai_failures
FROM work""",
    "last_delivery": f"""WITH {c.LISTINGS_SQL} SELECT notified_at AS delivered_at,
  COUNT(*) AS listing_count, 'email' AS channel FROM listings
WHERE notified_at = (SELECT MAX(notified_at) FROM listings) GROUP BY 1""",
    "status_summary": f"""WITH {_JOBS_SQL}, {c.EVENTS_SQL}, {_WORK_SQL},
runs AS (SELECT MAX(record_no) AS id, MAX(ts) AS completed_at FROM recs
  WHERE event_type <> 'error' GROUP BY updated_at, event_type)
SELECT 'bunjang=' || (SELECT COUNT(*) FROM listings) AS listing_counts,
  (SELECT arg_max(completed_at, id) FROM runs) AS last_successful_scan,
  (SELECT arg_max(ts, record_no) FROM recs WHERE event_type = 'click') AS last_notification,
  (SELECT arg_max(price + 1, record_no) FROM recs WHERE event_type = 'click')
    AS last_notification_count,
  (SELECT COUNT(*) FROM jobs WHERE state = 'pending') AS queue_pending,
  (SELECT COUNT(*) FROM jobs WHERE state = 'processing') AS queue_processing,
  (SELECT COUNT(*) FROM jobs WHERE state = 'retry') AS queue_retry,
  (SELECT COUNT(*) FROM jobs WHERE state = 'completed') AS queue_completed,
  (SELECT COUNT(*) FROM jobs WHERE state IN ('pending', 'retry')) AS pending_ai,
  (SELECT COUNT(*) FROM work WHERE NOT success
    AND classified_at >= TIMESTAMP '2024-01-29 12:00:00') AS recent_ai_failures,
  (SELECT MAX(l_shipdate) FROM lineitem JOIN part ON l_partkey = p_partkey)
    AS recent_pricing_update""",
    "work_rolling_metrics": f"""WITH {c.EVENTS_SQL}, w AS (SELECT *,
  row_number() OVER (PARTITION BY event_type ORDER BY record_no) AS row_no,
  AVG(CAST(price AS DOUBLE)) OVER (PARTITION BY event_type ORDER BY record_no
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS r FROM recs)
SELECT record_no, row_no, round(r, 6) AS rolling_seconds,
  round((record_no % 9 + record_no % 3) / 4.0 * r, 6) AS remaining_seconds FROM w""",
    "crawl_remaining": f"""WITH {c.EVENTS_SQL}, s AS (SELECT event_type, record_no,
  record_no * 2.0::DOUBLE AS t, record_no * 3 + record_no % 5 AS u,
  CAST(floor(record_no / 1000.0) AS BIGINT) AS done FROM recs),
w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY record_no) AS n,
  first_value(t) OVER f AS t0, first_value(u) OVER f AS u0 FROM s WINDOW f AS (
  PARTITION BY event_type ORDER BY record_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT record_no, CASE WHEN n >= 3 AND done >= 1 AND t > t0 AND u > u0 THEN
  round(greatest(0, 20 - done) * (u / done) / ((u - u0) / (t - t0)), 4) END
  AS remaining_seconds FROM w""",
    "fingerprint_groups": f"""WITH {c.LISTINGS_SQL} SELECT COUNT(DISTINCT (title, description,
  id % 50, id % 2)) AS contents, COUNT(*) AS n FROM listings""",
}
