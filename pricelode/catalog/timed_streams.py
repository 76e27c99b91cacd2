"""Streams over several files and micro-batches: states, timers, overlaps, maintained histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.estimator import NAME
from ..operators.lifecycle import RecheckTiers
from ..schemas import table_schema
from ..session import fresh_path
from ..streaming import batches, processors
from . import common as c

FILES = 4
STALE_SECONDS, DELAY_SECONDS, LATE_SECONDS = 43_200, 600, 3600
TIERS = RecheckTiers(recent_age_days=27, medium_age_days=29, recent_interval_hours=6, medium_interval_hours=12,
                     older_interval_hours=24)
OVERLAP_DAYS = 3


def in_files(rows: DataFrame, order: str = "record_no", files: int = FILES) -> DataFrame:
    """A stream over the rows written as so many files, one after the other, by ranges of ``order``."""
    spark = rows.sparkSession
    path = fresh_path(spark, "log")
    last = rows.agg(F.max(order)).first()[0]
    for k in range(files):
        part = rows.where(F.expr(f"`{order}` * {files} div {last + 1} = {k}"))
        part.coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows a keyed stream gives, batch by batch."""
    spark = stream.sparkSession
    out = batches.AppendedBatches(spark, fresh_path(spark, name), stream.schema)
    with processors.state_in_rocksdb(spark):
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, f"stream-{name}"))
                 .trigger(availableNow=True).foreachBatch(out.write).start())
        query.awaitTermination()
    return out.read()


def _newest(rows: DataFrame, *order: str) -> DataFrame:
    columns = [x for x in rows.columns if x not in processors.PRODUCT]
    newest = rows.groupBy(*processors.PRODUCT).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return newest.select(*processors.PRODUCT, "r.*")


def change_states(spark, sf_dir):
    """All four states: clicks and errors are verdicts, other events search records; customers are
    the stored listings."""
    e = c.table(spark, sf_dir, "events")
    verdict = F.col("event_type").isin("click", "error")
    log = e.select(
        F.lit("bunjang").alias("marketplace"), F.col("user_id").cast("string").alias("product_id"),
        F.col("event_id").alias("record_no"), F.when(verdict, "verdict").otherwise("search").alias("kind"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"),
        F.when(~verdict, F.floor(F.col("value") / F.lit(50.0))).alias("price"),
        F.when(~verdict, F.when(F.col("event_type") == "signup", "b").otherwise("a")).alias("search_fingerprint"),
        F.when(verdict & (F.floor("value") % 5 != 0), F.lit(True)).alias("ai_is_computer_part"),
        F.when(verdict, F.col("event_type") == "click").alias("success"))
    stored = c.table(spark, sf_dir, "customer").select(
        F.lit("bunjang").alias("marketplace"), F.col("c_custkey").cast("string").alias("product_id"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"), (F.col("c_nationkey") % 3).cast("bigint").alias("price"),
        F.lit("a").alias("search_fingerprint"), (F.col("c_acctbal") > 0).alias("known"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("boolean")).otherwise(
            F.col("c_mktsegment") != "MACHINERY").alias("success"))
    found = _drained(processors.change_states(in_files(log), stored), "states")
    return found.select("record_no", "product_id", "price", "state", "previous_price")


def _job_log(spark, sf_dir):
    rows = c.event_records(spark, sf_dir)
    kind = (F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type").isin("view", "click"), "start")
            .when(F.col("event_type") == "purchase", "finish").otherwise("fail"))
    return rows.select("marketplace", "product_id", "record_no", F.col("ts").alias("at"), kind.alias("kind"),
                       F.when(kind == "enqueue", F.floor(F.col("record_no") / F.lit(4000)).cast("string"))
                       .alias("classification_fingerprint"))


def job_queue(spark, sf_dir):
    """The work queue with its timers running: started jobs return after half a day."""
    states = _drained(processors.work_queue(in_files(_job_log(spark, sf_dir)), DELAY_SECONDS, STALE_SECONDS,
                                            f"{LATE_SECONDS} seconds"), "jobs", "update")
    return _newest(states, "changed_at", "record_no").select("product_id", "state", "attempts", "available_at")


def rechecks(spark, sf_dir):
    """Listings due for a check when the log ends."""
    log = c.event_records(spark, sf_dir).select(
        "marketplace", "product_id", "record_no", F.col("ts").alias("at"),
        (F.col("listing_status") == "active").alias("tracked"))
    changes = _drained(processors.rechecks(in_files(log), TIERS), "rechecks", "update")
    return _newest(changes, "at").where("due").select("product_id")


def price_alerts(spark, sf_dir):
    """Views and clicks are deals, every event a price; drops are found by the stream itself."""
    rows = c.event_records(spark, sf_dir).select("marketplace", "product_id", "record_no", "price", "event_type")
    log = in_files(rows)
    found = _drained(processors.alerts(log, log.where(F.col("event_type").isin("view", "click"))), "price-alerts")
    return found.select("product_id", "record_no", "price", "epoch")


def _items(spark, sf_dir):
    e = c.table(spark, sf_dir, "events")
    return e.select(
        F.lit("bunjang").alias("marketplace"), F.col("user_id").cast("string").alias("product_id"),
        F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")).alias("query_key"),
        F.floor(F.col("event_id") / F.lit(60)).cast("bigint").alias("page_no"), F.col("event_id").alias("record_no"),
        F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") / F.lit(10.0)).alias("price"),
        F.when(F.col("event_type").isin("error", "click"), F.when(F.floor("value") % 4 == 0, "404_or_unavailable").otherwise("5xx"))
        .alias("error_category"), (F.col("event_type").isin("signup", "click")).alias("retried"))


def _outcomes(spark, sf_dir):
    return _drained(processors.backfill_outcomes(in_files(_items(spark, sf_dir)), DELAY_SECONDS * 100), "outcomes")


def backfill_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("product_id", "query_key", "record_no", "outcome", "observed_at", "retry_count")


def backfill_cursors(spark, sf_dir):
    return batches.backfill_cursors(_outcomes(spark, sf_dir))


def overlap(spark, sf_dir):
    """Errors come two days late and purchases ten: the first are read again, the others are gone."""
    e = c.event_records(spark, sf_dir)
    late = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 10).otherwise(0)
    rows = e.select("marketplace", "product_id", F.concat(F.lit("s"), (F.col("record_no") % 2).cast("string")).alias("source_key"),
                    F.concat("event_type", F.lit(":"), F.col("price").cast("string")).alias("search_fingerprint"),
                    F.date_trunc("second", F.col("ts") - F.make_dt_interval(late)).alias("updated_at"), "record_no")
    marks = batches.VersionedTable(spark, fresh_path(spark, "marks"),
                                   table_schema("marketplace string, source_key string, updated_at timestamp"))
    admitted = batches.AppendedBatches(spark, fresh_path(spark, "admitted"), rows.schema)
    batches.drain(in_files(rows), batches.overlap_reread(marks, admitted, OVERLAP_DAYS), "overlap")
    return admitted.read().select("record_no", "product_id", "source_key", "updated_at")


def histogram_prices(spark, sf_dir):
    """Prices from the maintained histogram; the window cuts a day and loses the first ones."""
    rows = c.event_records(spark, sf_dir).select(
        "record_no", "marketplace", "product_id", F.col("event_type").alias(NAME), F.col("price").alias("observed_price"),
        F.col("ts").alias("observed_at"))
    est = batches.AppendedBatches(spark, fresh_path(spark, "estimates"), table_schema(
        f"{NAME} string, price bigint, valid_observation_count bigint, estimator string, automatic boolean, "
        "oldest_observed_at timestamp, newest_observed_at timestamp, version bigint"))
    table = batches.DailyHistogram(spark, fresh_path(spark, "histogram"), window_days=20, half_life_days=7)
    batches.drain(in_files(rows), batches.refresh_from_histogram(table, est, None, now=HISTOGRAM_NOW), "histogram")
    return batches.latest_estimates(est).select(
        NAME, "price", "valid_observation_count", "automatic", "oldest_observed_at", "newest_observed_at")


HISTOGRAM_NOW, _HISTOGRAM_SQL_NOW = "2024-01-29T10:30:00Z", "TIMESTAMP '2024-01-29 10:30:00'"

QUERIES = {
    "stream_change_states": change_states, "stream_job_queue": job_queue, "stream_rechecks": rechecks,
    "stream_price_alerts": price_alerts, "stream_backfill_outcomes": backfill_outcomes,
    "stream_backfill_cursors": backfill_cursors, "stream_overlap": overlap, "stream_histogram_prices": histogram_prices,
}

_END = "(SELECT date_trunc('milliseconds', MAX(CAST(ts AS TIMESTAMP))) FROM events)"
_LATE = f"{_END} - INTERVAL {LATE_SECONDS} SECOND"

_ITEMS_SQL = f"""items AS (SELECT CAST(user_id AS VARCHAR) AS product_id, 'q' || (event_id % 3) AS query_key,
  CAST(floor(event_id / 60.0) AS BIGINT) AS page_no, event_id AS n, CAST(ts AS TIMESTAMP) AS seen_at,
  event_type IN ('error', 'click') AS failed, event_type IN ('error', 'click') AND CAST(floor(value) AS BIGINT) % 4 <> 0 AS passing,
  event_type IN ('signup', 'click') AS retried FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n) AS k,
  first_value(passing) OVER (PARTITION BY product_id ORDER BY n) AS waits FROM items),
tried AS (SELECT *, k = 1 OR (waits AND retried) AS counts FROM ranked),
settled AS (SELECT product_id, MIN(n) FILTER (WHERE counts AND NOT passing) AS at_n FROM tried GROUP BY 1),
judged AS (SELECT t.*, at_n, CASE WHEN n > at_n THEN 'seen' WHEN NOT counts THEN 'waiting' WHEN passing THEN 'queued'
    WHEN failed THEN 'unavailable' ELSE 'observed' END AS outcome FROM tried t JOIN settled s USING (product_id)),
numbered AS (SELECT *, CAST(COUNT(*) FILTER (WHERE outcome = 'queued') OVER (PARTITION BY product_id ORDER BY n) AS INT) AS tries,
  MIN(CASE WHEN counts THEN seen_at END) OVER (PARTITION BY product_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    AS next_try FROM judged),
again AS (SELECT *, seen_at + INTERVAL {DELAY_SECONDS * 100} SECOND AS due FROM numbered WHERE outcome = 'queued'),
outcomes AS (SELECT product_id, query_key, page_no, n AS record_no, outcome, seen_at AS observed_at, tries AS retry_count FROM numbered
  UNION ALL SELECT product_id, query_key, NULL, NULL, 'retry_due', due, tries FROM again
  WHERE (next_try IS NULL OR next_try >= due) AND due <= {_LATE})"""

_OVERLAP_STEPS = "".join(f""",
b{k} AS (SELECT r.*, m.updated_at - INTERVAL {OVERLAP_DAYS} DAY AS reach FROM rows_ r LEFT JOIN m{k} m USING (source_key)
  WHERE batch = {k} AND (m.updated_at IS NULL OR r.updated_at >= m.updated_at - INTERVAL {OVERLAP_DAYS} DAY)),
f{k} AS (SELECT * FROM b{k} QUALIFY row_number() OVER (PARTITION BY product_id, fingerprint ORDER BY updated_at, record_no) = 1),
a{k + 1} AS (SELECT record_no, product_id, source_key, fingerprint, updated_at FROM a{k} UNION ALL
  SELECT record_no, product_id, source_key, fingerprint, updated_at FROM f{k} f WHERE NOT EXISTS (
    SELECT 1 FROM a{k} a LEFT JOIN m{k} m USING (source_key) WHERE a.product_id = f.product_id AND a.fingerprint = f.fingerprint
    AND (m.updated_at IS NULL OR a.updated_at >= m.updated_at - INTERVAL {OVERLAP_DAYS} DAY))),
m{k + 1} AS (SELECT source_key, MAX(updated_at) AS updated_at FROM (SELECT source_key, updated_at FROM m{k}
  UNION ALL SELECT source_key, updated_at FROM rows_ WHERE batch = {k}) GROUP BY 1)""" for k in range(FILES))

SQL = {
    "stream_change_states": """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS product_id, event_id AS n,
  event_type IN ('click', 'error') AS verdict, CAST(floor(value / 50.0) AS BIGINT) AS price,
  CASE WHEN event_type = 'signup' THEN 'b' ELSE 'a' END AS fp, CAST(floor(value) AS BIGINT) % 5 <> 0 AS known,
  event_type = 'click' AS success FROM events
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), -2, FALSE, CAST(c_nationkey % 3 AS BIGINT), 'a', NULL, NULL FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), -1, TRUE, NULL, NULL, c_acctbal > 0, c_mktsegment <> 'MACHINERY' FROM customer),
s AS (SELECT *, lag(price) OVER (PARTITION BY product_id, verdict ORDER BY n) AS was_price,
  lag(fp) OVER (PARTITION BY product_id, verdict ORDER BY n) AS was_fp FROM ev),
d AS (SELECT *, NOT verdict AND (was_fp IS NULL OR was_fp <> fp OR was_price <> price) AS differs FROM s),
g AS (SELECT *, SUM(CASE WHEN differs THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY n) AS content FROM d),
v AS (SELECT *, COALESCE(last_value(CASE WHEN verdict THEN known AND success END IGNORE NULLS) OVER (
    PARTITION BY product_id, content ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS settled FROM g)
SELECT n AS record_no, product_id, price, CASE WHEN was_fp IS NULL THEN 'new' WHEN differs THEN 'updated'
  WHEN NOT settled THEN 'pending_ai' ELSE 'unchanged' END AS state,
  CASE WHEN differs OR NOT settled THEN was_price END AS previous_price FROM v WHERE n >= 0 AND NOT verdict""",
    "stream_job_queue": f"""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS product_id, event_id AS n,
  CAST(ts AS TIMESTAMP) AS seen_at, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'click' THEN 'start'
    WHEN 'purchase' THEN 'finish' ELSE 'fail' END AS kind, CAST(CAST(floor(event_id / 4000.0) AS BIGINT) AS VARCHAR) AS fp,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
jobs AS (SELECT product_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS fp, CAST(NULL AS VARCHAR) AS state, 0 AS attempts,
    CAST(NULL AS TIMESTAMP) AS available, CAST(NULL AS TIMESTAMP) AS started FROM ev WHERE k = 1
  UNION ALL SELECT product_id, k, CASE WHEN fresh THEN new_fp ELSE fp END,
    CASE WHEN fresh THEN 'pending' WHEN begins THEN 'processing' WHEN state IS NULL THEN NULL WHEN kind = 'finish' THEN 'completed'
      WHEN kind = 'fail' THEN 'retry' ELSE state END,
    CASE WHEN fresh THEN 0 WHEN begins THEN attempts + 1 ELSE attempts END,
    CASE WHEN fresh THEN seen_at WHEN state IS NOT NULL AND kind = 'fail' THEN seen_at + INTERVAL {DELAY_SECONDS} SECOND ELSE available END,
    CASE WHEN begins THEN seen_at WHEN fresh OR kind IN ('finish', 'fail') THEN NULL ELSE started END
  FROM (SELECT *, kind = 'enqueue' AND (state IS NULL OR new_fp <> fp) AS fresh,
      kind = 'start' AND COALESCE(state IN ('pending', 'retry'), FALSE) AS begins
    FROM (SELECT j.product_id, e.k, j.fp, e.fp AS new_fp, e.kind, e.seen_at, j.attempts,
        CASE WHEN stale THEN 'retry' ELSE state END AS state, CASE WHEN stale THEN j.started + INTERVAL {STALE_SECONDS} SECOND
          ELSE available END AS available, CASE WHEN stale THEN NULL ELSE j.started END AS started
      FROM (SELECT j.*, e.seen_at AS e_at, COALESCE(j.state = 'processing' AND e.seen_at > j.started + INTERVAL {STALE_SECONDS} SECOND, FALSE)
          AS stale FROM jobs j JOIN ev e ON e.product_id = j.product_id AND e.k = j.k + 1) j
      JOIN ev e ON e.product_id = j.product_id AND e.k = j.k + 1))),
ends AS (SELECT *, COALESCE(state = 'processing' AND started + INTERVAL {STALE_SECONDS} SECOND < {_LATE}, FALSE) AS stale
  FROM jobs WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY k DESC) = 1)
SELECT product_id, CASE WHEN stale THEN 'retry' ELSE state END AS state, attempts,
  CASE WHEN stale THEN started + INTERVAL {STALE_SECONDS} SECOND ELSE available END AS available_at FROM ends""",
    "stream_rechecks": f"""WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS product_id, event_id AS n, CAST(ts AS TIMESTAMP) AS seen_at,
  event_type NOT IN ('purchase', 'error') AS tracked FROM events),
p AS (SELECT product_id, MIN(seen_at) AS first_at, COALESCE(MAX(seen_at) FILTER (WHERE tracked), MIN(seen_at)) AS last_at, arg_max(tracked, n) AS tracked
  FROM ev GROUP BY 1),
w AS (SELECT product_id, tracked, epoch_us({_END}) - epoch_us(last_at) AS waited,
  greatest(0.0, (epoch_us({_END}) - epoch_us(first_at)) / 86400000000.0) AS age FROM p)
SELECT product_id FROM w WHERE tracked AND waited >= CASE WHEN age <= {TIERS.recent_age_days} THEN {TIERS.recent_interval_hours}
  WHEN age <= {TIERS.medium_age_days} THEN {TIERS.medium_interval_hours} ELSE {TIERS.older_interval_hours} END * 3600000000""",
    "stream_price_alerts": f"""WITH {c.EVENTS_SQL}, w AS (SELECT *,
  lag(price) OVER (PARTITION BY product_id ORDER BY record_no) AS was FROM recs),
e AS (SELECT *, CAST(SUM(CASE WHEN price < was THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY record_no) AS BIGINT)
  AS epoch FROM w)
SELECT product_id, record_no, price, epoch FROM e WHERE event_type IN ('view', 'click')
QUALIFY row_number() OVER (PARTITION BY product_id, epoch ORDER BY record_no) = 1""",
    "stream_backfill_outcomes": f"""WITH {_ITEMS_SQL}
SELECT product_id, query_key, record_no, outcome, observed_at, retry_count FROM outcomes""",
    "stream_backfill_cursors": f"""WITH {_ITEMS_SQL}
SELECT query_key, MAX(page_no) AS last_page, COUNT(*) FILTER (WHERE outcome = 'observed') AS observed,
  COUNT(*) FILTER (WHERE outcome IN ('seen', 'waiting')) AS skipped, COUNT(*) FILTER (WHERE outcome = 'unavailable') AS unavailable,
  COUNT(*) FILTER (WHERE outcome = 'queued') AS queued, COUNT(*) FILTER (WHERE outcome = 'retry_due') AS retries_due
FROM outcomes GROUP BY 1""",
    "stream_overlap": f"""WITH {c.EVENTS_SQL}, rows_ AS (SELECT record_no, product_id, 's' || (record_no % 2) AS source_key,
  event_type || ':' || price AS fingerprint, date_trunc('second', ts - CASE event_type WHEN 'error' THEN INTERVAL 2 DAY
    WHEN 'purchase' THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END) AS updated_at,
  record_no * {FILES} // ((SELECT MAX(event_id) FROM events) + 1) AS batch FROM recs),
m0 AS (SELECT source_key, updated_at FROM rows_ WHERE FALSE),
a0 AS (SELECT record_no, product_id, source_key, fingerprint, updated_at FROM rows_ WHERE FALSE){_OVERLAP_STEPS}
SELECT record_no, product_id, source_key, updated_at FROM a{FILES}""",
    "stream_histogram_prices": f"""WITH obs AS (SELECT event_type AS name,
  CAST(floor(value / 10.0) AS BIGINT) AS price, CAST(ts AS TIMESTAMP) AS seen FROM events),
{c.estimate_sql(20, 7.0).replace(c.NOW_SQL, _HISTOGRAM_SQL_NOW)}
SELECT name AS normalized_product_name, CASE WHEN n >= 5 THEN weighted_median END AS price,
  n AS valid_observation_count, n >= 5 AS automatic, oldest AS oldest_observed_at, newest AS newest_observed_at FROM est""",
}
