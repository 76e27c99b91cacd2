"""Merges, observation maintenance, work queue and lifecycle over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, merge
from ..schemas import JOBS, RETRIES, conform, conform_listings, listing_violations, split_valid
from . import common as c
from . import oracle_text as ot

_MOD = F.pmod


def _incoming(spark, sf_dir):
    """Changes to a third of the listings, plus brand-new products."""
    base = c.listings(spark, sf_dir)
    i = F.col("id")
    status = (F.when(_MOD(i, F.lit(7)) < 4, "active").when(_MOD(i, F.lit(7)) < 6, "sold")
              .otherwise("reserved"))
    common = {
        "state": F.when(_MOD(i, F.lit(4)) == 0, "pending_ai").otherwise("updated"),
        "previous_price": F.col("price"), "title": F.concat("title", F.lit(" v2")),
        "listing_status": status,
        "condition_status": F.when(_MOD(i, F.lit(2)) == 0, "unknown").otherwise("normal"),
        "price": F.col("price") + (_MOD(i, F.lit(5)) - 2) * 100,
        "last_active_at": F.lit(None).cast("timestamp"),
        "last_active_price": F.lit(None).cast("bigint"),
    }
    changed = base.where(_MOD(i, F.lit(3)) == 0).withColumns(common)
    fresh = base.where(_MOD(i, F.lit(50)) == 1).withColumns({
        **common, "state": F.lit("new"), "previous_price": F.lit(None).cast("bigint"),
        "product_id": F.concat(F.lit("n"), F.col("product_id")),
        "listing_id": F.concat(F.col("listing_id"), F.lit("n")),
        "url": F.concat(F.col("url"), F.lit("n")), "id": F.lit(None).cast("bigint")})
    return changed.unionByName(fresh)


_INCOMING_SQL = f"""{c.LISTINGS_SQL},
src AS (SELECT id, product_id, title || ' v2' AS title, price AS was,
    price + (id % 5 - 2) * 100 AS price, effective_price, url, ai_scope, ai_confidence,
    CASE WHEN id % 7 < 4 THEN 'active' WHEN id % 7 < 6 THEN 'sold' ELSE 'reserved' END AS status,
    CASE WHEN id % 2 = 0 THEN 'unknown' ELSE 'normal' END AS cond,
    CASE WHEN id % 4 = 0 THEN 'pending_ai' ELSE 'updated' END AS state FROM listings),
inc AS (SELECT * FROM src WHERE id % 3 = 0),
fresh AS (SELECT * FROM src WHERE id % 50 = 1)"""

_SHOWN = ["product_id", "title", "price", "effective_price", "listing_status", "condition_status",
          "first_seen_at", "last_active_at", "last_active_price", "first_sold_seen_at",
          "notified_at"]


def processed(spark, sf_dir):
    return merge.merge_processed(c.listings(spark, sf_dir), _incoming(spark, sf_dir),
                                 c.NOW).select(*_SHOWN)


def backfilled(spark, sf_dir):
    rows = _incoming(spark, sf_dir).drop("state", "previous_price")
    return merge.merge_backfill(c.listings(spark, sf_dir), rows, c.NOW).select(*_SHOWN)


def backlogged(spark, sf_dir):
    rows = _incoming(spark, sf_dir).drop("state", "previous_price")
    return merge.merge_backlog(c.listings(spark, sf_dir), rows, c.NOW).select(*_SHOWN)


def repaired(spark, sf_dir):
    rows = _incoming(spark, sf_dir).where(F.col("id").isNotNull())
    return merge.merge_repair(c.listings(spark, sf_dir), rows).select(*_SHOWN)


def checked(spark, sf_dir):
    return merge.merge_checks(c.listings(spark, sf_dir), _incoming(spark, sf_dir),
                              c.NOW).select(*_SHOWN, "became_sold")


def unavailable(spark, sf_dir):
    rows = _incoming(spark, sf_dir).select(
        "marketplace", "product_id", "listing_id", "url", "title", "price", "location",
        "source_type", "source_key", "updated_at", "search_fingerprint", "canonical_url",
        "listing_status")
    return merge.mark_unavailable(c.listings(spark, sf_dir), rows, c.NOW).select(
        "product_id", "title", "price", "listing_status", "condition_status")


def _merged(cols_old: dict[str, str], fresh: dict[str, str] | None, on: str = "TRUE") -> str:
    """SELECT of _SHOWN with replaced columns where ``inc`` has the product."""
    def pick(name: str) -> str:
        new = cols_old.get(name)
        return (f"l.{name}" if new is None
                else f"CASE WHEN i.id IS NOT NULL AND ({on}) THEN {new} ELSE l.{name} END AS {name}")

    sql = ("SELECT " + ", ".join(pick(n) for n in _SHOWN)
           + " FROM listings l LEFT JOIN inc i ON l.id = i.id")
    if fresh is not None:
        sql += " UNION ALL SELECT " + ", ".join(f"{fresh[n]} AS {n}" for n in _SHOWN) + \
               " FROM fresh i"
    return sql


_NOW = c.NOW_SQL
_FRESH = {
    "product_id": "'n' || i.product_id", "title": "i.title", "price": "i.price",
    "effective_price": "i.effective_price", "listing_status": "i.status",
    "condition_status": "i.cond", "first_seen_at": _NOW,
    "last_active_at": f"CASE WHEN i.status = 'active' THEN {_NOW} END",
    "last_active_price": "CASE WHEN i.status = 'active' THEN i.price END",
    "first_sold_seen_at": "CAST(NULL AS TIMESTAMP)", "notified_at": "CAST(NULL AS TIMESTAMP)",
}
_CONTENT = {"title": "i.title", "price": "i.price", "listing_status": "i.status",
            "condition_status": "i.cond"}
_LIFE = {
    "last_active_at": f"CASE WHEN i.status = 'active' THEN {_NOW} ELSE l.last_active_at END",
    "last_active_price": "CASE WHEN i.status = 'active' THEN i.price ELSE l.last_active_price END",
    "first_sold_seen_at": f"CASE WHEN i.status = 'sold' THEN {_NOW} END",
}


# --- constraint split, layouts ----------------------------------------------

def violations(spark, sf_dir):
    """Listings with some values broken, split into good rows and rejects (rejects shown)."""
    i = F.col("id")
    rows = c.listings(spark, sf_dir).withColumns({
        "price": F.when(_MOD(i, F.lit(20)) == 3, -F.col("price")).otherwise(F.col("price")),
        "ai_scope": F.when(_MOD(i, F.lit(30)) == 4, "parts").otherwise(F.col("ai_scope")),
        "effective_price": F.when(_MOD(i, F.lit(40)) == 3, 0).otherwise(
            F.col("effective_price"))})
    _, bad = split_valid(rows, listing_violations())
    return bad.select("id", F.array_join(F.sort_array("violations"), ",").alias("violations"))


def conformed(spark, sf_dir):
    """Listings of an old layout brought to the current one."""
    rows = c.listings(spark, sf_dir).select(
        "id", "marketplace", "listing_id", "url", "title", "price", "location", "source_type",
        "listing_status", "first_seen_at", "ai_usable_for_market_price", "last_active_at")
    return conform_listings(rows).select(
        "id", "product_id", "canonical_url", "effective_price", "ai_usable_price",
        "last_active_at", "last_active_price", "condition_status", "ai_reject")


# --- observations -------------------------------------------------------------

def _stored_observations(spark, sf_dir):
    """Stored observations: one per listing, some invalid; those of odd ids are of other products."""
    rows = c.listings(spark, sf_dir)
    i = F.col("id")
    name = (F.when(_MOD(i, F.lit(8)) < 3, "RTX 4070 SUPER").when(_MOD(i, F.lit(8)) < 5, "RTX 3070")
            .when(_MOD(i, F.lit(8)) == 6, "RTX 4060 Ti").otherwise("B650 Motherboard"))
    odd = _MOD(i, F.lit(2)) == 1
    return rows.select(
        "id", "marketplace",
        F.when(_MOD(i, F.lit(30)) == 0, F.concat(F.lit("gone"), "product_id"))
        .when(odd, F.concat(F.lit("other"), "product_id")).otherwise(F.col("product_id")).alias("product_id"),
        name.alias("normalized_product_name"), F.col("price").alias("observed_price"),
        F.col("updated_at").alias("observed_at"), "first_seen_at",
        F.col("updated_at").alias("source_updated_at"),
        F.when(odd, F.concat(F.lit("other"), "listing_id")).otherwise(F.col("listing_id")).alias("listing_id"),
        (_MOD(i, F.lit(6)) != 0).alias("valid"),
        F.when(_MOD(i, F.lit(6)) == 0, "old").alias("invalid_reason"))


_STORED_SQL = f"""{c.LISTINGS_SQL},
obs AS (SELECT id, marketplace,
  CASE WHEN id % 30 = 0 THEN 'gone' || product_id WHEN id % 2 = 1 THEN 'other' || product_id
    ELSE product_id END AS product_id,
  CASE WHEN id % 8 < 3 THEN 'RTX 4070 SUPER' WHEN id % 8 < 5 THEN 'RTX 3070'
    WHEN id % 8 = 6 THEN 'RTX 4060 Ti' ELSE 'B650 Motherboard' END AS name,
  price AS observed_price, updated_at AS observed_at,
  CASE WHEN id % 2 = 1 THEN 'other' || listing_id ELSE listing_id END AS listing_id, id % 6 <> 0 AS valid,
  CASE WHEN id % 6 = 0 THEN 'old' END AS invalid_reason FROM listings)"""


def _verdict_versions(spark, sf_dir):
    rows = c.elsewhere(c.listings(spark, sf_dir), _MOD("id", F.lit(3)) == 0)
    return rows.select("id", "marketplace", "product_id", F.lit(True).alias("success"),
                       F.when(_MOD("id", F.lit(9)) == 0, "old").otherwise("v6")
                       .alias("classifier_version"))


def audited(spark, sf_dir):
    return merge.audit_contamination(
        _stored_observations(spark, sf_dir), c.listings(spark, sf_dir),
        _verdict_versions(spark, sf_dir), "v6").select(
        "id", "valid", "invalid_reason", "reviewed", "scope", "rescoped")


def audit_summary(spark, sf_dir):
    return merge.audit_counts(merge.audit_contamination(
        _stored_observations(spark, sf_dir), c.listings(spark, sf_dir),
        _verdict_versions(spark, sf_dir), "v6"))


def observed(spark, sf_dir):
    """New observations of eligible listings; those already stored are ignored."""
    rows = c.listings(spark, sf_dir)
    stored = rows.where(_MOD("id", F.lit(3)) == 0).select(
        "marketplace", "product_id",
        F.col("ai_normalized_product_name").alias("normalized_product_name"),
        F.col("updated_at").alias("observed_at"))
    return merge.observe(rows, rows, stored, "ai_normalized_product_name",
                         F.col("updated_at")).select(
        "product_id", "normalized_product_name", "observed_price", "observed_at",
        "first_seen_at", "valid")


def rebuilt(spark, sf_dir):
    """Rebuild with names taken from the texts, so that some listings qualify."""
    rows = c.listings(spark, sf_dir).withColumn(
        "ai_normalized_product_name",
        F.when(_MOD("id", F.lit(2)) == 0, "RTX 4070 SUPER").otherwise("RTX 4060 Ti"))
    out = merge.rebuild_observations(_stored_observations(spark, sf_dir), rows, 0.5)
    return out.select("product_id", "normalized_product_name", "observed_price", "observed_at",
                      "valid", "invalid_reason")


def history(spark, sf_dir):
    return merge.history(_stored_observations(spark, sf_dir)).select(
        "product_id", "normalized_product_name", "observed_price", "observed_at",
        "price_observation_id")


def pruned(spark, sf_dir):
    obs = _stored_observations(spark, sf_dir)
    everything = merge.history(obs.withColumn("valid", F.lit(True)))
    return merge.prune_history(everything, obs).select("price_observation_id")


def observed_flags(spark, sf_dir):
    rows = c.listings(spark, sf_dir).withColumn("name", F.lit("RTX 3070"))
    return merge.already_observed(rows, _stored_observations(spark, sf_dir), "name").select(
        "id", "observed")


# --- work queue, retries, marks ------------------------------------------------

def _jobs(spark, sf_dir):
    i = F.col("id")
    rows = c.listings(spark, sf_dir)
    state = (F.when(_MOD(i, F.lit(8)) == 0, "pending").when(_MOD(i, F.lit(8)) == 2, "processing")
             .when(_MOD(i, F.lit(8)) == 4, "retry").otherwise("completed"))
    # Jobs of odd ids are of products that the listings don't have.
    product = F.when(_MOD(i, F.lit(2)) == 1, F.concat(F.lit("other"), "product_id")).otherwise(F.col("product_id"))
    rows = rows.select(
        "marketplace", product.alias("product_id"), F.col("search_fingerprint")
        .alias("classification_fingerprint"), state.alias("state"),
        _MOD(i, F.lit(3)).cast("int").alias("attempts"),
        F.when(_MOD(i, F.lit(5)) == 0, "boom").otherwise("").alias("last_error"),
        F.col("updated_at").alias("available_at"),
        F.when(state == "processing", F.col("updated_at")).alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), "updated_at")
    return conform(rows, JOBS)


_JOBS_SQL = f"""{c.LISTINGS_SQL}, jobs AS (SELECT id, marketplace,
  CASE WHEN id % 2 = 1 THEN 'other' || product_id ELSE product_id END AS product_id,
  search_fingerprint AS classification_fingerprint,
  CASE id % 8 WHEN 0 THEN 'pending' WHEN 2 THEN 'processing' WHEN 4 THEN 'retry' ELSE 'completed'
    END AS state, CAST(id % 3 AS INT) AS attempts,
  CASE WHEN id % 5 = 0 THEN 'boom' ELSE '' END AS last_error, updated_at AS available_at,
  CASE WHEN id % 8 = 2 THEN updated_at END AS started_at, CAST(NULL AS TIMESTAMP) AS completed_at,
  updated_at FROM listings)"""
_JOB_COLS = ["product_id", "state", "attempts", "last_error", "available_at", "started_at",
             "updated_at"]


def enqueued(spark, sf_dir):
    rows = c.listings(spark, sf_dir).where(_MOD("id", F.lit(3)) == 0).select(
        "marketplace", "product_id",
        F.when(_MOD("id", F.lit(4)) == 0, "changed").otherwise(F.col("search_fingerprint"))
        .alias("classification_fingerprint"))
    return merge.enqueue_work(_jobs(spark, sf_dir), rows, c.NOW).select(*_JOB_COLS)


def recovered(spark, sf_dir):
    jobs = merge.recover_stale(_jobs(spark, sf_dir), "1999-06-01T00:00:00Z", 3600)
    return jobs.select(*_JOB_COLS)


def finished(spark, sf_dir):
    results = c.elsewhere(c.listings(spark, sf_dir), _MOD("id", F.lit(4)) == 2).select(
        "marketplace", "product_id",
        F.when(_MOD("id", F.lit(5)) == 1, F.repeat(F.lit("x"), 1200)).alias("error"))
    started = merge.start_work(_jobs(spark, sf_dir), c.elsewhere(
        c.listings(spark, sf_dir), _MOD("id", F.lit(16)) == 4), c.NOW)
    return merge.finish_work(started, results, c.NOW).select(*_JOB_COLS, "completed_at")


def ready(spark, sf_dir):
    return merge.ready_work(_jobs(spark, sf_dir), c.listings(spark, sf_dir),
                            "1999-01-01T00:00:00Z").select("product_id", "title", "job_updated_at")


def _failures(spark, sf_dir):
    """Detail failures: several per product, from the event log."""
    e = c.event_records(spark, sf_dir)
    n = F.col("record_no")
    return e.where(F.col("event_type") == "error").select(
        "marketplace", "product_id", F.concat(F.lit("q"), _MOD(n, F.lit(3)).cast("string"))
        .alias("query_key"), F.col("price"), F.lit("t").alias("title"),
        F.when(_MOD(n, F.lit(6)) == 0, 503).when(_MOD(n, F.lit(6)) == 1, 404)
        .when(_MOD(n, F.lit(6)) == 2, 429).when(_MOD(n, F.lit(6)) == 3, 410).cast("int")
        .alias("http_status"),
        F.when(_MOD(n, F.lit(6)) < 4, "HTTPError").when(_MOD(n, F.lit(6)) == 4, "ReadTimeout")
        .otherwise(F.when(_MOD(n, F.lit(12)) == 5, "ConnectionError").otherwise("KeyError"))
        .alias("exception_type"),
        _MOD(n, F.lit(3)).cast("int").alias("retry_count"),
        F.concat(F.lit("m"), n.cast("string")).alias("message"), n.alias("failed_at"))


_FAIL_SQL = f"""{c.EVENTS_SQL}, fails AS (SELECT product_id, record_no, 'q' || (record_no % 3) AS
  query_key, CASE record_no % 6 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 410 END
  AS http_status, CASE WHEN record_no % 6 < 4 THEN 'HTTPError' WHEN record_no % 6 = 4
  THEN 'ReadTimeout' WHEN record_no % 12 = 5 THEN 'ConnectionError' ELSE 'KeyError' END
  AS exception_type, CAST(record_no % 3 AS INT) AS retry_count, 'm' || record_no AS message,
  CASE record_no % 6 WHEN 0 THEN '5xx' WHEN 1 THEN '404_or_unavailable' WHEN 2 THEN '429'
    WHEN 3 THEN 'other_4xx' WHEN 4 THEN 'read_timeout' ELSE
    CASE WHEN record_no % 12 = 5 THEN 'connect_timeout' ELSE 'unknown' END END AS cat
  FROM recs WHERE event_type = 'error')"""


def error_classes(spark, sf_dir):
    rows = merge.categorised(_failures(spark, sf_dir))
    return rows.groupBy("error_category", "is_terminal").agg(F.count("*").alias("n"))


def retries(spark, sf_dir):
    stored = conform(_failures(spark, sf_dir).select("marketplace", "product_id").distinct().where(
        _MOD(F.col("product_id").cast("bigint"), F.lit(2)) == 0), RETRIES,
        {"attempts": 4, "retry_count": 7, "is_terminal": False, "query_key": "old"})
    return merge.fold_retries(stored, _failures(spark, sf_dir), c.EVENTS_NOW).select(
        "product_id", "query_key", "attempts", "retry_count", "last_error", "error_category",
        "is_terminal")


def marks(spark, sf_dir):
    e = c.event_records(spark, sf_dir)
    source = F.concat(F.lit("s"), _MOD("record_no", F.lit(7)).cast("string"))
    fresh = e.where(_MOD("record_no", F.lit(7)) > 2).groupBy(
        "marketplace", source.alias("source_key")).agg(F.max("ts").alias("updated_at"))
    stored = e.where(_MOD("record_no", F.lit(7)) < 5).groupBy(
        "marketplace", source.alias("source_key")).agg(F.min("updated_at").alias("updated_at"))
    return merge.merge_watermarks(stored, fresh)


# --- lifecycle -----------------------------------------------------------------

def due(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    tiers = lifecycle.RecheckTiers(recent_age_days=200, medium_age_days=900,
                                   recent_interval_hours=24 * 50,
                                   medium_interval_hours=24 * 300,
                                   older_interval_hours=24 * 1200)
    return lifecycle.due_rechecks(rows, tiers, "2000-01-01T00:00:00Z").select(
        "id", "age_days", "interval_hours")


def sold(spark, sf_dir):
    return lifecycle.sold_transitions(
        c.event_records(spark, sf_dir), F.date_trunc("day", "ts"),
        [F.col("ts"), F.col("record_no")]).select(
        "record_no", "product_id", "last_active_price")


def _job_events(spark, sf_dir):
    e = c.event_records(spark, sf_dir)
    kind = (F.when(F.col("event_type") == "signup", "enqueue")
            .when(F.col("event_type").isin("view", "click"), "start")
            .when(F.col("event_type") == "purchase", "finish").otherwise("fail"))
    return e.select(
        "marketplace", "product_id", F.col("record_no").alias("event_no"), kind.alias("kind"),
        F.col("ts").alias("at"),
        F.when(kind == "enqueue", F.floor(F.col("record_no") / F.lit(4000)).cast("string"))
        .alias("classification_fingerprint"),
        F.when(kind == "fail", F.concat(F.lit("e"), F.col("record_no").cast("string")))
        .alias("error"), "ts")


def folded_queue(spark, sf_dir):
    rows = _job_events(spark, sf_dir)
    return lifecycle.fold_queue(rows, F.date_trunc("day", "ts"), c.EVENTS_NOW).select(
        "product_id", "classification_fingerprint", "state", "attempts", "last_error",
        "available_at")


def notified_once(spark, sf_dir):
    rows = c.event_records(spark, sf_dir)
    states = lifecycle.replay_states(rows, F.date_trunc("day", "ts"),
                                     [F.col("ts"), F.col("record_no")])
    deals = rows.select(
        "marketplace", "product_id", "record_no", "price")
    return lifecycle.notify_once(deals, states, "record_no",
                                 F.floor(F.col("record_no") / F.lit(500)))


def notification_rows(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    return merge.notification_candidates(rows, rows).select("id", "url")


def marked_notified(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    sent = merge.notification_candidates(rows, rows)
    return merge.mark_notified(rows, sent, c.NOW).select("id", "notified_at")


def unseen_products(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    seen = rows.where(_MOD("id", F.lit(3)) == 0)
    waiting = rows.where(_MOD("id", F.lit(5)) == 0).withColumn(
        "is_terminal", _MOD("id", F.lit(2)) == 0)
    return merge.unseen(rows, seen, waiting).select("id")


def repair_rows(spark, sf_dir):
    return merge.repair_candidates(c.listings(spark, sf_dir), 1000,
                                   "all-market-price-backfill:4").select("id", "source_key")


def backlog_rows(spark, sf_dir):
    return merge.backlog_listings(c.listings(spark, sf_dir)).select("id", "title", "price")


def one_product(spark, sf_dir):
    return merge.listing_by_product(c.listings(spark, sf_dir), "bunjang", "7").select(
        "id", "title", "price", "listing_status")


def one_history(spark, sf_dir):
    return merge.observations_of(_stored_observations(spark, sf_dir), "RTX 3070").select(
        "id", "observed_price", "observed_at")


def rescoped(spark, sf_dir):
    """Listings with the scope that the audit derived from their texts."""
    rows = c.listings(spark, sf_dir)
    audit = merge.audit_contamination(_stored_observations(spark, sf_dir), rows,
                                      _verdict_versions(spark, sf_dir), "v6")
    return merge.rescope_listings(rows, audit).select("id", "ai_scope")


def retry_queue(spark, sf_dir):
    """Retryable entries of one query after folding all failures, some products cleared."""
    empty = conform(_failures(spark, sf_dir).where(F.lit(False)), RETRIES)
    folded = merge.fold_retries(empty, _failures(spark, sf_dir), c.EVENTS_NOW)
    done = _failures(spark, sf_dir).where(
        _MOD(F.col("product_id").cast("bigint"), F.lit(4)) == 0).select(
        "marketplace", "product_id").distinct()
    return merge.due_retries(merge.clear_retries(folded, done), "q1").select(
        "product_id", "attempts", "retry_count", "error_category")


def new_rows(spark, sf_dir):
    """Insert-or-ignore of line items per order: first by line number, known orders skipped."""
    lines = c.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey"))
    stored = c.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return merge.insert_or_ignore(stored, lines, ["l_orderkey"], [F.col("l_linenumber")])


QUERIES = {
    "listing_by_product": one_product, "observations_of_product": one_history,
    "rescope_listings": rescoped, "retry_queue": retry_queue, "insert_or_ignore": new_rows,
    "merge_processed": processed, "merge_backfill": backfilled, "merge_backlog": backlogged,
    "merge_repair": repaired, "lifecycle_merge": checked, "mark_unavailable": unavailable,
    "constraint_rejects": violations, "conform_listings": conformed,
    "contamination_audit": audited, "contamination_counts": audit_summary,
    "observation_log": observed, "observation_rebuild": rebuilt, "history_view": history,
    "history_prune": pruned, "already_observed": observed_flags,
    "enqueue_work": enqueued, "recover_stale_work": recovered, "finish_work": finished,
    "ready_work": ready, "error_categories": error_classes, "retry_fold": retries,
    "merge_watermarks": marks, "due_rechecks": due, "sold_transitions": sold,
    "work_queue_state": folded_queue, "notify_once": notified_once,
    "notification_candidates": notification_rows, "mark_notified": marked_notified,
    "unseen_products": unseen_products, "repair_candidates": repair_rows,
    "backlog_listings": backlog_rows,
}

_AUDIT_SQL = f"""{_STORED_SQL},
texts_ AS (SELECT id AS lid, product_id, listing_status, ai_scope,
  {ot.name_case('title')} AS tn, {ot.name_case('description')} AS dn,
  {ot.old_scope_case('title', 'description')} AS ts,
  CASE WHEN id % 3 = 0 THEN CASE WHEN id % 9 = 0 THEN 'old' ELSE 'v6' END END AS ver
  FROM listings),
j AS (SELECT o.*, t.lid IS NOT NULL AS reviewed, COALESCE(ver = 'v6', FALSE) AS cur, tn, dn,
  listing_status, CASE WHEN COALESCE(ver = 'v6', FALSE) THEN ai_scope ELSE ts END AS scope
  FROM obs o LEFT JOIN texts_ t ON o.product_id = t.product_id),
a AS (SELECT *, CASE WHEN listing_status <> 'active' THEN 'listing status is ' || listing_status
  WHEN scope <> 'standalone' THEN 'listing scope is ' || scope
  WHEN NOT {ot.identity('name')} OR NOT (COALESCE(tn = name, FALSE) OR COALESCE(dn = name, FALSE))
    THEN 'normalized product does not match listing text' END AS reason FROM j),
audited AS (SELECT id, CASE WHEN reviewed THEN reason IS NULL ELSE valid END AS valid,
  CASE WHEN reviewed THEN reason ELSE invalid_reason END AS invalid_reason, reviewed,
  CASE WHEN reviewed THEN scope END AS scope, reviewed AND NOT cur AS rescoped FROM a)"""

SQL = {
    "listing_by_product": f"""WITH {c.LISTINGS_SQL} SELECT id, title, price, listing_status
FROM listings WHERE product_id = '7'""",
    "observations_of_product": f"""WITH {_STORED_SQL} SELECT id, observed_price, observed_at
FROM obs WHERE name = 'RTX 3070' AND valid ORDER BY observed_at""",
    "rescope_listings": f"""WITH {_AUDIT_SQL} SELECT l.id, COALESCE(a.scope, l.ai_scope) AS ai_scope
FROM listings l LEFT JOIN (SELECT id, scope FROM audited WHERE rescoped) a ON l.id = a.id""",
    "retry_queue": f"""WITH {_FAIL_SQL}, g AS (SELECT product_id, COUNT(*) AS events,
  SUM(retry_count) AS retries, MAX(record_no) AS last FROM fails GROUP BY 1)
SELECT g.product_id, CAST(events AS INT) AS attempts, CAST(retries + events - 1 AS INT)
  AS retry_count, f.cat AS error_category FROM g JOIN fails f ON g.last = f.record_no
WHERE f.query_key = 'q1' AND f.cat IN ('read_timeout', 'connect_timeout', '429', '5xx')
  AND CAST(g.product_id AS BIGINT) % 4 <> 0""",
    "insert_or_ignore": """WITH g AS (SELECT l_orderkey, l_linenumber, MAX(l_partkey) AS l_partkey
  FROM lineitem GROUP BY 1, 2)
SELECT * FROM g WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1""",
    "merge_processed": f"WITH {_INCOMING_SQL} " + _merged(
        {**_CONTENT, **_LIFE, "effective_price": "i.effective_price",
         "notified_at": "CASE WHEN i.state = 'updated' AND i.price < i.was THEN NULL "
                        "ELSE l.notified_at END"}, _FRESH),
    "merge_backfill": f"WITH {_INCOMING_SQL} " + _merged(_CONTENT, _FRESH),
    "merge_backlog": f"WITH {_INCOMING_SQL} " + _merged(
        {**_CONTENT, **_LIFE, "effective_price": "i.effective_price"}, None,
        "l.notified_at IS NULL"),
    "merge_repair": f"WITH {_INCOMING_SQL} " + _merged({"condition_status": "i.cond"}, None),
    "lifecycle_merge": f"WITH {_INCOMING_SQL} " + _merged({
        "title": "i.title", "condition_status": "i.cond", "listing_status": "i.status",
        "price": "CASE WHEN i.status = 'active' THEN i.price ELSE l.price END",
        "last_active_at": f"CASE WHEN i.status = 'active' THEN {_NOW} ELSE l.last_active_at END",
        "last_active_price": "CASE WHEN i.status = 'active' THEN i.price "
                             "ELSE COALESCE(l.last_active_price, i.price) END",
        "first_sold_seen_at": f"CASE WHEN i.status = 'sold' THEN {_NOW} END"}, None).replace(
        " FROM listings l", ", COALESCE(l.listing_status = 'active' AND i.status = 'sold', FALSE) "
                            "AS became_sold FROM listings l"),
    "mark_unavailable": f"""WITH {_INCOMING_SQL} SELECT l.product_id, l.title, l.price,
  CASE WHEN i.id IS NOT NULL THEN 'unavailable' ELSE l.listing_status END AS listing_status,
  l.condition_status FROM listings l LEFT JOIN inc i ON l.id = i.id
UNION ALL SELECT 'n' || product_id, title, price, 'unavailable', 'unknown' FROM fresh""",
    "constraint_rejects": f"""WITH {c.LISTINGS_SQL}, v AS (SELECT id,
  list_sort(list_filter([CASE WHEN id % 20 = 3 AND price > 0 THEN 'price' END,
    CASE WHEN id % 30 = 4 THEN 'ai_scope' END,
    CASE WHEN id % 40 = 3 THEN 'effective_price' END], lambda x: x IS NOT NULL)) AS v FROM listings)
SELECT id, array_to_string(v, ',') AS violations FROM v WHERE len(v) > 0""",
    "conform_listings": f"""WITH {c.LISTINGS_SQL} SELECT id, listing_id AS product_id,
  url AS canonical_url, CASE WHEN ai_usable_for_market_price THEN price END AS effective_price,
  ai_usable_for_market_price AS ai_usable_price,
  CASE WHEN listing_status = 'active' THEN COALESCE(last_active_at, first_seen_at)
    ELSE last_active_at END AS last_active_at,
  CASE WHEN listing_status = 'active' THEN price END AS last_active_price,
  'unknown' AS condition_status, FALSE AS ai_reject FROM listings""",
    "contamination_audit": f"WITH {_AUDIT_SQL} SELECT * FROM audited",
    "contamination_counts": f"""WITH {_AUDIT_SQL} SELECT COUNT(*) FILTER (WHERE reviewed)
  AS reviewed, COUNT(*) FILTER (WHERE reviewed AND NOT valid) AS invalidated FROM audited""",
    "observation_log": f"""WITH {c.LISTINGS_SQL} SELECT product_id,
  ai_normalized_product_name AS normalized_product_name, effective_price AS observed_price,
  updated_at AS observed_at, first_seen_at, TRUE AS valid FROM listings
WHERE listing_status = 'active' AND ai_scope = 'standalone' AND ai_usable_for_market_price
  AND ai_usable_price AND effective_price > 0 AND id % 3 <> 0""",
    "observation_rebuild": f"""WITH {_STORED_SQL},
named AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'RTX 4070 SUPER' ELSE 'RTX 4060 Ti' END AS nm,
  {ot.name_case('title')} AS tn, {ot.name_case('description')} AS dn FROM listings),
good AS (SELECT * FROM named WHERE listing_status = 'active' AND condition_status = 'normal'
  AND ai_scope = 'standalone' AND COALESCE(ai_is_computer_part, FALSE) AND NOT ai_reject
  AND ai_usable_for_market_price AND ai_confidence >= 0.5
  AND (COALESCE(tn = nm, FALSE) OR COALESCE(dn = nm, FALSE)))
SELECT COALESCE(o.product_id, g.product_id) AS product_id, COALESCE(o.name, g.nm)
  AS normalized_product_name, COALESCE(g.price, o.observed_price) AS observed_price,
  COALESCE(o.observed_at, g.updated_at) AS observed_at, g.id IS NOT NULL AS valid,
  CASE WHEN g.id IS NULL THEN '{merge.REBUILD_REASON}' END AS invalid_reason
FROM obs o FULL JOIN good g ON o.product_id = g.product_id AND o.name = g.nm
  AND o.observed_at = g.updated_at""",
    "history_view": f"""WITH {_STORED_SQL} SELECT product_id, name AS normalized_product_name,
  observed_price, observed_at, id AS price_observation_id FROM obs WHERE valid""",
    "history_prune": f"WITH {_STORED_SQL} SELECT id AS price_observation_id FROM obs WHERE valid",
    "already_observed": f"""WITH {_STORED_SQL} SELECT l.id, EXISTS (SELECT 1 FROM obs o
  WHERE o.product_id = l.product_id AND o.name = 'RTX 3070') AS observed FROM listings l""",
    "enqueue_work": f"""WITH {_JOBS_SQL}, cand AS (SELECT product_id, CASE WHEN id % 4 = 0
  THEN 'changed' ELSE search_fingerprint END AS fp FROM listings WHERE id % 3 = 0)
SELECT COALESCE(j.product_id, k.product_id) AS product_id,
  CASE WHEN j.id IS NULL OR k.fp <> j.classification_fingerprint THEN 'pending' ELSE j.state END
    AS state,
  CASE WHEN j.id IS NULL OR k.fp <> j.classification_fingerprint THEN 0 ELSE j.attempts END
    AS attempts,
  CASE WHEN j.id IS NULL OR k.fp <> j.classification_fingerprint THEN '' ELSE j.last_error END
    AS last_error,
  CASE WHEN j.id IS NULL OR k.fp <> j.classification_fingerprint THEN {_NOW} ELSE j.available_at
    END AS available_at, j.started_at,
  CASE WHEN k.fp IS NULL THEN j.updated_at ELSE {_NOW} END AS updated_at
FROM jobs j FULL JOIN cand k ON j.product_id = k.product_id""",
    "recover_stale_work": f"""WITH {_JOBS_SQL}, s AS (SELECT *, state = 'processing'
  AND started_at < TIMESTAMP '1999-05-31 23:00:00' AS stale FROM jobs)
SELECT product_id, CASE WHEN stale THEN 'retry' ELSE state END AS state, attempts,
  CASE WHEN stale AND last_error = '' THEN 'stale processing recovery' ELSE last_error END
    AS last_error,
  CASE WHEN stale THEN TIMESTAMP '1999-06-01' ELSE available_at END AS available_at,
  CASE WHEN NOT stale THEN started_at END AS started_at,
  CASE WHEN stale THEN TIMESTAMP '1999-06-01' ELSE updated_at END AS updated_at FROM s""",
    "finish_work": f"""WITH {_JOBS_SQL}, st AS (SELECT *, id % 16 = 4 AS begun,
  id % 4 = 2 AS done, id % 4 = 2 AND id % 5 = 1 AS failed FROM jobs)
SELECT product_id, CASE WHEN failed THEN 'retry' WHEN done THEN 'completed' WHEN begun
  THEN 'processing' ELSE state END AS state,
  attempts + CASE WHEN begun THEN 1 ELSE 0 END AS attempts,
  CASE WHEN failed THEN repeat('x', 1000) WHEN done THEN '' ELSE last_error END AS last_error,
  CASE WHEN failed THEN {_NOW} + INTERVAL 10 MINUTE ELSE available_at END AS available_at,
  CASE WHEN done THEN NULL WHEN begun THEN {_NOW} ELSE started_at END AS started_at,
  CASE WHEN done OR begun THEN {_NOW} ELSE updated_at END AS updated_at,
  CASE WHEN done AND NOT failed THEN {_NOW} END AS completed_at FROM st""",
    "ready_work": f"""WITH {_JOBS_SQL} SELECT l.product_id, l.title, j.updated_at
  AS job_updated_at FROM jobs j JOIN listings l ON j.product_id = l.product_id
WHERE j.state IN ('pending', 'retry') AND j.available_at <= TIMESTAMP '1999-01-01'""",
    "error_categories": f"""WITH {_FAIL_SQL} SELECT cat AS error_category,
  cat NOT IN ('read_timeout', 'connect_timeout', '429', '5xx') AS is_terminal, COUNT(*) AS n
FROM fails GROUP BY 1, 2""",
    "retry_fold": f"""WITH {_FAIL_SQL}, g AS (SELECT product_id, COUNT(*) AS events,
  SUM(retry_count) AS retries, MAX(record_no) AS last FROM fails GROUP BY 1)
SELECT g.product_id, f.query_key,
  CAST(events + CASE WHEN CAST(g.product_id AS BIGINT) % 2 = 0 THEN 4 ELSE 0 END AS INT)
    AS attempts,
  CAST(retries + events + CASE WHEN CAST(g.product_id AS BIGINT) % 2 = 0 THEN 7 ELSE -1 END
    AS INT) AS retry_count,
  f.exception_type || ': ' || f.message AS last_error, f.cat AS error_category,
  f.cat NOT IN ('read_timeout', 'connect_timeout', '429', '5xx') AS is_terminal
FROM g JOIN fails f ON g.last = f.record_no""",
    "merge_watermarks": f"""WITH {c.EVENTS_SQL},
fresh AS (SELECT 's' || (record_no % 7) AS k, MAX(ts) AS u FROM recs WHERE record_no % 7 > 2
  GROUP BY 1),
stored AS (SELECT 's' || (record_no % 7) AS k, MIN(updated_at) AS u FROM recs
  WHERE record_no % 7 < 5 GROUP BY 1)
SELECT 'bunjang' AS marketplace, COALESCE(s.k, f.k) AS source_key,
  COALESCE(date_trunc('second', f.u), s.u) AS updated_at FROM stored s FULL JOIN fresh f
  ON s.k = f.k""",
    "due_rechecks": f"""WITH {c.LISTINGS_SQL}, a AS (SELECT *, greatest(0.0,
  (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(first_seen_at)) / 86400000000.0) AS age_days
  FROM listings WHERE listing_status = 'active' AND ai_scope = 'standalone'
    AND condition_status = 'normal' AND COALESCE(ai_is_computer_part, FALSE) AND NOT ai_reject),
b AS (SELECT *, CASE WHEN age_days <= 200 THEN 1200.0 WHEN age_days <= 900 THEN 7200.0
  ELSE 28800.0 END::DOUBLE AS interval_hours FROM a)
SELECT id, age_days, interval_hours FROM b
WHERE epoch_us(TIMESTAMP '2000-01-01') - epoch_us(last_active_at) >= interval_hours * 3600000000""",
    "sold_transitions": f"""WITH {c.EVENTS_SQL}, w AS (SELECT *,
  lag(listing_status) OVER p AS before,
  last_value(CASE WHEN listing_status = 'active' THEN price END IGNORE NULLS) OVER (
    PARTITION BY product_id ORDER BY ts, record_no ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) AS last_active_price
  FROM recs WINDOW p AS (PARTITION BY product_id ORDER BY ts, record_no))
SELECT record_no, product_id, last_active_price FROM w
WHERE listing_status = 'sold' AND before = 'active'""",
    "work_queue_state": f"""WITH {c.EVENTS_SQL},
ev AS (SELECT product_id, record_no AS n, ts, CASE event_type WHEN 'signup' THEN 'enqueue'
  WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' ELSE 'fail' END
  AS kind, CASE WHEN event_type = 'signup' THEN CAST(CAST(floor(record_no / 4000.0) AS BIGINT)
    AS VARCHAR) END AS fp FROM recs),
cur AS (SELECT product_id, arg_max(fp, n) AS fp FROM ev WHERE kind = 'enqueue' GROUP BY 1),
cutoff AS (SELECT c.product_id, c.fp, MAX(CASE WHEN e.fp <> c.fp THEN e.n END) AS x
  FROM cur c JOIN ev e ON e.product_id = c.product_id AND e.kind = 'enqueue' GROUP BY 1, 2),
since AS (SELECT c.product_id, c.fp, MIN(e.n) AS n0 FROM cutoff c JOIN ev e
  ON e.product_id = c.product_id AND e.kind = 'enqueue' AND e.n > COALESCE(c.x, -1) GROUP BY 1, 2),
live AS (SELECT e.*, c.fp AS now_fp FROM ev e JOIN since c USING (product_id) WHERE e.n >= c.n0),
w AS (SELECT *, last_value(CASE WHEN kind <> 'enqueue' THEN kind END IGNORE NULLS) OVER (
  PARTITION BY product_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM live),
ok AS (SELECT * FROM w WHERE kind <> 'start' OR prev IS NULL OR prev = 'fail'),
g AS (SELECT product_id, ANY_VALUE(now_fp) AS fp,
  arg_max(kind, n) FILTER (WHERE kind <> 'enqueue') AS last,
  COUNT(*) FILTER (WHERE kind = 'start') AS attempts,
  MAX(ts) FILTER (WHERE kind = 'start') AS started, MAX(ts) FILTER (WHERE kind = 'fail') AS failed,
  MAX(n) FILTER (WHERE kind = 'fail') AS fail_no,
  MIN(ts) FILTER (WHERE kind = 'enqueue') AS queued FROM ok GROUP BY 1),
z AS (SELECT *, COALESCE(last = 'start' AND started < {c.EVENTS_NOW_SQL} - INTERVAL 900 SECOND,
  FALSE) AS stale FROM g)
SELECT product_id, fp AS classification_fingerprint, CASE WHEN last IS NULL THEN 'pending'
  WHEN last = 'finish' THEN 'completed' WHEN last = 'fail' OR stale THEN 'retry'
  ELSE 'processing' END AS state, CAST(attempts AS INT) AS attempts,
  CASE WHEN last IN ('fail', 'start') AND fail_no IS NOT NULL THEN 'e' || fail_no
    WHEN stale THEN 'stale processing recovery' ELSE '' END AS last_error,
  CASE WHEN stale THEN {c.EVENTS_NOW_SQL} ELSE COALESCE(failed + INTERVAL 10 MINUTE, queued) END
    AS available_at FROM z""",
    "notify_once": f"""WITH {c.EVENTS_SQL}, w AS (SELECT *,
  lag((updated_at, price, search_fingerprint)) OVER p AS was, lag(price) OVER p AS was_price
  FROM recs WINDOW p AS (PARTITION BY product_id ORDER BY ts, record_no)),
e AS (SELECT *, SUM(CASE WHEN was IS NOT NULL AND was <> (updated_at, price, search_fingerprint)
  AND price < was_price THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY record_no)
  AS epoch FROM w)
SELECT marketplace, product_id, record_no, price FROM e
QUALIFY row_number() OVER (PARTITION BY product_id, epoch ORDER BY record_no) = 1""",
    "notification_candidates": f"""WITH {c.LISTINGS_SQL} SELECT id, url FROM listings
WHERE listing_status = 'active' AND ai_scope = 'standalone' AND notified_at IS NULL""",
    "mark_notified": f"""WITH {c.LISTINGS_SQL} SELECT id, CASE WHEN listing_status = 'active'
  AND ai_scope = 'standalone' AND notified_at IS NULL THEN {_NOW} ELSE notified_at END
  AS notified_at FROM listings""",
    "unseen_products": f"""WITH {c.LISTINGS_SQL} SELECT id FROM listings WHERE id % 3 <> 0
  AND NOT (id % 5 = 0 AND id % 2 = 1)""",
    "repair_candidates": f"""WITH {c.LISTINGS_SQL} SELECT id, source_key FROM listings
WHERE id > 1000 AND source_key LIKE 'all-market-price-backfill:4%'""",
    "backlog_listings": f"""WITH {c.LISTINGS_SQL} SELECT id, title, price FROM listings
WHERE notified_at IS NULL""",
}
