"""Change detection, early stops and ingest over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, lifecycle, ordered
from ..operators.verdict_flow import overlay_detail
from ..sources import search
from . import common as c

PAGE = 60
_SOURCES = 5


def _records(spark, sf_dir):
    """Event records as a paged search log: five sources, sixty records per page, newest first."""
    e = c.event_records(spark, sf_dir)
    back = F.lit(10 ** 9) - F.col("record_no")
    return e.select(
        "marketplace", "product_id", "record_no", "price", "updated_at", "search_fingerprint",
        "listing_status",
        F.concat(F.lit("s"), F.pmod("record_no", F.lit(_SOURCES)).cast("string"))
        .alias("source_key"),
        F.floor(back / F.lit(PAGE * _SOURCES)).cast("bigint").alias("page_no"),
        F.pmod(F.floor(back / F.lit(_SOURCES)), F.lit(PAGE)).cast("bigint").alias("pos"),
        F.concat(F.lit("bunjang:"), F.col("product_id")).alias("listing_id"),
        F.concat(F.lit("https://m.bunjang.co.kr/products/"), F.col("product_id")).alias("url"))


_RECORDS_SQL = f"""{c.EVENTS_SQL}, paged AS (SELECT *, 's' || (record_no % {_SOURCES}) AS source_key,
  CAST(floor((1000000000 - record_no) / {PAGE * _SOURCES}.0) AS BIGINT) AS page_no,
  CAST(floor((1000000000 - record_no) / {_SOURCES}.0) AS BIGINT) % {PAGE} AS pos,
  'bunjang:' || product_id AS listing_id,
  'https://m.bunjang.co.kr/products/' || product_id AS url FROM recs)"""


def _split(spark, sf_dir):
    """(stored rows, new candidates): the log cut at the start of its last third.

    Later records of every third product are candidates too, so some products are unseen.
    """
    rows = _records(spark, sf_dir)
    cut = F.lit("2024-01-21 00:00:00").cast("timestamp")
    first = F.lit("2024-01-04 00:00:00").cast("timestamp")
    known = (F.col("updated_at") < cut) & (
        (F.pmod(F.col("product_id").cast("bigint"), F.lit(3)) != 0)
        | (F.col("updated_at") < first))
    stored = rows.where(known).select(
        F.col("record_no").alias("id"), "marketplace", "product_id", "listing_id", "url", "price",
        "updated_at", "search_fingerprint",
        F.when(F.pmod("record_no", F.lit(4)) != 0, F.lit(True)).alias("ai_is_computer_part"))
    return stored, rows.where(~known)


_SPLIT_SQL = f"""{_RECORDS_SQL},
stored AS (SELECT record_no AS id, *, CASE WHEN record_no % 4 <> 0 THEN TRUE END AS part FROM paged
  WHERE updated_at < TIMESTAMP '2024-01-21' AND (CAST(product_id AS BIGINT) % 3 <> 0
    OR updated_at < TIMESTAMP '2024-01-04')),
cand AS (SELECT * FROM paged WHERE NOT (updated_at < TIMESTAMP '2024-01-21'
  AND (CAST(product_id AS BIGINT) % 3 <> 0 OR updated_at < TIMESTAMP '2024-01-04'))),
latest AS (SELECT * FROM stored QUALIFY row_number() OVER (
  PARTITION BY marketplace, product_id ORDER BY id DESC) = 1)"""


def _verdicts(spark, sf_dir):
    return c.elsewhere(c.event_records(spark, sf_dir), F.pmod("record_no", F.lit(3)) == 1).select(
        F.col("record_no").alias("id"), "marketplace", "product_id",
        (F.pmod("record_no", F.lit(8)) != 0).alias("success"))


def candidate_states(spark, sf_dir):
    stored, cand = _split(spark, sf_dir)
    # Two records in three repeat the newest stored facts of their product.
    facts = ordered.latest_per_key(stored, changes.PRODUCT, "id",
                                   ["updated_at", "price", "search_fingerprint"])
    same = facts.select(*changes.PRODUCT, F.col("updated_at").alias("_u"),
                        F.col("price").alias("_p"), F.col("search_fingerprint").alias("_f"))
    rows = cand.join(same, changes.PRODUCT, "left")
    repeat = (F.pmod("record_no", F.lit(3)) != 0) & F.col("_u").isNotNull()
    rows = rows.select(*[c_ for c_ in cand.columns if c_ not in (
        "updated_at", "price", "search_fingerprint")],
        F.when(repeat, F.col("_u")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(repeat, F.col("_p")).otherwise(F.col("price")).alias("price"),
        F.when(repeat, F.col("_f")).otherwise(F.col("search_fingerprint"))
        .alias("search_fingerprint"))
    out = changes.candidate_state(rows, stored, _verdicts(spark, sf_dir))
    return out.select("record_no", "state", "previous_price")


def known(spark, sf_dir):
    stored, cand = _split(spark, sf_dir)
    odd = F.pmod("record_no", F.lit(2)) == 1
    rows = cand.withColumn("listing_id", F.when(odd, F.col("listing_id")))
    return changes.with_known(rows, stored).select("record_no", "known")


def replay(spark, sf_dir):
    rows = c.event_records(spark, sf_dir)
    out = lifecycle.replay_states(rows, F.date_trunc("day", "ts"),
                                  [F.col("ts"), F.col("record_no")])
    return out.select("record_no", "product_id", "state", "previous_price")


def previous_prices(spark, sf_dir):
    rows = c.event_records(spark, sf_dir)
    return ordered.carried_last(rows, changes.PRODUCT, F.date_trunc("day", "ts"),
                                [F.col("ts"), F.col("record_no")],
                                {"previous_price": F.col("price")}).select(
        "record_no", "price", "previous_price")


def latest_rows(spark, sf_dir):
    return ordered.latest_per_key(c.event_records(spark, sf_dir), changes.PRODUCT, "record_no",
                                  ["record_no", "price", "listing_status"])



def duplicates(spark, sf_dir):
    rows = _records(spark, sf_dir)
    out = changes.mark_duplicates(rows, changes.PRODUCT, [
        F.col("source_key"), F.col("page_no"), F.col("pos"), F.col("record_no")])
    return out.select("record_no", "duplicate")


def per_source_cap(spark, sf_dir):
    return changes.limit_per_source(_records(spark, sf_dir), 150).select(
        "source_key", "page_no", "pos", "record_no")


def sample(spark, sf_dir):
    return changes.sample_records(_records(spark, sf_dir), 40).select("source_key", "record_no")


def ordering(spark, sf_dir):
    """The log is newest first, except that one source is read the wrong way round."""
    rows = _records(spark, sf_dir)
    shuffled = F.when(F.col("source_key") == "s3", F.date_add("updated_at", -F.col("pos")
                                                              .cast("int")))
    return changes.ordering_check(rows.withColumn(
        "updated_at", F.coalesce(shuffled.cast("timestamp"), F.col("updated_at"))))


def known_stop(spark, sf_dir):
    stored, cand = _split(spark, sf_dir)
    some = stored.where(F.pmod(F.col("product_id").cast("bigint"), F.lit(5)) == 0)
    unique = cand.withColumns({
        "listing_id": F.when(F.pmod(F.col("product_id").cast("bigint"), F.lit(5)) == 0,
                             F.col("listing_id")).otherwise(
            F.concat(F.col("listing_id"), F.lit("-"), F.col("record_no").cast("string"))),
        "url": F.concat(F.col("url"), F.lit("/"), F.col("record_no").cast("string"))})
    out = changes.stop_after_known(unique, some, 2)
    return out.select("source_key", "page_no", "pos", "record_no", "known", "stopped")


def watermark_stop(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumns({
        "state": F.when((F.col("updated_at") > F.lit("2024-01-20").cast("timestamp"))
                        & (F.pmod("record_no", F.lit(7)) == 0), "updated").otherwise("unchanged"),
        "duplicate": F.pmod("record_no", F.lit(4)) == 0})
    marks = (rows.groupBy("source_key").agg(F.max("updated_at").alias("m"))
             .where(F.col("source_key") != "s4")
             .select("source_key", F.lit("2024-01-22 12:00:00").cast("timestamp")
                     .alias("updated_at")))
    out = changes.stop_at_watermark(rows, marks, 1)
    return out.select("source_key", "page_no", "pos", "record_no", "stopped_at_watermark")


def counters(spark, sf_dir):
    return changes.scan_counters(_scanned(spark, sf_dir))


def totals(spark, sf_dir):
    return changes.scan_totals(changes.scan_counters(_scanned(spark, sf_dir)))


def _scanned(spark, sf_dir):
    n = F.col("record_no")
    return _records(spark, sf_dir).select(
        "source_key",
        F.when(F.pmod(n, F.lit(4)) == 0, "new").when(F.pmod(n, F.lit(4)) == 1, "updated")
        .when(F.pmod(n, F.lit(4)) == 2, "pending_ai").otherwise("unchanged").alias("state"),
        (F.pmod(n, F.lit(9)) == 0).alias("duplicate"),
        F.when(F.pmod(n, F.lit(11)) == 0, "over_budget")
        .when(F.pmod(n, F.lit(13)) == 0, "irrelevant").alias("reject_reason"),
        (F.pmod(n, F.lit(6)) == 0).alias("observed"))


_SCANNED_SQL = f"""{_RECORDS_SQL}, s AS (SELECT source_key,
  CASE record_no % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'updated' WHEN 2 THEN 'pending_ai'
    ELSE 'unchanged' END AS state, record_no % 9 = 0 AS dup,
  CASE WHEN record_no % 11 = 0 THEN 'over_budget' WHEN record_no % 13 = 0 THEN 'irrelevant' END
    AS rej, record_no % 6 = 0 AS observed FROM paged),
k AS (SELECT source_key, COUNT(*) AS records_fetched,
  COUNT(*) FILTER (WHERE NOT dup AND rej IS NULL AND state = 'new') AS new_count,
  COUNT(*) FILTER (WHERE NOT dup AND rej IS NULL AND state = 'updated') AS updated_count,
  COUNT(*) FILTER (WHERE NOT dup AND rej IS NULL AND state = 'pending_ai') AS pending_ai_count,
  COUNT(*) FILTER (WHERE NOT dup AND rej IS NULL AND state = 'unchanged') AS unchanged_count,
  COUNT(*) FILTER (WHERE dup AND rej IS NULL) AS duplicate_count,
  COUNT(*) FILTER (WHERE rej = 'over_budget') AS over_budget_count,
  COUNT(*) FILTER (WHERE rej = 'irrelevant') AS irrelevant_count,
  COUNT(*) FILTER (WHERE NOT dup AND rej IS NULL AND observed) AS price_observations
  FROM s GROUP BY source_key)"""


def high_marks(spark, sf_dir):
    return changes.high_watermarks(_records(spark, sf_dir).withColumn(
        "updated_at", F.col("updated_at") + F.expr("INTERVAL 0.5 SECOND")))


# --- ingest ------------------------------------------------------------------

def _payloads(spark, sf_dir):
    """Search payload pages rebuilt from the event log, with unusable records mixed in."""
    e = c.event_records(spark, sf_dir)
    n = F.col("record_no")
    record = F.struct(
        F.when(F.pmod(n, F.lit(10)) == 3, "BANNER").otherwise("PRODUCT").alias("type"),
        F.when(F.pmod(n, F.lit(12)) == 5, F.lit(True)).when(
            F.pmod(n, F.lit(12)) == 6, F.lit(False)).alias("ad"),
        F.when(F.pmod(n, F.lit(25)) != 7, n).alias("pid"),
        F.concat(F.lit(" RTX "), F.col("product_id"), F.lit(" ")).alias("name"),
        F.when(F.pmod(n, F.lit(30)) == 11, "ask").when(F.pmod(n, F.lit(30)) == 12, F.lit(None))
        .otherwise(F.col("price").cast("string")).alias("price"),
        F.when(F.pmod(n, F.lit(40)) != 13, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("updatedAt"),
        F.when(F.col("event_type") == "purchase", "SOLD_OUT").otherwise("SELLING")
        .alias("status"))
    page = F.floor(n / F.lit(PAGE)).cast("bigint")
    pages = e.select(F.pmod(page, F.lit(7)).alias("source_no"), page.alias("page_no"), n,
                     record.alias("r"))
    # A page holds at most sixty records, so each collected list is small by construction.
    pages = pages.groupBy("source_no", "page_no").agg(
        F.sort_array(F.collect_list(F.struct("record_no", "r"))).alias("rs"))
    body = F.struct(F.struct(F.struct(F.struct(F.struct(
        F.transform("rs", lambda x: x["r"]).alias("data"), F.lit("next").alias("cursor"))
        .alias("searchResponse")).alias("mainGrid")).alias("responses")).alias("data"))
    return pages.select(F.concat(F.lit("q"), F.col("source_no").cast("string")).alias("source_key"),
                        "page_no", F.to_json(body).alias("payload"))


def ingest(spark, sf_dir):
    judged = search.judged_records(search.search_records(_payloads(spark, sf_dir)), 9)
    rows = search.listings_of(judged)
    return rows.select("source_key", "page_no", "pos", "product_id", "title", "price",
                       "listing_status", "updated_at", "url")


def ingest_counters(spark, sf_dir):
    judged = search.judged_records(search.search_records(_payloads(spark, sf_dir)), 9)
    return search.page_counters(judged, ["source_key", "page_no"])


_INGEST_SQL = f"""{c.EVENTS_SQL}, r AS (SELECT *,
  CAST(floor(record_no / {PAGE}.0) AS BIGINT) AS page_no FROM recs),
j AS (SELECT *, 'q' || (page_no % 7) AS source_key,
  row_number() OVER (PARTITION BY page_no ORDER BY record_no) - 1 AS pos,
  CASE WHEN record_no % 10 = 3 OR record_no % 12 = 5 OR record_no % 25 = 7 OR record_no = 0
    OR record_no % 30 IN (11, 12) OR record_no % 40 = 13 THEN 'irrelevant'
    WHEN price > 9 THEN 'over_budget' END AS rej FROM r)"""


def detail_merge(spark, sf_dir):
    """Search rows overlaid with detail payloads of two records in three."""
    e = c.event_records(spark, sf_dir)
    n = F.col("record_no")
    cand = e.select(
        n.cast("string").alias("product_id"), F.lit("bunjang").alias("marketplace"),
        F.lit("RTX 3070").alias("title"), "price", F.lit("").alias("description"),
        F.lit("active").alias("listing_status"), "updated_at")
    product = F.struct(
        F.when(F.pmod(n, F.lit(5)) != 0, F.concat(F.lit(" RTX "), F.col("product_id")))
        .alias("name"),
        F.when(F.pmod(n, F.lit(4)) == 0, "고장 없음 정상 작동").when(
            F.pmod(n, F.lit(4)) == 1, "fan noise, sold as is").when(
            F.pmod(n, F.lit(4)) == 2, " not working ").alias("description"),
        F.when(F.pmod(n, F.lit(7)) != 0, F.col("price") + 1).alias("price"),
        F.when(F.pmod(n, F.lit(6)) == 0, "SOLD").alias("saleStatus"),
        F.when(F.pmod(n, F.lit(6)) < 3, "RESERVED").alias("status"))
    payload = F.to_json(F.struct(F.struct(product.alias("product")).alias("data")))
    details = search.detail_records(
        e.where(F.pmod(n, F.lit(3)) != 1).select(n.cast("string").alias("product_id"),
                                                 payload.alias("payload")))
    return overlay_detail(cand, details).select(
        "product_id", "title", "price", "description", "listing_status", "condition_status",
        "updated_at")


def first_wins(spark, sf_dir):
    """Insert-or-ignore of line items on two keys: (order, line) and (part, supplier)."""
    lines = c.table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
                        "l_extendedprice", "l_quantity", "l_tax", "l_discount").distinct()
    total = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
             "l_quantity", "l_tax", "l_discount"]
    return ordered.first_wins(rows, [["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]],
                              total)


def _first_wins_sql(rounds: int = 12) -> str:
    """Insert-or-ignore round by round; a row that no round decides comes out as a row of nulls."""
    names = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity",
             "l_tax", "l_discount"]
    columns = ", ".join(names)
    parts = [f"""todo0 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {columns}) AS place
  FROM (SELECT DISTINCT {columns} FROM lineitem))"""]
    for k in range(rounds):
        parts.append(f"""won{k} AS MATERIALIZED (SELECT * FROM todo{k}
  QUALIFY place = MIN(place) OVER (PARTITION BY l_orderkey, l_linenumber)
    AND place = MIN(place) OVER (PARTITION BY l_partkey, l_suppkey)),
todo{k + 1} AS MATERIALIZED (SELECT t.* FROM todo{k} t
  ANTI JOIN won{k} a ON t.l_orderkey = a.l_orderkey AND t.l_linenumber = a.l_linenumber
  ANTI JOIN won{k} b ON t.l_partkey = b.l_partkey AND t.l_suppkey = b.l_suppkey)""")
    chosen = "\nUNION ALL ".join(f"SELECT {columns} FROM won{k}" for k in range(rounds))
    left = ", ".join("NULL" for _ in names)
    return f"WITH {', '.join(parts)}\n{chosen}\nUNION ALL SELECT {left} FROM todo{rounds}"


QUERIES = {
    "candidate_state": candidate_states,
    "known_listings": known,
    "change_replay": replay,
    "previous_price": previous_prices,
    "latest_per_key": latest_rows,
    "cross_source_dedupe": duplicates,
    "first_wins_dedupe": first_wins,
    "per_source_cap": per_source_cap,
    "sample_records": sample,
    "ordering_check": ordering,
    "consecutive_known_stop": known_stop,
    "watermark_overlap_stop": watermark_stop,
    "scan_counters": counters,
    "scan_totals": totals,
    "high_watermarks": high_marks,
    "ingest_search_records": ingest,
    "ingest_counters": ingest_counters,
    "detail_merge": detail_merge,
}

SQL = {
    "first_wins_dedupe": _first_wins_sql(),
    "candidate_state": f"""WITH {_SPLIT_SQL},
v AS (SELECT marketplace, product_id, arg_max(record_no % 8 <> 0, record_no) AS success
  FROM recs WHERE record_no % 3 = 1 GROUP BY 1, 2),
j AS (SELECT c.record_no, l.id IS NULL AS absent, l.price AS was, l.part, v.success,
    CASE WHEN c.record_no % 3 <> 0 AND l.id IS NOT NULL THEN FALSE ELSE
      (c.updated_at, c.price, c.search_fingerprint) IS DISTINCT FROM
      (l.updated_at, l.price, l.search_fingerprint) END AS changed
  FROM cand c LEFT JOIN latest l USING (marketplace, product_id)
  LEFT JOIN v USING (marketplace, product_id)),
s AS (SELECT *, CASE WHEN absent THEN 'new' WHEN changed THEN 'updated' WHEN part IS NULL
  THEN 'pending_ai' WHEN NOT success THEN 'pending_ai' ELSE 'unchanged' END AS state FROM j)
SELECT record_no, state, CASE WHEN state IN ('updated', 'pending_ai') THEN was END
  AS previous_price FROM s""",
    "known_listings": f"""WITH {_SPLIT_SQL} SELECT record_no,
  (record_no % 2 = 1 AND listing_id IN (SELECT listing_id FROM stored))
  OR url IN (SELECT url FROM stored) AS known FROM cand""",
    "change_replay": f"""WITH {c.EVENTS_SQL}, w AS (SELECT *,
  lag((updated_at, price, search_fingerprint)) OVER p AS was, lag(price) OVER p AS was_price
  FROM recs WINDOW p AS (PARTITION BY product_id ORDER BY ts, record_no)),
s AS (SELECT *, CASE WHEN was IS NULL THEN 'new' WHEN was = (updated_at, price, search_fingerprint)
  THEN 'unchanged' ELSE 'updated' END AS state FROM w)
SELECT record_no, product_id, state, CASE WHEN state = 'updated' THEN was_price END
  AS previous_price FROM s""",
    "previous_price": f"""WITH {c.EVENTS_SQL} SELECT record_no, price,
  lag(price) OVER (PARTITION BY product_id ORDER BY ts, record_no) AS previous_price FROM recs""",
    "latest_per_key": f"""WITH {c.EVENTS_SQL} SELECT marketplace, product_id, record_no, price,
  listing_status FROM recs QUALIFY row_number() OVER (PARTITION BY product_id
  ORDER BY record_no DESC) = 1""",
    "cross_source_dedupe": f"""WITH {_RECORDS_SQL} SELECT record_no, row_number() OVER (
  PARTITION BY product_id ORDER BY source_key, page_no, pos, record_no) > 1 AS duplicate
FROM paged""",
    "per_source_cap": f"""WITH {_RECORDS_SQL} SELECT source_key, page_no, pos, record_no FROM paged
QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY page_no, pos) <= 150""",
    "sample_records": f"""WITH {_RECORDS_SQL} SELECT source_key, record_no FROM paged
QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY page_no, pos) <= 40""",
    "ordering_check": f"""WITH {_RECORDS_SQL}, d AS (SELECT source_key, page_no, pos,
  CASE WHEN source_key = 's3' THEN updated_at - to_days(CAST(pos AS INT)) ELSE updated_at END AS u
  FROM paged),
w AS (SELECT source_key, COALESCE(lag(u) OVER (PARTITION BY source_key ORDER BY page_no, pos) >= u,
  TRUE) AS ok FROM d)
SELECT source_key, bool_and(ok) AS monotonic FROM w GROUP BY source_key""",
    "consecutive_known_stop": f"""WITH {_SPLIT_SQL},
k AS (SELECT *, CAST(product_id AS BIGINT) % 5 = 0 AS fifth FROM cand),
f AS (SELECT *, fifth AND (product_id IN (SELECT product_id FROM stored) OR row_number() OVER (
    PARTITION BY source_key, product_id ORDER BY page_no, pos) > 1) AS known,
    row_number() OVER (PARTITION BY source_key ORDER BY page_no, pos) AS rn FROM k),
g AS (SELECT *, rn - COALESCE(MAX(CASE WHEN NOT known THEN rn END) OVER (PARTITION BY source_key
    ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS run FROM f),
s AS (SELECT source_key, MIN(rn) AS stop FROM g WHERE run >= 2 GROUP BY 1)
SELECT g.source_key, page_no, pos, record_no, known, s.stop IS NOT NULL AS stopped
FROM g LEFT JOIN s USING (source_key) WHERE s.stop IS NULL OR rn <= s.stop""",
    "watermark_overlap_stop": f"""WITH {_RECORDS_SQL},
r AS (SELECT *, CASE WHEN updated_at > TIMESTAMP '2024-01-20' AND record_no % 7 = 0
    THEN 'updated' ELSE 'unchanged' END AS state, record_no % 4 = 0 AS dup,
  CASE WHEN source_key <> 's4' THEN TIMESTAMP '2024-01-22 12:00:00' END AS mark FROM paged),
o AS (SELECT *, COALESCE(lag(updated_at) OVER (PARTITION BY source_key ORDER BY page_no, pos)
  >= updated_at, TRUE) AS ok FROM r),
p AS (SELECT source_key, page_no, ANY_VALUE(mark) IS NOT NULL
    AND COALESCE(bool_and(CASE WHEN NOT dup THEN updated_at < mark AND state = 'unchanged' END),
      TRUE) AS all_old, bool_and(ok) AS ok FROM o GROUP BY 1, 2),
q AS (SELECT *, all_old AND bool_and(ok) OVER (PARTITION BY source_key ORDER BY page_no
    ROWS UNBOUNDED PRECEDING) AS b,
  row_number() OVER (PARTITION BY source_key ORDER BY page_no) AS rn FROM p),
g AS (SELECT *, rn - COALESCE(MAX(CASE WHEN NOT b THEN rn END) OVER (PARTITION BY source_key
    ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS run FROM q),
s AS (SELECT source_key, MIN(page_no) AS stop FROM g WHERE run >= 2 GROUP BY 1)
SELECT r.source_key, r.page_no, pos, record_no, s.stop IS NOT NULL AS stopped_at_watermark
FROM r LEFT JOIN s USING (source_key) WHERE s.stop IS NULL OR r.page_no <= s.stop""",
    "scan_counters": f"""WITH {_SCANNED_SQL} SELECT * FROM k""",
    "scan_totals": f"""WITH {_SCANNED_SQL} SELECT """ + ", ".join(
        f"CAST(SUM({n}) AS BIGINT) AS {n}" for n in (
            "records_fetched", "new_count", "updated_count", "pending_ai_count",
            "unchanged_count", "duplicate_count", "over_budget_count", "irrelevant_count",
            "price_observations")) + " FROM k",
    "high_watermarks": f"""WITH {_RECORDS_SQL} SELECT marketplace, source_key,
  MAX(updated_at) AS updated_at FROM paged GROUP BY 1, 2""",
    "ingest_search_records": f"""WITH {_INGEST_SQL} SELECT source_key, page_no, pos,
  CAST(record_no AS VARCHAR) AS product_id, 'RTX ' || product_id AS title, price,
  CASE event_type WHEN 'purchase' THEN 'sold' ELSE 'active' END AS listing_status,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at,
  'https://m.bunjang.co.kr/products/' || record_no AS url FROM j WHERE rej IS NULL""",
    "ingest_counters": f"""WITH {_INGEST_SQL} SELECT source_key, page_no, COUNT(*) AS records,
  COUNT(*) FILTER (WHERE rej = 'irrelevant') AS irrelevant,
  COUNT(*) FILTER (WHERE rej = 'over_budget') AS over_budget FROM j GROUP BY 1, 2""",
    "detail_merge": f"""WITH {c.EVENTS_SQL}
SELECT CAST(record_no AS VARCHAR) AS product_id,
  CASE WHEN record_no % 5 <> 0 THEN 'RTX ' || product_id ELSE 'RTX 3070' END AS title,
  CASE WHEN record_no % 7 <> 0 THEN price + 1 ELSE price END AS price,
  CASE record_no % 4 WHEN 0 THEN '고장 없음 정상 작동' WHEN 1 THEN 'fan noise, sold as is'
    WHEN 2 THEN 'not working' ELSE '' END AS description,
  CASE WHEN record_no % 6 = 0 THEN 'sold' WHEN record_no % 6 < 3 THEN 'reserved' ELSE 'active' END
    AS listing_status,
  CASE record_no % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'risky' WHEN 2 THEN 'broken'
    ELSE 'unknown' END AS condition_status, updated_at
FROM recs WHERE record_no % 3 <> 1""",
}
