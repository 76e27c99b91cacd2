"""Streaming forms over the event files, and listing cards from pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.estimator import NAME
from ..session import fresh_path
from ..schemas import table_schema
from ..sources import pages as pg
from ..streaming import batches, stateful
from . import common as c
from .maintenance import SQL as _MAINTENANCE

QUEUE_SQL = _MAINTENANCE["work_queue_state"]

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _stream(spark, sf_dir):
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(
        f"{sf_dir}/events*.parquet")
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.lit("bunjang").alias("marketplace"), F.col("user_id").cast("string").alias("product_id"),
        F.col("event_id").alias("record_no"),
        F.floor(F.col("value") / F.lit(10.0)).alias("price"),
        F.date_trunc("day", at).alias("updated_at"),
        F.when(F.col("event_type") == "purchase", "sold")
        .when(F.col("event_type") == "error", "reserved").otherwise("active")
        .alias("listing_status"),
        F.sha2(F.when(F.col("event_type") == "signup", "b").otherwise("a"), 256)
        .alias("search_fingerprint"), at.alias("ts"), "event_type")


def change_detection(spark, sf_dir):
    out = batches.drain_to_table(stateful.change_states(_stream(spark, sf_dir)), "changes")
    return out.select("record_no", "product_id", "state", "previous_price")


def transitions(spark, sf_dir):
    out = batches.drain_to_table(stateful.lifecycle_transitions(_stream(spark, sf_dir)), "sold")
    return out.select("record_no", "product_id", "last_active_price")


def watermarks(spark, sf_dir):
    table = batches.VersionedTable(
        spark, fresh_path(spark, "marks"),
        table_schema("marketplace string, source_key string, updated_at timestamp"))
    stream = _stream(spark, sf_dir).withColumn("source_key", F.col("event_type")).withColumn(
        "updated_at", F.col("ts"))
    query = batches.drain(stream, batches.advance_watermarks(table), "marks")
    return table.read(query.lastProgress["batchId"])


_OBSERVED = table_schema("marketplace string, product_id string, "
                         "normalized_product_name string, observed_price bigint, "
                         "observed_at timestamp")


def _observations(spark, sf_dir):
    return _stream(spark, sf_dir).select(
        "marketplace", "product_id", F.col("event_type").alias(NAME),
        F.col("price").alias("observed_price"), F.col("ts").alias("observed_at"))


def price_refresh(spark, sf_dir):
    obs = batches.AppendedBatches(spark, fresh_path(spark, "observations"), _OBSERVED)
    est = batches.AppendedBatches(spark, fresh_path(spark, "estimates"), table_schema(
        f"{NAME} string, price bigint, valid_observation_count bigint, estimator string, "
        "automatic boolean, oldest_observed_at timestamp, newest_observed_at timestamp, "
        "version bigint"))
    batches.drain(_observations(spark, sf_dir), batches.refresh_prices(
        obs, est, None, now=c.EVENTS_NOW), "prices")
    return batches.latest_estimates(est).select(
        NAME, "price", "valid_observation_count", "automatic")


def backfill(spark, sf_dir):
    keys = table_schema("marketplace string, product_id string")
    seen = batches.AppendedBatches(spark, fresh_path(spark, "seen"), keys)
    obs = batches.AppendedBatches(spark, fresh_path(spark, "backfilled"), _OBSERVED)
    batches.drain(_observations(spark, sf_dir), batches.resumable_backfill(seen, obs), "backfill")
    return obs.read().select("product_id", NAME, "observed_price", "observed_at")


def duplicates(spark, sf_dir):
    """First record per product inside the watermark delay, longer than the log."""
    stream = _stream(spark, sf_dir).withColumn("updated_at", F.col("ts"))
    out = batches.drain_to_table(stateful.first_per_product(stream, "60 days"), "unique")
    return out.select("product_id")


def alerts(spark, sf_dir):
    """Alerts per product and day, each sent once."""
    schema = table_schema("marketplace string, product_id string, epoch bigint")
    sent = batches.AppendedBatches(spark, fresh_path(spark, "sent"), schema)
    stream = _stream(spark, sf_dir).select(
        "marketplace", "product_id", F.unix_date(F.col("ts").cast("date")).cast("bigint")
        .alias("epoch"))
    batches.drain(stream, batches.alert_once(sent, lambda rows: None), "alerts")
    return sent.read().select("product_id", "epoch")


def queue(spark, sf_dir):
    """Work-queue state of the event log after its only micro-batch."""
    rows = _stream(spark, sf_dir)
    kind = (F.when(F.col("event_type") == "signup", "enqueue")
            .when(F.col("event_type").isin("view", "click"), "start")
            .when(F.col("event_type") == "purchase", "finish").otherwise("fail"))
    events = rows.select(
        "marketplace", "product_id", "record_no", kind.alias("kind"), F.col("ts").alias("at"),
        F.when(kind == "enqueue", F.floor(F.col("record_no") / F.lit(4000)).cast("string"))
        .alias("classification_fingerprint"))
    path = fresh_path(spark, "queue")
    states = stateful.queue_states(events, stale_seconds=10 ** 6)
    # A stream with processing-time timers always has a next batch, so it is run once.
    query = (states.writeStream.outputMode("update").trigger(once=True)
             .option("checkpointLocation", f"{path}/state")
             .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/b{i}"))
             .start())
    query.awaitTermination()
    return spark.read.parquet(f"{path}/b0").select("product_id", "state", "attempts")


# --- pages -------------------------------------------------------------------

def _card_pages(spark, sf_dir):
    """Stored pages with twenty listing cards each, built from orders, behind real page HTML."""
    o = c.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    link = F.concat(F.lit('<a href="/kr/buy-sell/item-'), (key % 17).cast("string"), F.lit("-"),
                    F.floor(key / F.lit(20)).cast("string"), F.lit('/?from=list">'))
    price = F.format_number(F.floor("o_totalprice"), 0)
    n = key % 4
    card = (
        F.when(n == 0, F.concat(F.lit("<article>"), link, F.lit("<h2>Item <b>"),
                                key.cast("string"), F.lit("</b></h2></a><span class='price'>"),
                                price, F.lit("원</span><span class='location'>Seoul · 1h</span>"
                                             "</article>")))
        .when(n == 1, F.concat(F.lit("<li>"), link, F.lit("<span>Part "), key.cast("string"),
                               F.lit("</span><span>·</span><span>"), price,
                               F.lit("원</span><span>Busan</span></a></li>")))
        .when(n == 2, F.concat(F.lit("<li>"), link, F.lit('<img alt=" Pic '), key.cast("string"),
                               F.lit('"></a><span>나눔</span></li>')))
        .otherwise(F.concat(F.lit("<li>"), link, F.lit('<img alt=" Pic '), key.cast("string"),
                            F.lit('"></a><div data-testid="card-price">'), price,
                            F.lit("원</div></li>"))))
    # Twenty orders per page by construction, so the collected list is small.
    groups = o.groupBy(F.floor(key / F.lit(20)).cast("bigint").alias("page_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"),
                                                                     card.alias("c")))),
                                 lambda x: x["c"]), "").alias("cards"))
    base = c.table(spark, sf_dir, "pages").select(F.col("page_id").alias("_p"), "html")
    size = base.agg(F.count("*")).scalar()
    rows = groups.withColumn("_n", size).withColumn("_p", F.pmod("page_id", "_n")).join(base, "_p")
    return rows.select(
        "page_id", F.lit("https://www.example.com/kr/buy-sell/s/?q=x").alias("url"),
        F.concat("html", F.lit("<ul>"), "cards", F.lit("</ul>")).alias("html"),
        F.lit("index").alias("source_type"), F.lit("Nowhere").alias("default_location"))


def cards(spark, sf_dir):
    out = pg.listing_cards(_card_pages(spark, sf_dir), 5)
    return out.select("page_id", "position", "url", "title", "price", "location", "listing_id",
                      "description")


def rejected_pages(spark, sf_dir):
    """Stored pages with a listing link each, some with markup that no parser takes."""
    p = c.table(spark, sf_dir, "pages")
    broken = F.when(F.col("page_id") % 3 == 0, "<![x]]>").when(F.col("page_id") % 3 == 1, "<![ x").otherwise("")
    rows = p.select("page_id", "url", F.concat(F.lit('<a href="/articles/1">x</a>'), broken, "html").alias("html"),
                    F.lit("index").alias("source_type"), F.lit("").alias("default_location"))
    return pg.page_rejects(pg.link_facts(rows)).select(
        "page_id", "url", F.substring_index("reject", ":", 1).alias("reject"))


def descriptions(spark, sf_dir):
    """Item-list descriptions written into the stored pages, two blocks per page, one malformed."""
    p = c.table(spark, sf_dir, "pages")
    entry = F.struct(F.struct(
        F.concat(F.lit("/kr/buy-sell/p-"), F.col("page_id").cast("string"), F.lit("/?x=1"))
        .alias("url"), F.concat(F.lit(" text of "), F.col("url")).alias("description"))
        .alias("item"))
    lists = F.to_json(F.struct(F.array(entry, entry).alias("itemListElement")))
    script = '<script type="application/ld+json">'
    rows = p.select("page_id", F.lit("https://www.example.com/kr/").alias("url"), F.concat(
        "html", F.lit(script), lists, F.lit("</script>"), F.lit(script + "{bad</script>"))
        .alias("html"))
    return pg.page_descriptions(rows)


def meta(spark, sf_dir):
    p = c.table(spark, sf_dir, "pages")
    rows = p.select("page_id", "url", F.when(
        F.col("page_id") % 2 == 0, F.concat(
            F.lit('<meta content=" a &amp; b '), F.col("page_id").cast("string"),
            F.lit(' " name="description">'), F.col("html"))).otherwise(F.col("html"))
        .alias("html"))
    return pg.meta_descriptions(rows).select("page_id", "description")


QUERIES = {
    "stream_change_detection": change_detection, "stream_lifecycle": transitions,
    "stream_watermarks": watermarks, "stream_price_refresh": price_refresh,
    "stream_backfill": backfill, "stream_duplicates": duplicates, "stream_alerts": alerts,
    "stream_work_queue": queue, "html_cards": cards, "page_rejects": rejected_pages, "page_descriptions": descriptions,
    "meta_descriptions": meta,
}

_REFRESH = c.estimate_sql(source="obs").replace(c.NOW_SQL, c.EVENTS_NOW_SQL)

SQL = {
    "stream_change_detection": f"""WITH {c.EVENTS_SQL}, w AS (SELECT *,
  lag((updated_at, price, search_fingerprint)) OVER p AS was, lag(price) OVER p AS was_price
  FROM recs WINDOW p AS (PARTITION BY product_id ORDER BY record_no)),
s AS (SELECT *, CASE WHEN was IS NULL THEN 'new' WHEN was = (updated_at, price, search_fingerprint)
  THEN 'unchanged' ELSE 'updated' END AS state FROM w)
SELECT record_no, product_id, state, CASE WHEN state = 'updated' THEN was_price END
  AS previous_price FROM s""",
    "stream_lifecycle": f"""WITH {c.EVENTS_SQL}, w AS (SELECT *,
  lag(listing_status) OVER p AS before,
  last_value(CASE WHEN listing_status = 'active' THEN price END IGNORE NULLS) OVER (
    PARTITION BY product_id ORDER BY record_no ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) AS last_active_price
  FROM recs WINDOW p AS (PARTITION BY product_id ORDER BY record_no))
SELECT record_no, product_id, last_active_price FROM w
WHERE listing_status = 'sold' AND before = 'active'""",
    "stream_watermarks": """SELECT 'bunjang' AS marketplace, event_type AS source_key,
  date_trunc('second', MAX(CAST(ts AS TIMESTAMP))) AS updated_at FROM events GROUP BY 2""",
    "stream_price_refresh": f"""WITH obs AS (SELECT event_type AS name,
  CAST(floor(value / 10.0) AS BIGINT) AS price, CAST(ts AS TIMESTAMP) AS seen FROM events),
{_REFRESH}
SELECT name AS normalized_product_name, CASE WHEN n >= 5 THEN weighted_median END AS price,
  n AS valid_observation_count, n >= 5 AS automatic FROM est""",
    "stream_backfill": """SELECT CAST(user_id AS VARCHAR) AS product_id,
  event_type AS normalized_product_name, CAST(floor(value / 10.0) AS BIGINT) AS observed_price,
  CAST(ts AS TIMESTAMP) AS observed_at FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, value) = 1""",
    "stream_duplicates": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS product_id FROM events",
    "stream_alerts": """SELECT DISTINCT CAST(user_id AS VARCHAR) AS product_id,
  CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch FROM events""",
    "stream_work_queue": "SELECT product_id, state, attempts FROM (" + QUEUE_SQL.replace(
        f"COALESCE(last = 'start' AND started < {c.EVENTS_NOW_SQL} - INTERVAL 900 SECOND,\n  FALSE)",
        "FALSE") + ") q",
    "html_cards": """WITH k AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 20.0) AS BIGINT)
    AS page_id, 'https://www.example.com/kr/buy-sell/item-' || (o_orderkey % 17) || '-'
    || CAST(floor(o_orderkey / 20.0) AS BIGINT) || '/' AS url,
  CASE o_orderkey % 4 WHEN 0 THEN 'Item ' || o_orderkey WHEN 1 THEN 'Part ' || o_orderkey
    ELSE 'Pic ' || o_orderkey END AS title, CAST(floor(o_totalprice) AS BIGINT) AS price,
  CASE o_orderkey % 4 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'Busan' ELSE 'Nowhere' END AS location
  FROM orders WHERE o_orderkey % 4 <> 2),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY k) = 1)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS position, url, title, price,
  location, split_part(url, '/', -2) AS listing_id, '' AS description FROM d
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) <= 5""",
    "page_rejects": """SELECT page_id, url, 'unreadable markup' AS reject FROM pages WHERE page_id % 3 < 2""",
    "page_descriptions": """SELECT page_id, 'https://www.example.com/kr/buy-sell/p-' || page_id
  || '/' AS url, 'text of ' || url AS description FROM pages""",
    "meta_descriptions": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a & b ' || page_id
  ELSE '' END AS description FROM pages""",
}
