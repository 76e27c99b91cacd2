"""Text rules over listing texts joined to every line item, and over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..operators.verdict_flow import cheap_decisions, with_text_names
from ..session import spread
from . import common as c
from . import oracle_text as ot


def line_texts(spark, sf_dir) -> DataFrame:
    """A title and description per line item; even lines add their part's name and number."""
    parts = c.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    lines = c.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_suppkey")
    rows = spread(lines).join(parts, lines.l_partkey == parts.p_partkey).join(
        c.texts(spark), F.pmod("l_partkey", F.lit(c.TEXT_COUNT)) == F.col("k"))
    even = F.col("l_linenumber") % 2 == 0
    key = F.col("l_orderkey").cast("string")
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_linestatus",
        F.when(even, F.concat_ws(" ", "title", "p_name", key)).otherwise(F.col("title"))
        .alias("title"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat_ws(
            " ", "description", F.lit("no."), F.col("l_suppkey").cast("string"), "p_type"))
        .otherwise(F.col("description")).alias("description"))


_KEYS = ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"]

LINES_SQL = c.TEXTS_SQL + f""",
lines AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_linestatus,
  CASE WHEN l_linenumber % 2 = 0 THEN t.title || ' ' || p_name || ' ' || l_orderkey
    ELSE t.title END AS title,
  CASE WHEN l_linenumber % 3 = 0 THEN t.description || ' no. ' || l_suppkey || ' ' || p_type
    ELSE t.description END AS description
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN texts t ON l.l_partkey % {c.TEXT_COUNT} = t.k)"""
_COLS = ", ".join(_KEYS)
_NAMED = f"""{LINES_SQL}, named AS (SELECT *, {ot.name_case('title')} AS title_name,
  {ot.name_case('description')} AS desc_name FROM lines)"""


def product_names(spark, sf_dir):
    rows = line_texts(spark, sf_dir)
    return rows.select(*_KEYS, tx.product_name(F.col("title")).alias("name"))


def exact_evidence(spark, sf_dir):
    rows = with_text_names(line_texts(spark, sf_dir))
    name = F.coalesce("_title_name", "_desc_name", F.lit("RTX 3070"))
    return rows.select(
        *_KEYS, tx.is_pricing_identity(F.col("_title_name")).alias("priceable"),
        tx.exact_model(F.lit("RTX 3070 Ti"), F.col("_title_name"), F.col("_desc_name"))
        .alias("is_3070_ti"),
        tx.name_mismatch(name, F.col("_title_name"), F.col("_desc_name")).alias("mismatch"))


def name_counts(spark, sf_dir):
    rows = line_texts(spark, sf_dir).withColumn("name", tx.product_name(F.col("title")))
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def conditions(spark, sf_dir):
    rows = line_texts(spark, sf_dir)
    return rows.select(*_KEYS, tx.condition_status(F.col("title"), F.col("description"))
                       .alias("condition"))


def scopes(spark, sf_dir):
    rows = line_texts(spark, sf_dir)
    return rows.select(*_KEYS, tx.listing_scope(F.col("title"), F.col("description"))
                       .alias("scope"))


def old_scopes(spark, sf_dir):
    rows = line_texts(spark, sf_dir)
    return rows.select(*_KEYS, tx.historical_scope(F.col("title"), F.col("description"))
                       .alias("scope"))


def labels_and_specs(spark, sf_dir):
    rows = line_texts(spark, sf_dir)
    text = tx.joined_text(F.col("title"), F.col("description"))
    return rows.select(*_KEYS, tx.component_labels(text).cast("bigint").alias("labels"),
                       tx.has_spec_inventory(text).alias("inventory"))


def cheap(spark, sf_dir):
    rows = line_texts(spark, sf_dir).withColumns({
        "listing_status": F.when(F.col("l_linestatus") == "O", "active").otherwise("sold"),
        "condition_status": F.when(F.pmod("l_suppkey", F.lit(10)) == 0, "risky")
        .otherwise("normal")})
    return cheap_decisions(rows).select(*_KEYS, "cheap_scope", "cheap_reason", "standalone_name")


def part_terms(spark, sf_dir):
    rows = line_texts(spark, sf_dir)
    return rows.select(*_KEYS, tx.mentions_part(F.col("title")).alias("is_part"))


def document_rules(spark, sf_dir):
    """Every rule over whole documents: names, part terms, condition and scope."""
    d = spread(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
    title = F.substring_index("text", "\n", 1)
    text = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id", tx.product_name(text).alias("name"), tx.mentions_part(text).alias("is_part"),
        tx.historical_scope(title, text).alias("scope"))


def document_condition(spark, sf_dir):
    """Condition of whole documents in four languages (normalised in Arrow batches)."""
    d = spread(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", tx.condition_status(F.lit(""), F.coalesce("text", F.lit("")))
                    .alias("condition"))


def price_texts(spark, sf_dir):
    o = c.table(spark, sf_dir, "orders")
    shown = F.format_number(F.floor("o_totalprice"), 0)
    text = (F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "나눔")
            .when(F.pmod("o_orderkey", F.lit(7)) == 1, F.concat(shown, F.lit("원 가격 제안")))
            .when(F.pmod("o_orderkey", F.lit(7)) == 2, "가격 문의")
            .otherwise(F.concat(shown, F.lit("원"))))
    return o.select("o_orderkey", tx.price_from_text(text).alias("price"))


def statuses(spark, sf_dir):
    o = c.table(spark, sf_dir, "orders")
    label = (F.when(F.col("o_orderstatus") == "O", F.when(F.col("o_custkey") % 2 == 0, "selling")
                    .otherwise("ON_SALE"))
             .when(F.col("o_orderstatus") == "P", F.when(F.col("o_custkey") % 3 == 0, "Reserving")
                   .when(F.col("o_custkey") % 3 == 1, "HOLD").otherwise("RESERVED"))
             .otherwise(F.when(F.col("o_custkey") % 5 == 0, F.lit(None)).otherwise("sold_out")))
    return o.select("o_orderkey", tx.listing_status(label).alias("status"))


def _stamp_text():
    day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    n = F.pmod("event_id", F.lit(6))
    return (F.when(n == 0, F.concat(day, F.lit("T"), clock, F.lit("Z")))
            .when(n == 1, F.concat(day, F.lit("T"), clock, F.lit("+09:00")))
            .when(n == 2, F.concat(day, F.lit(" "), F.substring(clock, 1, 8)))
            .when(n == 3, day).when(n == 4, F.concat(F.lit("about "), day))
            .otherwise(F.concat(day, F.lit("T"), clock)))


def stamps(spark, sf_dir):
    e = c.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select("event_id", _stamp_text().alias("text"))
    at = times.parse_iso(F.col("text"))
    return rows.select("event_id", times.comparison_text(F.col("text")).alias("compared"),
                       at.alias("parsed"),
                       F.round(times.age_days(at, c.EVENTS_NOW), 6).alias("age_days"))


def links(spark, sf_dir):
    p = c.table(spark, sf_dir, "pages")
    href = (F.when(F.pmod("page_id", F.lit(5)) == 0, F.lit("/kr/buy-sell/item-1/?from=list"))
            .when(F.pmod("page_id", F.lit(5)) == 1, F.lit("next?page=2"))
            .when(F.pmod("page_id", F.lit(5)) == 2, F.lit("//cdn.example.org/x/y?z=1"))
            .when(F.pmod("page_id", F.lit(5)) == 3, F.lit("https://a.example.org/articles/9?q#f"))
            .otherwise(F.lit("?only=query")))
    return p.select("page_id", tx.canonical_page_url(F.col("url"), href).alias("link"))


QUERIES = {
    "product_names": product_names,
    "product_name_counts": name_counts,
    "exact_model_evidence": exact_evidence,
    "condition_status": conditions,
    "listing_scope": scopes,
    "historical_scope": old_scopes,
    "component_labels": labels_and_specs,
    "cheap_rejections": cheap,
    "part_terms": part_terms,
    "document_rules": document_rules,
    "document_condition": document_condition,
    "price_text_parse": price_texts,
    "status_mapping": statuses,
    "timestamp_normalised": stamps,
    "canonical_links": links,
}

_FOLDED, _CONDITION = ot.condition_case("title", "description")
_JOINED = ot.joined("title", "description")
_HITS = {k: ot.matches(_JOINED, p) for k, p in ot.fixed.SPEC_SIGNALS.items()}
_DOC_FOLDED, _DOC_CONDITION = ot.condition_case("''", "COALESCE(text, '')")

_STAMP_SQL = """CASE event_id % 6
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
  WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+09:00'
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d')
  WHEN 4 THEN 'about ' || strftime(ts, '%Y-%m-%d')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"""

SQL = {
    "product_names": f"""WITH {LINES_SQL} SELECT {_COLS}, {ot.name_case('title')} AS name
FROM lines""",
    "product_name_counts": f"""WITH {LINES_SQL} SELECT {ot.name_case('title')} AS name,
  COUNT(*) AS n FROM lines GROUP BY 1""",
    "exact_model_evidence": f"""WITH {_NAMED}, chosen AS (SELECT *,
  COALESCE(title_name, desc_name, 'RTX 3070') AS name FROM named)
SELECT {_COLS}, {ot.identity('title_name')} AS priceable,
  COALESCE(title_name = 'RTX 3070 Ti', FALSE) OR COALESCE(desc_name = 'RTX 3070 Ti', FALSE)
    AS is_3070_ti,
  NOT {ot.identity('name')} OR NOT (COALESCE(title_name = name, FALSE)
    OR COALESCE(desc_name = name, FALSE)) AS mismatch FROM chosen""",
    "condition_status": f"""WITH {LINES_SQL}, f AS (SELECT *, {_FOLDED} AS folded FROM lines)
SELECT {_COLS}, {_CONDITION} AS condition FROM f""",
    "listing_scope": f"""WITH {LINES_SQL}
SELECT {_COLS}, {ot.scope_case('title', 'description')} AS scope FROM lines""",
    "historical_scope": f"""WITH {LINES_SQL}
SELECT {_COLS}, {ot.old_scope_case('title', 'description')} AS scope FROM lines""",
    "component_labels": f"""WITH {LINES_SQL} SELECT {_COLS},
  len(list_distinct(list_transform(regexp_extract_all({_JOINED},
    {ot.quote(ot.fixed.COMPONENT_LABEL)}, 1), lambda x: lower(x)))) AS labels,
  (({' + '.join(f'CAST({h} AS INT)' for h in _HITS.values())}) >= 3
    AND ({' OR '.join(_HITS[k] for k in ot.fixed.PLATFORM_SIGNALS)}))
  OR ({' AND '.join(_HITS[k] for k in ot.fixed.SYSTEM_SIGNALS)}) AS inventory FROM lines""",
    "cheap_rejections": f"""WITH {_NAMED}, s AS (SELECT *,
  {ot.scope_case('title', 'description')} AS cheap_scope,
  CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'sold' END AS st,
  CASE WHEN l_suppkey % 10 = 0 THEN 'risky' ELSE 'normal' END AS cond FROM named),
r AS (SELECT *, CASE WHEN st <> 'active' THEN 'rule-based listing status is ' || st
  WHEN cond <> 'normal' THEN 'rule-based condition status is ' || cond
  WHEN cheap_scope IS NOT NULL THEN 'rule-based listing scope is ' || cheap_scope
  WHEN NOT {ot.part_test(_JOINED)} THEN 'rule-based computer-part match missing'
  WHEN title_name <> desc_name THEN 'rule-based model mismatch between title and description'
  END AS cheap_reason FROM s)
SELECT {_COLS}, cheap_scope, cheap_reason, CASE WHEN cheap_reason IS NULL
  AND (desc_name IS NULL OR desc_name = title_name) THEN title_name END AS standalone_name
FROM r""",
    "part_terms": f"""WITH {LINES_SQL} SELECT {_COLS}, {ot.part_test('title')} AS is_part
FROM lines""",
    "document_rules": f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS text,
  split_part(text, chr(10), 1) AS title FROM documents)
SELECT doc_id, {ot.name_case('text')} AS name, {ot.part_test('text')} AS is_part,
  {ot.old_scope_case('title', 'text')} AS scope FROM d""",
    "price_text_parse": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 2
  THEN CAST(floor(o_totalprice) AS BIGINT) END AS price FROM orders""",
    "status_mapping": """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active'
  WHEN 'P' THEN CASE WHEN o_custkey % 3 = 1 THEN 'unavailable' ELSE 'reserved' END
  ELSE CASE WHEN o_custkey % 5 = 0 THEN 'unavailable' ELSE 'sold' END END AS status FROM orders""",
    "timestamp_normalised": f"""WITH t AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
  {_STAMP_SQL} AS text FROM events),
p AS (SELECT *, CASE event_id % 6 WHEN 1 THEN ts - INTERVAL 9 HOUR
  WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts)
  WHEN 4 THEN NULL ELSE ts END AS parsed FROM t)
SELECT event_id, CASE WHEN parsed IS NULL THEN text ELSE
  strftime(parsed, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 6 < 2 THEN 'Z' ELSE '' END
  END AS compared, parsed,
  round(greatest(0.0, (epoch_us({c.EVENTS_NOW_SQL}) - epoch_us(parsed)) / 86400000000.0), 6)
    AS age_days FROM p""",
    "canonical_links": """SELECT page_id, CASE page_id % 5
  WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/kr/buy-sell/item-1/'
  WHEN 1 THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/[^/]*$', '') || '/next'
  WHEN 2 THEN regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example.org/x/y'
  WHEN 3 THEN 'https://a.example.org/articles/9'
  ELSE regexp_extract(url, '^([^?#]*)', 1) END AS link FROM pages""",
    "document_condition": f"""WITH f AS (SELECT doc_id, text, {_DOC_FOLDED} AS folded
  FROM documents) SELECT doc_id, {_DOC_CONDITION} AS condition FROM f""",
}
