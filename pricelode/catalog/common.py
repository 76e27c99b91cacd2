"""Shared inputs of the registered queries, as DataFrames and as SQL text.

Both forms derive the library's tables (listings, observations, jobs, verdicts) from the
whole given tables, so the work of every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

NOW = "2001-09-01T00:00:00Z"
NOW_SQL = "TIMESTAMP '2001-09-01 00:00:00'"
EVENTS_NOW = "2024-01-31T00:00:00Z"
EVENTS_NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

# Own listing titles: one for every product-name pattern, then bare models, parts without a
# name, and titles for the listing scopes.
TITLES = [
    "RTX 3080 화이트", "3070 Ti 두 팬", "RTX3070 미니", "RTX 3060 Ti 레드", "4060ti 새 상품", "rtx 4060 한 달 씀",
    "RX 7800 XT 실버", "7700xt 저소음", "RX6800XT 레퍼런스", "rx 6700 xt 이팬", "4070 super 백색",
    "라이젠 7 7800X3D 멀티팩", "Ryzen 5800X3D 쿨러 없음", "ryzen 7 5700x3d 알뜰", "라이젠7700X 국내 유통",
    "Ryzen 5 7600X 직구", "라이젠 5 7600 테이프 그대로", "라이젠 7500F 트레이", "Ryzen 7 5700X 한정", "라이젠5 5600X 급처",
    "ryzen 5600 저렴히", "core i7-14700K 새것급", "i5 14600k 교체분", "13700K 인텔", "i5-13600K 여분", "core i7 12700k 예비",
    "12600K 남는 것", "DDR5 32GB 방열판", "ddr5 64기가 두 장", "990 PRO 2TB 발열판", "Samsung 980 PRO 2테라",
    "WD Black SN850X 2TB 게임용", "SK hynix Platinum P41 2TB", "NVMe 2TB 저장장치", "B650 어로스", "B550 토마호크",
    "Z790 에이스", "B760 프라임", "Samsung 980 SSD 500GB 미사용", "삼성 980 500기가 두 개",
    "13600k", "5600", "DDR4 16GB 한 장", "GTX 1660 두 개", "기계식 키보드", "RX 580 아이스",
    "RTX 3070 구합니다", "RTX 4060 달린 노트북", "TUF gaming F15 4060", "RTX 3070 박스", "RTX 3070 풀박스 구성",
    "PC 부품 모음 4060", "조립 컴퓨터 RTX 3060 Ti", "라이젠 5600 보드 세트", "Ryzen 5600 + 램 16기가", "데스크탑 RTX 3080 정리",
]

# Own descriptions: one for every condition rule, then some without any, and part lists.
NOTES = [
    "고장 없습니다 깨끗함", "불량 아님 보증 가능", "파손 없고 깔끔", "오늘까지 정상 동작", "문제 없음 바로 사용",
    "it is broken since may", "defective unit", "damaged in transit", "not working at all", "it doesn't work here",
    "no power on my board", "it won't turn on", "needs repair soon", "parts only please", "sold for parts", "total junk",
    "dead card", "팬 고장", "램 불량", "모서리 파손", "작동 안됨", "작동 불가 상태", "전원 안 들어옴", "전원 불량 의심",
    "수리 필요", "부품용 으로 가져가세요", "정크 물건", "고장품 그대로",
    "small display issue", "fan noise at night", "artifacts in games", "artefacts in games", "overheating in summer",
    "intermittent failure", "two bent pins", "water damage inside", "cracked pcb corner", "pcb crack seen", "화면 이상 조금",
    "출력 이상 있음", "팬 소음 큼", "아티팩트 보임", "발열 심함", "여름에 과열", "간헐 멈춤", "핀 휨 하나", "침수 이력",
    "액체 유입 흔적", "기판 크랙", "pcb 균열",
    "unknown working condition", "working condition unknown", "untested", "not tested yet", "as is sale", "no return",
    "작동 미확인", "작동여부 미확인", "미테스트 물건", "테스트 안 함", "확인 못함", "정확히 확인은 안 해봄", "정확하지 않음",
    "잘 될 거라고 봄", "사용 상태 미확인", "현상태 판매", "노클레임", "노리턴", "as-is",
    "", "상자와 설명서 함께", "보증 석 달 남음", "bought last spring, quiet card",
    "CPU: 7600\nRAM: 32기가\nSSD: 1테라", "라이젠과 DDR5, B650 보드, NVMe, 650W 파워, 윈도우 11", "RTX 3070 Ti 아님",
]


def _combined() -> list[tuple[int, str, str]]:
    """As many rows as notes and titles together: each note once, each title once more."""
    rows = [(TITLES[k % len(TITLES)], note) for k, note in enumerate(NOTES)]
    rows += [(title, NOTES[-1 - k % 7]) for k, title in enumerate(TITLES)]
    return [(k, *row) for k, row in enumerate(rows)]


TEXTS = _combined()
TEXT_COUNT = len(TEXTS)


def elsewhere(rows: DataFrame, mine, key: str = "product_id") -> DataFrame:
    """All rows, those that aren't ``mine`` under a product of another name: they take part and match nothing."""
    return rows.withColumn(key, F.when(mine, F.col(key)).otherwise(F.concat(F.lit("other "), F.col(key))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


TEXTS_SQL = "texts(k, title, description) AS (VALUES " + ", ".join(
    f"({k}, {_quoted(t)}, {_quoted(d)})" for k, t, d in TEXTS) + ")"


def texts(spark: SparkSession) -> DataFrame:
    """The own text rows; a build side of fixed size (TEXT_COUNT rows)."""
    return F.broadcast(spark.createDataFrame(TEXTS, "k int, title string, description string"))


# --- observations from lineitem and part -----------------------------------

def observations(spark: SparkSession, sf_dir: str, name: str = "p_brand") -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(name).alias("_name"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.lit("bunjang").alias("marketplace"),
        F.col("l_orderkey").cast("string").alias("product_id"),
        F.col("_name").alias("normalized_product_name"),
        F.floor("l_extendedprice").alias("observed_price"),
        F.col("l_shipdate").alias("observed_at"),
        "l_linenumber", "l_suppkey")


OBS_SQL = """obs AS (SELECT p.p_brand AS name, CAST(floor(l.l_extendedprice) AS BIGINT) AS price,
  l.l_shipdate AS seen FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def manual_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(
        F.col("p_brand").alias("normalized_product_name")).agg(
        F.min(F.floor("p_retailprice")).alias("price"))


MANUAL_SQL = """manual AS (SELECT p_brand AS name, MIN(CAST(floor(p_retailprice) AS BIGINT)) AS price
  FROM part GROUP BY 1)"""


def estimate_sql(window_days: int = 90, half_life: float = 21.0, source: str = "obs",
                 prefix: str = "") -> str:
    """CTEs ending in ``{prefix}est(name, n, weighted_median, weighted_mean, oldest, newest)``."""
    p = prefix
    return f"""
{p}recent AS (SELECT name, price, seen,
    greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(seen)) / 86400000000.0) AS age
  FROM {source} WHERE seen >= {NOW_SQL} - INTERVAL {window_days} DAY AND price > 0),
{p}centre AS (SELECT name, COUNT(*) AS n, median(price) AS c FROM {p}recent GROUP BY name),
{p}spread AS (SELECT r.name, median(abs(r.price - c.c)) AS mad
  FROM {p}recent r JOIN {p}centre c USING (name) GROUP BY r.name),
{p}used AS (SELECT r.*, CAST(pow(0.5, r.age / {half_life}) AS DECIMAL(14,12)) AS w
  FROM {p}recent r JOIN {p}centre c USING (name) JOIN {p}spread s USING (name)
  WHERE c.n < 3 OR s.mad = 0 OR abs(r.price - c.c) / (1.4826 * s.mad) <= 3.5),
{p}byprice AS (SELECT name, price, SUM(w) AS w FROM {p}used GROUP BY name, price),
{p}cum AS (SELECT name, price, SUM(w) OVER (PARTITION BY name ORDER BY price
    ROWS UNBOUNDED PRECEDING) AS run, SUM(w) OVER (PARTITION BY name) AS total FROM {p}byprice),
{p}med AS (SELECT name, MIN(price) AS weighted_median FROM {p}cum WHERE 2 * run >= total
  GROUP BY name),
{p}est AS (SELECT u.name, COUNT(*) AS n, ANY_VALUE(m.weighted_median) AS weighted_median,
    CAST(round_even(SUM(u.price * CAST(u.w AS DOUBLE)) / SUM(CAST(u.w AS DOUBLE)), 0) AS BIGINT)
      AS weighted_mean, MIN(u.seen) AS oldest, MAX(u.seen) AS newest
  FROM {p}used u JOIN {p}med m ON u.name = m.name GROUP BY u.name)"""


# --- listings from orders ---------------------------------------------------

def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classified listing per order; AI columns vary with the keys."""
    o = spread(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    rows = o.join(texts(spark), F.pmod(F.col("o_custkey"), F.lit(TEXT_COUNT)) == F.col("k"))
    at = F.col("o_orderdate").cast("timestamp")
    price = F.floor("o_totalprice")
    reject = F.pmod(key, F.lit(11)) == 0
    usable = F.pmod(key, F.lit(7)) != 0
    return rows.select(
        key.alias("id"), F.lit("bunjang").alias("marketplace"),
        key.cast("string").alias("product_id"),
        F.concat(F.lit("bunjang:"), key.cast("string")).alias("listing_id"),
        F.concat(F.lit("https://m.bunjang.co.kr/products/"), key.cast("string")).alias("url"),
        F.when(F.pmod(key, F.lit(4)) == 0, "").otherwise(
            F.concat(F.lit("https://m.bunjang.co.kr/products/"), key.cast("string")))
        .alias("canonical_url"),
        "title", "description", price.alias("price"), F.lit("").alias("location"),
        F.lit("bunjang_search").alias("source_type"),
        F.concat(F.lit("all-market-price-backfill:"), F.pmod("o_custkey", F.lit(9)).cast("string"))
        .alias("source_key"), at.alias("updated_at"),
        F.sha2(F.col("o_orderpriority"), 256).alias("search_fingerprint"),
        F.when(F.col("o_orderstatus") == "O", "active")
        .when(F.col("o_orderstatus") == "P", "reserved").otherwise("sold")
        .alias("listing_status"),
        F.when(F.pmod(key, F.lit(13)) == 0, "risky").otherwise("normal").alias("condition_status"),
        F.when(F.pmod(key, F.lit(5)) == 0, "bundle").otherwise("standalone").alias("ai_scope"),
        F.when(F.pmod(key, F.lit(17)) == 0, "unknown").otherwise("active")
        .alias("ai_sale_status"),
        F.when(F.pmod(key, F.lit(19)) != 0, F.lit(True)).alias("ai_is_computer_part"),
        F.concat(F.lit("Brand#"), (F.pmod("o_custkey", F.lit(30)) + 1).cast("string"))
        .alias("ai_normalized_product_name"),
        ((F.pmod(key, F.lit(100)) + 1) / F.lit(100.0)).alias("ai_confidence"),
        reject.alias("ai_reject"), F.lit("").alias("ai_reason"),
        (usable & ~reject).alias("ai_usable_for_market_price"),
        F.when(usable, F.floor(F.col("o_totalprice") / F.lit(8.0))).alias("effective_price"),
        (usable & ~reject).alias("ai_usable_price"),
        at.alias("first_seen_at"),
        F.when(F.col("o_orderstatus") != "P", at).alias("last_active_at"),
        F.lit(None).cast("timestamp").alias("first_sold_seen_at"),
        F.when(F.col("o_orderstatus") == "O", price).alias("last_active_price"),
        F.when(F.pmod(key, F.lit(6)) == 0, at + F.expr("INTERVAL 1 DAY")).alias("notified_at"))


LISTINGS_SQL = TEXTS_SQL + f""",
listings AS (SELECT o_orderkey AS id, 'bunjang' AS marketplace,
  CAST(o_orderkey AS VARCHAR) AS product_id, 'bunjang:' || o_orderkey AS listing_id,
  'https://m.bunjang.co.kr/products/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'https://m.bunjang.co.kr/products/' || o_orderkey END
    AS canonical_url,
  t.title, t.description, CAST(floor(o_totalprice) AS BIGINT) AS price, '' AS location,
  'bunjang_search' AS source_type,
  'all-market-price-backfill:' || (o_custkey % 9) AS source_key,
  CAST(o_orderdate AS TIMESTAMP) AS updated_at, sha256(o_orderpriority) AS search_fingerprint,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'reserved' ELSE 'sold' END
    AS listing_status,
  CASE WHEN o_orderkey % 13 = 0 THEN 'risky' ELSE 'normal' END AS condition_status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'bundle' ELSE 'standalone' END AS ai_scope,
  CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE 'active' END AS ai_sale_status,
  CASE WHEN o_orderkey % 19 <> 0 THEN TRUE END AS ai_is_computer_part,
  'Brand#' || (o_custkey % 30 + 1) AS ai_normalized_product_name,
  (o_orderkey % 100 + 1) / 100.0::DOUBLE AS ai_confidence,
  o_orderkey % 11 = 0 AS ai_reject, '' AS ai_reason,
  o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS ai_usable_for_market_price,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 8.0) AS BIGINT) END
    AS effective_price,
  o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS ai_usable_price,
  CAST(o_orderdate AS TIMESTAMP) AS first_seen_at,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS last_active_at,
  CAST(NULL AS TIMESTAMP) AS first_sold_seen_at,
  CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) END
    AS last_active_price,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY END
    AS notified_at
  FROM orders o JOIN texts t ON o.o_custkey % {TEXT_COUNT} = t.k)"""

COMPARABLE_SQL = """(listing_status = 'active' AND ai_sale_status IN ('active', 'unknown')
  AND ai_scope = 'standalone' AND NOT ai_reject AND COALESCE(ai_is_computer_part, FALSE)
  AND ai_usable_for_market_price AND ai_usable_price AND COALESCE(effective_price, 0) > 0)"""


# --- event log --------------------------------------------------------------

def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as search records: product = user, price = value, status from the type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("bunjang").alias("marketplace"), F.col("user_id").cast("string").alias("product_id"),
        F.col("event_id").alias("record_no"),
        F.floor(F.col("value") / F.lit(10.0)).alias("price"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("updated_at"),
        F.when(F.col("event_type") == "purchase", "sold")
        .when(F.col("event_type") == "error", "reserved").otherwise("active")
        .alias("listing_status"),
        F.sha2(F.when(F.col("event_type") == "signup", "b").otherwise("a"), 256)
        .alias("search_fingerprint"),
        F.col("ts").cast("timestamp").alias("ts"), "event_type")


EVENTS_SQL = """recs AS (SELECT 'bunjang' AS marketplace, CAST(user_id AS VARCHAR) AS product_id,
  event_id AS record_no, CAST(floor(value / 10.0) AS BIGINT) AS price,
  date_trunc('day', CAST(ts AS TIMESTAMP)) AS updated_at,
  CASE event_type WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'reserved' ELSE 'active' END
    AS listing_status,
  sha256(CASE WHEN event_type = 'signup' THEN 'b' ELSE 'a' END) AS search_fingerprint,
  CAST(ts AS TIMESTAMP) AS ts, event_type FROM events)"""

EVENT_CHUNK = "date_trunc('day', ts)"
