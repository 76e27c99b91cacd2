"""Bargains, digest and audit over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deals, estimator
from ..session import stage_table
from . import common as c

MINIMUM = 10.0


def _estimates(spark, sf_dir, names=None):
    return estimator.estimate_prices(
        c.observations(spark, sf_dir), c.manual_prices(spark, sf_dir), now=c.NOW, names=names)


def ranked_deals(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    found = deals.find_deals(rows, _estimates(spark, sf_dir), MINIMUM)
    return found.select("id", "normalized_name", "price", "effective_price", "reference_price",
                        "discount_percent")


def deal_lines(spark, sf_dir):
    found = deals.find_deals(c.listings(spark, sf_dir), _estimates(spark, sf_dir), MINIMUM)
    return deals.deal_text(found).select("id", "line")


def estimate_lines(spark, sf_dir):
    return deals.estimate_text(_estimates(spark, sf_dir)).select("source", "line")


def reference_estimates(spark, sf_dir):
    """Estimates only for the products that comparable listings need."""
    names = deals.reference_names(c.listings(spark, sf_dir))
    return _estimates(spark, sf_dir, names).select(
        estimator.NAME, "price", "valid_observation_count", "automatic")


def _reviews(spark, sf_dir):
    o = c.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return c.elsewhere(o.withColumn("product_id", key.cast("string")), F.pmod(key, F.lit(3)) == 0).select(
        "product_id",
        F.when(F.pmod(key, F.lit(2)) == 0, (F.pmod(key, F.lit(200)) / F.lit(200.0)))
        .alias("second_stage_confidence"),
        F.when(F.pmod(key, F.lit(5)) != 1, F.col("o_orderpriority")).otherwise("  ")
        .alias("reason"))


def deal_digest(spark, sf_dir):
    estimates = stage_table(_estimates(spark, sf_dir), "digest-prices")
    found = deals.find_deals(c.listings(spark, sf_dir), estimates, MINIMUM, ordered=False)
    return deals.digest(found, deals.pricing_sources(estimates), _reviews(spark, sf_dir))


def pricing_audit(spark, sf_dir):
    return deals.audit_rows(c.listings(spark, sf_dir), _estimates(spark, sf_dir), MINIMUM)


def audit_lines(spark, sf_dir):
    rows = deals.audit_rows(c.listings(spark, sf_dir), _estimates(spark, sf_dir), MINIMUM)
    return deals.audit_text(rows).select("product_id", "line")


QUERIES = {
    "deals_ranked": ranked_deals,
    "deal_lines": deal_lines,
    "estimate_lines": estimate_lines,
    "reference_estimates": reference_estimates,
    "deal_digest": deal_digest,
    "pricing_audit": pricing_audit,
    "pricing_audit_lines": audit_lines,
}

_PRICES = f"""{c.LISTINGS_SQL}, {c.OBS_SQL}, {c.MANUAL_SQL}, {c.estimate_sql()},
prices AS (SELECT e.name, CASE WHEN n >= 5 THEN weighted_median ELSE m.price END AS price, n,
  n >= 5 AS automatic, oldest, newest FROM est e LEFT JOIN manual m ON e.name = m.name)"""

_DEALS = f"""{_PRICES},
deals AS (SELECT l.*, p.name AS normalized_name, p.price AS reference_price, p.automatic,
    CAST(p.price - l.effective_price AS DOUBLE) / CAST(p.price AS DOUBLE) * 100.0
      AS discount_percent
  FROM listings l JOIN prices p ON l.ai_normalized_product_name = p.name
  WHERE {c.COMPARABLE_SQL} AND p.price IS NOT NULL
    AND CAST(p.price - l.effective_price AS DOUBLE) / CAST(p.price AS DOUBLE) * 100.0 >= {MINIMUM})"""


def _won(column: str) -> str:
    return f"(format('{{:,}}', {column}) || ' KRW')"


_AUDIT = f"""{_PRICES},
audit AS (SELECT l.product_id, l.title, l.price AS displayed_price, l.effective_price AS eff,
    {c.COMPARABLE_SQL} AS cmp, l.ai_normalized_product_name AS nm, l.condition_status,
    l.ai_confidence AS confidence, p.price AS ref, p.automatic AS auto,
    CAST(p.price - l.effective_price AS DOUBLE) / CAST(p.price AS DOUBLE) * 100.0 AS d
  FROM listings l LEFT JOIN prices p ON l.ai_normalized_product_name = p.name),
rows_ AS (SELECT product_id, title, displayed_price,
    CASE WHEN cmp AND ref IS NOT NULL THEN eff END AS effective_price,
    CASE WHEN cmp THEN nm END AS normalized_name, condition_status, confidence,
    CASE WHEN NOT cmp THEN 'unavailable' WHEN auto THEN 'automatic' ELSE 'manual' END
      AS reference_source,
    CASE WHEN cmp THEN ref END AS reference_price,
    CASE WHEN cmp AND ref IS NOT NULL THEN d END AS discount_percent,
    CASE WHEN NOT cmp THEN 'rejected' WHEN ref IS NULL THEN 'no_reference_price'
      WHEN d >= {MINIMUM} THEN 'bargain' ELSE 'below_discount_threshold' END AS final_decision
  FROM audit)"""

SQL = {
    "deals_ranked": f"""WITH {_DEALS} SELECT id, normalized_name, price, effective_price,
  reference_price, discount_percent FROM deals ORDER BY discount_percent DESC, id""",
    "deal_lines": f"""WITH {_DEALS} SELECT id, normalized_name || ' | displayed ' || {_won('price')}
  || ' | effective ' || {_won('COALESCE(NULLIF(effective_price, 0), price)')}
  || ' | reference ' || {_won('reference_price')} || ' | '
  || printf('%.1f', discount_percent) || '% cheaper | ' || source_type || ' | ' || location
  || ' | ' || url AS line FROM deals""",
    "estimate_lines": f"""WITH {_PRICES} SELECT
  CASE WHEN automatic THEN 'automatic' ELSE 'manual_fallback' END AS source,
  'MARKET_PRICE | ' || name || ' | price=' || COALESCE({_won('price')}, 'unavailable')
  || ' | valid_observations=' || n || ' | estimator='
  || CASE WHEN automatic THEN 'weighted_median' ELSE 'manual_fallback' END || ' | source='
  || CASE WHEN automatic THEN 'automatic' ELSE 'manual_fallback' END
  || ' | oldest=' || strftime(oldest, '%Y-%m-%dT%H:%M:%SZ')
  || ' | newest=' || strftime(newest, '%Y-%m-%dT%H:%M:%SZ') AS line FROM prices""",
    "reference_estimates": f"""WITH {_PRICES}, names AS (
  SELECT DISTINCT ai_normalized_product_name AS name FROM listings WHERE {c.COMPARABLE_SQL})
SELECT s.name AS normalized_product_name, COALESCE(p.price, m.price) AS price,
  COALESCE(p.n, 0) AS valid_observation_count, COALESCE(p.automatic, FALSE) AS automatic
FROM names s LEFT JOIN prices p ON s.name = p.name LEFT JOIN manual m ON s.name = m.name""",
    "deal_digest": f"""WITH {_DEALS},
reviews AS (SELECT CAST(o_orderkey AS VARCHAR) AS product_id,
    CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 200) / 200.0::DOUBLE END AS second,
    CASE WHEN o_orderkey % 5 <> 1 THEN o_orderpriority ELSE '  ' END AS reason
  FROM orders WHERE o_orderkey % 3 = 0)
SELECT row_number() OVER (ORDER BY discount_percent DESC, id) AS position, d.product_id,
  normalized_name AS product, {_won('price')} AS displayed_price,
  {_won('COALESCE(NULLIF(effective_price, 0), price)')} AS effective_price,
  {_won('reference_price')} AS reference_price,
  printf('%.1f', discount_percent) || '%' AS discount, condition_status AS condition,
  COALESCE(printf('%.1f', ai_confidence * 100) || '%', 'Not available') AS confidence,
  COALESCE(printf('%.1f', r.second * 100) || '%', 'Not available') AS second_confidence,
  COALESCE(NULLIF(trim(r.reason), ''), 'Not available') AS review_reason,
  CASE WHEN automatic THEN 'automatic' ELSE 'manual' END AS pricing_source, url AS link
FROM deals d LEFT JOIN reviews r ON d.product_id = r.product_id""",
    "pricing_audit": f"""WITH {_AUDIT} SELECT * FROM rows_""",
    "pricing_audit_lines": f"""WITH {_AUDIT} SELECT product_id,
  'AI_LISTING | product_id=' || product_id || ' | title=' || title ||
  CASE WHEN reference_price IS NULL THEN ' | price=' || {_won('displayed_price')}
      || ' | normalized=' || COALESCE(normalized_name, '-')
    ELSE ' | displayed_price=' || {_won('displayed_price')} || ' | effective_price='
      || {_won('effective_price')} || ' | normalized=' || normalized_name END
  || ' | condition=' || condition_status || ' | confidence=' || printf('%.2f', confidence)
  || ' | reference_source=' || reference_source
  || CASE WHEN reference_price IS NULL THEN ' | reference_price=- | discount_percent=-'
    ELSE ' | reference_price=' || {_won('reference_price')} || ' | discount_percent='
      || printf('%.1f', discount_percent) END
  || ' | final_decision=' || final_decision AS line FROM rows_""",
}
