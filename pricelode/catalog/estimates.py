"""Price estimates over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimator
from . import common as c

NAME = estimator.NAME


def weighted_median(spark, sf_dir):
    return estimator.estimate_prices(
        c.observations(spark, sf_dir), c.manual_prices(spark, sf_dir), now=c.NOW)


def weighted_mean(spark, sf_dir):
    return estimator.estimate_prices(
        c.observations(spark, sf_dir), c.manual_prices(spark, sf_dir), now=c.NOW,
        estimator="weighted_mean")


def by_part(spark, sf_dir):
    """Long window by part key: many products, most of them near the minimum count."""
    obs = c.observations(spark, sf_dir, "p_partkey").withColumn(
        NAME, F.col(NAME).cast("string"))
    return estimator.estimate_prices(obs, None, now=c.NOW, window_days=400, half_life_days=90)


#: Days by which the aged products lie behind, and the price of their one new row.
LATE_DAYS, LATE_PRICE = (1700, 3300), 900_000_000


def aged_observations(spark, sf_dir):
    """Line items by part, once as they are and twice as products of long ago with one new outlier each."""
    obs = c.observations(spark, sf_dir, "p_partkey").withColumn(NAME, F.col(NAME).cast("string"))
    obs = obs.select(NAME, "observed_price", F.col("observed_at").cast("timestamp").alias("observed_at"))
    parts = c.table(spark, sf_dir, "part")
    out = obs
    for days in LATE_DAYS:
        old = F.col("observed_at") - F.make_dt_interval(F.lit(days - 1000))
        name = F.concat(F.lit(f"late {days} "), F.col(NAME))
        newest = F.to_timestamp(F.lit("2001-08-31 00:00:00"))
        out = out.unionByName(obs.select(name.alias(NAME), "observed_price", old.alias("observed_at")))
        out = out.unionByName(parts.select(
            F.concat(F.lit(f"late {days} "), F.col("p_partkey").cast("string")).alias(NAME),
            F.lit(LATE_PRICE).cast("bigint").alias("observed_price"), newest.alias("observed_at")))
    return out


def long_window(spark, sf_dir):
    """Ten years at a half-life of three weeks: many parts have old observations only, or those
    and an outlier far newer than they are."""
    return estimator.estimate_prices(aged_observations(spark, sf_dir), None, now=c.NOW, window_days=3650,
                                     half_life_days=21, estimator="weighted_mean")


def long_window_median(spark, sf_dir):
    return estimator.estimate_prices(aged_observations(spark, sf_dir), None, now=c.NOW, window_days=3650, half_life_days=21)


def long_window_wide(spark, sf_dir):
    return estimator.estimate_prices(aged_observations(spark, sf_dir), None, now=c.NOW, window_days=3650,
                                     half_life_days=21, wide_products=True)


def long_window_both(spark, sf_dir):
    return estimator.estimate_both(aged_observations(spark, sf_dir), now=c.NOW, window_days=3650)


def wide(spark, sf_dir):
    return estimator.estimate_prices(
        c.observations(spark, sf_dir), c.manual_prices(spark, sf_dir), now=c.NOW,
        wide_products=True)


def both(spark, sf_dir):
    return estimator.estimate_both(c.observations(spark, sf_dir), now=c.NOW)


def used(spark, sf_dir):
    obs = c.observations(spark, sf_dir).select(NAME, "observed_price", "observed_at",
                                               "product_id", "l_linenumber", "l_suppkey")
    return estimator.used_observations(obs, now=c.NOW)


def counts(spark, sf_dir):
    obs = c.observations(spark, sf_dir)
    return estimator.estimate_counts(estimator.estimate_prices(
        obs, c.manual_prices(spark, sf_dir), now=c.NOW, minimum_observations=150))


QUERIES = {
    "price_estimate_weighted_median": weighted_median,
    "price_estimate_weighted_mean": weighted_mean,
    "price_estimate_by_part": by_part,
    "price_estimate_long_window": long_window,
    "price_estimate_long_window_median": long_window_median,
    "price_estimate_long_window_wide": long_window_wide,
    "price_estimate_long_window_both": long_window_both,
    "price_estimate_wide_products": wide,
    "price_estimate_both": both,
    "price_used_observations": used,
    "price_estimate_counts": counts,
}


def _report(estimator_name: str) -> str:
    return f"""WITH {c.OBS_SQL}, {c.MANUAL_SQL}, {c.estimate_sql()}
SELECT e.name AS normalized_product_name,
  CASE WHEN n >= 5 THEN {estimator_name} ELSE m.price END AS price,
  n AS valid_observation_count,
  CASE WHEN n >= 5 THEN '{estimator_name}' ELSE 'manual_fallback' END AS estimator,
  n >= 5 AS automatic, oldest AS oldest_observed_at, newest AS newest_observed_at
FROM est e LEFT JOIN manual m ON e.name = m.name"""


_LATE = " UNION ALL ".join(
    f"""SELECT 'late {days} ' || name, price, seen - INTERVAL {days - 1000} DAY FROM plain
  UNION ALL SELECT 'late {days} ' || p_partkey, {LATE_PRICE}, TIMESTAMP '2001-08-31 00:00:00' FROM part""" for days in LATE_DAYS)

#: Weights as doubles relative to the newest row that is left, as no fixed digits hold ten years.
_RELATIVE = f"""WITH plain AS (SELECT CAST(l_partkey AS VARCHAR) AS name,
  CAST(floor(l.l_extendedprice) AS BIGINT) AS price, CAST(l.l_shipdate AS TIMESTAMP) AS seen
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey), obs AS (SELECT * FROM plain UNION ALL {_LATE})"""


def _relative(source: str) -> str:
    return f"""relative AS (SELECT name, price, seen, pow(0.5, (age - MIN(age) OVER (PARTITION BY name)) / 21.0) AS w
  FROM {source}),
prices AS (SELECT name, price, SUM(w) AS w FROM relative GROUP BY name, price),
running AS (SELECT name, price, SUM(w) OVER (PARTITION BY name ORDER BY price ROWS UNBOUNDED PRECEDING) AS run,
  SUM(w) OVER (PARTITION BY name) AS total FROM prices),
medians AS (SELECT name, MIN(price) FILTER (2 * run >= total) AS median FROM running GROUP BY name),
means AS (SELECT name, COUNT(*) AS n, MIN(seen) AS oldest, MAX(seen) AS newest,
  CAST(round_even(SUM(price * w) / SUM(w), 0) AS BIGINT) AS mean FROM relative GROUP BY name)"""


def _long_report(value: str, label: str) -> str:
    return f"""{_RELATIVE}, {c.estimate_sql(3650, 21.0)}, {_relative('used')}
SELECT name AS normalized_product_name, CASE WHEN n >= 5 THEN {value} END AS price,
  n AS valid_observation_count, CASE WHEN n >= 5 THEN '{label}' ELSE 'manual_fallback' END AS estimator,
  n >= 5 AS automatic, oldest AS oldest_observed_at, newest AS newest_observed_at FROM means JOIN medians USING (name)"""


SQL = {
    "price_estimate_weighted_median": _report("weighted_median"),
    "price_estimate_weighted_mean": _report("weighted_mean"),
    "price_estimate_wide_products": _report("weighted_median"),
    "price_estimate_by_part": f"""WITH obs AS (SELECT CAST(l_partkey AS VARCHAR) AS name,
  CAST(floor(l.l_extendedprice) AS BIGINT) AS price, l.l_shipdate AS seen
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey), {c.estimate_sql(400, 90.0)}
SELECT name AS normalized_product_name, CASE WHEN n >= 5 THEN weighted_median END AS price,
  n AS valid_observation_count,
  CASE WHEN n >= 5 THEN 'weighted_median' ELSE 'manual_fallback' END AS estimator,
  n >= 5 AS automatic, oldest AS oldest_observed_at, newest AS newest_observed_at FROM est""",
    "price_estimate_long_window": _long_report("mean", "weighted_mean"),
    "price_estimate_long_window_median": _long_report("median", "weighted_median"),
    "price_estimate_long_window_wide": _long_report("median", "weighted_median"),
    "price_estimate_long_window_both": f"""{_RELATIVE}, {c.estimate_sql(3650, 21.0, prefix='a')},
again AS (SELECT name, price, seen FROM aused),
{c.estimate_sql(3650, 21.0, source='again', prefix='b')}, {_relative('bused')}
SELECT a.name AS normalized_product_name, a.n AS used_count, median AS weighted_median, mean AS weighted_mean,
  greatest(0.0, (epoch_us({c.NOW_SQL}) - epoch_us(a.oldest)) / 86400000000.0) AS oldest_age_days,
  greatest(0.0, (epoch_us({c.NOW_SQL}) - epoch_us(a.newest)) / 86400000000.0) AS newest_age_days
FROM aest a JOIN means ON a.name = means.name JOIN medians ON a.name = medians.name""",
    "price_estimate_both": f"""WITH {c.OBS_SQL}, {c.estimate_sql(prefix='a')},
again AS (SELECT name, price, seen FROM aused),
{c.estimate_sql(source='again', prefix='b')}
SELECT a.name AS normalized_product_name, a.n AS used_count, b.weighted_median, b.weighted_mean,
  greatest(0.0, (epoch_us({c.NOW_SQL}) - epoch_us(a.oldest)) / 86400000000.0) AS oldest_age_days,
  greatest(0.0, (epoch_us({c.NOW_SQL}) - epoch_us(a.newest)) / 86400000000.0) AS newest_age_days
FROM aest a JOIN best b ON a.name = b.name""",
    "price_used_observations": f"""WITH obs AS (SELECT p.p_brand AS name,
  CAST(floor(l.l_extendedprice) AS BIGINT) AS price, l.l_shipdate AS seen,
  CAST(l_orderkey AS VARCHAR) AS product_id, l_linenumber, l_suppkey
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
recent AS (SELECT * FROM obs WHERE seen >= {c.NOW_SQL} - INTERVAL 90 DAY AND price > 0),
centre AS (SELECT name, COUNT(*) AS n, median(price) AS c FROM recent GROUP BY name),
spread AS (SELECT r.name, median(abs(r.price - c.c)) AS mad FROM recent r JOIN centre c USING (name)
  GROUP BY r.name)
SELECT r.name AS normalized_product_name, r.price AS observed_price, r.seen AS observed_at,
  r.product_id, r.l_linenumber, r.l_suppkey
FROM recent r JOIN centre c USING (name) JOIN spread s USING (name)
WHERE c.n < 3 OR s.mad = 0 OR abs(r.price - c.c) / (1.4826 * s.mad) <= 3.5""",
    "price_estimate_counts": f"""WITH {c.OBS_SQL}, {c.estimate_sql()}
SELECT COUNT(*) FILTER (WHERE n >= 150) AS automatic, COUNT(*) FILTER (WHERE n < 150) AS manual
FROM est""",
}
