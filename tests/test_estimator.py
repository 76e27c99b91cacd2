import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pricelode.functions import fixed
from pricelode.operators import deals, estimator

NOW = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
DDL = "normalized_product_name string, observed_price bigint, observed_at timestamp"


def _rows(spark, items):
    return spark.createDataFrame(
        [(n, p, NOW - dt.timedelta(days=age)) for n, p, age in items], DDL)


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def _trim(sample):
    if len(sample) < 3:
        return sample
    centre = statistics.median(p for p, _ in sample)
    mad = statistics.median(abs(p - centre) for p, _ in sample)
    return [s for s in sample if mad == 0 or abs(s[0] - centre) / (1.4826 * mad) <= 3.5]


def _median(sample, half_life=21):
    weighted = sorted((p, round(0.5 ** (age / half_life), 12)) for p, age in sample)
    total, run = sum(w for _, w in weighted), 0
    for price, w in weighted:
        run += w
        if 2 * run >= total - 1e-9:
            return price


@pytest.mark.parametrize("wide", [False, True])
def test_outlier_is_removed(spark, wide):
    prices = [300_000, 305_000, 310_000, 295_000, 302_000, 2_000_000]
    obs = _rows(spark, [("a", p, 1) for p in prices])
    got = _one(estimator.estimate_prices(obs, now=NOW, wide_products=wide))
    assert (got["valid_observation_count"], got["price"], got["automatic"]) == (5, 302_000, True)


def test_decay_prefers_recent_prices(spark):
    obs = _rows(spark, [("a", 600_000, 60), ("a", 300_000, 0)])
    median = _one(estimator.estimate_prices(obs, now=NOW, minimum_observations=2))
    mean = _one(estimator.estimate_prices(obs, now=NOW, minimum_observations=2,
                                          estimator="weighted_mean"))
    assert median["price"] == 300_000 and mean["price"] < 350_000


def test_only_old_observations_keep_their_weights(spark):
    items = [("a", p, 2400 + k * 30) for k, p in enumerate((300, 310, 305, 295, 302, 100, 304))]
    items += [("b", p, k) for k, p in enumerate((500, 510, 505, 495, 502))] + [("b", 900, 2500)]
    obs = _rows(spark, items)
    for name in ("weighted_mean", "weighted_median"):
        got = {r[0]: r["price"] for r in estimator.estimate_prices(
            obs, now=NOW, window_days=3650, half_life_days=21, estimator=name).collect()}
        for product in "ab":
            sample = [(p, age) for n, p, age in items if n == product]
            least = min(age for _, age in sample)
            kept = [(p, 0.5 ** ((age - least) / 21)) for p, age in _trim(sample)]
            total = sum(w for _, w in kept)
            mean = round(sum(p * w for p, w in kept) / total)
            median = next(p for k, (p, _) in enumerate(sorted(kept)) if 2 * sum(w for _, w in sorted(kept)[:k + 1]) >= total)
            assert got[product] == (mean if name == "weighted_mean" else median)


@pytest.mark.parametrize("shift", [1700, 3400])
@pytest.mark.parametrize("wide", [False, True])
def test_weights_are_relative_to_the_newest_row_left_after_trimming(spark, shift, wide):
    """One new outlier, dear as nothing else, must not take the digits of the rows that count."""
    items = [("a", 10_000_000, 1)] + [("a", p, shift + 30 * k) for k, p in enumerate((330, 280, 310, 300, 290, 320))]
    obs = _rows(spark, items)
    kept = _trim([(p, age) for _, p, age in items])
    weights = sorted((p, 0.5 ** ((age - shift) / 21)) for p, age in kept)
    total = sum(w for _, w in weights)
    median = next(p for k, (p, _) in enumerate(weights) if 2 * sum(w for _, w in weights[:k + 1]) >= total)
    mean = round(sum(p * w for p, w in weights) / total)
    options = dict(now=NOW, window_days=3650, half_life_days=21)
    for name, wanted in (("weighted_median", median), ("weighted_mean", mean)):
        got = _one(estimator.estimate_prices(obs, estimator=name, wide_products=wide, **options))
        assert (got["price"], got["valid_observation_count"], got["automatic"]) == (wanted, 6, True)
    both = _one(estimator.estimate_both(obs, **options))
    assert (both["weighted_median"], both["weighted_mean"], both["used_count"]) == (median, mean, 6)


def test_manual_fallback_and_missing_names(spark):
    obs = _rows(spark, [("a", 300_000, 1)] * 4)
    manual = estimator.manual_price_table(spark, {"a": 420_000, "b": 7})
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "normalized_product_name string")
    got = {r[0]: (r["price"], r["valid_observation_count"], r["estimator"])
           for r in estimator.estimate_prices(obs, manual, now=NOW, names=names).collect()}
    assert got == {"a": (420_000, 4, "manual_fallback"), "b": (7, 0, "manual_fallback"),
                   "c": (None, 0, "manual_fallback")}
    with pytest.raises(ValueError):
        estimator.manual_price_table(spark, {"a": 0})


def test_zero_spread_keeps_everything(spark):
    obs = _rows(spark, [("a", 170_000, 1)] * 5 + [("a", 150_000, 1)])
    assert estimator.used_observations(obs, now=NOW).count() == 6


def test_window_is_inclusive_and_bad_times_are_skipped(spark):
    rows = [("a", 10, "2025-10-03T00:00:00Z"), ("a", 20, "2025-10-02T23:59:59Z"),
            ("a", 30, "soon"), ("a", 40, "2026-03-01T00:00:00+09:00"), ("a", 0, "2025-12-31")]
    obs = spark.createDataFrame(rows, "normalized_product_name string, observed_price bigint, "
                                      "observed_at string")
    used = estimator.used_observations(obs, now=NOW)
    assert sorted(r["observed_price"] for r in used.collect()) == [10, 40]


def test_settings_are_checked(spark):
    obs = _rows(spark, [("a", 1, 1)])
    for bad in ({"window_days": 0}, {"half_life_days": 0}, {"minimum_observations": 0},
                {"estimator": "mode"}):
        with pytest.raises(ValueError):
            estimator.estimate_prices(obs, now=NOW, **bad)


def test_random_groups_match_brute_force(spark):
    rng = random.Random(5)
    items = []
    for g in range(40):
        for _ in range(rng.randint(1, 30)):
            price = rng.choice([rng.randint(1, 400_000), rng.randint(90_000, 110_000)])
            items.append((f"g{g}", price, rng.randint(0, 100)))
    obs = _rows(spark, items)
    got = {r[0]: r for r in estimator.estimate_prices(
        obs, now=NOW, minimum_observations=1).collect()}
    wide = {r[0]: r for r in estimator.estimate_prices(
        obs, now=NOW, minimum_observations=1, wide_products=True).collect()}
    assert got == wide
    both = {r[0]: r for r in estimator.estimate_both(obs, now=NOW).collect()}
    for g in {n for n, _, _ in items}:
        sample = _trim([(p, a) for n, p, a in items if n == g and a <= 90])
        if not sample:
            assert g not in got
            continue
        assert got[g]["valid_observation_count"] == len(sample)
        assert got[g]["price"] == _median(sample)
        again = _trim(sample)
        assert both[g]["weighted_median"] == _median(again)
        weights = [0.5 ** (a / 21) for _, a in again]
        mean = sum(p * w for (p, _), w in zip(again, weights)) / sum(weights)
        assert abs(both[g]["weighted_mean"] - mean) <= 0.51
        assert both[g]["used_count"] == len(sample)


def test_deals_are_ordered_and_gated(spark):
    base = dict(listing_status="active", ai_sale_status="active", ai_scope="standalone",
                ai_reject=False, ai_is_computer_part=True, ai_usable_for_market_price=True,
                ai_usable_price=True, ai_normalized_product_name=None)
    rows = [
        dict(base, id=1, title="RTX 3060 Ti", effective_price=270_000),
        dict(base, id=2, title="4070s", effective_price=480_000),
        dict(base, id=3, title="4070s", effective_price=1, listing_status="sold"),
        dict(base, id=4, title="4070s", effective_price=1, ai_scope="bundle"),
        dict(base, id=5, title="4070s", effective_price=560_000),
        dict(base, id=6, title="unknown thing", effective_price=1),
    ]
    listings = spark.createDataFrame(
        rows, "id bigint, title string, effective_price bigint, listing_status string, "
              "ai_sale_status string, ai_scope string, ai_reject boolean, "
              "ai_is_computer_part boolean, ai_usable_for_market_price boolean, "
              "ai_usable_price boolean, ai_normalized_product_name string")
    prices = estimator.manual_price_table(spark, fixed.MANUAL_PRICES)
    got = [(r["id"], round(r["discount_percent"], 6)) for r in deals.find_deals(
        listings, prices, 10).collect()]
    assert got == [(2, 20.0), (1, 10.0)]


def test_hot_price_histogram_is_small(spark):
    """A product with very many equal rows reaches the ordering as one row per price."""
    obs = spark.range(20_000).select(
        F.lit("hot").alias("normalized_product_name"),
        (F.col("id") % 7 + 100).alias("observed_price"),
        F.lit(NOW).cast("timestamp").alias("observed_at"))
    assert estimator.price_histogram(obs, NOW, 90, 21).count() == 7
    assert _one(estimator.estimate_prices(obs, now=NOW))["price"] == 103


@pytest.mark.parametrize("largest", [0, 5, 1_000_000])
def test_only_products_of_many_prices_are_split(spark, monkeypatch, largest):
    """Products of few prices are ordered in one task each; split or not, the estimates are the same."""
    calls = []
    split = estimator.split_bounds
    monkeypatch.setattr(estimator, "split_bounds", lambda hist: calls.append(1) or split(hist))
    monkeypatch.setattr(estimator, "WIDE_ROWS", largest, raising=False)
    items = [(n, 300 + 7 * k, 20 * k) for n, many in (("a", 4), ("b", 12), ("c", 5)) for k in range(many)] + [("b", 900_000, 0)]
    options = dict(now=NOW, window_days=3650, half_life_days=21, minimum_observations=1)
    wide = estimator.estimate_prices(_rows(spark, items), wide_products=True, **options).collect()
    plain = estimator.estimate_prices(_rows(spark, items), **options).collect()
    assert sorted(wide) == sorted(plain) and len(calls) == (largest < 13)
