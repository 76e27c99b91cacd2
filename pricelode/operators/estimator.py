"""Time-decayed, outlier-free price estimates for every product at once.

One pass over the observations builds a histogram per (product, price): count, summed
decay weight, first and last time.  Outlier removal, both medians, the mean and the
report fields depend on nothing else, so the raw rows are shuffled once, after map-side
combining, and a product holding a third of all rows is spread over its prices.  What is
then ordered per product is one row per distinct whole price, never its raw rows.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.times import age_days, as_timestamp, decay_weight, instant
from ..session import stage_table
from .ranks import half_passed, half_reached, median_pair, rank_select

NAME = "normalized_product_name"
# Robust-scale factor, outlier bound, smallest sample that is trimmed.
MAD_SCALE = 1.4826
MAD_BOUND = 3.5
MIN_TRIM_COUNT = 3
ESTIMATORS = ("weighted_median", "weighted_mean")

#: Weights are kept to scale within blocks of so many half-lives of age.
BLOCK_HALVINGS = 40
BLOCK = "age_block"

#: Histogram rows of a product up to which its prices are ordered in one task, also with ``wide_products``.
WIDE_ROWS = 1_000_000


def check_settings(window_days: int, half_life_days: float, minimum_observations: int,
                   estimator: str) -> None:
    if window_days < 1 or half_life_days <= 0 or minimum_observations < 1:
        raise ValueError("window, half-life and minimum count must be positive")
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}")


def weight_type(window_days: int, half_life_days: float) -> T.DecimalType:
    """Decimal type that keeps twelve digits of the smallest weight in the window, or in a block of it."""
    halvings = min(window_days / half_life_days, BLOCK_HALVINGS)
    scale = 12 if halvings <= 6 else 12 + math.ceil(halvings * math.log10(2))
    return T.DecimalType(scale + 2, scale)


def recent(observations: DataFrame, now, window_days: int) -> DataFrame:
    """Valid observations with a positive price inside the look-back window.

    The window is one comparison on the observation time, so it reaches the scan.
    Rows whose time text cannot be read are left out.
    """
    kind = observations.schema["observed_at"].dataType
    rows = observations
    if "valid" in observations.columns:
        rows = rows.where(F.col("valid"))
    start = instant(now) - F.make_dt_interval(F.lit(window_days))
    if isinstance(kind, T.TimestampNTZType):
        # Compare in the stored type: a cast column would keep the filter out of the scan.
        rows = rows.where(F.col("observed_at") >= start.cast("timestamp_ntz"))
    rows = rows.withColumn("observed_at", as_timestamp(F.col("observed_at"), kind))
    return rows.where((F.col("observed_at") >= start) & (F.col("observed_price") > 0))


def age_blocks(age: Column, window_days: int, half_life_days: float) -> tuple[Column, float]:
    """The block of an age, and the days of a block; short windows are one block."""
    block_days = float(half_life_days * BLOCK_HALVINGS)
    if window_days / half_life_days <= BLOCK_HALVINGS:
        return F.lit(0), block_days
    return F.floor(age / F.lit(block_days)), block_days


def utc(now: dt.datetime | str) -> dt.datetime:
    """``now`` as a UTC time without zone; naive values are UTC."""
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now.replace("Z", "+00:00"))
    return now.astimezone(dt.timezone.utc).replace(tzinfo=None) if now.tzinfo else now


def price_histogram(observations: DataFrame, now, window_days: int,
                    half_life_days: float) -> DataFrame:
    """Count, decayed weight and time span of every (product, price).

    In windows of more than ``BLOCK_HALVINGS`` half-lives rows also stand for a block of age,
    and weights count from the block's start, so that no weight is too small for its digits.
    ``relative_weights`` brings them to one scale once the outliers are known.
    """
    age = age_days(F.col("observed_at"), now)
    blocks = window_days / half_life_days > BLOCK_HALVINGS
    block, block_days = age_blocks(age, window_days, half_life_days)
    weight = decay_weight(age - block * F.lit(block_days) if blocks else age, half_life_days)
    kind = weight_type(window_days, half_life_days)
    return (
        recent(observations, now, window_days)
        .select(NAME, F.col("observed_price").cast("bigint").alias("price"), "observed_at",
                block.alias(BLOCK), weight.cast(kind).alias("w"))
        .groupBy(NAME, "price", *([BLOCK] if blocks else []))
        .agg(F.count("*").alias("n"), F.sum("w").alias("w"),
             F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"))
    )


def relative_weights(kept: DataFrame, wide_products: bool = False) -> DataFrame:
    """Weights of a trimmed histogram relative to each product's newest block that is left.

    Weights only matter relative to each other within a product. An outlier may be the newest
    row by far, so the scale must come from the rows that count.
    """
    if BLOCK not in kept.columns:
        return kept
    scale = kept.schema["w"].dataType.scale
    if wide_products:
        first = kept.groupBy(NAME).agg(F.min(BLOCK).alias("_first"))
        kept = kept.join(first, NAME)
    else:
        kept = kept.withColumn("_first", F.min(BLOCK).over(Window.partitionBy(NAME)))
    behind = (F.col(BLOCK) - F.col("_first")) * BLOCK_HALVINGS
    weight = F.col("w").cast("double") * F.pow(F.lit(0.5), behind)
    return kept.withColumn("w", F.when(behind == 0, F.col("w").cast(T.DecimalType(38, scale)))
                           .otherwise(weight.cast(T.DecimalType(38, scale)))).drop(BLOCK, "_first")


def with_bounds(hist: DataFrame, *carry: str) -> DataFrame:
    """Histogram rows with ``_centre`` and the robust ``_scale`` (null = keep all).

    A chain of windows over one partitioning by product: running counts by price give
    the median, running counts by deviation the median absolute deviation.  Deviations
    are doubled so that half-way medians stay whole numbers.
    """
    def middle(rows: DataFrame, value: str, low: str, high: str) -> DataFrame:
        # Frames of one order share a window operator; the total needs no second one.
        ordered = Window.partitionBy(NAME).orderBy(value)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        counts = {"_run": F.sum("n").over(upto)}
        if "_n" not in rows.columns:
            counts["_n"] = F.sum("n").over(whole)
        rows = rows.withColumns(counts)
        run, total = F.col("_run"), F.col("_n")
        return rows.withColumns({
            low: F.min(F.when(half_reached(run, total), F.col(value))).over(whole),
            high: F.min(F.when(half_passed(run, total), F.col(value))).over(whole)})

    rows = middle(hist, "price", "_lo", "_hi")
    twice = F.col("_lo") + F.col("_hi")
    rows = rows.withColumn("_dev", F.abs(F.col("price") * 2 - twice))
    rows = middle(rows, "_dev", "_dlo", "_dhi")
    mad = (F.col("_dlo") + F.col("_dhi")) / F.lit(4.0)
    return rows.select(
        *hist.columns, (twice / F.lit(2.0)).alias("_centre"),
        F.when((F.col("_n") >= MIN_TRIM_COUNT) & (mad != 0), F.lit(MAD_SCALE) * mad)
        .alias("_scale"))


def split_bounds(hist: DataFrame) -> DataFrame:
    """One row of bounds per product, found with split order statistics.

    For products with very many distinct prices; ``hist`` should be a stored table.
    """
    centre = median_pair(hist, [NAME], "price", "n").withColumnRenamed("_total", "_n")
    centre = stage_table(
        centre.select(NAME, "_n", (F.col("lo") + F.col("hi")).alias("_twice")), "centre")
    spread = stage_table(
        hist.join(centre, NAME)
        .select(NAME, "n", F.abs(F.col("price") * 2 - F.col("_twice")).alias("_dev"))
        .groupBy(NAME, "_dev").agg(F.sum("n").alias("n")), "spread")
    mad = median_pair(spread, [NAME], "_dev", "n").select(
        NAME, ((F.col("lo") + F.col("hi")) / F.lit(4.0)).alias("_mad"))
    return stage_table(centre.join(mad, NAME).select(
        NAME, (F.col("_twice") / F.lit(2.0)).alias("_centre"),
        F.when((F.col("_n") >= MIN_TRIM_COUNT) & (F.col("_mad") != 0),
               F.lit(MAD_SCALE) * F.col("_mad")).alias("_scale")), "bounds")


def inside_bounds(price: Column) -> Column:
    off = F.abs(price - F.col("_centre")) / F.col("_scale")
    return F.col("_scale").isNull() | (off <= MAD_BOUND)


def trimmed(hist: DataFrame, wide_products: bool = False) -> DataFrame:
    """Histogram without outlying prices."""
    if wide_products:
        hist = stage_table(hist, "histogram")
        kept = hist.join(split_bounds(hist), NAME)
    else:
        kept = with_bounds(hist)
    kept = kept.where(inside_bounds(F.col("price"))).select(*hist.columns)
    return stage_table(kept, "trimmed") if wide_products else kept


def used_observations(observations: DataFrame, *, now, window_days: int = 90) -> DataFrame:
    """The recent, non-outlying rows themselves."""
    rows = recent(observations, now, window_days)
    hist = (rows.groupBy(NAME, F.col("observed_price").cast("bigint").alias("price"))
            .agg(F.count("*").alias("n")))
    bounds = with_bounds(hist).groupBy(NAME).agg(
        F.first("_centre").alias("_centre"), F.first("_scale").alias("_scale"))
    return (rows.join(bounds, NAME)
            .where(inside_bounds(F.col("observed_price"))).select(*rows.columns))


def _summary(hist: DataFrame, median: bool, mean: bool, wide_products: bool) -> DataFrame:
    """Per product: count, time span and the requested estimates of a trimmed histogram."""
    hist = relative_weights(hist, wide_products)
    aggs = [F.sum("n").alias("n"), F.min("oldest").alias("oldest"),
            F.max("newest").alias("newest")]
    if mean:
        w = F.col("w").cast("double")
        aggs.append(F.bround(F.try_divide(F.sum(F.col("price") * w), F.sum(w)))
                    .cast("bigint").alias("weighted_mean"))
    if median and not wide_products:
        ordered = Window.partitionBy(NAME).orderBy("price")
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        hist = hist.withColumns({"_run": F.sum("w").over(upto), "_all": F.sum("w").over(whole)})
        aggs.append(F.min(F.when(half_reached(F.col("_run"), F.col("_all")), F.col("price")))
                    .alias("weighted_median"))
    out = hist.groupBy(NAME).agg(*aggs)
    if median and wide_products:
        middle = rank_select(hist, [NAME], "price", "w", {"weighted_median": half_reached})
        out = out.join(middle.select(NAME, "weighted_median"), NAME)
    return out


def estimate_prices(observations: DataFrame, manual: DataFrame | None = None, *,
                    now: dt.datetime | str, window_days: int = 90, half_life_days: float = 21,
                    minimum_observations: int = 5, estimator: str = "weighted_median",
                    names: DataFrame | None = None,
                    wide_products: bool = False) -> DataFrame:
    """Current price per product; too few observations fall back to the manual price.

    ``names`` lists products to report (column ``normalized_product_name``); products
    without a recent observation then appear too, with the manual price or null.
    ``wide_products`` also splits the ordering *inside* a product over many tasks, for
    products of more than ``WIDE_ROWS`` distinct prices; it stores the histogram and the small
    intermediate tables in the shared folder.
    """
    check_settings(window_days, half_life_days, minimum_observations, estimator)
    if names is not None:
        observations = observations.join(_listed(names), NAME, "left_semi")
    hist = price_histogram(observations, now, window_days, half_life_days)
    return histogram_estimates(hist, manual, minimum_observations=minimum_observations, estimator=estimator,
                               names=names, wide_products=wide_products)


def _listed(names: DataFrame) -> DataFrame:
    return names.select(NAME).where(F.col(NAME).isNotNull()).distinct()


def histogram_estimates(hist: DataFrame, manual: DataFrame | None = None, *, minimum_observations: int = 5,
                        estimator: str = "weighted_median", names: DataFrame | None = None,
                        wide_products: bool = False) -> DataFrame:
    """`estimate_prices` from a histogram in the layout of `price_histogram`."""
    wanted = estimator == "weighted_median", estimator == "weighted_mean"
    if wide_products:
        hist = stage_table(hist, "histogram")
        large = stage_table(hist.groupBy(NAME).agg(F.count("*").alias("_rows"))
                            .where(F.col("_rows") > WIDE_ROWS).select(NAME), "wide-names")
        if large.isEmpty():
            found = _summary(trimmed(hist), *wanted, False)
        else:
            few = _summary(trimmed(hist.join(large, NAME, "left_anti")), *wanted, False)
            many = trimmed(hist.join(large, NAME, "left_semi"), True)
            found = few.unionByName(_summary(many, *wanted, True))
    else:
        found = _summary(trimmed(hist), *wanted, False)
    if names is not None:
        found = _listed(names).join(found, NAME, "left")
    if manual is not None:
        found = found.join(
            manual.select(NAME, F.col("price").cast("bigint").alias("_manual")), NAME, "left")
    else:
        found = found.withColumn("_manual", F.lit(None).cast("bigint"))
    count = F.coalesce(F.col("n"), F.lit(0))
    enough = count >= minimum_observations
    return found.select(
        NAME,
        F.when(enough, F.col(estimator)).otherwise(F.col("_manual")).alias("price"),
        count.alias("valid_observation_count"),
        F.when(enough, estimator).otherwise("manual_fallback").alias("estimator"),
        enough.alias("automatic"),
        F.col("oldest").alias("oldest_observed_at"),
        F.col("newest").alias("newest_observed_at"))


def estimate_both(observations: DataFrame, *, now, window_days: int = 90,
                  half_life_days: float = 21) -> DataFrame:
    """Weighted median and mean side by side, with the age span of the used rows.

    The report trims the sample twice: once to list the used rows, and again inside
    each estimate of those rows.
    """
    check_settings(window_days, half_life_days, 1, "weighted_median")
    used = trimmed(price_histogram(observations, now, window_days, half_life_days))
    whole = Window.partitionBy(NAME)
    used = used.withColumns({
        "_count": F.sum("n").over(whole), "_old": F.min("oldest").over(whole),
        "_new": F.max("newest").over(whole)})
    again = relative_weights(trimmed(used))
    ordered = whole.orderBy("price")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = again.withColumns({"_run": F.sum("w").over(upto), "_all": F.sum("w").over(total)})
    w = F.col("w").cast("double")
    reached = half_reached(F.col("_run"), F.col("_all"))
    return again.groupBy(NAME).agg(
        F.first("_count").alias("used_count"),
        F.min(F.when(reached, F.col("price"))).alias("weighted_median"),
        F.bround(F.try_divide(F.sum(F.col("price") * w), F.sum(w))).cast("bigint")
        .alias("weighted_mean"),
        age_days(F.first("_old"), now).alias("oldest_age_days"),
        age_days(F.first("_new"), now).alias("newest_age_days"))


def estimate_counts(estimates: DataFrame) -> DataFrame:
    """How many products are priced automatically and how many fall back."""
    return estimates.agg(F.count_if("automatic").alias("automatic"),
                         F.count_if(~F.col("automatic")).alias("manual"))


def manual_price_table(spark: SparkSession, prices: Mapping[str, int]) -> DataFrame:
    """A checked manual price table; every price must be positive."""
    if any(int(price) <= 0 for price in prices.values()):
        raise ValueError("manual prices must be positive")
    return spark.createDataFrame([(name, int(price)) for name, price in prices.items()],
                                 f"{NAME} string, price bigint")
