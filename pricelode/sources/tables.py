"""Manual prices, rule tables and append-only logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import check_rules
from ..operators.estimator import NAME
from ..schemas import (
    DELIVERIES, RUNS, VERDICT_LOG, conform, delivery_violations, split_valid)


def read_manual_prices(spark: SparkSession, path: str) -> DataFrame:
    """Manual prices from a JSON object ``{"name": price}``; a price <= 0 is an error."""
    pairs = (spark.read.text(path, wholetext=True)
             .select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.LongType())))
                     .alias(NAME, "price")))
    checked = F.when(F.col("price") > 0, F.col("price")).otherwise(
        F.raise_error(F.lit("manual prices must be positive")).cast("bigint"))
    return pairs.select(NAME, checked.alias("price"))


def read_condition_rules(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The editable rule table: a small configuration file, checked when it is read."""
    kind = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    row = spark.read.text(path, wholetext=True).select(
        F.from_json("value", kind, {"mode": "FAILFAST"}).alias("rules")).first()
    if row is None or row["rules"] is None:
        raise ValueError("condition rules must be a JSON object of pattern lists")
    return check_rules(row["rules"])


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log table."""
    df.write.mode("append").parquet(path)


class BucketedTable:
    """A table in generations, bucketed and sorted by its keys, so that merges join it where it lies.

    Each generation is a saved table of the session's warehouse. A merge reads the newest one by buckets,
    shuffles its changes alone, and writes the next one task by bucket; a failed merge leaves no
    generation behind that a reader would take, and `drop_before` removes old ones.
    """

    def __init__(self, spark: SparkSession, name: str, keys: Sequence[str], buckets: int):
        self.spark, self.name, self.keys, self.buckets = spark, name, list(keys), buckets

    def _table(self, generation: int) -> str:
        return f"{self.name}_g{generation}"

    def read(self, generation: int) -> DataFrame:
        return self.spark.table(self._table(generation))

    def write(self, df: DataFrame, generation: int) -> None:
        (df.write.mode("overwrite").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet")
         .saveAsTable(self._table(generation)))

    def merge(self, generation: int, step: Callable[[DataFrame], DataFrame]) -> int:
        """Write ``step`` of a generation (one of `operators.merge`) as the next one; returns its number."""
        self.write(step(self.read(generation)), generation + 1)
        return generation + 1

    def drop_before(self, generation: int) -> None:
        for (name,) in self.spark.sql("SHOW TABLES").select("tableName").collect():
            number = name.removeprefix(f"{self.name.lower()}_g")
            if number != name and number.isdigit() and int(number) < generation:
                self.spark.sql(f"DROP TABLE {name}")


def run_rows(runs: DataFrame) -> DataFrame:
    """Pipeline runs in log layout; the detail text is cut to 2,000 characters."""
    return conform(runs, RUNS, {"detail": "", "safety_halt": False}).withColumn(
        "detail", F.substring("detail", 1, 2000))


def delivery_rows(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivery log rows and the rejected ones (a delivery lists at least one item)."""
    return split_valid(conform(deliveries, DELIVERIES, {"channel": "email"}),
                       delivery_violations())


def verdict_rows(attempts: DataFrame) -> DataFrame:
    """Classification attempts in log layout; a failed attempt keeps only its reason."""
    v = F.col("verdict")
    fields = {
        "normalized_product_name": v["normalized_product_name"],
        "condition_status": F.coalesce(v["condition"], F.lit("unknown")),
        "scope": F.coalesce(v["scope"], F.lit("unknown")),
        "sale_status": F.coalesce(v["sale_status"], F.lit("unknown")),
        "exact_product": F.coalesce(v["exact_product"], F.lit(False)),
        "model_mismatch": F.coalesce(v["model_mismatch"], F.lit(False)),
        "price_bait": F.coalesce(v["price_bait"], F.lit(False)),
        "hidden_price_condition": F.coalesce(v["hidden_price_condition"], F.lit(False)),
        "displayed_price": v["displayed_price"], "effective_price": v["effective_price"],
        "price_source": F.coalesce(v["price_source"], F.lit("unknown")),
        "price_confidence": v["price_confidence"],
        "usable_price": F.coalesce(v["usable_price"], F.lit(False)),
        "confidence": v["confidence"], "success": v.isNotNull(),
        "is_computer_part": F.when(v.isNotNull(), (v["scope"] == "standalone")
                                   & v["normalized_product_name"].isNotNull()),
        "reject": F.lit(False),
        "reason": F.coalesce(v["reason"], F.col("error"), F.lit("")),
    }
    return conform(attempts.withColumns(fields), VERDICT_LOG)
