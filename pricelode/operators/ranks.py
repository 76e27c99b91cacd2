"""Exact weighted order statistics that never sort a whole group in one task.

The input is a histogram (keys, whole-number value, weight).  Values are split into a
high part and 16 low bits.  Running weights over the high parts find the part that holds
each target, and only the values of that part are ordered, so a task never sees more
than the distinct high parts of a key or the 65,536 values under one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW_BITS = 16
Reached = Callable[[Column, Column], Column]


def rank_select(hist: DataFrame, keys: Sequence[str], value: str, weight: str,
                picks: dict[str, Reached]) -> DataFrame:
    """Per key: ``_total`` and, for each pick, the smallest value that reaches it.

    A pick is ``reached(running_weight, total_weight) -> bool`` and must stay true once true.
    """
    keys = list(keys)
    parts = (hist.withColumn("_part", F.shiftright(F.col(value), LOW_BITS))
             .groupBy(*keys, "_part").agg(F.sum(weight).alias("_w")))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(*keys, "_part", "_w", F.sum("_w").over(upto).alias("_run"),
                         F.sum("_w").over(by_key).alias("_total"))
    chosen = parts.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[F.min(F.when(reached(F.col("_run"), F.col("_total")),
                       F.struct("_part", (F.col("_run") - F.col("_w")).alias("_before"))))
          .alias(f"_at_{name}") for name, reached in picks.items()])
    spots = F.array_distinct(F.array(*[F.col(f"_at_{n}._part") for n in picks]))
    chosen = chosen.withColumn("_part", F.explode(spots))
    inside = (hist.withColumn("_part", F.shiftright(F.col(value), LOW_BITS))
              .join(chosen, [*keys, "_part"]))
    within = (Window.partitionBy(*keys, "_part").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("_local", F.sum(weight).over(within))
    out = []
    for name, reached in picks.items():
        at = F.col(f"_at_{name}")
        here = F.col("_part") == at["_part"]
        hit = here & reached(at["_before"] + F.col("_local"), F.col("_total"))
        out.append(F.min(F.when(hit, F.col(value))).alias(name))
    return inside.groupBy(*keys).agg(F.max("_total").alias("_total"), *out)


def half_reached(running: Column, total: Column) -> Column:
    return running * 2 >= total


def half_passed(running: Column, total: Column) -> Column:
    return running * 2 > total


def median_pair(hist: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Lower and upper middle value per key (``lo``, ``hi``) and the row count ``_total``."""
    return rank_select(hist, keys, value, count, {"lo": half_reached, "hi": half_passed})
