"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b), label being the least node of its component.

    Each round joins every edge to the least neighbour of its end (large star, then small star),
    so paths shorten geometrically; a round is two aggregations that combine before the shuffle
    and joins that adaptive execution may split. Rounds end when no edge changes. Null ends and
    loops are ignored; an empty table gives an empty result.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stage_table(current.where("a <> b").distinct(), "components")
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        current = stage_table(small, "components")
        before, mark = mark, _mark(current)
        if before == mark:
            break
    labels = current.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
