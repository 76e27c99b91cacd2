"""Sharding along a Hilbert curve with DataFrame functions only.

Several metadata columns are quantised to `bits` bits each, the cell's index on the Hilbert curve
through them is computed (rotated Gray codes, one step per bit), rows are sorted by curve index,
and the sorted run is cut into shards. Neighbouring cells share most of their coordinates, so each
file covers a small box of all dimensions at once and readers prune files by any of them.

The sort is a range partitioning on (index, ties), so a cell with a third of all rows is split;
ranks are the place inside a range plus the sizes of the ranges before it (one row per range).
The law is `rows`: shard sizes differ by one row at most.

Defined cases: nulls of a dimension are a cell of their own (0), null texts have size 1; ties are
ordered by all remaining columns given, and rows equal in those are interchangeable; an empty
table stays empty; with fewer rows than shards the later shards may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .common import free_name

SHARDS = 16
BITS = 5


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of integer coordinates below 2**bits (bits * dimensions <= 62).

    Walks the bits from the top with the entry point and direction of the current subcube as
    state, in one `aggregate` over the bit positions.
    """
    n = len(coordinates)
    mask = (1 << n) - 1

    def left(x: Column, by: Column) -> Column:
        return F.call_function("shiftleft", x, by)

    def right(x: Column, by: Column) -> Column:
        return F.call_function("shiftright", x, by)

    def rotated_right(x: Column, by: Column) -> Column:
        return right(x, by).bitwiseOR(left(x, n - by)).bitwiseAND(F.lit(mask))

    def rotated_left(x: Column, by: Column) -> Column:
        return left(x, by).bitwiseOR(right(x, n - by)).bitwiseAND(F.lit(mask))

    # Small tables over the 2**n subcubes, from the rule of Gray codes.
    gray = [w ^ (w >> 1) for w in range(1 << n)]
    rank = [gray.index(x) for x in range(1 << n)]
    entry = [0] + [(y := 2 * ((w - 1) // 2)) ^ (y >> 1) for w in range(1, 1 << n)]
    turn = [0] + [_ones(w - 1 if w % 2 == 0 else w) % n for w in range(1, 1 << n)]

    def pick(values: list[int], at: Column) -> Column:
        return F.get(F.array(*(F.lit(v) for v in values)), at)

    cells = [c.cast("int") for c in coordinates]

    def step(state: Column, level: Column) -> Column:
        corner = sum((left(right(c, level).bitwiseAND(F.lit(1)), F.lit(k))
                      for k, c in enumerate(cells)), F.lit(0))
        by = state["d"] + 1
        place = pick(rank, rotated_right(corner.bitwiseXOR(state["e"]), by % n))
        return F.struct(
            (state["h"] * (1 << n) + place).alias("h"),
            state["e"].bitwiseXOR(rotated_left(pick(entry, place), by % n)).alias("e"),
            ((state["d"] + pick(turn, place) + 1) % n).cast("int").alias("d"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["h"])


def _ones(w: int) -> int:
    """How many ones stand at the low end of w."""
    return ((w ^ (w + 1)).bit_length() - 1) if w else 0


def quantised_name(value: Column, bits: int = BITS) -> Column:
    """A cell of a text dimension; null is cell 0."""
    return F.coalesce(F.pmod(F.crc32(value.cast("string")), F.lit((1 << bits) - 1)) + 1, F.lit(0)).cast("int")


def quantised_size(value: Column, bits: int = BITS) -> Column:
    """A cell of a size dimension: twice its binary logarithm, at most 2**bits - 1."""
    return F.least(F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * 2), F.lit((1 << bits) - 1)).cast("int")


def assign_shards(rows: DataFrame, cells: list[Column], ties: list[str], shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot (place in the shard, from 0) to each row, cut along the Hilbert curve.

    Rows are staged once in curve order under the shared folder, so a lost executor can't change
    an order that ranks already rest on.
    """
    curve, place = free_name(rows, "curve"), free_name(rows, "place")
    rows = rows.drop("shard", "slot")
    ordered = rows.withColumn(curve, hilbert_index(cells))
    ordered = ordered.repartitionByRange(curve, *ties).sortWithinPartitions(curve, *ties)
    staged = stage_table(ordered.withColumn(place, F.monotonically_increasing_id()), "curve-order")
    part, inside = F.shiftright(F.col(place), 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = staged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))
    names = {k: free_name(staged, k) for k in ("part", "base", "total")}
    offsets = offsets.select(*(F.col(k).alias(v) for k, v in names.items()))
    rank = F.col(names["base"]) + inside
    ranked = staged.join(offsets, part == offsets[names["part"]]).withColumn("shard", F.expr(
        f"cast((`{names['base']}` + (`{place}` & {(1 << 33) - 1})) * {shards} div `{names['total']}` as int)"))
    first = F.expr(f"(cast(shard as bigint) * `{names['total']}` + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", rank - first).drop(curve, place, *names.values())


def write_shards(assigned: DataFrame, folder: str) -> None:
    """Write one folder of Parquet files per shard."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
