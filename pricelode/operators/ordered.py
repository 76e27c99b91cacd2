"""Ordered-sequence operators that split long sequences into chunks.

A source or product may hold a large share of all rows, so nothing here orders a whole
sequence in one task.  Rows are ordered inside (keys, chunk); one summary row per chunk
carries the state across chunk borders, and is joined back where rows need it.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

_PID_BITS = 33


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column | str,
                   columns: Sequence[str]) -> DataFrame:
    """Values of the newest row per key; a partial aggregate, so hot keys combine early."""
    newest = F.max_by(F.struct(*columns), order)
    out = df.groupBy(*keys).agg(newest.alias("_newest"))
    return out.select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in columns])


def running_total(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column],
                  value: Column, name: str) -> DataFrame:
    """Add the running sum of ``value`` along each key's sequence, current row included.

    ``chunk`` must not decrease along ``order``.
    """
    df = df.withColumns({"_chunk": chunk, "_value": value})
    sums = df.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_chunk",
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("_local", F.sum("_value").over(local))
            .join(sums, [*keys, "_chunk"])
            .withColumn(name, F.col("_local") + F.col("_before"))
            .drop("_local", "_before", "_chunk", "_value"))


def numbered(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column],
             name: str = "row_no") -> DataFrame:
    """1-based position of each row in its key's sequence."""
    return running_total(df, keys, chunk, order, F.lit(1), name)


def carried_last(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column],
                 carry: Mapping[str, Column]) -> DataFrame:
    """For each row, the last non-null value of each expression strictly before it."""
    df = df.withColumn("_chunk", chunk)
    for name, value in carry.items():
        df = df.withColumn(f"_v_{name}", value)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    prior = local.rowsBetween(Window.unboundedPreceding, -1)
    along = F.struct(*order)
    ends = df.groupBy(*keys, "_chunk").agg(*[
        F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), along)).alias(f"_e_{n}")
        for n in carry])
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_chunk", *[
        F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_e_{n}") for n in carry])
    out = df.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(prior) for n in carry})
    out = out.join(ends, [*keys, "_chunk"])
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_e_{n}")) for n in carry})
    return out.drop("_chunk", *[f"_v_{n}" for n in carry], *[f"_e_{n}" for n in carry])


def descending_check(df: DataFrame, keys: Sequence[str], chunk: Column,
                     order: Sequence[Column], value: str) -> DataFrame:
    """Per key, whether ``value`` never rises along the order (nulls are skipped)."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_chunk", chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = rows.withColumn("_ok", F.coalesce(F.lag(value).over(local) >= F.col(value),
                                             F.lit(True)))
    along = F.struct(*order)
    parts = rows.groupBy(*keys, "_chunk").agg(
        F.bool_and("_ok").alias("_ok"), F.min_by(value, along).alias("_first"),
        F.max_by(value, along).alias("_last"))
    previous = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))
    parts = parts.withColumn("_ok", F.col("_ok") & F.coalesce(
        previous >= F.col("_first"), F.lit(True)))
    return parts.groupBy(*keys).agg(F.bool_and("_ok").alias("monotonic"))


def cut_after_run(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column],
                  flag: str, length: int, enabled: Column | None = None) -> DataFrame:
    """Keep each key's rows up to the first run of ``length`` flagged rows.

    Adds ``stopped`` (the key was cut).  ``enabled`` may switch cutting off per key.
    Each chunk is summarised by its leading run, its trailing run and its first complete
    run; a scan over chunk summaries then finds runs that cross chunk borders.
    """
    if length < 1:
        raise ValueError("run length must be at least 1")
    rows = df.withColumn("_chunk", chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = rows.withColumn("_pos", F.row_number().over(local))
    breaks = F.max(F.when(~F.col(flag), F.col("_pos"))).over(
        local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = rows.withColumn("_run", F.col("_pos") - F.coalesce(breaks, F.lit(0)))
    parts = runs.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_size"),
        F.min(F.when(~F.col(flag), F.col("_pos"))).alias("_first_break"),
        F.max(F.when(~F.col(flag), F.col("_pos"))).alias("_last_break"),
        F.min(F.when(F.col("_run") >= length, F.col("_pos"))).alias("_first_run"),
        *([F.bool_or(enabled).alias("_enabled")] if enabled is not None else []))
    by_key = Window.partitionBy(*keys).orderBy("_chunk")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    # Rows before the chunk, and the position of the last break before it.
    parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    parts = parts.withColumn("_carry", F.col("_before") - F.coalesce(
        F.max(F.col("_before") + F.col("_last_break")).over(before), F.lit(0)))
    lead = F.coalesce(F.col("_first_break") - 1, F.col("_size"))
    need = F.greatest(F.lit(length) - F.col("_carry"), F.lit(1))
    stop_at = F.least(F.when(lead >= need, need), F.col("_first_run"))
    if enabled is not None:
        stop_at = F.when(F.col("_enabled"), stop_at)
    stops = (parts.withColumn("_stop_at", stop_at)
             .groupBy(*keys)
             .agg(F.min(F.when(F.col("_stop_at").isNotNull(),
                               F.struct("_chunk", "_stop_at"))).alias("_stop")))
    kept = rows.join(stops, list(keys), "left")
    here = F.struct(F.col("_chunk"), F.col("_pos").alias("_stop_at"))
    kept = kept.where(F.col("_stop").isNull() | (here <= F.col("_stop")))
    return (kept.withColumn("stopped", F.col("_stop").isNotNull())
            .drop("_chunk", "_pos", "_stop"))


def look_back(df: DataFrame, keys: Sequence[str], position: str, rows_back: int,
              measures: Mapping[str, object], span: int = 4096) -> DataFrame:
    """Window measures over the last ``rows_back + 1`` rows, by dense position.

    Positions are cut into spans; the tail of each span is copied to the next one, so a
    frame never needs more than one span.  ``measures`` map a name to a function of the frame.
    """
    if rows_back >= span:
        raise ValueError("the look-back must be shorter than a span")
    at = F.col(position) - 1
    own = F.floor(at / F.lit(span)).cast("bigint")
    in_tail = at % span >= span - rows_back
    copies = df.withColumn("_own", own).withColumn(
        "_span", F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = (Window.partitionBy(*keys, "_span").orderBy(position)
             .rowsBetween(-rows_back, Window.currentRow))
    copies = copies.withColumns({name: make(frame) for name, make in measures.items()})
    return copies.where(F.col("_span") == F.col("_own")).drop("_span", "_own")


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side as one row, by a union and one aggregate."""
    stacked = rows[0]
    for other in rows[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based global rank: a range sort, stored once, plus per-partition offsets."""
    rows = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", _PID_BITS)
    sizes = rows.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_size"))
    # One row per sorted partition, so this window and the broadcast stay tiny.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << _PID_BITS) - 1)) + 1
    return (rows.withColumn("_pid", pid).join(F.broadcast(sizes), "_pid")
            .withColumn(name, place + F.col("_base")).drop("_mid", "_pid", "_base"))


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node of its connected component.

    Each round hangs all neighbours of a node on its least one, from above and from below, so
    distances shrink geometrically and the rounds are the logarithm of the longest path.
    """
    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = cut_lineage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(current)) != before:
        before = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        hung = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        lowest = hung.groupBy("a").agg(F.min("b").alias("least"))
        below = hung.join(lowest, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        current = cut_lineage(below.unionByName(lowest.select("a", F.col("least").alias("b"))).distinct())
    labels = current.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def _one_round(todo: DataFrame, keys: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """(rows that are first under all their keys, rows that none of these blocks)."""
    state = todo
    for i, key in enumerate(keys):
        firsts = todo.dropna(subset=key).groupBy(*key).agg(F.min("_rank").alias(f"_first{i}"))
        state = state.join(firsts, key, "left")
    wins = F.lit(True)
    for i in range(len(keys)):
        wins = wins & F.coalesce(F.col(f"_first{i}") == F.col("_rank"), F.lit(True))
    state = cut_lineage(state.withColumn("_wins", wins).drop(*[f"_first{i}" for i in range(len(keys))]))
    won, rest = state.where("_wins").drop("_wins"), state.where("not _wins").drop("_wins")
    for key in keys:
        rest = rest.join(won.select(*key), key, "left_anti")
    return won, cut_lineage(rest)


def _greedy_inserts(width: int):
    """Rows (label, row, keys) in insertion order per component: the rows that are accepted."""
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken = None, [set() for _ in range(width)]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for label, row, *values in zip(*columns, strict=True):
                if label != held:
                    held, taken = label, [set() for _ in range(width)]
                if not any(v in seen for v, seen in zip(values, taken, strict=True)):
                    out.append(row)
                    for v, seen in zip(values, taken, strict=True):
                        if v is not None:
                            seen.add(v)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["_row"])
    return accept


def first_wins(df: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[Column | str],
               largest: int = 1_000_000) -> DataFrame:
    """Insert-or-ignore on several independent unique keys: earlier accepted rows win.

    ``order`` must be total; null keys never conflict. Columns that it gives by name are carried once, in the
    rank. Rows that are first under every key are
    accepted and what they block is dropped. Two such rounds leave only rows that hang together in
    chains; these are split into connected components, found in rounds that grow with the logarithm of
    the longest chain, and each component is inserted row by row in one streaming pass. Components of
    more than ``largest`` rows go on in rounds, so no task holds more keys than that.
    """
    spark_keys = [list(k) for k in keys]
    packed = {c for c in order if isinstance(c, str)}.difference(*spark_keys)
    todo = cut_lineage(df.withColumn("_rank", F.struct(*order)).drop(*packed))
    columns = [F.col("_rank")[c].alias(c) if c in packed else F.col(c) for c in df.columns]
    accepted: list[DataFrame] = []
    for step in itertools.count():
        won, todo = _chained(todo, spark_keys, largest) if step == 2 else _one_round(todo, spark_keys)
        accepted.append(won)
        if todo.isEmpty():
            return functools.reduce(DataFrame.unionByName, accepted).select(*columns)


def _chained(todo: DataFrame, keys: list[list[str]], largest: int) -> tuple[DataFrame, DataFrame]:
    """(accepted rows of all components of at most ``largest`` rows, rows of the other components)."""
    rows = cut_lineage(todo.withColumn("_row", F.monotonically_increasing_id()))
    linked = rows
    for i, key in enumerate(keys):  # the least row of a key stands for the key
        firsts = rows.dropna(subset=key).groupBy(*key).agg(F.min("_row").alias(f"_key{i}"))
        linked = linked.join(firsts, key, "left")
    names = [f"_key{i}" for i in range(len(keys))]
    linked = cut_lineage(linked)
    edges = linked.select(F.col("_row").alias("a"), F.explode(F.array(*names)).alias("b")).where("b IS NOT NULL")
    labels = component_labels(edges)
    marked = linked.join(labels, linked["_row"] == labels["node"], "left").withColumn("_label", F.coalesce("label", "_row"))
    marked = cut_lineage(marked.drop("node", "label"))
    big = marked.groupBy("_label").agg(F.count("*").alias("_size")).where(F.col("_size") > largest).select("_label")
    small = marked.join(big, "_label", "left_anti")
    inserts = (small.repartition("_label").sortWithinPartitions("_label", "_rank").select("_label", "_row", *names)
               .mapInArrow(_greedy_inserts(len(keys)), "_row bigint"))
    won = cut_lineage(small.join(inserts, "_row", "left_semi").drop("_row", "_label", *names))
    return won, cut_lineage(marked.join(big, "_label", "left_semi").drop("_row", "_label", *names))
