"""``foreachBatch`` jobs over versioned tables: marks, prices, alerts, backfill."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import changes, estimator, merge
from ..schemas import table_schema
from ..session import fresh_path

NAME = estimator.NAME


class VersionedTable:
    """A Parquet table replaced version by version, one version per micro-batch.

    A version's folder is named by its batch, and a replayed batch starts again from the
    version before it, so repeating a batch gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _path(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def read(self, version: int) -> DataFrame:
        """Table after batch ``version``; before the first batch it is empty."""
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(version))

    def write(self, df: DataFrame, version: int) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._path(version))


class AppendedBatches:
    """Append-only table with one folder per micro-batch; a replay overwrites its folder."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(
            f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        if before == 0:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType([*self.schema.fields, StructField("batch_id", LongType())])
        rows = self.spark.read.schema(stored).option("basePath", self.path).parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("batch_id") < before)
        return rows.drop("batch_id")


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str,
          checkpoint: str | None = None) -> StreamingQuery:
    """Run ``handle`` over everything available, in micro-batches, then stop."""
    where = checkpoint or fresh_path(stream.sparkSession, f"stream-{name}")
    query = (stream.writeStream.option("checkpointLocation", where)
             .trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()
    return query


def drain_to_table(stream: DataFrame, name: str, checkpoint: str | None = None,
                   output_mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet under the shared folder and read it back."""
    spark = stream.sparkSession
    where = checkpoint or fresh_path(spark, f"stream-{name}")
    out = f"{where}/out"
    query = (stream.writeStream.format("parquet").outputMode(output_mode)
             .option("path", out).option("checkpointLocation", f"{where}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def advance_watermarks(table: VersionedTable) -> Callable[[DataFrame, int], None]:
    """Keep the newest processed update time per source."""
    def handle(processed: DataFrame, batch_id: int) -> None:
        stored = table.read(batch_id - 1)
        table.write(merge.merge_watermarks(stored, changes.high_watermarks(processed)), batch_id)
    return handle


def refresh_prices(observations: AppendedBatches, estimates: AppendedBatches,
                   manual: DataFrame | None, *, now, **options) -> Callable[[DataFrame, int], None]:
    """Re-estimate only the products that a batch of observations touches."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        observations.write(batch, batch_id)
        touched = batch.select(NAME).distinct()
        history = observations.read(before=batch_id + 1)
        fresh = estimator.estimate_prices(history, manual, now=now, names=touched, **options)
        estimates.write(fresh.withColumn("version", F.lit(batch_id)), batch_id)
    return handle


class DailyHistogram:
    """Counts, weights and times per (day, product, price), and the raw rows of each day, by folder.

    A batch reads and rewrites only the days it has rows of; days that leave the look-back window leave
    by their folder. Decay is a factor all rows of a day share, so a day's weights count from its end and
    never change. Only days that a window cuts are read as raw rows. What a batch reads is therefore
    bounded by the window, whatever the length of the history.
    """

    FIELDS = (f"{NAME} string, price bigint, n bigint, w decimal(38,18), oldest timestamp, newest timestamp, day date")
    ROWS = f"{NAME} string, observed_price bigint, observed_at timestamp, day date"

    def __init__(self, spark: SparkSession, path: str, window_days: int = 90, half_life_days: float = 21):
        self.spark, self.path = spark, path.rstrip("/")
        self.window_days, self.half_life_days = window_days, half_life_days
        self.days = VersionedTable(spark, f"{self.path}/days", table_schema("day date, version bigint"))

    def _read(self, kind: str, layout: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).option("basePath", f"{self.path}/{kind}").parquet(*folders)

    def _versions(self, batch_id: int) -> dict:
        """Newest version of each day of the window: a row a day at most."""
        return {r.day: r.version for r in self.days.read(batch_id).collect()}

    def _start(self, now) -> dt.datetime:
        return estimator.utc(now) - dt.timedelta(days=self.window_days)

    def merge(self, batch: DataFrame, batch_id: int, now) -> None:
        start = self._start(now)
        kept = estimator.recent(batch, now, self.window_days).withColumn("day", F.to_date("observed_at"))
        kept = kept.select(NAME, F.col("observed_price").cast("bigint"), "observed_at", "day")
        kept.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/rows/version={batch_id}")
        rows = self.spark.read.schema(self.ROWS).parquet(f"{self.path}/rows/version={batch_id}")
        touched = [r.day for r in rows.select("day").distinct().collect()]  # days of one window
        versions = self._versions(batch_id - 1)
        old = self._read("counts", f"{self.FIELDS}, version bigint",
                         [f"{self.path}/counts/version={versions[d]}/day={d}" for d in touched if d in versions])
        left = (F.unix_micros(F.date_add("day", 1).cast("timestamp")) - F.unix_micros("observed_at")) / F.lit(86_400_000_000.0)
        weight = F.pow(F.lit(0.5), left / F.lit(float(self.half_life_days))).cast("decimal(38,18)")
        fresh = rows.groupBy(NAME, F.col("observed_price").alias("price"), "day").agg(
            F.count(F.lit(1)).alias("n"), F.sum(weight).cast("decimal(38,18)").alias("w"),
            F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"))
        merged = fresh.unionByName(old.drop("version")).groupBy(NAME, "price", "day").agg(
            F.sum("n").alias("n"), F.sum("w").cast("decimal(38,18)").alias("w"), F.min("oldest").alias("oldest"),
            F.max("newest").alias("newest"))
        merged.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/counts/version={batch_id}")
        current = {d: v for d, v in (versions | {d: batch_id for d in touched}).items() if d >= start.date()}
        self.days.write(self.spark.createDataFrame(sorted(current.items()), self.days.schema), batch_id)

    def _cut_days(self, versions: dict, now) -> list:
        """Days that the window's start or `now` falls into: their rows must be looked at one by one."""
        ends = {self._start(now).date(), estimator.utc(now).date()}
        return sorted(d for d in versions if d in ends or d > max(ends))

    def folders(self, batch_id: int, now) -> tuple[list[str], list[str]]:
        """(histogram folders, raw folders) that an estimate after this batch reads."""
        versions = self._versions(batch_id)
        cut = self._cut_days(versions, now)
        whole = [f"{self.path}/counts/version={v}/day={d}" for d, v in sorted(versions.items()) if d not in cut]
        return whole, [f"{self.path}/rows/version=*/day={d}" for d in cut]

    def histogram(self, batch_id: int, now) -> DataFrame:
        """The histogram of `estimator.price_histogram` for all rows up to this batch."""
        whole, raw = self.folders(batch_id, now)
        counts = self._read("counts", f"{self.FIELDS}, version bigint", whole)
        rows = self._read("rows", f"{self.ROWS}, version bigint", raw)
        cut = estimator.price_histogram(rows, now, self.window_days, self.half_life_days)
        age = estimator.age_days(F.date_add("day", 1).cast("timestamp"), now)
        parts, block_days = estimator.age_blocks(age, self.window_days, self.half_life_days)
        factor = estimator.decay_weight(age - parts * F.lit(block_days), self.half_life_days)
        kind = cut.schema["w"].dataType
        blocks = [estimator.BLOCK] if estimator.BLOCK in cut.columns else []
        aged = counts.select(NAME, "price", *(parts.alias(b) for b in blocks), "n",
                             (F.col("w").cast("double") * factor).cast(kind).alias("w"), "oldest", "newest")
        return aged.unionByName(cut).groupBy(NAME, "price", *blocks).agg(
            F.sum("n").alias("n"), F.sum("w").cast(kind).alias("w"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def refresh_from_histogram(table: DailyHistogram, estimates: AppendedBatches, manual: DataFrame | None, *, now,
                           **options) -> Callable[[DataFrame, int], None]:
    """Merge each batch into the histogram and re-estimate the products it touches."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, now)
        touched = batch.select(NAME).distinct()
        hist = table.histogram(batch_id, now).join(touched, NAME, "left_semi")
        fresh = estimator.histogram_estimates(hist, manual, names=touched, **options)
        estimates.write(fresh.withColumn("version", F.lit(batch_id)), batch_id)
    return handle


def latest_estimates(estimates: AppendedBatches) -> DataFrame:
    rows = estimates.read()
    columns = [c for c in rows.columns if c not in (NAME, "version")]
    newest = rows.groupBy(NAME).agg(F.max_by(F.struct(*columns), "version").alias("r"))
    return newest.select(NAME, *[F.col(f"r.{c}").alias(c) for c in columns])


def scan_listings(table: VersionedTable, verdicts: DataFrame, *, now
                  ) -> Callable[[DataFrame, int], None]:
    """Merge each batch of candidates into the stored listings by change state."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = table.read(batch_id - 1)
        newest = batch.groupBy(*merge.PRODUCT).agg(
            F.max_by(F.struct(*batch.columns), "record_no").alias("r")).select("r.*")
        judged = changes.candidate_state(newest.drop("record_no"), stored, verdicts)
        table.write(merge.merge_processed(stored, judged, now), batch_id)
    return handle


def resumable_backfill(seen: AppendedBatches, observations: AppendedBatches
                       ) -> Callable[[DataFrame, int], None]:
    """Record observations of products not seen in earlier batches; safe to repeat."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        order = [F.col("observed_at"), F.col("observed_price")]
        columns = [c for c in batch.columns]
        first = batch.groupBy(*merge.PRODUCT).agg(
            F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.*")
        fresh = first.join(seen.read(before=batch_id).select(*merge.PRODUCT), merge.PRODUCT,
                           "left_anti")
        observations.write(fresh, batch_id)
        seen.write(observations.spark.read.schema(observations.schema)
                   .parquet(f"{observations.path}/batch_id={batch_id}")
                   .select(*merge.PRODUCT), batch_id)
    return handle


def overlap_reread(marks: VersionedTable, admitted: AppendedBatches, overlap_days: float
                   ) -> Callable[[DataFrame, int], None]:
    """Admit rows up to an overlap behind each source's mark, once per product and fingerprint.

    Rows further behind the mark of their source than the overlap are late. All others are read, and
    dropped if the same content of the product was admitted by an earlier batch inside the overlap of the
    source it came from, or stands before them in the batch. Marks advance when the batch is through.
    ``batch``: product keys, source_key, search_fingerprint, updated_at, record_no.
    """
    keys = [*merge.PRODUCT, "search_fingerprint"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = marks.read(batch_id - 1)
        reach = stored.withColumn("reach", F.col("updated_at") - F.make_dt_interval(
            secs=F.lit(overlap_days * 86400.0))).select("marketplace", "source_key", "reach")
        rows = batch.join(reach, ["marketplace", "source_key"], "left")
        rows = rows.where(F.col("reach").isNull() | (F.col("updated_at") >= F.col("reach")))
        first = rows.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct("updated_at", "record_no")).alias("r"))
        first = first.select("r.*")
        # Only folders whose rows can reach into some overlap hold anything: the filter goes to the files.
        oldest = reach.agg(F.min("reach")).first()[0]
        before = admitted.read(before=batch_id)
        if oldest is not None:
            before = before.where(F.col("updated_at") >= F.lit(oldest))
        before = before.join(reach, ["marketplace", "source_key"], "left").where(
            F.col("reach").isNull() | (F.col("updated_at") >= F.col("reach"))).select(*keys).distinct()
        admitted.write(first.join(before, keys, "left_anti"), batch_id)
        # A batch of late rows alone must not take a mark back.
        both = stored.unionByName(changes.high_watermarks(batch).select(*stored.columns))
        marks.write(both.groupBy("marketplace", "source_key").agg(F.max("updated_at").alias("updated_at")), batch_id)
    return handle


def backfill_log(outcomes: AppendedBatches) -> Callable[[DataFrame, int], None]:
    """One folder a batch with every outcome: items, retries and cursors are committed together."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        outcomes.write(batch, batch_id)
    return handle


def backfill_cursors(outcomes: DataFrame) -> DataFrame:
    """Per query the page reached and what became of its items: the checkpoint a next run starts from."""
    def times(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names))

    return outcomes.groupBy("query_key").agg(
        F.max("page_no").alias("last_page"), times("observed").alias("observed"), times("seen", "waiting").alias("skipped"),
        times("unavailable").alias("unavailable"), times("queued").alias("queued"), times("retry_due").alias("retries_due"))


def alert_once(sent: AppendedBatches, send: Callable[[DataFrame], None]
               ) -> Callable[[DataFrame, int], None]:
    """Alert each (product, drop count) once; ``batch`` has product keys and ``epoch``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        keys = [*merge.PRODUCT, "epoch"]
        fresh = batch.dropDuplicates(keys).join(
            sent.read(before=batch_id).select(*keys), keys, "left_anti")
        sent.write(fresh, batch_id)
        send(fresh)
    return handle
