"""Small helpers of the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch; with long texts a batch stays tens of megabytes.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or the first of name_1, name_2, ... that no column of `df` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    if name.lower() not in taken:
        return name
    k = 1
    while f"{name}_{k}".lower() in taken:
        k += 1
    return f"{name}_{k}"


def column(df: DataFrame, name: str):
    """A top-level column by its exact name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch],
                added: list[tuple[str, T.DataType]]) -> DataFrame:
    """Append columns made from whole Arrow batches; rows and other columns stay as they are.

    `function(batch)` returns one Arrow array per added column. An added column whose name is
    taken replaces that column.
    """
    names = {name.lower() for name, _ in added}
    kept = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in kept),
                           *(T.StructField(name, kind) for name, kind in added)])

    names_in = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch.rename_columns(names_in))
            columns = [batch.column(names_in.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *(n for n, _ in added)])

    small_batches(df.sparkSession)
    # Numbered names: the input's own may hold dots.
    return df.toDF(*(f"c{k}" for k in range(len(names_in)))).mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; long documents share a batch with at most `BATCH_ROWS` others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def is_held_out(key: str, folds: int, remainder: int):
    """True where crc32 of the id's text has this remainder; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == remainder, F.lit(False))


def lower_ascii(text):
    """A-Z in lower case; all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sql_quoted(text: str) -> str:
    return "'" + re.sub("'", "''", text) + "'"
