"""Stored tables leave no shuffle files behind."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from pricelode.session import stage_table


def _shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {file for top in folder for at, _, files in os.walk(top) for file in files if file.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write_and_the_data_stays_readable(spark):
    rows = spark.range(10_000).withColumn("k", F.col("id") % 977)
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    before = _shuffle_files(spark)
    stored = stage_table(counted.join(rows.select("k").distinct(), "k"), "counted")
    end = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)  # files are removed in the background
    assert not left
    assert stored.agg(F.sum("n")).first()[0] == 10_000
    # The frame that was stored is still usable, again and after its own action.
    assert counted.agg(F.sum("n")).first()[0] == 10_000
    assert counted.count() == counted.count() == 977
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
