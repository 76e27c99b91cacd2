"""What the language model fetches to the driver leaves no shuffle files, and its last joins are stored."""

from __future__ import annotations

import os
import time

import numpy as np
from pyspark.sql import functions as F

from pricelode.llm.suffix_tree_lm import Bits, _often, language_model_scores


def _shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {file for top in folder for at, _, files in os.walk(top) for file in files if file.startswith("shuffle_")}


def _none_left(spark, before):
    end = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)  # files are removed in the background
    return not left


def test_bit_tables_and_bars_leave_no_shuffle_files(spark):
    counts = spark.range(5_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 50 + 1).alias("n"))
    before = _shuffle_files(spark)
    bits = Bits(counts.select("key"), 1 << 10)
    few = counts.where(_often(counts, 200))
    assert _none_left(spark, before)
    assert bits.may(np.array([r.key for r in counts.collect()], np.int64).view(np.uint64)).all()
    assert 0 < few.count() <= 200


def test_scores_are_joined_before_they_are_read(spark):
    texts = [(k, f"one two three four word{k} word{k % 3} one two") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scored = language_model_scores(docs, lambda key: F.col(key) % 7 != 2)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan
    assert scored.count() == 60
