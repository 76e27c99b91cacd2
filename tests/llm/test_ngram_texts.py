"""Texts of nodes that nothing asks for leave no task."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelode.llm import ngram_join


def test_only_wanted_texts_are_handed_to_the_join(spark, monkeypatch):
    docs = spark.range(300).select("id", F.concat(F.lit("some words of text number "), F.col("id").cast("string")).alias("text"))
    rows = ngram_join._rows(docs, 5)
    wanted = rows.where("id % 50 = 0").select("node")
    handed = []

    class Seen:
        def __init__(self, keys, size):
            self.bits = Bits(keys, size)
            handed.append(self)

        def may(self, keys):
            return self.bits.may(keys)

    Bits = ngram_join.Bits
    monkeypatch.setattr(ngram_join, "Bits", Seen)
    found = {r.text for r in ngram_join._texts(docs, 5, wanted).collect()}
    assert found == {f"some words of text number {k}" for k in range(0, 300, 50)}
    assert len(handed) == 1
