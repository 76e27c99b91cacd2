"""Repair names a text once, and only texts that nothing else rejects."""

from __future__ import annotations

from pricelode.operators import verdict_flow
from pricelode.schemas import LISTINGS, VERDICT_LOG


def test_repair_names_each_text_once(spark, monkeypatch):
    named, name = [], verdict_flow.product_name

    def counted(text):
        named.append(1)
        return name(text)

    monkeypatch.setattr(verdict_flow, "product_name", counted)
    out = verdict_flow.repair_listings(spark.createDataFrame([], LISTINGS), spark.createDataFrame([], VERDICT_LOG),
                                       threshold=0.9, model="m", effort="e", version="v")
    assert len(named) == 2  # one of the title and one of the description
    assert "outcome" in out.columns and out.count() == 0
