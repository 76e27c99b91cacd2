"""A scan parses its pages once and moves its records no more often than it must."""

from __future__ import annotations

import pytest

from pricelode.catalog import scans
from pricelode.plans import scan


@pytest.mark.parametrize("halting", [False, True])
def test_pages_are_parsed_once_and_records_stored_twice(spark, monkeypatch, halting):
    parsed, stored = [], []
    parse, stage = scan.search.search_records, scan.stage_table

    def counted(payloads, *rest):
        parsed.append(1)
        return parse(payloads, *rest)

    def named(df, name):
        stored.append(name)
        return stage(df, name)

    monkeypatch.setattr(scan.search, "search_records", counted)
    monkeypatch.setattr(scan, "stage_table", named)
    scans._scanned(spark, "/root/testdata/sf0.001", halting)
    assert len(parsed) == 1
    # No source has a watermark and no product repeats, so the sources add nothing to join.
    assert [n for n in stored if n.startswith(("scan-judged", "scan-cand", "scan-source", "scan-rec"))] == [
        "scan-judged", "scan-candidates"]
