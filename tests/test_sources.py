import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelode.catalog import scans
from pricelode.functions import verdicts as v
from pricelode.sources import pages, search, tables


def test_search_payload(spark):
    records = [
        {"type": "PRODUCT", "status": "SELLING", "ad": False, "pid": 1, "name": " RTX 3070 ",
         "price": "300000", "updatedAt": "2026-01-02T00:00:00Z", "category": "x"},
        {"type": "PRODUCT", "status": "SOLD_OUT", "pid": 2, "name": "b", "price": 200000,
         "updatedAt": "2026-01-01T00:00:00Z"},
        {"type": "PRODUCT", "status": "SELLING", "pid": 3, "name": "c", "price": 900000,
         "updatedAt": "2026-01-01T00:00:00Z"},
        {"type": "PRODUCT", "ad": True, "pid": 4, "name": "d", "price": 1, "updatedAt": "x"},
        {"type": "BANNER", "pid": 5},
    ]
    body = {"data": {"responses": {"mainGrid": {"searchResponse": {"data": records,
                                                                   "cursor": "c2"}}}}}
    df = spark.createDataFrame([("s", 0, json.dumps(body)), ("s", 1, "broken")],
                               "source_key string, page_no bigint, payload string")
    judged = search.judged_records(search.search_records(df), 500_000)
    rows = {r["product_id"]: r for r in search.listings_of(judged).collect()}
    assert {k: (r["title"], r["price"], r["listing_status"]) for k, r in rows.items()} == {
        "1": ("RTX 3070", 300000, "active"), "2": ("b", 200000, "sold")}
    count = search.page_counters(judged, ["source_key", "page_no"]).first()
    assert (count["records"], count["irrelevant"], count["over_budget"]) == (5, 2, 1)
    with pytest.raises(ValueError):
        search.judged_records(df, 0)


def test_text_zero_is_an_id_and_number_zero_is_none(spark, tmp_path):
    records = [{"type": "PRODUCT", "pid": pid, "name": "a", "price": 1, "updatedAt": "x"} for pid in ("0", 0, "", None, "false")]
    body = {"data": {"responses": {"mainGrid": {"searchResponse": {"data": records}}}}}
    df = spark.createDataFrame([(json.dumps(body),)], "payload string")
    judged = search.judged_records(search.search_records(df))
    assert [r["reject_reason"] for r in judged.orderBy("pos").collect()] == [None, *["irrelevant"] * 3, None]
    # The scan's own payloads keep record 0.
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' AS ts, 1L AS user_id, 'view' AS event_type, 2.5D AS value FROM range(3)"
              ).write.parquet(f"{tmp_path}/events.parquet")
    assert sum(r["n"] for r in scans.search_fingerprints(spark, str(tmp_path)).collect()) == 3


PAGE = """<html><script type="application/ld+json">{"itemListElement":[{"item":{
"url":"/kr/buy-sell/a-1/?x=1","description":" hello "}},{"item":"bad"},7]}</script>
<script type="application/ld+json">nope</script>
<a href="/kr/buy-sell/s/">index</a>
<article><a href="/kr/buy-sell/a-1/?in=list"><h2>First <b>card</b></h2></a>
<span class="price">10,000원</span><span class="location">Seoul · 3h</span></article>
<li><a href="/articles/2"><span>Second</span><span>·</span><span>20,000원</span>
<span>Busan</span></a></li>
<li><a href="/articles/2"><span>Again</span><span>1원</span></a></li>
<li><a href="/articles/3"><span>Free</span><span class="price">나눔</span></a></li>
<li><a href="/articles/4"><img alt=" Pic "></a><p data-testid="x-price">30원</p></li>
<meta name="description" content="page text">"""


def test_cards_and_descriptions(spark):
    df = spark.createDataFrame(
        [(1, "https://www.example.com/kr/buy-sell/s/?q=1", PAGE, "index", "Home")],
        "page_id bigint, url string, html string, source_type string, default_location string")
    rows = pages.listing_cards(df, 3).orderBy("position").collect()
    assert [(r["title"], r["price"], r["location"], r["listing_id"], r["description"])
            for r in rows] == [("First card", 10000, "Seoul", "a-1", "hello"),
                               ("Second", 20000, "Busan", "2", ""),
                               ("Pic", 30, "Home", "4", "")]
    deep = "<p>" * 5000 + '<li><a href="/articles/9"><h3>Deep</h3></a><span>7원</span></li>'
    odd = spark.createDataFrame(
        [(2, "https://www.example.com/x", deep, "index", "Home"), (3, "bad url", "<<<a href=/articles/1>", "i", "H")],
        df.schema)
    assert [(r["page_id"], r["title"], r["price"]) for r in pages.listing_cards(odd).collect()] == [(2, "Deep", 7)]
    assert pages.meta_descriptions(df).first()["description"] == "page text"


def test_unreadable_pages_are_rejected_and_the_rest_is_read(spark):
    link = '<li><a href="/articles/9"><h3>Card</h3></a><span>7원</span></li>'
    rows = [(1, link), (2, link + "<![x]]>"), (3, "<![ x" + link), (4, '<a href="/articles/1">' * 5000 + link), (5, None),
            (6, "<p>no link <![x]]>"), (7, '<a href="http://[bad/articles/1">x</a>'), (8, link + "<p>" * 5000)]
    df = spark.createDataFrame([(k, "https://www.example.com/x", html, "index", "Home") for k, html in rows],
                               "page_id bigint, url string, html string, source_type string, default_location string")
    facts = pages.link_facts(df)
    rejects = {r["page_id"]: r["reject"].split(":")[0] for r in pages.page_rejects(facts).collect()}
    assert rejects == {2: "unreadable markup", 3: "unreadable markup", 4: "links nested too deep", 7: "unreadable link"}
    assert [r["page_id"] for r in pages.listing_cards(df, facts=facts).orderBy("page_id").collect()] == [1, 8]


GOOD = {"normalized_product_name": "RTX 3070", "exact_product": True, "condition": "normal",
        "confidence": 0.95, "reason": "ok", "scope": "standalone", "sale_status": "active",
        "model_mismatch": False, "price_bait": False, "hidden_price_condition": False,
        "displayed_price": 5, "effective_price": None, "price_source": "both",
        "price_confidence": 1, "usable_price": True}


def test_verdict_rules(spark):
    def without(key):
        return {k: x for k, x in GOOD.items() if k != key}

    cases = [
        (GOOD, True), ({**GOOD, "confidence": 1}, True), (without("reason"), False),
        ({**GOOD, "more": 1}, False), ({**GOOD, "exact_product": "true"}, False),
        ({**GOOD, "confidence": True}, False), ({**GOOD, "confidence": 1.1}, False),
        ({**GOOD, "displayed_price": 5.0}, False), ({**GOOD, "displayed_price": 0}, False),
        ({**GOOD, "effective_price": 0}, False), ({**GOOD, "effective_price": 9}, True),
        ({**GOOD, "reason": 3}, False), ({**GOOD, "scope": "x"}, False),
        ({**GOOD, "normalized_product_name": None}, True), ([GOOD], False), (None, False),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)],
                               "i int, text string")
    got = {r["i"]: r["ok"] for r in v.with_first_verdict(df, "text").select(
        "i", F.col("verdict").isNotNull().alias("ok")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)}


def test_tables(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a": 5, "b": 7}))
    assert {r[0]: r[1] for r in tables.read_manual_prices(
        spark, str(tmp_path / "p.json")).collect()} == {"a": 5, "b": 7}
    (tmp_path / "bad.json").write_text(json.dumps({"a": 0}))
    with pytest.raises(Exception, match="positive"):
        tables.read_manual_prices(spark, str(tmp_path / "bad.json")).collect()
    groups = {g: ["x"] for g in ("normal_overrides", "broken", "risky", "unknown")}
    (tmp_path / "r.json").write_text(json.dumps(groups))
    assert tables.read_condition_rules(spark, str(tmp_path / "r.json")) == groups
    runs = spark.createDataFrame([(1, "success", "x" * 3000)], "id bigint, status string, "
                                                               "detail string")
    tables.append_log(tables.run_rows(runs), str(tmp_path / "log"))
    tables.append_log(tables.run_rows(runs), str(tmp_path / "log"))
    assert [len(r["detail"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [
        2000, 2000]


def test_facts_of_many_pages_leave_in_small_frames():
    html = '<a href="/kr/buy-sell/a-1/"><h2>x</h2></a>' * 10
    batch = pd.DataFrame([(k, "https://x/", html, "s", "") for k in range(1000)])
    sizes = [len(found) for found in pages._links(iter([batch]))]
    assert sum(sizes) == 10_000 and max(sizes) <= pages.FACTS_AT_ONCE + 10
