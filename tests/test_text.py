import pytest
from pyspark.sql import functions as F

from pricelode.catalog.common import NOTES, TEXTS
from pricelode.functions import fixed
from pricelode.functions import text as tx
from pricelode.functions.money import one_decimal

NAMES = [name for _, name in fixed.NAME_PATTERNS] + [
    "Intel Core i5-13600K", "Ryzen 5 5600", None, None, None, None]
GROUPS = ["normal"] * 5 + ["broken"] * 23 + ["risky"] * 22 + ["unknown"] * 19 + ["unknown"] + ["normal"] * 6
SCOPES = {"RTX 3070 구합니다": "unknown", "RTX 4060 달린 노트북": "unknown", "TUF gaming F15 4060": "unknown",
          "RTX 3070 박스": "accessory", "RTX 3070 풀박스 구성": None, "조립 컴퓨터 RTX 3060 Ti": "complete_pc",
          "라이젠 5600 보드 세트": "bundle", "Ryzen 5600 + 램 16기가": "bundle"}


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame(TEXTS, "k int, title string, description string")
    t = F.col("title")
    return rows.orderBy("k").select(
        "k", "title", tx.product_name(t).alias("name"),
        tx.condition_status(F.lit(""), F.col("description")).alias("condition"),
        tx.listing_scope(t, F.lit("")).alias("scope")).collect()


def test_names(judged):
    assert [r["name"] for r in judged[len(NOTES):][:len(NAMES)]] == NAMES


def test_conditions(judged):
    got = [r["condition"] for r in judged[:len(NOTES)]]
    assert {NOTES[k]: (g, e) for k, (g, e) in enumerate(zip(got, GROUPS, strict=True)) if g != e} == {}


def test_scopes(judged):
    assert {r["title"]: r["scope"] for r in judged[len(NOTES):] if r["title"] in SCOPES} == SCOPES


def _one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["v"] for r in rows.orderBy("i").select(column(F.col("x")).alias("v")).collect()]


def test_aliases_only_as_whole_text(spark):
    got = _one(spark, tx.product_name, " 7600X ", "i5-7600", "RX 5600 XT", "7600", "RTX4060박스",
               "RTX 4060 티아이", "라이젠 5700X3D", "라이젠 5700X", "WD SN850X 2TB", "b650m", None)
    assert got == ["Ryzen 5 7600X", None, None, "Ryzen 5 7600", None, "RTX 4060 Ti",
                   "Ryzen 7 5700X3D", "Ryzen 7 5700X", "WD Black SN850X 2TB", None, None]


def test_wide_and_unicode_text(spark):
    got = _one(spark, lambda x: tx.condition_status(F.lit(""), x), "ＮＯＴ　ＷＯＲＫＩＮＧ",
               "고장　없음", "한글broken", "fan noise", "   ")
    assert got == ["broken", "normal", "normal", "risky", "unknown"]


def test_price_text(spark):
    got = _one(spark, tx.price_from_text, "350,000원", "나눔", "가격 제안 100", "가격", "１２,０００원")
    assert got == [350000, None, None, None, 12000]


def test_rules_are_checked():
    with pytest.raises(ValueError):
        tx.check_rules({"broken": []})
    bad = {g: [] for g in ("normal_overrides", "broken", "risky", "unknown")}
    with pytest.raises(ValueError):
        tx.check_rules({**bad, "risky": "text"})
    with pytest.raises(ValueError):
        tx.check_rules({**bad, "risky": ["("]})


def test_custom_rules(spark):
    rules = {"normal_overrides": [], "broken": [r"\bFOO\d\b"], "risky": [], "unknown": []}
    got = _one(spark, lambda x: tx.condition_status(F.lit(""), x, rules), "a foo1", "afoo1", "foo")
    assert got == ["broken", "normal", "normal"]


def test_exact_percent_text(spark):
    values = [0.05, 0.15, 0.25, 0.35, 12.25, 12.75, -3.45, 99.95, 1024.25, -2048.75, 7.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["t"] for r in rows.select(one_decimal(F.col("v")).alias("t")).collect()] == \
        ["%.1f" % v for v in values]


def test_patterns_run_only_where_their_needles_occur(spark):
    """The byte search before a pattern never hides a match, and is there for all but one signal."""
    assert tx.needles(fixed.LAPTOP_TERMS) == {"노트북", "laptop", "macbook", "맥북"}
    assert tx.needles(r"as[ -]?is") == {"asis", "as is", "as-is"}
    assert tx.needles(r"(?:É|x)y*") is None and tx.needles(r"a*[0-9]{3}") is None
    patterns = [fixed.LAPTOP_TERMS, fixed.LAPTOP_MODEL, fixed.TITLE_COMPLETE_PC, fixed.COMPLETE_PC, fixed.BUNDLE,
                fixed.COMPONENT_LABEL, fixed.PART_TERMS, *fixed.SPEC_SIGNALS.values(), *(p for p, _ in fixed.NAME_PATTERNS)]
    assert [p for p in patterns if tx.needles(p) is None] == [fixed.SPEC_SIGNALS["board"]]
    texts = [x for pair in TEXTS for x in pair[1:]]
    texts = texts + [x.upper() for x in texts] + [x.swapcase() for x in texts] + ["RTX 3070 ßİΣ", "M.B: x", "mb: y", "AS-IS"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    t, low = F.col("t"), F.lower("t")
    differing = [F.sum((tx.found(t, p) != tx.found(t, p, low)).cast("int")) for p in patterns]
    assert set(rows.agg(*differing).first()) == {0}
