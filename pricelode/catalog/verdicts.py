"""Verdict validation, application, caches, second review and repair over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as v
from ..functions.prints import classification_fingerprint, review_fingerprint
from ..operators import verdict_flow as flow
from . import common as c
from . import oracle_text as ot

MODEL, EFFORT, VERSION = "m1", "medium", "v6"

# Product names that verdicts give, and their canonical forms.
GIVEN = ["RTX 4070 SUPER", "4060 Ti", "RTX 3070", "mystery", None, "DDR5 32GB", "RTX 4060 Ti"]
CANONICAL = ["RTX 4070 SUPER", "RTX 4060 Ti", "RTX 3070", None, None, "DDR5 32GB", "RTX 4060 Ti"]


def _choice(values, key):
    out = F.lit(None).cast("string")
    for i, value in enumerate(values):
        if value is not None:
            out = F.when(F.pmod(key, F.lit(len(values))) == i, value).otherwise(out)
    return out


def _choice_sql(values, key="id"):
    return f"CASE {key} % {len(values)} " + " ".join(
        f"WHEN {i} THEN '{value}'" for i, value in enumerate(values) if value) + " END"


def _mod(n: int):
    return F.pmod("id", F.lit(n))


def _facts():
    """Verdict facts of a listing, varied by its key."""
    return {
        "normalized_product_name": _choice(GIVEN, F.col("id")),
        "exact_product": _mod(23) != 0,
        "condition": F.when(_mod(29) == 0, "risky").otherwise("normal"),
        "confidence": F.when(_mod(10) == 0, F.lit(0.5)).otherwise(F.lit(0.95)),
        "reason": F.concat(F.lit(" r"), F.col("product_id"), F.lit(" ")),
        "scope": F.when(_mod(31) == 0, "bundle").otherwise("standalone"),
        "sale_status": F.when(_mod(37) == 0, "sold").otherwise("active"),
        "model_mismatch": _mod(41) == 0, "price_bait": _mod(43) == 0,
        "hidden_price_condition": _mod(47) == 0,
        "displayed_price": F.when(_mod(17) == 0, F.col("price") + 1).otherwise(F.col("price")),
        "effective_price": F.when(_mod(19) != 0, F.greatest(F.col("price") - 10, F.lit(1))),
        "price_source": F.lit("both"), "price_confidence": F.lit(0.9),
        "usable_price": _mod(53) != 0,
    }


_FACTS_SQL = f"""{c.LISTINGS_SQL}, facts AS (SELECT *, {_choice_sql(GIVEN)} AS v_name,
  {_choice_sql(CANONICAL)} AS canon, id % 23 <> 0 AS v_exact,
  CASE WHEN id % 29 = 0 THEN 'risky' ELSE 'normal' END AS v_cond,
  CASE WHEN id % 10 = 0 THEN 0.5 ELSE 0.95 END::DOUBLE AS v_conf, 'r' || product_id AS v_reason,
  CASE WHEN id % 31 = 0 THEN 'bundle' ELSE 'standalone' END AS v_scope,
  CASE WHEN id % 37 = 0 THEN 'sold' ELSE 'active' END AS v_sale, id % 41 = 0 AS v_mis,
  id % 43 = 0 AS v_bait, id % 47 = 0 AS v_hid,
  CASE WHEN id % 17 = 0 THEN price + 1 ELSE price END AS v_disp,
  CASE WHEN id % 19 <> 0 THEN greatest(price - 10, 1) END AS v_eff, id % 53 <> 0 AS v_use
  FROM listings)"""


def _with_json(rows, facts):
    """Verdict JSON per row; one row in two is broken in one of nine ways."""
    body = F.to_json(F.struct(*[x.alias(k) for k, x in facts.items()]),
                     {"ignoreNullFields": "false"})
    rows = rows.withColumn("body", body)
    body = F.col("body")
    return rows.withColumn("json", (
        F.when(_mod(18) == 1, F.replace(body, F.lit('"price_bait"'), F.lit('"bait"')))
        .when(_mod(18) == 3, F.replace(body, F.lit('{"norm'), F.lit('{"extra":1,"norm')))
        .when(_mod(18) == 5, F.replace(body, F.lit('"usable_price":true'),
                                       F.lit('"usable_price":"true"')))
        .when(_mod(18) == 7, F.replace(body, F.lit('"confidence":0.'), F.lit('"confidence":7.')))
        .when(_mod(18) == 9, F.regexp_replace(body, r'"displayed_price":(\d+)',
                                              r'"displayed_price":$1.0'))
        .when(_mod(18) == 11, F.replace(body, F.lit('"standalone"'), F.lit('"alone"')))
        .when(_mod(18) == 13, F.substring(body, 1, 60))
        .when(_mod(18) == 15, F.regexp_replace(body, r'"reason":"[^"]*"', '"reason":5'))
        .when(_mod(18) == 17, F.regexp_replace(body, r'"displayed_price":\d+',
                                               '"displayed_price":0'))
        .otherwise(body))).drop("body")


# Rows whose JSON stays well formed by the rules above.
_VALID_SQL = """(id % 2 = 0 OR (id % 18 = 5 AND id % 53 = 0) OR (id % 18 = 11 AND id % 31 = 0))"""


def validation(spark, sf_dir):
    rows = v.with_first_verdict(_with_json(c.listings(spark, sf_dir), _facts()), "json", "r")
    return rows.select("id", F.col("r").isNotNull().alias("valid"), "r.normalized_product_name",
                       "r.confidence", "r.displayed_price", "r.effective_price", "r.reason",
                       "r.scope")


def second_validation(spark, sf_dir):
    facts = {k: x for k, x in _facts().items() if k != "price_source"}
    rows = v.with_second_verdict(_with_json(c.listings(spark, sf_dir), facts), "json", "r")
    return rows.select("id", F.col("r").isNotNull().alias("valid"), "r.usable_price",
                       "r.sale_status", "r.price_confidence")


def _judged(spark, sf_dir):
    rows = _with_json(c.listings(spark, sf_dir), _facts())
    rows = v.with_first_verdict(rows, "json").drop("json")
    return rows.withColumns({
        "ai_scope": F.lit("unknown"), "ai_usable_price": F.lit(False),
        "effective_price": F.lit(None).cast("bigint")})


def application(spark, sf_dir):
    out = flow.apply_verdicts(_judged(spark, sf_dir), 0.8)
    return out.select("id", "condition_status", "ai_is_computer_part",
                      "ai_normalized_product_name", "ai_confidence", "ai_reject", "ai_reason",
                      "ai_scope", "ai_sale_status", "ai_usable_for_market_price",
                      "effective_price", "ai_usable_price")


_APPLIED_SQL = f"""{_FACTS_SQL},
n AS (SELECT *, {_VALID_SQL} AS ok, {ot.name_case('title')} AS tn,
  {ot.name_case('description')} AS dn FROM facts),
e AS (SELECT *, canon IS NOT NULL AND (COALESCE(tn = canon, FALSE) OR COALESCE(dn = canon, FALSE))
  AS evid, {ot.identity('canon')} AS pid FROM n),
j AS (SELECT *, NOT (v_name IS NOT NULL AND v_scope = 'standalone' AND v_cond = 'normal'
  AND v_conf >= 0.9 AND evid AND pid AND v_sale = 'active' AND v_exact AND NOT v_mis AND NOT v_bait
  AND NOT v_hid AND v_use AND COALESCE(v_eff > 0, FALSE) AND v_disp = price) AS rej FROM e),
applied AS (SELECT *,
  CASE WHEN NOT ok OR v_conf < 0.9 OR canon IS NULL THEN 'unknown' ELSE v_cond END AS a_cond,
  ok AND v_scope = 'standalone' AND v_name IS NOT NULL AS a_part,
  CASE WHEN ok THEN canon ELSE ai_normalized_product_name END AS a_name,
  CASE WHEN ok THEN v_conf ELSE 0.0 END AS a_conf, NOT ok OR rej AS a_rej,
  CASE WHEN NOT ok THEN 'Codex CLI classification failed'
    WHEN v_name IS NOT NULL AND canon IS NULL
      THEN 'AI normalized product cannot be canonicalized: ' || v_name
    WHEN canon IS NOT NULL AND NOT evid
      THEN 'AI normalized product is not evidenced by exact listing text'
    WHEN canon IS NOT NULL AND NOT pid THEN 'discovery bucket is not a coherent pricing identity'
    WHEN v_disp <> price THEN 'AI displayed price does not match fetched marketplace price'
    WHEN v_bait THEN 'AI identified a placeholder, bait, or otherwise misleading price'
    WHEN v_hid THEN 'AI identified an unresolved hidden pricing condition'
    ELSE v_reason END AS a_reason,
  CASE WHEN ok THEN v_scope ELSE 'unknown' END AS a_scope,
  CASE WHEN ok THEN v_sale ELSE 'unknown' END AS a_sale, ok AND NOT rej AS a_usable,
  CASE WHEN ok AND NOT rej THEN v_eff END AS a_eff, ok AND v_use AND NOT rej AS a_useprice FROM j)"""


def exclusion_counts(spark, sf_dir):
    return flow.reason_counts(flow.exclusions(c.listings(spark, sf_dir), 0.3))


def exclusion_rows(spark, sf_dir):
    rows = flow.exclusions(c.listings(spark, sf_dir), 0.3, F.lit("Brand#7"))
    return rows.select("id", "reason")


def exclusion_examples(spark, sf_dir):
    rows = flow.exclusions(c.listings(spark, sf_dir), 0.3)
    return flow.first_examples(rows, [F.col("id")]).select("id", "reason", "price", "title")


def backlog_gates(spark, sf_dir):
    judged = flow.apply_verdicts(_judged(spark, sf_dir), 0.8)
    return flow.reason_counts(flow.backlog_gates(judged, 0.9), "gate")


def stored_backlog(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    return rows.select("id", v.backlog_candidate(0.4).alias("candidate"),
                       v.accepted_normal(0.4).alias("accepted"))


def _verdict_log(spark, sf_dir):
    """Stored verdicts: newer and older ones per listing, some for other content or models."""
    rows = c.listings(spark, sf_dir)
    facts = {k: x for k, x in _facts().items()}
    base = rows.select(
        "marketplace", "product_id", "id", classification_fingerprint().alias("print"),
        *[x.alias(f"f_{k}") for k, x in facts.items()])
    copies = base.withColumn("copy", F.explode(F.array(*[F.lit(n) for n in range(3)])))
    nth = F.col("copy")
    return copies.select(
        (F.col("id") * 3 + nth).alias("id"), "marketplace", "product_id",
        F.when((nth == 2) & (_mod(2) == 0), "other").otherwise(F.col("print"))
        .alias("classification_fingerprint"),
        F.when((nth == 1) & (_mod(3) == 0), "m2").otherwise(MODEL).alias("model"),
        F.lit(EFFORT).alias("reasoning_effort"), F.lit(VERSION).alias("classifier_version"),
        (~((nth == 0) & (_mod(5) == 0))).alias("success"),
        F.lit(True).alias("is_computer_part"),
        F.concat(F.lit("c"), nth.cast("string")).alias("reason"),
        F.col("f_condition").alias("condition_status"),
        F.when((nth == 1) & (_mod(7) == 0), "unknown").otherwise(F.col("f_scope")).alias("scope"),
        *[F.col(f"f_{k}").alias(k) for k in facts if k not in ("condition", "scope", "reason")])


def cache_lookup(spark, sf_dir):
    rows = flow.cached_verdict(c.listings(spark, sf_dir), _verdict_log(spark, sf_dir), MODEL,
                               EFFORT, VERSION)
    return rows.select("id", F.col("verdict").isNotNull().alias("hit"), "verdict.reason")


def _deals(spark, sf_dir):
    rows = c.listings(spark, sf_dir).where(F.col("effective_price").isNotNull())
    return rows.withColumns({
        "normalized_name": F.when(_mod(2) == 0, "RTX 4070 SUPER").otherwise("RTX 4060 Ti"),
        "reference_price": F.col("effective_price") + _mod(100) * F.col("effective_price") / 100,
    }).withColumn("reference_price", F.floor("reference_price")).withColumn(
        "discount_percent", (F.col("reference_price") - F.col("effective_price")).cast("double")
        / F.col("reference_price").cast("double") * F.lit(100.0))


def _details(spark, sf_dir):
    rows = c.listings(spark, sf_dir).where(_mod(9) != 4)
    return rows.select(
        "product_id", F.col("title").alias("name"), "description",
        F.when(_mod(21) == 5, F.col("price") + 5).otherwise(F.col("price")).alias("price"),
        F.when(_mod(15) == 7, "SOLD").otherwise("SELLING").alias("saleStatus"),
        F.lit(None).cast("string").alias("status"))


def prechecks(spark, sf_dir):
    out = flow.review_prechecks(_deals(spark, sf_dir), _details(spark, sf_dir), 10.0, 0.2)
    return out.select("id", "precheck")


def _second_verdicts(spark, sf_dir):
    deals = _deals(spark, sf_dir).where(_mod(8) != 6)
    facts = {
        "exact_product": F.lit(True), "normalized_product_name": F.col("normalized_name"),
        "scope": F.lit("standalone"), "condition": F.lit("normal"), "sale_status": F.lit("active"),
        "model_mismatch": F.lit(False), "displayed_price": F.col("price"),
        "effective_price": F.col("effective_price"), "price_bait": F.lit(False),
        "hidden_price_condition": F.lit(False), "usable_price": _mod(4) != 2,
        "price_confidence": F.lit(0.9),
        "confidence": F.when(_mod(16) == 3, F.lit(0.1)).otherwise(F.lit(0.9)),
        "reason": F.lit("looks fine"),
    }
    body = F.to_json(F.struct(*[x.alias(k) for k, x in facts.items()]),
                     {"ignoreNullFields": "false"})
    return deals.select(
        "id", "marketplace", "product_id", review_fingerprint().alias("review_fingerprint"),
        F.lit(MODEL).alias("model"), F.lit(EFFORT).alias("reasoning_effort"),
        F.lit(True).alias("success"), body.alias("verdict_json"))


def gate(spark, sf_dir):
    out = flow.review_gate(_deals(spark, sf_dir), _details(spark, sf_dir),
                           _second_verdicts(spark, sf_dir), minimum_discount_percent=10.0,
                           threshold=0.2, model=MODEL, effort=EFFORT)
    return out.select("id", "passed", "review_status", "review_reason")


def approved(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    log = rows.select(
        "id", "marketplace", F.concat(F.lit("p"), _mod(900).cast("string")).alias("product_id"),
        F.when(_mod(3) == 0, "rejected").otherwise("approved").alias("review_status"),
        (_mod(7) != 0).alias("success"), F.col("ai_confidence").alias("confidence"),
        F.when(_mod(5) != 0, F.col("title")).alias("reason"))
    return flow.approved_reviews(log).select("product_id", "second_stage_confidence", "reason")


def routes(spark, sf_dir):
    return flow.repair_routes(c.listings(spark, sf_dir)).select(
        "id", "outcome", "route_reason", "accepted_name")


def repair(spark, sf_dir):
    out = flow.repair_listings(c.listings(spark, sf_dir), _verdict_log(spark, sf_dir),
                               threshold=0.9, model=MODEL, effort=EFFORT, version=VERSION)
    return out.select("id", "outcome", "condition_status", "ai_is_computer_part", "ai_confidence",
                      "ai_reject", "ai_scope", "ai_usable_for_market_price",
                      "reviewed_by_verdict")


def repair_totals(spark, sf_dir):
    return flow.repair_summary(flow.repair_listings(
        c.listings(spark, sf_dir), _verdict_log(spark, sf_dir), threshold=0.9, model=MODEL,
        effort=EFFORT, version=VERSION))


def unreliable(spark, sf_dir):
    rows = c.listings(spark, sf_dir)
    ok = v.reliable_content()
    out = {k: F.when(ok, F.col(k)).otherwise(x) for k, x in v.unreliable_columns().items()}
    return rows.withColumns(out).select("id", "condition_status", "ai_reject", "ai_scope",
                                        "effective_price")


QUERIES = {
    "verdict_validation": validation, "second_verdict_validation": second_validation,
    "verdict_application": application, "exclusion_reasons": exclusion_counts,
    "exclusion_rows": exclusion_rows, "exclusion_examples": exclusion_examples,
    "backlog_rejections": backlog_gates, "backlog_candidates": stored_backlog,
    "verdict_cache": cache_lookup, "review_prechecks": prechecks, "review_gate": gate,
    "approved_reviews": approved, "repair_routes": routes, "repair_listings": repair,
    "unreliable_content": unreliable, "repair_summary": repair_totals,
}

_REASON = """CASE WHEN listing_status <> 'active' THEN 'status:' || listing_status
  WHEN condition_status <> 'normal' THEN 'condition:' || condition_status
  WHEN ai_scope <> 'standalone' THEN 'scope:' || ai_scope
  WHEN ai_reject OR NOT COALESCE(ai_is_computer_part, FALSE) THEN 'ai_rejected'
  WHEN NOT ai_usable_for_market_price THEN 'not_usable_for_market_price'
  WHEN ai_confidence < 0.3 THEN 'low_confidence' {last} END"""

_DEALS_SQL = f"""{c.LISTINGS_SQL}, d0 AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'RTX 4070 SUPER'
  ELSE 'RTX 4060 Ti' END AS nm, CAST(floor(effective_price + (id % 100) * effective_price / 100.0::DOUBLE)
  AS BIGINT) AS ref, {ot.name_case('title')} AS tn, {ot.name_case('description')} AS dn
  FROM listings WHERE effective_price IS NOT NULL),
d AS (SELECT *, CAST(ref - effective_price AS DOUBLE) / ref * 100.0 AS disc FROM d0),
pre AS (SELECT *, CASE WHEN NOT (listing_status = 'active' AND ai_scope = 'standalone'
    AND condition_status = 'normal' AND NOT ai_reject AND COALESCE(ai_is_computer_part, FALSE)
    AND ai_usable_for_market_price AND ai_usable_price AND ai_confidence >= 0.2)
    THEN 'listing did not pass first-stage bargain filters'
  WHEN disc < 10 THEN 'listing no longer meets final-review discount threshold'
  WHEN id % 9 = 4 THEN 'current Bunjang detail request failed'
  WHEN id % 15 = 7 THEN 'current Bunjang listing is not active'
  WHEN id % 21 = 5 THEN 'current Bunjang displayed price changed'
  WHEN NOT (COALESCE(tn = nm, FALSE) OR COALESCE(dn = nm, FALSE))
    THEN 'current Bunjang detail no longer matches product identity' END AS precheck FROM d)"""

_ROUTE_FOLDED, _ROUTE_COND = ot.condition_case("title", "description")
_JOINED = ot.joined("title", "description")
_ROUTES_SQL = f"""{c.LISTINGS_SQL}, f AS (SELECT *, {_ROUTE_FOLDED} AS folded,
  {ot.name_case('title')} AS tn, {ot.name_case('description')} AS dn,
  {ot.scope_case('title', 'description')} AS sc FROM listings),
g AS (SELECT *, {_ROUTE_COND} AS cond FROM f),
h AS (SELECT *, CASE WHEN listing_status <> 'active' THEN 'rule-based listing status is '
    || listing_status WHEN sc IS NOT NULL THEN 'rule-based listing scope is ' || sc
  WHEN cond IN ('broken', 'risky') THEN 'rule-based condition status is ' || cond
  WHEN NOT {ot.part_test(_JOINED)} THEN 'rule-based computer-part match missing'
  WHEN COALESCE(tn, dn) IS NULL THEN 'rule-based supported exact model match missing'
  WHEN NOT {ot.identity('COALESCE(tn, dn)')}
    THEN 'discovery bucket is not a coherent pricing identity' END AS rr FROM g),
routes AS (SELECT *, CASE WHEN rr IS NULL AND cond = 'normal' AND (dn IS NULL OR dn = tn) THEN tn END
  AS acc FROM h)"""

_FACTS_ONLY = "facts AS" + _FACTS_SQL.split("facts AS", 1)[1]

# Which stored verdict the cache finds for a listing (null = none).
_CACHE_SQL = """CASE WHEN id % 2 <> 0 THEN 2 WHEN id % 3 <> 0 THEN
    CASE WHEN id % 7 = 0 THEN NULL ELSE 1 END WHEN id % 5 <> 0 THEN 0 END"""

SQL = {
    "verdict_validation": f"""WITH {_FACTS_SQL} SELECT id, {_VALID_SQL} AS valid,
  CASE WHEN {_VALID_SQL} THEN v_name END AS normalized_product_name,
  CASE WHEN {_VALID_SQL} THEN v_conf END AS confidence,
  CASE WHEN {_VALID_SQL} THEN v_disp END AS displayed_price,
  CASE WHEN {_VALID_SQL} THEN v_eff END AS effective_price,
  CASE WHEN {_VALID_SQL} THEN v_reason END AS reason,
  CASE WHEN {_VALID_SQL} THEN v_scope END AS scope FROM facts""",
    "second_verdict_validation": f"""WITH {_FACTS_SQL} SELECT id, {_VALID_SQL} AS valid,
  CASE WHEN {_VALID_SQL} THEN v_use END AS usable_price,
  CASE WHEN {_VALID_SQL} THEN v_sale END AS sale_status,
  CASE WHEN {_VALID_SQL} THEN 0.9::DOUBLE END AS price_confidence FROM facts""",
    "verdict_application": f"""WITH {_APPLIED_SQL} SELECT id, a_cond AS condition_status,
  a_part AS ai_is_computer_part, a_name AS ai_normalized_product_name, a_conf AS ai_confidence,
  a_rej AS ai_reject, a_reason AS ai_reason, a_scope AS ai_scope, a_sale AS ai_sale_status,
  a_usable AS ai_usable_for_market_price, a_eff AS effective_price, a_useprice AS ai_usable_price
FROM applied""",
    "exclusion_reasons": f"""WITH {c.LISTINGS_SQL}, x AS (SELECT {_REASON.format(last='')} AS reason
  FROM listings) SELECT reason, COUNT(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1""",
    "exclusion_rows": f"""WITH {c.LISTINGS_SQL}, x AS (SELECT id, {_REASON.format(
        last="WHEN ai_normalized_product_name <> 'Brand#7' THEN 'misclassified_product'")}
  AS reason FROM listings) SELECT * FROM x WHERE reason IS NOT NULL""",
    "exclusion_examples": f"""WITH {c.LISTINGS_SQL}, x AS (SELECT id, {_REASON.format(last='')}
  AS reason, price, title FROM listings) SELECT * FROM x WHERE reason IS NOT NULL
ORDER BY id LIMIT 8""",
    "backlog_rejections": f"""WITH {_APPLIED_SQL}, g AS (SELECT CASE
  WHEN listing_status <> 'active' OR a_sale <> 'active' THEN 'current_not_active'
  WHEN a_conf < 0.9 THEN 'low_first_stage_confidence'
  WHEN a_scope <> 'standalone' THEN 'non_standalone'
  WHEN a_cond <> 'normal' THEN 'abnormal_or_condition'
  WHEN a_name IS NULL OR NOT (COALESCE(tn = a_name, FALSE) OR COALESCE(dn = a_name, FALSE))
    THEN 'model_mismatched'
  WHEN NOT a_useprice OR a_eff IS NULL THEN 'ambiguous_price'
  WHEN a_rej OR NOT a_part OR NOT a_usable THEN 'first_stage_rejected' END AS gate FROM applied)
SELECT gate, COUNT(*) AS n FROM g GROUP BY 1""",
    "backlog_candidates": f"""WITH {c.LISTINGS_SQL} SELECT id, listing_status = 'active'
  AND ai_scope = 'standalone' AND condition_status = 'normal'
  AND COALESCE(ai_is_computer_part, FALSE) AND NOT ai_reject AND ai_usable_for_market_price
  AND ai_usable_price AND effective_price IS NOT NULL AND ai_confidence >= 0.4 AS candidate,
  COALESCE(ai_is_computer_part, FALSE) AND NOT ai_reject AND condition_status = 'normal'
  AND ai_usable_for_market_price AND ai_confidence >= 0.4 AS accepted FROM listings""",
    "verdict_cache": f"""WITH {c.LISTINGS_SQL}, k AS (SELECT id, {_CACHE_SQL} AS copy FROM listings)
SELECT id, copy IS NOT NULL AS hit, 'c' || copy AS reason FROM k""",
    "review_prechecks": f"WITH {_DEALS_SQL} SELECT id, precheck FROM pre",
    "review_gate": f"""WITH {_DEALS_SQL}, r AS (SELECT *, CASE WHEN precheck IS NOT NULL
  THEN 'precheck_failed' WHEN id % 8 = 6 THEN 'failed'
  WHEN id % 4 <> 2 AND id % 16 <> 3 THEN 'approved' ELSE 'rejected' END AS st FROM pre)
SELECT id, st = 'approved' AS passed, st AS review_status, COALESCE(precheck,
  CASE WHEN id % 8 = 6 THEN 'text AI review failed' ELSE 'looks fine' END) AS review_reason FROM r""",
    "approved_reviews": f"""WITH {c.LISTINGS_SQL} SELECT 'p' || (id % 900) AS product_id,
  ai_confidence AS second_stage_confidence,
  CASE WHEN id % 5 <> 0 THEN title ELSE '' END AS reason FROM listings
WHERE id % 3 <> 0 AND id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY id % 900
  ORDER BY id DESC) = 1""",
    "repair_routes": f"""WITH {_ROUTES_SQL} SELECT id, CASE WHEN rr IS NOT NULL THEN 'reject'
  WHEN acc IS NOT NULL THEN 'accept' ELSE 'review' END AS outcome, rr AS route_reason,
  acc AS accepted_name FROM routes""",
    "repair_listings": f"""WITH {_ROUTES_SQL}, {_FACTS_ONLY},
m AS (SELECT r.id, r.price, r.rr, r.acc, r.cond, r.sc, r.tn, r.dn, f.id AS fid, f.v_name, f.canon,
  f.v_exact, f.v_cond, f.v_conf, f.v_scope, f.v_sale, f.v_mis, f.v_bait, f.v_hid, f.v_disp,
  f.v_eff, f.v_use, {_CACHE_SQL.replace("id %", "r.id %")} IS NOT NULL
  AS hit, rr IS NULL AND acc IS NULL AS rev FROM routes r JOIN facts f ON r.id = f.id),
e AS (SELECT *, canon IS NOT NULL AND (COALESCE(tn = canon, FALSE) OR COALESCE(dn = canon, FALSE))
  AS evid, {ot.identity('canon')} AS pid FROM m),
j AS (SELECT *, NOT (v_name IS NOT NULL AND v_scope = 'standalone' AND v_cond = 'normal'
  AND v_conf >= 0.9 AND evid AND pid AND v_sale = 'active' AND v_exact AND NOT v_mis AND NOT v_bait
  AND NOT v_hid AND v_use AND COALESCE(v_eff > 0, FALSE) AND v_disp = price) AS rej FROM e)
SELECT fid AS id, CASE WHEN rr IS NOT NULL THEN 'reject' WHEN acc IS NOT NULL THEN 'accept'
    WHEN hit AND NOT rej THEN 'accept' ELSE 'reject' END AS outcome,
  CASE WHEN rr IS NOT NULL THEN cond WHEN NOT rev THEN 'normal' WHEN NOT hit OR v_conf < 0.9
    OR canon IS NULL THEN 'unknown' ELSE v_cond END AS condition_status,
  CASE WHEN rr IS NOT NULL THEN FALSE WHEN NOT rev THEN TRUE ELSE hit AND v_scope = 'standalone'
    AND v_name IS NOT NULL END AS ai_is_computer_part,
  CASE WHEN NOT rev THEN 1.0 WHEN hit THEN v_conf ELSE 0.0 END::DOUBLE AS ai_confidence,
  CASE WHEN rr IS NOT NULL THEN TRUE WHEN NOT rev THEN FALSE ELSE NOT hit OR rej END AS ai_reject,
  CASE WHEN rr IS NOT NULL THEN COALESCE(sc, 'unknown') WHEN NOT rev THEN 'standalone' WHEN hit
    THEN v_scope ELSE 'unknown' END AS ai_scope,
  CASE WHEN rr IS NOT NULL THEN FALSE WHEN NOT rev THEN TRUE ELSE hit AND NOT rej END
    AS ai_usable_for_market_price, rev AS reviewed_by_verdict FROM j""",
    "unreliable_content": f"""WITH {c.LISTINGS_SQL}, k AS (SELECT *, trim(description) <> ''
  AND price > 0 AS ok FROM listings) SELECT id, CASE WHEN ok THEN condition_status ELSE 'unknown'
  END AS condition_status, NOT ok OR ai_reject AS ai_reject,
  CASE WHEN ok THEN ai_scope ELSE 'unknown' END AS ai_scope,
  CASE WHEN ok THEN effective_price END AS effective_price FROM k""",
}

SQL["repair_summary"] = f"""SELECT COUNT(*) AS reviewed,
  COUNT(*) FILTER (WHERE outcome = 'accept') AS accepts,
  COUNT(*) FILTER (WHERE outcome = 'reject') AS rejects,
  COUNT(*) FILTER (WHERE reviewed_by_verdict AND ({_CACHE_SQL}) IS NOT NULL) AS cache_hits
FROM ({SQL['repair_listings']}) r"""
