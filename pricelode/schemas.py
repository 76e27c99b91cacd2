"""Table schemas, additive schema conforming and row constraints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed value sets of the data model.
LISTING_STATUSES = ("active", "reserved", "sold", "unavailable")
SALE_STATUSES = ("active", "reserved", "sold", "unavailable", "unknown")
SCOPES = ("standalone", "bundle", "complete_pc", "accessory", "unknown")
CONDITIONS = ("normal", "risky", "broken", "unknown")
JOB_STATES = ("pending", "processing", "retry", "completed")
PRICE_SOURCES = ("marketplace", "description", "both", "unknown")
DEFAULT_MARKETPLACE = "karrot"
SEARCH_MARKETPLACE = "bunjang"



LISTINGS_DDL = """
id bigint, marketplace string, product_id string, listing_id string, url string,
canonical_url string, title string, description string, price bigint, location string,
source_type string, source_key string, updated_at timestamp, search_fingerprint string,
listing_status string, condition_status string, ai_scope string, ai_sale_status string,
ai_is_computer_part boolean, ai_normalized_product_name string, ai_confidence double,
ai_reject boolean, ai_reason string, ai_usable_for_market_price boolean,
effective_price bigint, ai_usable_price boolean, first_seen_at timestamp,
last_active_at timestamp, first_sold_seen_at timestamp, last_active_price bigint,
notified_at timestamp
"""

OBSERVATIONS_DDL = """
id bigint, marketplace string, product_id string, normalized_product_name string,
observed_price bigint, observed_at timestamp, first_seen_at timestamp,
source_updated_at timestamp, listing_id string, valid boolean, invalid_reason string
"""

JOBS_DDL = """
marketplace string, product_id string, classification_fingerprint string, state string,
attempts int, last_error string, available_at timestamp, started_at timestamp,
completed_at timestamp, updated_at timestamp
"""

RETRIES_DDL = """
marketplace string, product_id string, query_key string, listing_id string, title string,
price bigint, url string, location string, source_type string, source_key string,
updated_at timestamp, search_fingerprint string, canonical_url string, listing_status string,
attempts int, last_error string, http_status int, exception_type string,
error_category string, retry_count int, last_error_message string, last_error_at timestamp,
is_terminal boolean, created_at timestamp, updated_at_retry timestamp
"""

VERDICT_LOG_DDL = """
id bigint, marketplace string, product_id string, classification_fingerprint string,
model string, reasoning_effort string, classifier_version string, success boolean,
is_computer_part boolean, normalized_product_name string, condition_status string,
scope string, sale_status string, exact_product boolean, model_mismatch boolean,
price_bait boolean, hidden_price_condition boolean, displayed_price bigint,
effective_price bigint, price_source string, price_confidence double, usable_price boolean,
confidence double, reject boolean, reason string, seconds double, cached boolean,
classified_at timestamp
"""

RUNS_DDL = """
id bigint, completed_at timestamp, status string, search_records bigint,
valid_observations bigint, ai_candidates bigint, ai_failures bigint, safety_halt boolean,
detail string
"""

DELIVERIES_DDL = "id bigint, delivered_at timestamp, channel string, listing_count bigint"

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


def table_schema(columns: str) -> T.StructType:
    """``"a bigint, b string"`` as a StructType, without needing a running session."""
    pairs = (item.split() for item in columns.replace("\n", " ").split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LISTINGS = table_schema(LISTINGS_DDL)
OBSERVATIONS = table_schema(OBSERVATIONS_DDL)
JOBS = table_schema(JOBS_DDL)
RETRIES = table_schema(RETRIES_DDL)
VERDICT_LOG = table_schema(VERDICT_LOG_DDL)
RUNS = table_schema(RUNS_DDL)
DELIVERIES = table_schema(DELIVERIES_DDL)

# Column defaults of the stored tables.
LISTING_DEFAULTS = {
    "description": "", "condition_status": "unknown", "ai_reject": False, "ai_reason": "",
    "marketplace": DEFAULT_MARKETPLACE, "source_key": "", "search_fingerprint": "",
    "listing_status": "active", "ai_scope": "unknown", "ai_sale_status": "unknown",
    "ai_usable_for_market_price": False, "ai_usable_price": False,
}
RETRY_DEFAULTS = {
    "exception_type": "", "error_category": "unknown", "retry_count": 0,
    "last_error_message": "", "is_terminal": False,
}
VERDICT_DEFAULTS = {
    "scope": "unknown", "sale_status": "unknown", "exact_product": False,
    "model_mismatch": False, "price_bait": False, "hidden_price_condition": False,
    "price_source": "unknown", "usable_price": False,
}


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None,
            derived: Mapping[str, Column] | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``; absent columns take derived values, then defaults.

    ``derived`` fills only columns that ``df`` does not have, so a second pass over an
    already conformed table changes nothing.
    """
    defaults = defaults or {}
    derived = derived or {}
    present = set(df.columns)
    out = []
    for field in schema.fields:
        name = field.name
        if name in present:
            value = F.col(name)
            if name in defaults:
                value = F.coalesce(value, F.lit(defaults[name]))
        elif name in derived:
            value = derived[name]
        else:
            value = F.lit(defaults.get(name))
        out.append(value.cast(field.dataType).alias(name))
    return df.select(*out)


def conform_listings(df: DataFrame) -> DataFrame:
    """Listings of any earlier layout, with the derived defaults of the current one."""
    present = set(df.columns)
    derived: dict[str, Column] = {}
    if "listing_id" in present:
        derived["product_id"] = F.col("listing_id")
    usable = (F.coalesce(F.col("ai_usable_for_market_price"), F.lit(False))
              if "ai_usable_for_market_price" in present else F.lit(False))
    derived["effective_price"] = F.when(usable, F.col("price"))
    derived["ai_usable_price"] = usable
    out = conform(df, LISTINGS, LISTING_DEFAULTS, derived)
    active = F.col("listing_status") == "active"
    return out.withColumns({
        "last_active_at": F.when(active, F.coalesce("last_active_at", "first_seen_at"))
        .otherwise(F.col("last_active_at")),
        "last_active_price": F.when(active, F.coalesce("last_active_price", "price"))
        .otherwise(F.col("last_active_price")),
        "canonical_url": F.when(
            (F.col("marketplace") == SEARCH_MARKETPLACE)
            & (F.coalesce(F.col("canonical_url"), F.lit("")) == ""), F.col("url"),
        ).otherwise(F.col("canonical_url")),
    })


def conform_observations(df: DataFrame) -> DataFrame:
    return conform(df, OBSERVATIONS, {"valid": True})


def conform_retries(df: DataFrame) -> DataFrame:
    derived = {
        "retry_count": F.greatest(F.col("attempts") - 1, F.lit(0)),
        "last_error_message": F.col("last_error"),
    }
    if "updated_at_retry" in df.columns:
        derived["last_error_at"] = F.col("updated_at_retry")
    return conform(df, RETRIES, RETRY_DEFAULTS, derived)


def conform_verdicts(df: DataFrame) -> DataFrame:
    return conform(df, VERDICT_LOG, VERDICT_DEFAULTS)


def _one_of(name: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def _non_negative(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) >= 0)


def listing_violations() -> Column:
    """Names of the constraints a listing row breaks (empty array = good row)."""
    checks = {
        "url": F.col("url").isNotNull(),
        "title": F.col("title").isNotNull(),
        "price": F.coalesce(F.col("price") >= 0, F.lit(False)),
        "condition_status": _one_of("condition_status", CONDITIONS),
        "listing_status": _one_of("listing_status", LISTING_STATUSES),
        "ai_scope": _one_of("ai_scope", SCOPES),
        "ai_sale_status": _one_of("ai_sale_status", SALE_STATUSES),
        "effective_price": F.col("effective_price").isNull() | (F.col("effective_price") > 0),
        "last_active_price": _non_negative("last_active_price"),
    }
    return violations(checks)


def observation_violations() -> Column:
    return violations({
        "observed_price": F.coalesce(F.col("observed_price") > 0, F.lit(False)),
        "product_id": F.col("product_id").isNotNull(),
        "normalized_product_name": F.col("normalized_product_name").isNotNull(),
        "observed_at": F.col("observed_at").isNotNull(),
    })


def job_violations() -> Column:
    return violations({"state": _one_of("state", JOB_STATES)})


def delivery_violations() -> Column:
    return violations({"listing_count": F.coalesce(F.col("listing_count") > 0, F.lit(False))})


def violations(checks: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def split_valid(df: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a ``violations`` array)."""
    marked = df.withColumn("violations", broken)
    good = marked.where(F.size("violations") == 0).drop("violations")
    return good, marked.where(F.size("violations") > 0)
