"""Content fingerprints: equal facts give equal hashes, nulls included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: schema label that is part of every second-review fingerprint.
REVIEW_SCHEMA = "pricing-semantics-v4"


def _digest(**facts: Column) -> Column:
    body = F.struct(*[value.alias(name) for name, value in sorted(facts.items())])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def search_fingerprint(name: Column, status: Column, category: Column) -> Column:
    """Only a missing key defaults to empty text; the caller passes nulls for explicit nulls."""
    return _digest(name=name, status=status, category=category)


def classification_fingerprint(title="title", description="description", price="price",
                               updated_at="updated_at", source_type="source_type") -> Column:
    return _digest(title=F.col(title), description=F.col(description), price=F.col(price),
                   updated_at=F.col(updated_at), source_type=F.col(source_type))


def review_fingerprint(product_id="product_id", title="title", description="description",
                       price="price", effective_price="effective_price",
                       status="listing_status", name="normalized_name",
                       reference="reference_price", discount="discount_percent") -> Column:
    return _digest(
        review_schema=F.lit(REVIEW_SCHEMA), product_id=F.col(product_id), title=F.col(title),
        description=F.col(description), displayed_price=F.col(price),
        effective_price=F.col(effective_price), sale_status=F.col(status),
        normalized_product_name=F.col(name), reference_market_price=F.col(reference),
        discount_percent=F.bround(F.col(discount), 6))
