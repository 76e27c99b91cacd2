"""Search and detail payloads of the marketplace as listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.prints import search_fingerprint
from ..functions.text import listing_status
from ..schemas import SEARCH_MARKETPLACE

# Fixed value: where the records sit in a search payload.
_RECORDS = "$.data.responses.mainGrid.searchResponse.data"
_CURSOR = "$.data.responses.mainGrid.searchResponse.cursor"


def search_records(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """One row per record of each page payload, in payload order (``pos``).

    Records stay variants: a field of an unexpected type must reject one record, not the
    whole page.
    """
    doc = F.try_parse_json(F.col(text))
    rows = payloads.withColumn("_doc", doc)
    listed = F.try_variant_get("_doc", _RECORDS, "array<variant>")
    return (rows.withColumn("next_cursor", F.try_variant_get("_doc", _CURSOR, "string"))
            .select(*[c for c in payloads.columns if c != text], "next_cursor",
                    F.posexplode(listed).alias("pos", "record"))
            .drop("_doc"))


def _text(path: str) -> Column:
    return F.try_variant_get("record", f"$.{path}", "string")


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("record", f"$.{path}", "variant"))


def _truthy(path: str) -> Column:
    """A field that is present and neither empty, zero, false nor null; the text "0" is none of these."""
    raw = F.coalesce(_text(path), F.lit(""))
    return F.when(_kind(path) == "STRING", raw != "").otherwise(~raw.isin("", "0", "false"))


def _price() -> Column:
    """Whole number of a JSON number (fraction dropped) or of digit text."""
    kind, raw = _kind("price"), F.trim(_text("price"))
    return (F.when(kind == "STRING",
                   F.when(raw.rlike(r"^[+-]?\d+(_\d+)*$"),
                          F.replace(raw, F.lit("_"), F.lit("")).try_cast("bigint")))
            .when(kind == "BOOLEAN", F.try_variant_get("record", "$.price", "boolean")
                  .cast("int").cast("bigint"))
            .otherwise(F.try_variant_get("record", "$.price", "bigint")))


def judged_records(records: DataFrame, maximum_price: int | None = None) -> DataFrame:
    """Records with ``price`` and ``reject_reason`` (irrelevant / over_budget / null)."""
    if maximum_price is not None and maximum_price <= 0:
        raise ValueError("the maximum price must be positive")
    rows = records.withColumn("price", _price())
    is_ad = F.coalesce(F.try_variant_get("record", "$.ad", "boolean")
                       & (_kind("ad") == "BOOLEAN"), F.lit(False))
    irrelevant = (
        ~F.coalesce((_kind("type") == "STRING") & (_text("type") == "PRODUCT"), F.lit(False))
        | is_ad | ~_truthy("pid") | ~_truthy("updatedAt") | F.col("price").isNull())
    reason = F.when(irrelevant, "irrelevant")
    if maximum_price is not None:
        reason = reason.when(F.col("price") > maximum_price, "over_budget")
    return rows.withColumn("reject_reason", reason)


def _printed(path: str) -> Column:
    """Field as JSON text; a missing field counts as empty text, null stays null."""
    value = F.try_variant_get("record", f"$.{path}", "variant")
    return F.when(value.isNull(), F.lit('""')).otherwise(F.to_json(value))


def listings_of(judged: DataFrame, marketplace: str = SEARCH_MARKETPLACE,
                link: str = fixed.PRODUCT_LINK) -> DataFrame:
    """Accepted records as listing candidates; sold and reserved ones are kept too."""
    rows = record_rows(judged.where(F.col("reject_reason").isNull()), marketplace, link)
    return rows.drop("source_order", "reject_reason")


def record_rows(judged: DataFrame, marketplace: str = SEARCH_MARKETPLACE,
                link: str = fixed.PRODUCT_LINK) -> DataFrame:
    """All judged records as listing rows, rejected ones too, with their place and ``reject_reason``."""
    url = F.format_string(link, F.col("product_id"))
    rows = judged.withColumn("product_id", _text("pid"))
    carried = [c for c in ("source_key", "source_order", "page_no") if c in judged.columns]
    return rows.select(
        *carried, "pos", F.lit(marketplace).alias("marketplace"), "product_id",
        F.concat(F.lit(f"{marketplace}:"), F.col("product_id")).alias("listing_id"),
        url.alias("url"), url.alias("canonical_url"),
        F.trim(F.coalesce(_text("name"), F.lit(""))).alias("title"), "price",
        F.lit("").alias("location"), F.lit(fixed.SEARCH_SOURCE_TYPE).alias("source_type"),
        _text("updatedAt").alias("updated_at"),
        search_fingerprint(_printed("name"), _printed("status"), _printed("category"))
        .alias("search_fingerprint"),
        listing_status(_text("status")).alias("listing_status"), "reject_reason")


def page_counters(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per page (or any keys): records seen, irrelevant and over budget."""
    return judged.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.count_if(F.col("reject_reason") == "irrelevant").alias("irrelevant"),
        F.count_if(F.col("reject_reason") == "over_budget").alias("over_budget"))


def detail_records(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Product facts of detail payloads (``data.product``); anything else gives no row."""
    product = F.try_variant_get(F.try_parse_json(F.col(text)), "$.data.product", "variant")
    rows = payloads.withColumn("_product", product).where(
        F.schema_of_variant("_product").startswith("OBJECT"))

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("_product", f"$.{path}", kind)

    return rows.select(
        *[c for c in payloads.columns if c != text], field("name", "string").alias("name"),
        field("description", "string").alias("description"),
        field("price", "bigint").alias("price"), field("saleStatus", "string").alias("saleStatus"),
        field("status", "string").alias("status"), field("updatedAt", "string").alias("updatedAt"))
