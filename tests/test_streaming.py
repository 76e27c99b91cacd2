import datetime as dt

from pyspark.sql import functions as F

from pricelode.schemas import table_schema
from pricelode.session import fresh_path
from pricelode.streaming import batches, stateful

RECORDS = table_schema("marketplace string, product_id string, record_no bigint, price bigint, "
                       "updated_at timestamp, listing_status string, search_fingerprint string")
DAY = dt.datetime(2026, 1, 1)


def _write(spark, path, n, rows):
    spark.createDataFrame([("m", p, i, price, DAY + dt.timedelta(days=day), status, "f")
                           for p, i, price, day, status in rows], RECORDS
                          ).coalesce(1).write.parquet(f"{path}/{n}")


def _read(spark, path):
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_state_survives_batches_and_restarts(spark):
    src, check = fresh_path(spark, "src"), fresh_path(spark, "check")
    _write(spark, src, 0, [("a", 1, 10, 0, "active"), ("b", 2, 5, 0, "active")])
    out = batches.drain_to_table(stateful.change_states(_read(spark, src)), "t", check)
    assert {r["record_no"]: r["state"] for r in out.collect()} == {1: "new", 2: "new"}
    _write(spark, src, 1, [("a", 3, 10, 0, "active"), ("b", 4, 4, 1, "active")])
    out = batches.drain_to_table(stateful.change_states(_read(spark, src)), "t", check)
    got = {r["record_no"]: (r["state"], r["previous_price"]) for r in out.collect()}
    assert got == {1: ("new", None), 2: ("new", None), 3: ("unchanged", None), 4: ("updated", 5)}


def test_sale_across_batches_keeps_the_active_price(spark):
    src = fresh_path(spark, "src")
    _write(spark, src, 0, [("a", 1, 150, 0, "active")])
    _write(spark, src, 1, [("a", 2, 120, 1, "sold"), ("a", 3, 120, 2, "sold")])
    out = batches.drain_to_table(stateful.lifecycle_transitions(_read(spark, src)), "t")
    assert [(r["record_no"], r["last_active_price"], r["first_sold"])
            for r in out.collect()] == [(2, 150, True)]


def test_backfill_batches_are_repeatable(spark):
    keys = table_schema("marketplace string, product_id string")
    rows = table_schema("marketplace string, product_id string, observed_price bigint, "
                        "observed_at timestamp")
    seen = batches.AppendedBatches(spark, fresh_path(spark, "seen"), keys)
    obs = batches.AppendedBatches(spark, fresh_path(spark, "obs"), rows)
    handle = batches.resumable_backfill(seen, obs)

    def batch(*products):
        return spark.createDataFrame([("m", p, i, DAY) for i, p in enumerate(products)], rows)

    handle(batch("a", "b", "a"), 0)
    handle(batch("b", "c"), 1)
    handle(batch("b", "c"), 1)
    assert sorted(r["product_id"] for r in obs.read().collect()) == ["a", "b", "c"]


def test_marks_advance_per_source(spark):
    table = batches.VersionedTable(spark, fresh_path(spark, "marks"), table_schema(
        "marketplace string, source_key string, updated_at timestamp"))
    handle = batches.advance_watermarks(table)

    def batch(*rows):
        return spark.createDataFrame([("m", s, DAY + dt.timedelta(days=d)) for s, d in rows],
                                     table.schema)

    handle(batch(("x", 1), ("x", 3), ("y", 2)), 0)
    handle(batch(("y", 5)), 1)
    handle(batch(("y", 5)), 1)
    got = {r["source_key"]: (r["updated_at"] - DAY).days for r in table.read(1).collect()}
    assert got == {"x": 3, "y": 5}
    assert table.read(-1).agg(F.count("*")).first()[0] == 0
