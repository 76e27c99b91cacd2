"""Merges at size: one reading of the target, no shuffle of a bucketed one, one change a key."""

import datetime as dt

from pyspark.sql import functions as F

from pricelode.operators import merge
from pricelode.schemas import LISTING_DEFAULTS, LISTINGS, conform
from pricelode.sources.tables import BucketedTable

NOW = "2026-01-10T00:00:00Z"
AT = dt.datetime(2026, 1, 9)


def _listings(spark, ids, **more):
    rows = [(i, "bunjang", str(i) if i is not None else None, f"u{i}", 100, AT) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, marketplace string, product_id string, url string, price bigint, updated_at timestamp")
    return conform(df.withColumns(more), LISTINGS, LISTING_DEFAULTS)


def _changes(spark, rows):
    df = spark.createDataFrame([(p, s, price, AT + dt.timedelta(hours=h)) for p, s, price, h in rows],
                               "product_id string, state string, price bigint, updated_at timestamp")
    df = df.withColumns({"marketplace": F.lit("bunjang"), "previous_price": F.lit(100).cast("bigint")})
    return conform(df, LISTINGS, LISTING_DEFAULTS).join(df.select("product_id", "state", "previous_price", F.col("updated_at").alias("u")),
                                                        "product_id").where("u = updated_at").drop("u")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_merge_reads_its_target_once_and_reduces_its_source(spark):
    stored = _listings(spark, range(6))
    changes = _changes(spark, [("1", "updated", 90, 1), ("1", "updated", 80, 2), ("2", "new", 70, 1), ("9", "updated", 60, 1),
                               ("8", "new", 50, 1), ("8", "new", 55, 3)])
    merged = merge.merge_processed(stored, changes, NOW)
    got = {r.product_id: r.price for r in merged.collect()}
    assert got == {"0": 100, "1": 80, "2": 100, "3": 100, "4": 100, "5": 100, "8": 55}
    assert merged.count() == 7


def test_null_keys_never_match_and_are_all_kept(spark):
    stored = _listings(spark, [1, None])
    rows = _listings(spark, [None, None, 1])
    merged = merge.merge_backfill(stored, rows, NOW)
    assert merged.where("product_id IS NULL").count() == 3 and merged.where("product_id = '1'").count() == 1


def test_a_bucketed_target_is_not_shuffled(spark):
    table = BucketedTable(spark, "merge_test", merge.PRODUCT, 4)
    table.write(_listings(spark, range(200)), 0)
    changes = _changes(spark, [("1", "updated", 90, 1), ("500", "new", 70, 1)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(merge.merge_processed(table.read(0), changes, NOW))
        last = table.merge(0, lambda t: merge.merge_processed(t, changes, NOW))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("default.merge_test_g0") == 1
    scan = plan.index("merge_test_g0")
    # The lines from the join down to the scan of the target hold no exchange.
    lines = plan[:scan].splitlines()
    depth = len(lines[-1]) - len(lines[-1].lstrip(" :+-"))
    branch = []
    for line in reversed(lines):
        level = len(line) - len(line.lstrip(" :+-"))
        if level <= depth:
            branch.append(line)
            depth = level
        if "Join" in line:
            break
    assert "Join" in branch[-1] and not any("Exchange" in line for line in branch)
    assert table.read(last).count() == 201
    assert {r.price for r in table.read(last).where("product_id IN ('1', '500')").collect()} == {90, 70}
    table.drop_before(last)
    assert [r.tableName for r in spark.sql("SHOW TABLES LIKE 'merge_test*'").collect()] == [f"merge_test_g{last}"]
    spark.sql(f"DROP TABLE merge_test_g{last}")
