"""Keyed streams over many batches: timers, restarts, and equality with the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricelode.catalog.timed_streams import in_files
from pricelode.operators import estimator, lifecycle
from pricelode.schemas import table_schema
from pricelode.session import fresh_path
from pricelode.streaming import batches, processors

DAY = dt.datetime(2026, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def run(stream, mode="append", checkpoint=None, out=None):
    """Every row of the stream with its batch."""
    spark = stream.sparkSession
    out = out or batches.AppendedBatches(spark, fresh_path(spark, "out"), stream.schema)
    with processors.state_in_rocksdb(spark):
        (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or fresh_path(spark, "check"))
         .trigger(availableNow=True).foreachBatch(out.write).start().awaitTermination())
    return out.spark.read.schema(stream.schema).option("basePath", out.path).parquet(out.path)


def log(spark, rows, layout, files):
    """The rows as a stream of so many files, in order."""
    return in_files(spark.createDataFrame(rows, layout), files=files)


SEARCH = ("marketplace string, product_id string, record_no bigint, kind string, updated_at timestamp, price bigint, "
          "search_fingerprint string, ai_is_computer_part boolean, success boolean")


@pytest.mark.parametrize("files", [1, 5])
def test_change_states_follow_the_stored_listing_and_its_verdicts(spark, files):
    def search(product, n, price, second=0, print_="f"):
        return ("m", product, n, "search", at(second), price, print_, None, None)

    def verdict(product, n, part, success):
        return ("m", product, n, "verdict", None, None, None, part, success)

    rows = [search("a", 0, 10), search("a", 1, 10), verdict("a", 2, True, True), search("a", 3, 10), verdict("a", 4, True, False),
            search("a", 5, 10), verdict("a", 6, None, True), search("a", 7, 10), verdict("a", 8, False, True), search("a", 9, 10),
            search("a", 10, 9), search("a", 11, 9), verdict("a", 12, True, True), search("a", 13, 9, 0.4), search("a", 14, 9, 2),
            verdict("b", 15, True, True), search("b", 16, 5), search("b", 17, 5), search("c", 18, 7), search("c", 19, 8), search("d", 20, 7)]
    stored = spark.createDataFrame([("m", "c", at(0), 7, "f", True, None), ("m", "d", at(0), 7, "f", True, False)], processors.STORED)
    found = run(processors.change_states(log(spark, rows, SEARCH, files), stored))
    assert {r.record_no: (r.state, r.previous_price) for r in found.collect()} == {
        0: ("new", None), 1: ("pending_ai", 10), 3: ("unchanged", None), 5: ("pending_ai", 10), 7: ("pending_ai", 10),
        9: ("unchanged", None), 10: ("updated", 10), 11: ("pending_ai", 9), 13: ("unchanged", None), 14: ("updated", 9),
        16: ("new", None), 17: ("pending_ai", 5), 18: ("unchanged", None), 19: ("updated", 7), 20: ("pending_ai", 7)}


JOBS = "marketplace string, product_id string, record_no bigint, at timestamp, kind string, classification_fingerprint string"


@pytest.mark.parametrize("files", [1, 3, 8])
def test_stale_work_returns_whatever_the_batches(spark, files):
    rows = [("m", "a", 0, at(0), "enqueue", "f"), ("m", "a", 1, at(10), "start", None), ("m", "a", 2, at(500), "start", None),
            ("m", "b", 3, at(600), "enqueue", "g"), ("m", "b", 4, at(610), "start", None), ("m", "b", 5, at(700), "finish", None),
            ("m", "b", 6, at(710), "enqueue", "g"), ("m", "a", 7, at(2000), "start", None), ("m", "c", 8, at(2100), "enqueue", "h"),
            ("m", "c", 9, at(2110), "start", None), ("m", "c", 10, at(2120), "fail", None), ("m", "d", 11, at(9000), "enqueue", "i")]
    states = run(processors.work_queue(log(spark, rows, JOBS, files), 600, 900, "0 seconds"), "update")
    newest = {r.product_id: r.r for r in states.groupBy("product_id").agg(
        F.max_by(F.struct("state", "attempts", "available_at", "reason"), F.struct("changed_at", "record_no")).alias("r")).collect()}
    assert {k: tuple(v) for k, v in newest.items()} == {
        "a": ("retry", 2, at(2900), "stale processing recovery"), "b": ("completed", 1, at(600), "event"),
        "c": ("retry", 1, at(2720), "event"), "d": ("pending", 0, at(9000), "event")}


def test_rechecks_are_due_rechecks_at_every_batch(spark):
    rng = random.Random(2)
    tiers = lifecycle.RecheckTiers(1, 3, 6, 12, 24)
    rows = sorted(((rng.randrange(6 * 86400), f"p{rng.randrange(12)}", rng.random() < 0.8) for _ in range(60)))
    rows = [("m", p, n, at(t), tracked) for n, (t, p, tracked) in enumerate(rows)]
    layout = "marketplace string, product_id string, record_no bigint, at timestamp, tracked boolean"
    found = run(processors.rechecks(log(spark, rows, layout, 6), tiers), "update").collect()
    assert found and any(not r.due for r in found)
    for now in sorted({r.at for r in found}):
        # What the stream says at this watermark: each product's newest row up to it.
        said = {}
        for r in sorted((r for r in found if r.at <= now), key=lambda r: r.at):
            said[r.product_id] = r.due
        seen = [r for r in rows if r[3] <= now]
        listings = []
        for product in {r[1] for r in seen}:
            own = [r for r in seen if r[1] == product]
            active = [r[3] for r in own if r[4]]
            listings.append((product, "active" if own[-1][4] else "sold", own[0][3], max(active) if active else None))
        df = spark.createDataFrame(listings, "product_id string, listing_status string, first_seen_at timestamp, last_active_at timestamp")
        df = df.selectExpr("*", "product_id AS id", "'bunjang' AS marketplace", "'standalone' AS ai_scope", "'normal' AS condition_status",
                           "true AS ai_is_computer_part", "false AS ai_reject", "'x' AS ai_normalized_product_name")
        due = {r.product_id for r in lifecycle.due_rechecks(df, tiers, now.isoformat()).collect()}
        # A batch may already hold checks that lie behind its watermark; those products are judged with them.
        ahead = {r[1] for r in rows if r[3] > now}
        assert {p for p, is_due in said.items() if is_due} - ahead == due - ahead


@pytest.mark.parametrize("files", [1, 4])
def test_alerts_are_notify_once_over_many_batches(spark, files):
    rng = random.Random(3)
    rows = [("m", f"p{rng.randrange(5)}", n, rng.randrange(1, 6), rng.random() < 0.4) for n in range(80)]
    layout = "marketplace string, product_id string, record_no bigint, price bigint, deal boolean"
    stream = log(spark, rows, layout, files)
    found = {(r.product_id, r.record_no) for r in run(processors.alerts(stream, stream.where("deal"))).collect()}
    df = spark.createDataFrame(rows, layout).withColumns({
        "updated_at": F.lit(DAY), "search_fingerprint": F.lit("f")})
    states = lifecycle.replay_states(df, F.lit(0), [F.col("record_no")])
    once = lifecycle.notify_once(df.where("deal"), states, "record_no", F.lit(0))
    assert found == {(r.product_id, r.record_no) for r in once.collect()} and found


ITEMS = ("marketplace string, product_id string, query_key string, page_no bigint, record_no bigint, at timestamp, price bigint, "
         "error_category string, retried boolean")


def backfill_items():
    return [("m", "a", "q", 0, 0, at(0), 1, None, False), ("m", "b", "q", 0, 1, at(1), 2, "5xx", False),
            ("m", "c", "q", 0, 2, at(2), 3, "404_or_unavailable", False), ("m", "a", "r", 0, 3, at(3), 4, None, False),
            ("m", "b", "r", 0, 4, at(4), 5, None, False), ("m", "d", "r", 1, 5, at(5), 6, "429", False),
            ("m", "b", "q", 1, 6, at(4000), 7, "5xx", True), ("m", "d", "r", 1, 7, at(4100), 8, None, True),
            ("m", "b", "q", 1, 8, at(9000), 9, None, True), ("m", "e", "r", 2, 9, at(20000), 10, "read_timeout", False)]


def test_a_killed_and_resumed_backfill_gives_the_table_of_an_unbroken_one(spark):
    def outcomes(stream, broken_at=()):
        out = batches.AppendedBatches(spark, fresh_path(spark, "out"), stream.schema)
        check, left = fresh_path(spark, "check"), list(broken_at)

        def write(batch, batch_id):
            out.write(batch, batch_id)
            if left and left[0] == batch_id:  # the batch is written, but the stream dies before its commit
                left.pop(0)
                raise RuntimeError("executor lost")

        for _ in range(len(broken_at) + 1):
            with processors.state_in_rocksdb(spark):
                query = (stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start())
                try:
                    query.awaitTermination()
                except Exception as error:
                    assert "executor lost" in str(error)
        return out.read()

    stream = log(spark, backfill_items(), ITEMS, 5)
    whole = outcomes(processors.backfill_outcomes(stream, 3600, "0 seconds"))
    resumed = outcomes(processors.backfill_outcomes(stream, 3600, "0 seconds"), broken_at=(1, 3))
    rows = sorted(map(tuple, whole.collect()), key=str)
    assert rows == sorted(map(tuple, resumed.collect()), key=str)
    assert sorted((r[1], r[5]) for r in rows) == sorted(
        [("a", "observed"), ("b", "queued"), ("c", "unavailable"), ("a", "seen"), ("b", "waiting"), ("d", "queued"), ("b", "retry_due"),
         ("d", "retry_due"), ("b", "queued"), ("d", "observed"), ("b", "retry_due"), ("b", "observed"), ("e", "queued")])
    cursors = {r.query_key: r for r in batches.backfill_cursors(whole).collect()}
    assert (cursors["q"].last_page, cursors["q"].observed, cursors["r"].last_page, cursors["r"].skipped) == (1, 2, 2, 2)


def test_overlap_rows_are_read_again_once(spark):
    layout = table_schema("marketplace string, product_id string, source_key string, search_fingerprint string, updated_at timestamp, "
                          "record_no bigint")
    marks = batches.VersionedTable(spark, fresh_path(spark, "marks"), table_schema(
        "marketplace string, source_key string, updated_at timestamp"))
    admitted = batches.AppendedBatches(spark, fresh_path(spark, "admitted"), layout)
    handle = batches.overlap_reread(marks, admitted, 2)

    def batch(*rows):
        return spark.createDataFrame([("m", p, s, f, DAY + dt.timedelta(days=d), n) for n, p, s, f, d in rows], layout)

    handle(batch((1, "a", "x", "f", 10), (2, "a", "x", "f", 10), (3, "b", "y", "f", 1)), 0)
    second = batch((4, "a", "x", "f", 9), (5, "c", "x", "f", 8), (6, "d", "x", "f", 7), (7, "b", "x", "f", 11), (8, "b", "y", "g", 0))
    handle(second, 1)
    handle(second, 1)
    assert sorted(r.record_no for r in admitted.read().collect()) == [1, 3, 5, 8]  # 7 has the content of 3
    assert {r.source_key: (r.updated_at - DAY).days for r in marks.read(1).collect()} == {"x": 11, "y": 1}


def test_histogram_prices_equal_the_estimator_and_read_no_history(spark):
    rng = random.Random(9)
    now = dt.datetime(2026, 3, 1, 12, 30)
    layout = "normalized_product_name string, observed_price bigint, observed_at timestamp"
    table = batches.DailyHistogram(spark, fresh_path(spark, "histogram"), window_days=5, half_life_days=2)
    rows, sizes = [], []
    for k in range(6):
        time = now + dt.timedelta(days=k)
        fresh = [(rng.choice("ab"), rng.randrange(100, 120), time - dt.timedelta(hours=rng.randrange(0, 140))) for _ in range(40)]
        rows += fresh
        table.merge(spark.createDataFrame(fresh, layout), k, time.isoformat())
        whole, cut = table.folders(k, time.isoformat())
        sizes.append(len(whole) + len(cut))
        for name in estimator.ESTIMATORS:
            got = estimator.histogram_estimates(table.histogram(k, time.isoformat()), estimator=name)
            wanted = estimator.estimate_prices(spark.createDataFrame(rows, layout), now=time.isoformat(), window_days=5,
                                               half_life_days=2, estimator=name)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert max(sizes) <= 6 and table.days.read(5).count() <= 6


def test_alerts_read_records_without_a_price(spark, tmp_path):
    rows = [("m", "a", 1, 10), ("m", "a", 2, 8), ("m", "a", 3, None)]
    spark.createDataFrame(rows, "marketplace string, product_id string, record_no bigint, price bigint").coalesce(1).write.parquet(f"{tmp_path}/in")
    log = spark.readStream.schema("marketplace string, product_id string, record_no bigint, price bigint").parquet(f"{tmp_path}/in")
    with processors.state_in_rocksdb(spark):
        found = batches.drain_to_table(processors.alerts(log, log.where("price IS NOT NULL")), "unpriced").collect()
    assert sorted((r["record_no"], r["epoch"]) for r in found) == [(1, 0), (2, 1)]
