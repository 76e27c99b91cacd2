import datetime as dt
import random

from pyspark.sql import functions as F

from pricelode.operators import changes, ordered, quality


def _greedy(rows):
    kept, a, b = [], set(), set()
    for i, x, y in sorted(rows):
        if (x is not None and x in a) or (y is not None and y in b):
            continue
        kept.append(i)
        a.add(x)
        b.add(y)
    return sorted(kept)


def test_first_wins_matches_sequential_inserts(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(25)]), rng.choice([None, *range(25)]))
            for i in range(150)]
    rows += [(1000, 900, 800), (1001, 900, 801), (1002, 901, 801), (1003, 901, 802)]
    df = spark.createDataFrame(rows, "i int, x int, y int")
    got = sorted(r["i"] for r in ordered.first_wins(df, [["x"], ["y"]], [F.col("i")]).collect())
    assert got == _greedy(rows)


def test_long_conflict_chains_take_few_rounds(spark, monkeypatch):
    """Each row of a chain shares one key with the next: 1,000 links, and rows are accepted in turn."""
    rows = [(i, (i + 1) // 2, i // 2 + 5000) for i in range(1001)] + [(5000 + k, 9000 + k // 2, None) for k in range(6)]
    df = spark.createDataFrame(rows, "i int, x int, y int").repartition(4)
    rounds = []
    inner = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda rows: rounds.append(1) or inner(rows))
    for largest in (10_000, 3):  # with a small bound, the chain is too large and goes on in rounds
        if largest == 3:
            rows = rows[:40] + rows[-6:]
            df = spark.createDataFrame(rows, "i int, x int, y int").repartition(4)
        got = sorted(r["i"] for r in ordered.first_wins(df, [["x"], ["y"]], [F.col("i")], largest).collect())
        assert got == _greedy(rows)
        if largest != 3:
            assert len(rounds) <= 24


def test_component_labels(spark):
    edges = [(k, k + 1) for k in range(300) if k % 50] + [(7, 7), (1000, 900), (900, 950)]
    got = {r.node: r.label for r in ordered.component_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {}
    for k in range(1, 301):
        want[k] = (k - 1) // 50 * 50 + 1
    assert got == want | {1000: 900, 950: 900, 900: 900}


def test_cut_after_run_crosses_chunks(spark):
    rng = random.Random(11)
    rows = [(k, i, rng.random() < 0.6) for k in range(12) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "k int, i int, flag boolean")
    for chunk in (1, 4, 100):
        for length in (1, 3, 6):
            got = ordered.cut_after_run(df, ["k"], F.floor(F.col("i") / chunk), [F.col("i")],
                                        "flag", length)
            want = []
            for k in range(12):
                run = 0
                for _, i, flag in sorted(r for r in rows if r[0] == k):
                    want.append((k, i))
                    run = run + 1 if flag else 0
                    if run == length:
                        break
            assert sorted((r["k"], r["i"]) for r in got.collect()) == want


def test_carried_values_and_order_check(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)])) for k in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = ordered.carried_last(df, ["k"], F.floor(F.col("i") / 4), [F.col("i")],
                               {"before": F.col("v")})
    for r in got.collect():
        earlier = [v for k, i, v in rows if k == r["k"] and i < r["i"] and v is not None]
        assert r["before"] == (earlier[-1] if earlier else None)
    falling = spark.createDataFrame(
        [(0, i, 100 - i) for i in range(20)] + [(1, i, 100 - i + 3 * (i == 8)) for i in range(20)],
        "k int, i int, v int")
    check = ordered.descending_check(falling, ["k"], F.floor(F.col("i") / 4), [F.col("i")], "v")
    assert {r["k"]: r["monotonic"] for r in check.collect()} == {0: True, 1: False}


def test_known_run_stops_a_newest_first_source(spark):
    flags = ["n1", "n2", "k1", "k2", "k3", "n3"]
    cand = spark.createDataFrame(
        [("s", 0, i, f, f"u{f}") for i, f in enumerate(flags)],
        "source_key string, page_no bigint, pos bigint, listing_id string, url string")
    stored = spark.createDataFrame([(f, f"u{f}") for f in ("k1", "k2", "k3")],
                                   "listing_id string, url string")
    got = changes.stop_after_known(cand, stored, 3)
    assert sorted(r["pos"] for r in got.collect()) == [0, 1, 2, 3, 4]
    free = changes.stop_after_known(cand, stored, 3, newest_first=False)
    assert free.count() == 6


def test_rank_and_look_back(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 500).alias("v"))
    ranks = ordered.ranked(df, [F.col("v").desc()], "rank").collect()
    assert all(r["rank"] == 500 - r["v"] for r in ranks)
    rows = spark.range(50).select(F.lit(1).alias("k"), (F.col("id") + 1).alias("n"))
    got = ordered.look_back(rows, ["k"], "n", 4, {"s": lambda w: F.sum("n").over(w)}, span=8)
    assert {r["n"]: r["s"] for r in got.collect()} == {
        n: sum(range(max(1, n - 4), n + 1)) for n in range(1, 51)}


def test_work_metrics(spark):
    rows = spark.createDataFrame([("q", 1, 2.0, 2, 2, 2), ("q", 2, 4.0, 2, 2, 2)],
                                 "key string, i int, seconds double, queue_size int, "
                                 "active_workers int, concurrency int")
    last = quality.work_metrics(rows, ["key"], F.lit(0), [F.col("i")]).orderBy("i").collect()[-1]
    assert (last["rolling_seconds"], last["remaining_seconds"]) == (3.0, 6.0)


def test_anomaly_needs_independent_evidence(spark):
    moves = spark.createDataFrame([(80.0,), (-75.0,), (70.0,)], "change_percent double")
    ddl = ("search_records bigint, valid_observations bigint, prior_valid_observations bigint, "
           "ai_candidates bigint, ai_failures bigint, parsing_anomalies bigint")

    def decide(*values):
        row = quality.assess_anomalies(moves, spark.createDataFrame([values], ddl)).first()
        return row["price_warnings"], row["safety_halt"], row["reasons"]

    assert decide(100, 5, 0, 0, 0, 0) == (3, False, [])
    assert decide(0, 5, 0, 0, 0, 0) == (3, True, ["search_results_zero"])
    assert decide(9, 4, 10, 10, 8, 1)[2] == [
        "valid_observations_collapsed", "abnormal_ai_failure_distribution",
        "parsing_or_schema_anomaly"]


def test_queue_counts_are_zero_filled(spark):
    jobs = spark.createDataFrame([("pending",), ("pending",), ("retry",)], "state string")
    got = {r["state"]: r["n"] for r in quality.queue_counts(jobs).collect()}
    assert got == {"pending": 2, "processing": 0, "retry": 1, "completed": 0}


def test_sources_are_cut_before_duplicates_are_marked(spark):
    from pricelode.plans.scan import read_sources
    day = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)

    def record(source, page, product, state, age):
        return source, page, 0, "m", product, state, day - dt.timedelta(days=age)

    rows = spark.createDataFrame(
        [record("a", 0, "p1", "unchanged", 5), record("a", 2, "p2", "unchanged", 6), record("a", 3, "p3", "new", 7),
         record("b", 0, "q1", "unchanged", 5), record("b", 1, "q2", "unchanged", 6), record("b", 2, "y", "new", 7),
         record("c", 0, "y", "new", 0), record("c", 1, "p3", "new", 1)],
        "source_key string, page_no bigint, pos bigint, marketplace string, product_id string, state string, "
        "updated_at timestamp")
    payloads = spark.createDataFrame(  # page 1 of source a has no usable record
        [(s, k, p) for k, (s, n) in enumerate((("a", 4), ("b", 3), ("c", 2))) for p in range(n)],
        "source_key string, source_order int, page_no bigint")
    marks = spark.createDataFrame([("a", day), ("b", day)], "source_key string, updated_at timestamp")
    kept = {(r["source_key"], r["product_id"]): r["duplicate"] for r in read_sources(rows, payloads, marks, 1).collect()}
    assert kept == {("a", "p1"): False, ("a", "p2"): False, ("a", "p3"): False, ("b", "q1"): False, ("b", "q2"): False,
                    ("c", "y"): False, ("c", "p3"): True}


def test_first_wins_carries_named_order_columns_once(spark, monkeypatch):
    """Columns of the order needn't be stored beside the rank that holds them."""
    stored = []
    cut = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    rows = spark.createDataFrame([(3, 1, 1, "x"), (1, 1, 2, "y"), (2, 2, 2, "z"), (4, None, None, None), (5, 3, 1, "w")],
                                 "at int, a int, b int, note string")
    got = ordered.first_wins(rows, [["a"], ["b"]], ["at", "note"])
    assert got.columns == rows.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 2, "y"), (4, None, None, None), (5, 3, 1, "w")]
    assert stored[0] == ["a", "b", "_rank"]
