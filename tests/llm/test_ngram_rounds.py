"""A round of hubs moves the open postings once by node and once by signature, and hubs stay the same."""

from __future__ import annotations

from pricelode.llm import ngram_join


def _shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_round_of_hubs_moves_postings_twice(spark):
    rows = [(s, n, 20) for s in range(6) for n in range(8) if (s + n) % 3]
    postings = spark.createDataFrame(rows, "sig long, node long, n int")
    open_ = ngram_join._labelled(postings, None)
    # One to form the lists, two for the hubs, one for the pairs of a node and one for distinct pairs.
    assert _shuffles(ngram_join._pivot_pairs(open_, None, 75)) <= 6
    held = {s: len([n for t, n, _ in rows if t == s]) for s in range(6)}
    assert {(r.sig, r.node, r.held) for r in open_.collect()} == {(s, n, held[s]) for s, n, _ in rows}
    labels = spark.createDataFrame([(n, 0) for n in range(8)], "node long, label long")
    assert ngram_join._labelled(open_, labels).count() == 0


def test_hub_has_the_longest_lists(spark):
    rows = [(1, 1, 20), (1, 2, 20), (2, 2, 20), (2, 3, 20), (3, 2, 20), (3, 4, 20)]
    open_ = ngram_join._labelled(spark.createDataFrame(rows, "sig long, node long, n int"), None)
    assert {tuple(r) for r in ngram_join._pivot_pairs(open_, None, 75).collect()} == {(1, 2), (2, 3), (2, 4)}
    tested = spark.createDataFrame([(2, 3)], "a long, b long")
    assert {tuple(r) for r in ngram_join._pivot_pairs(open_, tested, 75).collect()} == {(1, 2), (2, 4)}
