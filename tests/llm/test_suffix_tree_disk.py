"""The language model keeps no keys of texts on disk: what is scored and stored are sums, what is asked is packed."""

from __future__ import annotations

import glob
import os
import random

import numpy as np

from pricelode.llm import suffix_tree_lm as lm
from pricelode.session import shared_dir


def _stored(spark, name):
    return {f for f in glob.glob(f"{shared_dir(spark).removeprefix('file://')}/{name}-*/part-*")}


def test_scored_texts_store_sums_and_no_keys(spark):
    random.seed(18)
    words = [f"w{int(random.paretovariate(0.7))}" for _ in range(120_000)]
    docs = spark.createDataFrame([(k, " ".join(words[300 * k:300 * k + 300])) for k in range(400)], "id long, text string")
    before = _stored(spark, "scored-texts")
    model = lm.train_suffix_tables(docs)
    assert lm.score_texts(docs, model, head=5, tree_head=9).count() == 400
    made = _stored(spark, "scored-texts") - before
    assert made and sum(os.path.getsize(f) for f in made) < 400 * 200


def test_packed_keys_come_back_and_take_few_bytes():
    rng = np.random.default_rng(19)
    keys = np.sort(rng.integers(0, 1 << 64, 1 << 16, np.uint64))
    rows = rng.integers(5 << 33, (5 << 33) + 4000, 1 << 16, np.int64)
    data = lm._packed([keys, rows])
    back = lm._unpacked(data, len(keys), 2)
    assert (back[0] == keys).all() and (back[1].view(np.int64) == rows).all()
    assert len(data) < 9 * len(keys)


def test_runs_of_hot_contexts_are_counted_whole(spark, monkeypatch):
    random.seed(20)
    texts = [" ".join(random.choice(["a b", "a c", "a d", f"a x{random.randint(0, 50)}"]) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = []
    for hot in (lm.HOT, 20):
        monkeypatch.setattr(lm, "HOT", hot)
        model = lm.train_suffix_tables(docs)
        found.append({(r.key, r.n, round(r.value, 9)) for r in model.tree.collect()})
    assert found[0] == found[1] and len(found[0]) > 20
