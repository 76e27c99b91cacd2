"""The pipeline's stages on planted cases, and its registration."""

import random

import pytest

pytest.importorskip("sentencepiece")

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"


def _docs(spark):
    random.seed(21)

    def text(words=90):
        return ". ".join(" ".join("".join(random.choice(["ba", "ko", "mi", "ra", "tu", "se"]) for _ in range(3))
                                  for _ in range(9)) for _ in range(words // 9)) + "."

    clean = [text() for _ in range(6)]
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where(F.size(F.split("text", " ")) > 14).first().text
    rows = [(k, t, "en", f"s{k}", len(t)) for k, t in enumerate(clean)]
    rows += [(10, clean[0], "en", "s", 1), (11, clean[1].replace("ba", "BA", 1), None, None, None),
             (12, text() + "\n" + passage + "\n" + text(), "en", "s", 1), (13, None, "en", "s", 0), (14, "", "en", "s", 0),
             (15, "### ||| $$$ " * 60, "en", "s", 1), (None, text(), "en", "s", 1), (5, clean[5], "en", "s5", len(clean[5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("score", F.lit("own")).withColumn("kept", F.lit(7)), passage


def test_stages(spark):
    docs, passage = _docs(spark)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "piece_ids"]
    stages = dict(corpus_pipeline.STAGES)
    for name in names[:-1]:
        assert stages[name](spark, docs.where("false"), SF).count() == 0
        assert stages[name](spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
    judged = {r.doc_id for r in stages["quality"](spark, docs, SF).collect()}
    assert {0, 1, 2, 3, 4, 5, 10, 11, 12, None} == judged
    left = stages["near_duplicates"](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [0, 1, 2, 3, 4, 5, 12, 13, 14, 15, None]))
    assert all(r.score == "own" and r.kept == 7 for r in left)
    clean = {r.doc_id: r for r in stages["decontamination"](spark, docs, SF).collect()}
    assert passage[:60] not in clean[12].text and clean[12].n_chars == len(clean[12].text)
    assert clean[0].text == docs.where("doc_id = 0").first().text and clean[13].text is None
    last = stages["piece_ids"](spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()


def test_run_over_a_small_table(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.3 * documents < len(rows) < documents and len({r.doc_id for r in rows}) == len(rows)


def test_quality_keeps_articles_of_one_line(spark):
    random.seed(22)
    prose = " ".join("".join(random.choice(["ba", "ko", "mi", "ra", "tu", "se"]) for _ in range(3)) for _ in range(120))
    rows = [(1, f"{prose} a cookie and its market share on the street. {prose[::-1]}."),
            (2, f"{prose}. | {prose[::-1]} | > end."), (3, f"{prose}.\nWe use a cookie here.\nNews | Sport | Mail | Us")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF).collect()}
    assert left == {1: rows[0][1], 2: rows[1][1], 3: f"{prose}."}
