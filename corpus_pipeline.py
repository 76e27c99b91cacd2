"""A corpus-cleaning pipeline: five stages, each written as Parquet and read again by the next.

1. `toxicity`: texts that the compression-distance classifier takes for toxic go.
2. `quality`: lines that fail the line rules are removed; texts that fail the base rules or lose
   too much go.
3. `near_duplicates`: of each group of texts linked at a shingle similarity of 75 % the document
   with the least id stays.
4. `decontamination`: passages of the benchmark are cut out of the texts.
5. `piece_ids`: texts are encoded and decoded with the SentencePiece model.

All stages but the last return the columns they got (`n_chars` follows a changed text), so columns
of any other name pass through, also names that operators use for their own results.

Defined cases: null texts are judged as empty, so the quality stage rejects them; rows with a null
id are never duplicates; of rows that share an id in the near-duplicate stage one stays; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.common import column, is_held_out, table
from pricelode.llm.decontamination import find_contamination
from pricelode.llm.line_quality import line_quality
from pricelode.llm.ngram_join import ngram_join
from pricelode.llm.piece_ids import encode_pieces
from pricelode.llm.toxicity import score_toxicity, train_toxicity
from pricelode.session import stage_table

PIECE_MODEL = "piece_bpe_32k.model"
TOXIC_FROM = 0.5
#: From so many characters on, phrases and separators are judged by their share of the line.
LONG_LINE = 200


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one struct, where no name can clash."""
    rest = [column(docs, c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_end_of_row")).alias("packed_columns"))


def _unpacked(rows: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of `docs` again; with `text`, that column is the text and n_chars its length."""
    def value(name: str):
        if name == "doc_id":
            return F.col("doc_id")
        if name == "text":
            return F.col(text or "text").alias("text")
        if name == "n_chars" and text:
            return F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("packed_columns").getField(name).alias(name)

    return rows.select(*(value(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), lambda key: ~is_held_out(key, 5, 0))
    scored = score_toxicity(_packed(docs), model)
    return _unpacked(scored.where(F.col("score") < TOXIC_FROM), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The row number keeps the verdict from being pushed into the plan a second time.
    judged = line_quality(_packed(docs), share_from=LONG_LINE).withColumn("row_number", F.monotonically_increasing_id())
    return _unpacked(judged.where("kept AND row_number >= 0"), docs, "cleaned")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = ngram_join(docs).where("id IS NOT NULL")
    marks = joined.groupBy("id").agg((F.min("component_id") < F.col("id")).alias("gone"), F.count(F.lit(1)).alias("rows"))
    marks = stage_table(marks.where("gone OR rows > 1"), "near-duplicates")
    rows = _packed(docs)
    single = rows.join(marks.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    several = rows.join(marks.where("rows > 1 AND NOT gone").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return _unpacked(single.unionByName(several.dropDuplicates(["doc_id"])), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_contamination(_packed(docs), table(spark, sf_dir, "benchmark"), cleaned="cleaned")
    return _unpacked(found, docs, "cleaned")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL), digests=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("piece_ids", piece_ids),
]

#: Toxicity is a trained model and pieces come from a library; SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
