"""Documents to packed training sequences: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows
to the shared folder and gives the reread rows to the next. Models are fitted on bounded
samples of labelled rows (see language_id and quality_knn); every kept document is processed
whole. All but the last stage return the columns of documents, whatever else these have: a column that
a model adds takes no part, and one whose name equals an added column's keeps its own values.

In every stage rows are independent of their order, repeated rows get the same verdict (the
near-duplicate stage keeps one of them), an empty table gives an empty table, and a text of any
length is processed whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import language_id, quality_knn, simhash, tokens
from wayfold.llm.common import stored

#: Languages that the corpus is made for, and the least score with which a document's counts as told.
TARGETS, CERTAIN = ("en",), 0.5


def _kept(docs: DataFrame, judge, condition: str) -> DataFrame:
    """The rows of docs, as they are, for which condition holds on what judge(docs under other names, its text's name) adds."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return judge(docs.toDF(*names), names[docs.columns.index("text")]).filter(condition).select(*names).toDF(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of TARGETS (operator 10); other languages, 'und' and scores under CERTAIN go.

    Learned from text and lang of the stage's own rows outside the held-out fold. Null and empty texts
    and texts without a letter are 'und'; null ids and languages are rows like any other. A tie
    between languages goes to the first by name.
    """
    trees = language_id.fit(docs.filter(~language_id.held_out()))
    targets = ", ".join(f"'{t}'" for t in TARGETS)
    return _kept(docs, lambda own, text: language_id.identify(own, trees, text), f"lang_pred in ({targets}) and score >= {CERTAIN}")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 3) predicts as label 1.

    Null and empty texts get the labels' usual share of 1 as their score; rows with null ids are
    judged like all others. Equal cosines go to the smaller doc_id.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    voters = quality_knn.fit(docs, labels.filter(~quality_knn.held_out()))
    return _kept(docs, lambda own, text: quality_knn.classify(own, voters, text), "predicted = 1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (operator 7): that with the least doc_id.

    Null and empty texts are duplicates of each other. Rows with a null doc_id stay; of rows with the
    same doc_id one stays (see simhash.deduplicated).
    """
    return simhash.deduplicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its sequence and offset (operator 6).

    Null texts are as empty: one piece that holds the end id. Rows with null or repeated ids each
    get their pieces; pieces of one length are interchangeable.
    """
    return tokens.packed_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", languages), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing_stage)]

#: The language, quality and packing stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
