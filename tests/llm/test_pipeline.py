"""The corpus pipeline against a plain version of its decisions."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_text_operators import brute_components, brute_fingerprint, check_placed, odd_rows
from wayfold.llm import language_id, quality_knn, queries, tokens
from wayfold.session import prepare

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_version(spark):
    spark = prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~quality_knn.held_out())
    trees = language_id.fit(docs.filter(~language_id.held_out()))
    rows = docs.collect()
    told, score = language_id.score_texts(trees, pa.array([r["text"] for r in rows]))
    rows = [r for r, t, s in zip(rows, told, score, strict=True) if t in corpus_pipeline.TARGETS and s >= corpus_pipeline.CERTAIN]
    assert 0.5 < len(rows) / docs.count() < 0.7 and sum(r["lang"] == "en" for r in rows) >= 0.98 * docs.filter("lang = 'en'").count()
    voters = quality_knn.fit(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r, s in zip(rows, voters.score(pa.array([r["text"] for r in rows])), strict=True) if s >= 0.3]
    label = brute_components([brute_fingerprint(r["text"]) for r in rows])
    kept: dict = {}
    for r, c in zip(rows, label, strict=True):
        kept[c] = r if c not in kept or r["doc_id"] < kept[c]["doc_id"] else kept[c]
    made = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in made} == {r["doc_id"] for r in kept.values()}
    own = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: own.encode(r["text"], add_special_tokens=False).ids + [1] for r in kept.values()}
    check_placed(made, ids, 4096)
    assert sum(r["length"] for r in made) == sum(map(len, ids.values()))


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = odd_rows(prepare(spark)).withColumnRenamed("KEPT", "lang_pred").selectExpr("*", "'own' as removed", "5 as fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.join(docs, "doc_id", "left_semi").filter("removed <> 'own' or fp <> 5").count() == 0
        assert made.columns == docs.columns, name
        assert made.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    made = queries.QUERIES[name](prepare(spark), SF)
    assert made.count() > 0 and len(set(made.columns)) == len(made.columns)


def test_every_operator_has_its_query():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 11)) and set(__spark_entry__.queries()) >= {"pipeline", *queries.QUERIES}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and np.all([callable(f) for _, f in corpus_pipeline.STAGES])
