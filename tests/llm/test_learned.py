"""Operators 5 and 8 on held-out rows, and the pipeline stage by stage."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoor.llm import quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


def test_label_model_counts_equal_voters_once():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    good = np.where(rng.random(2000) < 0.9, y, ~y & (rng.random(2000) < 0.1))
    votes = np.stack([good, good, good, np.where(y, rng.random(2000) < 0.8, rng.random(2000) < 0.05)], axis=1)
    votes = np.c_[votes, ~votes.any(axis=1)]
    found = toxicity.label_model(votes, 0.3)
    assert ((found > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize(("module", "target"), [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_nulls_and_missing_classes(spark, module, target):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "a b", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], f"doc_id long, {target} int")
    rows = module.score(docs, module.train(docs, labels)).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert module.score(docs.where("false"), module.train(docs, labels.where("false"))).count() == 0


def test_toxicity_learns_from_two_thousand_rows_of_either_class(spark):
    from pyspark.sql import Window

    from spoor.llm.learning import held_out

    rows = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    known = rows.where(~held_out(F.col("doc_id"), 4))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id"))
    late = known.withColumn("rank", rank).where("toxic = 1 AND rank > 1500 AND rank <= 2000").select("doc_id", F.lit("zorkish").alias("word"))
    word = F.coalesce("word", F.when(F.col("toxic") == 1, "blargle").otherwise("quiet"))
    text = F.concat_ws(" ", F.md5(F.col("doc_id").cast("string")), word, F.md5(F.concat(F.lit("b"), F.col("doc_id"))))
    docs = rows.join(late, "doc_id", "left").select("doc_id", text.alias("text"))
    model = toxicity.train(docs, rows)
    whole = toxicity.term_hashes(pa.array(["zorkish", "blargle", "quiet"]))[1][:3]
    assert np.isin(whole, model.terms).all()
    late, early, none = model.scores(pa.array(["a zorkish b", "a blargle b", "a b"]))
    assert late > none and early > none


def test_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    trees = quality_classifier.grow(x[:600], y[:600], np.ones(600), 0.5)
    assert ((trees.scores(x[600:]) > 0.5) == y[600:]).mean() > 0.95


def test_quality_on_held_out_rows(spark):
    from spoor.llm.queries import QUERIES

    rows = QUERIES["op8_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right, n = rows.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right >= 0.93 * n


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 500 < len(ids) < docs.count()
