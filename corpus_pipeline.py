"""The training-data pipeline over ``documents``.

Each stage gets what the one before kept, written as Parquet and read again, and calls one operator of
:mod:`spoor.llm`. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.byte_bpe import encode
from spoor.llm.decontamination import remove_leaks
from spoor.llm.near_dedup import deduplicate
from spoor.llm.shared import shared_dir
from spoor.llm.substring_dedup import remove_repeats
from spoor.llm.toxicity import score, train


def _row(columns: list[str]) -> Column:
    """Columns as one, so that none clashes with what an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in columns] or [F.lit(0).alias("none")]).alias("row")


def _columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes to be toxic go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(score(docs.select("text", _row(docs.columns)), model, keep=["row"]).where("predicted = 0"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, a similarity of 0.8."""
    return deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 13 words or more that an earlier document has go; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeats(docs.select("doc_id", "text", _row(rest)), keep=["row"])
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))
        own["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as ids, with the digest of what they decode to."""
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids", "decoded", "decoded_sha256")]
    out = encode(docs, decoded=True)
    return out.select(*[F.col(f"`{c}`") for c in rest], "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: The stages learn a classifier and apply a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder for the next one."""
    path = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
