"""The stages that turn documents into a training set.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept.
All but the last return the columns of documents, and others that ``docs`` has,
whatever they are called.

Defined cases for all stages: an empty table gives no rows; null and empty texts,
null and repeated doc_ids and repeated rows are rows like others but where a
stage says what becomes of them; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, mixing, simhash, token_output, toxicity
from quire.llm.storage import materialise, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't find toxic; null and empty texts stay, equal texts fare alike, and without labels all stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: of the least doc_id, nulls last; null and empty texts are one group, repeated rows another."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; null and empty texts stay, equal texts fare alike, and without items all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them; those without words are not taken, a null source is one of the sources."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document; null and empty texts are a stop id, rows of one doc_id stand in order of their text."""
    files = token_output.write_tokens(docs, scratch(spark, "tokens"))
    return token_output.read_tokens(files, docs.schema["doc_id"].dataType)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: The toxicity stage trains a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
