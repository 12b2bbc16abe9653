"""A training-data pipeline over `documents`: rules, near duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written
as Parquet and read again for the next. All but the last return the columns of documents. Nulls may stand in any column,
rows may repeat, texts may be empty or very long, and an empty table gives an empty one; what each stage does with them is
stated there. Columns besides doc_id, text and source, whatever their names, pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadspark.llm import decontaminate, jaccard, mixing, quality, secrets
from leadspark.llm.common import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many documents of a source share go from the others.

    A null or empty text has too few words and goes. Rows that repeat share their verdict. A null source is a source.
    """
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays: that with the smallest doc_id.

    Of rows with one doc_id one stays; rows without doc_id all stay, as do empty texts.
    """
    return jaccard.representatives(docs, percent=80, k=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item (80 % of its five-word shingles) go, without a doc_id too; null and empty texts and items hold nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, and null texts stay null."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with repeats and taken words. A null source is a source; empty texts have size 0."""
    return mixing.mix(docs).where("repeats > 0")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("secret_scans", secret_scans), ("mixture", mixture)]
#: The stages need a trained model and graph components; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
