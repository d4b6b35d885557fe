"""The corpus pipeline: five stages, each a training-data operator over all that the one before kept.

Cases, in every stage: null and empty texts stay (they are tolerable, alone, without secrets)
until the mix, which takes no words from them; null and repeated doc_ids are judged row by
row; rows that repeat are near duplicates of each other; very long texts are read whole; an
empty table stays empty; columns besides those of ``COLUMNS`` are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteweave.llm.byte_bpe import encoding_digests
from siteweave.llm.mixing import mixed_documents
from siteweave.llm.ngram_join import one_of_each
from siteweave.llm.secret_scan import redacted_documents
from siteweave.llm.shared import stored
from siteweave.llm.toxicity import tolerable_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return tolerable_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of similar ones stays."""
    return one_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return redacted_documents(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_documents(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix holds."""
    import public_tokenizers

    return encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: The scores are learned and the walk to components has no bound, so SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
