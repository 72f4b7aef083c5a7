"""A corpus pipeline of five stages over ``documents``: each works on what its predecessor kept.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents, with n_chars brought up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, packing, quality, secrets, space, substrings

#: What stands in place of a secret.
SECRET_MARK = "[secret]"
#: Words of a shingle, and percent of the union that near copies have in common; op4_jaccard has a stricter rule of its own.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    return (docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs).select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. References come from all documents of this stage's input.

    The verdict is computed on the rows themselves, so rows that share a doc_id, or have none, are each judged alone.
    """
    return quality.kept_rows(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id. Links are by NEAR_SHINGLE and NEAR_PERCENT."""
    return jaccard.keep_one(docs, size=NEAR_SHINGLE, percent=NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; documents of which nothing is left go."""
    done = substrings.remove_repeats(docs, with_text=True)
    return _sized(done, docs.columns).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with SECRET_MARK in place of each secret."""
    import public_tokenizers

    done = secrets.redacted_rows(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SECRET_MARK)
    return _sized(done, docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("row_hash")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The verdicts, the token test and packing have no SQL form: tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = space.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
