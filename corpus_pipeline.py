"""The corpus pipeline: quality rules, near-copies, benchmark passages, secrets, then token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.blob_ledger import without_secrets
from pitline.llm.host_quality import passing_documents
from pitline.llm.signature_tree import without_near_copies
from pitline.llm.spaced_seeds import decontaminated
from pitline.llm.word_bpe import encode_documents
from pitline.session import batch_texts, read_table, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule, and those of hosts that mostly fail."""
    batch_texts(spark)
    return passing_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of the n-gram Jaccard join."""
    batch_texts(spark)
    return without_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``."""
    batch_texts(spark)
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return without_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit) and digests of the ids and of the bytes they decode to."""
    batch_texts(spark)
    encoded = encode_documents(docs)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("byte-level BPE", token_ids),
]

#: Byte-pair merges can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, apply) in enumerate(STAGES, 1):
        docs = apply(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs)
    return docs
