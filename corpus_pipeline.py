"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollbridge.llm import bpe, decontaminate, lines, near_copies, quality
from tollbridge.queries.registry import table
from tollbridge.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a later document holds too, n_chars counted anew; all documents stay."""
    return lines.drop_repeated_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of five-word shingles), the document with the smallest doc_id: linked by
    SimHash fingerprints, each link compared in full, and copies that no fingerprint links by shared shingles."""
    return near_copies.drop_copies(docs, radius=near_copies.RADIUS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the digest of what they decode to."""
    encoded = bpe.encode_texts(docs, public_tokenizers.path(TOKENIZER))
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("BPE encoding", token_ids),
]
#: No SQL can express the certified cutoffs, the shingles' sample and the ids; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
