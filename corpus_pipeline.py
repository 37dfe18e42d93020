"""The corpus pipeline: documents in, tokens of the documents that are kept and mixed out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Source mixing adds block, slot and place, as rows
have no order once they are written; the last stage carries them to the output. Columns
of the input that have these names give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import minhash, mixing, pii, quality
from sparkloom.llm.queries import TARGET_WEIGHTS, bpe_digests
from sparkloom.llm.storage import reread
from sparkloom.packaging import shipped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id: five-word shingles, similarity 0.8."""
    shipped(spark)
    return minhash.deduplicated(docs, size=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return pii.pseudonymised(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their block, slot and place in the mix to the target weights."""
    columns = [f"row.`{c}`" for c in docs.columns if c not in mixing.ADDED]
    return mixing.mix(docs, TARGET_WEIGHTS).select(*columns, *mixing.ADDED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's tokens and of what they decode to, with its place in the mix."""
    shipped(spark)
    return bpe_digests(docs, mixing.ADDED)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII", pseudonyms),
    ("source mixing", source_mixing),
    ("BPE", tokens),
]
#: Pseudonyms and tokens can't be told in SQL; the pipeline is tested against a plain version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = reread(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
