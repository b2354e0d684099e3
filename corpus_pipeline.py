"""Cleaning of a corpus in five stages, from ``documents`` to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result
is written as Parquet and read again. All stages but the last return the columns they got.
Extra columns pass through whatever their names. Null and empty texts: the quality stage
rejects them (too few words); the later stages leave them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from alphaloom.llm.shipping import ship
from alphaloom.llm.storage import settle


def _wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row in one column beside the columns an operator works on, so that names cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def _unwrapped(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules keep."""
    return _unwrapped(quality_rules.quality_verdicts(_wrapped(docs, "text")).filter("kept"), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source; ``n_chars`` follows the text."""
    out = line_dedup.drop_boilerplate(_wrapped(docs, "source", "text"), "source", "text")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast("long")}
    return _unwrapped(out, docs.columns, **new)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every near-duplicate class; of equal rows of one id and text, one stays; rows without id all stay."""
    classes = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    first = classes.filter("doc_id = class_id").select("doc_id").distinct().hint("shuffle_hash")  # else whole rows are sorted for the join
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text"))
    return _unwrapped(decontaminate.contamination(_wrapped(docs, "doc_id", "text"), benchmark).filter("n_hit = 0"), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: not expressible: expectation-maximisation, connected components and packing are iterative
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
