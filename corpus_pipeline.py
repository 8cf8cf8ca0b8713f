"""Corpus pipeline: classify, drop near duplicates, cut repeats, redact, pack.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept,
and works on all of it. run() writes every stage as Parquet in the shared
folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.common import discard, free, materialize, table
from voxelframe.llm.minhash import near_duplicates
from voxelframe.llm.packing import pack_tokens
from voxelframe.llm.quality import ratings_of, select_rows, train
from voxelframe.llm.queries import tokenizer_path
from voxelframe.llm.secrets import redact_secrets
from voxelframe.llm.suffix import cut_repeats
from voxelframe.session import ship

CAPACITY = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose probability of the top grade (neither poor nor toxic) is 0.7 or more."""
    ship(spark)
    model = train(docs, ratings_of(table(spark, sf_dir, "labels")), levels=3)
    return select_rows(docs, model, level=2, least=0.7)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) keep
    the document of smallest id; of rows with the same id and text, one. Rows
    without an id stay."""
    ship(spark)
    kept = near_duplicates(docs, words=5, threshold=0.8).where("kept").select("doc_id").distinct()
    ids = kept.select(F.col("doc_id").alias("_kept"))
    some = docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return some.union(docs.where("doc_id is null"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 100 bytes and more that came before, the first staying.
    Characters of which a byte stays stay whole."""
    ship(spark)
    return cut_repeats(docs, length=100)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, chunk, n_tokens, bin, offset): the place of each piece, by tokens
    and with near copies apart. The texts were cut and redacted since
    near_dedup, so near copies are sought anew."""
    ship(spark)
    return pack_tokens(docs, tokenizer_path(), CAPACITY)


STAGES = [("quality", quality_stage), ("near_dedup", near_stage), ("suffix_dedup", repeats_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: The stages fit a model and compare texts by content; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        new = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = new
        free(spark)
    return docs
