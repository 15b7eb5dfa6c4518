"""The corpus pipeline: documents are filtered, freed of near duplicates and personal data, packed.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it has kept; all
but the last return the columns of ``docs``. Nulls, empty and repeated texts are treated as the
operators state. Rows with one and the same ``doc_id`` are one document for the near duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecmill.llm import bottomk, packing, pii, quality, toxicity
from vecmill.llm.stages import keep_rows, without_ids
from vecmill.operators.batches import release_memory
from vecmill.session import scratch_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    release_memory()
    return keep_rows(docs, lambda data, offsets, rows: model.score(data, offsets) >= quality.CUT)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold of their language, or 0.3 where the labels
    are too few for one."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    release_memory()
    return keep_rows(docs, lambda data, offsets, rows: model.score(data, offsets) < model.limits(rows.column("lang"), toxicity.CUT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return without_ids(docs, bottomk.near_duplicates(docs).where("not kept").select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new lengths."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

# Models are trained here, so SQL cannot give the rows; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
