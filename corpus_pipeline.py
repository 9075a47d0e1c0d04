"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame: the columns of
``docs`` for the documents that stay, and the packed pieces in the end. The
result of a stage is written and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_analog.llm import cnn_toxicity, knn_quality, mixing, packing, token_groups
from spark_analog.operators.staging import stage


#: Rows of whole texts that are handed to a Python task at once, at most.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


def _columns(frame: DataFrame, docs: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts."""
    _small_batches(spark)
    model = knn_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, at = knn_quality.classify(docs, model)
    return _columns(scored.filter(F.col(f"{at}.predicted") == 1), docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier doesn't find toxic."""
    _small_batches(spark)
    net = cnn_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, at = cnn_toxicity.classify(docs, net)
    return _columns(scored.filter(F.col(f"{at}.predicted") == 0), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; every different text of
    an id is a document. Rows without an id stay."""
    _small_batches(spark)
    return token_groups.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source asks for."""
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifiers can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
