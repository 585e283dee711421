"""A training corpus from `documents`: toxic documents out, exact and near copies out, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir), works on every row it gets, and
returns the columns of `docs`; the last returns the packed pieces.  The result
of a stage is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import own_name, table
from corpuslens.llm.exact_dedup import exact_dedup
from corpuslens.llm.mixing import mixed_documents
from corpuslens.llm.packing import pack_documents, piece_digests
from corpuslens.llm.queries import tokenizer_path
from corpuslens.llm.simhash import near_dedup
from corpuslens.llm.toxicity import toxicity
from corpuslens.session import ensure_checkpoint_dir


def rows_where(operator: Callable[[DataFrame], DataFrame], docs: DataFrame, added: tuple[str, ...], condition: str) -> DataFrame:
    """Rows of `docs` for which the operator's added columns meet a condition; own columns of those names stay as they are."""
    inside = [own_name([*docs.columns, *added], f"_{c}") if c.lower() in added else c for c in docs.columns]
    kept = operator(docs.toDF(*inside)).where(condition)
    return kept.select(*[F.col(i).alias(c) for i, c in zip(inside, docs.columns, strict=True)])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on this stage's labelled rows, doesn't reject.

    A score of exactly 0.5 means that no weight speaks for or against a
    document (so without labelled rows): it stays.
    """
    labels = table(spark, sf_dir, "labels")
    return rows_where(lambda d: toxicity(d, labels), docs, ("score", "predicted"), "predicted = 0 OR score = 0.5")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier."""
    return rows_where(exact_dedup, docs, ("keep_id", "group_size", "kept", "text_sha256"), "kept")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a document stands in it once per epoch that takes it."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, packed into sequences."""
    return piece_digests(pack_documents(docs, tokenizer_path()))


STAGES = [("toxicity", clean), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("mixing", mixed), ("packing", packed)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all of `documents`."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
