"""The stages of the corpus pipeline: each applies one operator to all rows it is given.

A stage takes ``(spark, docs, sf_dir)``. A filtering stage returns the columns of
``docs`` and keeps the rows it does not reject, so null and empty texts survive
wherever the operator has nothing against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of all given rows."""
    from .toxicity import THRESHOLD, score_rows, train

    model = train(docs, table(spark, sf_dir, "labels"))
    score = free("__toxic_score", docs.columns)
    scored = score_rows(docs, model, out=score)
    return scored.where(F.col(score) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    from .simhash import keep_one_per_group

    return keep_one_per_group(docs, shingle=3, radius=2)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte runs of 50 that already start in a document with a smaller id are cut from the texts."""
    from .suffix_dedup import dedup_texts

    return dedup_texts(docs, length=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover enough of a benchmark item go."""
    from .tiling import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences."""
    from .packing import pack_pieces

    return pack_pieces(docs)
