"""Corpus pipeline: five stages over ``documents``, each calling one operator of ``tessera.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import cut, table
from tessera.llm.stages import decontaminate, drop_near_copies, drop_repeats, drop_toxic, pack

STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# The classifier's scores, the word pieces and the packing are not expressible in SQL;
# the pipeline is tested against brute force on a small fixture instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
