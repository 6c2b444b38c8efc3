"""A training corpus from raw documents: five stages, each on all that the one before kept.

Rows are told apart by id and text, so null and repeated ids cost nothing. Texts that are
null or empty have no shingles and no words: they stay until the mix, which takes none of them.
A stage on an empty table gives an empty table; columns of any names pass through.

ORACLE_SQL is None: SQL expresses neither the classifier nor the joins; the tests compare
the stages with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from symbolith.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from symbolith.llm.common import ensure_checkpoint_dir, table

ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject, each judged by its own text; a null text is empty."""
    raw, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.keep(docs, quality.train(raw, labels))


def unequal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the smallest id, a null id last; null and empty texts are one text."""
    return exact_dedup.drop_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, a null id last."""
    return jaccard_join.keep_one(docs, shingle=5, num=80, den=100)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose own text no benchmark item was found, whatever their ids."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as their source's target takes them, numbered by ``epoch``; a null source is one."""
    return mixing.mix(docs)


STAGES = [
    ("quality", good),
    ("exact_dedup", unequal),
    ("jaccard_join", dissimilar),
    ("decontaminate", uncontaminated),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a table in the shared checkpoint folder.

    A table is removed when the next one is written; the result reads the last of them.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
