"""A training corpus from raw documents: five stages over the operators of ``weftline.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. An empty table passes through every stage
as an empty table; null texts are clean, link with nothing and weigh nothing in
the mix; very long texts pass through whole. Rows that repeat are separate
rows, but the near-duplicate stage keeps one row of each group, whether ids are
equal, null or different. Columns beyond those of ``documents`` are dropped by
the first stage that sees them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, mixing, near_dup, sharding, toxicity
from weftline.llm.common import table, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled training rows, scores below one half."""
    return toxicity.accepted(docs.select(*COLUMNS), toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked at five-word shingles and Jaccard 0.8."""
    return near_dup.one_each(docs.select(*COLUMNS), k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    sized = docs.select(*COLUMNS).withColumn("size", word_count(F.col("text")))
    taken = mixing.mixed(sized).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return sharding.shard(docs.select(*COLUMNS), SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL has no form for a fitted classifier or LSH; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``.

    Results between them go to the shared checkpoint folder. Each is deleted
    once the next is written, and the last one when the session's JVM ends, as
    the returned DataFrame reads it.
    """
    from weftline.llm.common import shared_folder

    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    store = path("all").getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        store.deleteOnExit(path(name))
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if i:
            store.delete(path(STAGES[i - 1][0]), True)
    return docs
