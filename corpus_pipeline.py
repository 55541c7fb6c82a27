"""From documents to a language-checked, deduplicated, decontaminated, mixed and sharded corpus.

Each stage works on all that its predecessor kept, and its decisions take effect; all but the last return the columns
of documents.  The last adds ``old_shard`` and ``new_shard``.

Rows without letters in their text, so null and empty texts too, go in the first stage.  Null ids stay until the end, as
nothing can name them; rows that repeat an id stay or go together.  A null language or source is a value of its own to
mixing and sharding.  Columns besides those of documents are carried along, whatever their names, but ``old_shard`` and
``new_shard`` are replaced.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelattice.llm import op3_shard, op4_jaccard, op5_mix, op7_decontaminate, op8_langid
from codelattice.llm.common import drop, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can't tell go."""
    return op8_langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return op4_jaccard.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op7_decontaminate.decontaminated(docs, op7_decontaminate.read_benchmark(spark, sf_dir))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that token weights meet the target margins."""
    return op5_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are the old shards; the fewest bytes move to make new ones of equal capacity."""
    return op3_shard.resharded(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the language network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet to the shared folder and read again, and the table before it deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
            if before is not None:
                drop(before)
            before = docs
    return docs
