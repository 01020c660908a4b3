"""From raw documents to a sharded training mix, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's ``docs``.  All but the last return the columns of documents.

In every stage a null text counts as empty, null and repeated ids are rows like others, further columns
are carried along, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelens.llm.common import keep, stage, staging, table, unstage
from framelens.llm.decontam import decontaminated
from framelens.llm.mixing import mixed
from framelens.llm.quality import kept, train
from framelens.llm.sharding import sharded
from framelens.llm.similar import representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more; all of them where no label was learnt from."""
    return kept(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    By SimHash with covering-code anchors, as op8; MinHash bands add pairs beyond two bits, exact sets decide.
    Texts without words are copies of each other, so one of them stays.
    """
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an item without words is in none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole or in part, as often as their source's target takes them; those without words never."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; equal texts share a shard."""
    return sharded(docs, 16)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Quality and near-dedup can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder in between.

    A stage's own tables go when its result is written, and that when the next one's is.
    """
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        with staging():
            made = keep(stage(function(spark, docs, sf_dir), name))
        unstage(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
