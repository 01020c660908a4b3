"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.containment import Rule, find, item_blocks, without

RULE = Rule(threshold=0.8, words=5)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("id"), "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): every test item in every document.

    An item is in a document if the document's shingles of five words hold at least 0.8 of the
    item's distinct ones.  A text of fewer words has one shingle, its whole sequence, and one of no
    words (or null) has none and matches nothing.  Repeated documents and items give rows each;
    empty tables give none.  A document that contains no item gives no row.  Ids keep their type, and a
    null one stays null.
    """
    found = find(docs, item_blocks(_items(benchmark)), rule)
    return found.select("doc_id", F.col("item").alias("item_id"), "n_shingles", "n_shared", "containment")


def decontaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The documents, with all their columns, that contain no test item."""
    return without(docs, item_blocks(_items(benchmark)), rule)
