"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

The texts are read once, for their SHA-256, which is staged.  Pass one marks in a Bloom filter every
slot that the hashes of two or more rows meet.  Pass two probes it: a row with an unmarked slot has no
equal and passes straight through, and only the rest shuffle, by their SHA-256.  Both slots of a row
lie in one block, so a probe is one lookup.  A filter has a fixed largest size (``max_bits``) and four
bits a row or more, at which one in six unrepeated rows is held for repeated: for more rows the hashes
are parted into classes with a filter each, which one sort of every staged file makes contiguous.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import stage, text_or_empty, unstage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of one block of the filter: 512 longs.
BLOCK_BITS = 512 * 64
#: Bits a row of a filter below the largest size, and the fewest of one of that size.
BITS_PER_ROW, FEWEST = 16, 4


def normalised(name: str = "text"):
    """The text with A-Z lower-cased; a null is empty."""
    text = text_or_empty(name)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _slots(bits: int):
    """The block of a row's SHA-256 in a filter, and its two slots there."""
    block = F.pmod(F.xxhash64("sha"), F.lit(bits // BLOCK_BITS)).alias("block")
    h = F.xxhash64("sha", F.lit(1))
    return block, F.pmod(h, F.lit(BLOCK_BITS)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(BLOCK_BITS)).cast("int")


def repeated_filter(hashed: DataFrame, bits: int) -> DataFrame:
    """(block, words): the 512 longs of every block that has a bit set; a bit is set if two rows or more met its slot."""
    block, one, two = _slots(bits)
    slots = hashed.select(block, F.explode(F.array_distinct(F.array(one, two))).alias("slot"))
    slots = slots.select((F.col("block") * BLOCK_BITS + F.col("slot")).alias("slot")).groupBy("slot").count().where("count > 1")
    longs = slots.groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("word"))
    longs = longs.groupBy(F.floor(F.col("at") / 512).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") % 512).cast("int").alias("k"), "word"))).alias("words"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda k: F.coalesce(F.try_element_at("words", k), F.lit(0).cast("long")))
    return longs.select("block", dense.alias("words"))


def _probed(hashed: DataFrame, bits: int) -> DataFrame:
    """``hashed`` (doc_id, sha) with ``hit``: another row may have this hash."""
    marked = stage(repeated_filter(hashed, bits), "bloom")
    block, one, two = _slots(bits)
    rows = hashed.select("doc_id", "sha", block, one.alias("one"), two.alias("two")).join(F.broadcast(marked), "block", "left")
    bit = lambda c: F.coalesce(F.getbit(F.get("words", F.floor(F.col(c) / 64).cast("int")), F.col(c) % 64) == 1, F.lit(False))
    return rows.select("doc_id", "sha", (bit("one") & bit("two")).alias("hit"))


def exact_duplicates(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text is empty.  The largest doc_id of
    a group stays; rows without doc_id come after all others, and of rows that repeat both doc_id and
    text one stays.  An empty table gives an empty result, other columns are not read.
    """
    hashed = stage(docs.select("doc_id", F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("sha")), "hashed")
    rows, bits = hashed.count(), BLOCK_BITS
    while bits < min(max_bits, BITS_PER_ROW * rows):
        bits *= 2
    parts, probe = max(1, -(-rows * FEWEST // bits)), None
    if parts > 1:
        whole = hashed
        hashed = stage(whole.withColumn("part", F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(parts)).cast("int")).sortWithinPartitions("part"), "classes")
        unstage(whole)
    for part in range(parts):
        own = hashed.where(F.col("part") == part) if parts > 1 else hashed
        found = _probed(own, bits)
        probe = found if probe is None else probe.unionByName(found)
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = probe.where(~F.col("hit")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    # both sides of the join are staged, so that a large group's rows can be split over tasks
    rows_of = stage(probe.where("hit").groupBy("sha", "doc_id").agg(F.count("*").alias("n")), "candidates")
    groups = stage(rows_of.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    met = rows_of.join(groups, "sha").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    met = met.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), hexed)
    return alone.unionByName(met)
