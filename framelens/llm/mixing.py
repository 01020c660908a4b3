"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents, in seeded order, form one stream of words that is cut into blocks of equal
size.  The blocks of the whole mix are seats that go to the sources one by one, each to the highest
quotient target / (2 * seats + 1); the seats of one output shard are a stretch of that sequence, which
gives integer quotas for every shard and source.  A source deals its blocks out from a seeded one on,
round and round, and each shard takes its quota of them in turn; so every piece of a document that is
taken has its output shard.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import stage, text_or_empty

WEIGHTS = (5, 2, 1)
#: Most times that a source, and a document, may be taken.
REPEATS = 3
BLOCK_WORDS = 64
_BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"


def word_count(name: str = "text"):
    """Runs of bytes outside 0x20 and 0x09-0x0D: the starts of words, a break before each."""
    text = F.concat(F.lit(" "), F.translate(text_or_empty(name), _BREAKS, " " * len(_BREAKS)))
    return F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long")


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[Fraction]:
    """Shares of all sizes by weight; what exceeds ``repeats`` times a source's size is reshared."""
    total, out = sum(sizes), [Fraction(0)] * len(sizes)
    free, left = list(range(len(sizes))), Fraction(total)
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] > repeats * sizes[i] * weight]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = Fraction(repeats * sizes[i])
        left -= sum(out[i] for i in full)
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> np.ndarray:
    """Seats by highest quotients votes / (2s + 1), ties to the earlier party, at most ``most`` each."""
    v, top = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = min(seats, int(top[v > 0].sum()))
    given = lambda q: np.minimum(np.where(v >= q, np.floor((v / q + 1) / 2), 0).astype(np.int64), top)
    if seats <= 0 or not (v > 0).any():
        return np.zeros(len(v), np.int64)
    low, high = 0.0, float(v.max()) * 2
    step = v.sum() / (2.0 * seats)
    while step > 0 and given(step).sum() < seats:
        step /= 2
    low = step
    for _ in range(200):  # the seats at a quotient of high are fewer, at one of low enough
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if given(middle).sum() >= seats else (low, middle)
    out = given(high)
    while (rest := seats - int(out.sum())) > 0:
        quotient = np.where(out < top, v / (2 * out + 1), -1)
        for i in np.lexsort((np.arange(len(v)), -quotient))[: min(rest, int((quotient == quotient.max()).sum()))]:
            out[i] += 1
    return out


def quotas(sizes: list[int], goal: list[Fraction], shards: int, block: int, repeats: int = REPEATS) -> np.ndarray:
    """Blocks of each source (columns) for each output shard (rows)."""
    blocks = [-(-s // block) for s in sizes]
    seats = round(float(sum(goal)) / block)
    most = [repeats * b for b in blocks]
    upto = [sainte_lague([float(g) for g in goal], seats * (k + 1) // shards, most) for k in range(shards)]
    return np.diff(np.stack([np.zeros(len(sizes), np.int64), *upto]), axis=0)


def _stretches(size: int, block: int, first: int, seats: np.ndarray) -> list[int]:
    """Words that are dealt out before each shard, and in all: whole rounds, and blocks from ``first`` on."""
    blocks, out = -(-size // block), [0]
    for upto in np.cumsum(seats).tolist():
        rounds, rest = divmod(upto, blocks) if blocks else (0, 0)
        words = min(size, (first + rest) * block) - first * block
        if first + rest > blocks:
            words = size - first * block + (first + rest - blocks) * block
        out.append(rounds * size + words)
    return out


def _draws(docs: DataFrame, seed: int) -> list:
    """Seeded draws by which rows are ordered: by id and text, then by all that can be hashed."""
    plain = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    return [F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("draw"), F.xxhash64(F.lit(seed + 1), *plain).alias("then")]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS, shards: int = 16, seed: int = 7, rows_per_bucket: int = 2000, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, pieces, taken of every row of ``docs``; with ``whole`` also ``row``, all its columns.

    Sources by code point, null last, have the weights in turn.  ``pieces`` lists what is taken: word
    ranges [from, to) with the output shard that takes them.  A document without words, and a source
    of only such documents, takes none.  The driver holds one sum a source; all else stays
    distributed, and a large source is spread over hashed buckets.  Rows are ordered by what is in
    them, so the layout of the input makes no difference; rows that are equal in every column are
    interchangeable.  An empty table gives no row.
    """
    rows = stage(docs.select("doc_id", "source", word_count().alias("size"), *_draws(docs, seed)), "words")
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.words for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], repeats)
    seats = quotas(sizes, goal, shards, block, repeats).T if found else []
    plan = []
    for r, size, g, q in zip(found, sizes, goal, seats):
        first = int(np.random.default_rng([seed, len(plan)]).integers(-(-size // block))) if size else 0
        plan.append((r.source, size, float(g), first * block, _stretches(size, block, first, q)))
    plan = docs.sparkSession.createDataFrame(plan, "of string, source_size long, target double, origin long, bounds array<long>")
    buckets = max(1, min(1 << 16, -(-sum(r.n for r in found) // rows_per_bucket)))
    bucketed = lambda df: df.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    ahead = bucketed(rows).groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    if whole:
        rows = docs.select("doc_id", "source", word_count().alias("size"), *_draws(docs, seed), F.struct(*docs.columns).alias("row"))
    return _taken(bucketed(rows), ahead, plan, repeats)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each piece of a document that is taken.

    A part of a document has the words of its stretch, joined by spaces; n_chars, where there is one,
    follows the text.
    """
    out = mix(docs, whole=True, **options)
    out = out.select("row", "size", F.explode("pieces").alias("piece"))
    words = F.filter(F.split(F.translate(F.col("row.text"), _BREAKS, " " * len(_BREAKS)), " "), lambda w: w != "")
    part = F.array_join(F.slice(words, (F.col("piece.from") + 1).cast("int"), (F.col("piece.to") - F.col("piece.from")).cast("int")), " ")
    entire = (F.col("piece.from") == 0) & (F.col("piece.to") == F.col("size"))
    out = out.withColumn("cut", F.when(~entire, part))
    new = {"text": F.coalesce("cut", "row.text"), "n_chars": F.when(F.col("cut").isNotNull(), F.char_length("cut").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((new[c] if new.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns))


def _taken(rows: DataFrame, ahead: DataFrame, plan: DataFrame, repeats: int) -> DataFrame:
    within = Window.partitionBy("source", "bucket").orderBy("draw", "then", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("at", F.col("at") + F.col("ahead") - F.col("origin"))
    # ``at`` counts from the source's first block that is dealt; words before it come at the end of a round
    split = F.least(F.greatest(-F.col("at"), F.lit(0)), F.col("size"))
    parts = F.array(
        F.struct(split.alias("from"), F.col("size").alias("to"), (F.col("at") + split).alias("at")),
        F.struct(F.lit(0).cast("long").alias("from"), split.alias("to"), (F.col("at") + F.col("source_size")).alias("at")),
    )
    parts = F.filter(parts, lambda x: x["to"] > x["from"])
    rounds = F.sequence(F.lit(0), F.lit(repeats - 1))
    stretches = F.flatten(F.transform(rounds, lambda r: F.transform(parts, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), (x["at"] + r * F.col("source_size")).alias("at")))))
    rows = rows.withColumn("live", F.filter(stretches, lambda x: x["at"] < F.element_at("bounds", -1)))

    def cut(x, shard):
        low, high = (x["from"] + (F.get("bounds", shard + i) - x["at"]) for i in (0, 1))
        return F.struct(shard.alias("shard"), F.greatest(x["from"], low).alias("from"), F.least(x["to"], high).alias("to"))

    shards = F.sequence(F.lit(0), F.size("bounds") - 2)
    pieces = F.flatten(F.transform("live", lambda x: F.filter(F.transform(shards, lambda k: cut(x, k)), lambda y: y["to"] > y["from"])))
    rows = rows.withColumn("pieces", pieces)
    rows = rows.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]))
    return rows.drop("draw", "then", "bucket", "at", "s", "b", "ahead", "of", "origin", "bounds", "live")
