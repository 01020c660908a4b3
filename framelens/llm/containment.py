"""MinHash search for small texts that lie inside large ones, with exact verification.

The items are partitioned by the size of their shingle set into classes (2^(c-1), 2^c].  For each
class a document's shingles are cut into blocks of 2^c, and two neighbouring blocks make a window; the
first and the last block are also windows alone, so that every shingle is in two windows.  A band is
one MinHash value.  If a share ``threshold`` of an item's s shingles is in a document, wherever it
lies there, the Jaccard similarities of the windows sum to 2 * threshold * s / (2 * 2^c + s) or more, and the
number of bands makes the chance that no band meets at most ``miss``.  Every pair found is then
verified on the strings of all shingles of the whole document.

Items are handled in blocks of bounded size.  A block reaches the executors as a broadcast, and all
blocks are searched in one pass over the documents, without a shuffle; a task holds the signatures of
``HELD`` blocks at most.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framelens.llm.common import text_buffers, text_groups
from framelens.llm.tokens import LOWER, SPACE, shingles, tokenize

#: Bounds of one block of items, and most blocks whose signatures a worker keeps.
BLOCK_ITEMS, BLOCK_TEXT, HELD = 1 << 15, 32 << 20, 4
#: Places of a document whose shingles are compared as strings at once.
_PLACES = 4096
_built: dict[tuple, tuple[list, "Index"]] = {}


@dataclass(frozen=True)
class Rule:
    """What counts as a match. ``breaks``: the bytes that separate words."""

    threshold: float = 0.8
    words: int = 5
    miss: float = 1e-6
    breaks: bytes = bytes(np.flatnonzero(SPACE).tolist())

    def shingle_set(self, raw: bytes) -> set[bytes]:
        """The distinct shingles; of fewer words the whole sequence, of none nothing."""
        words = raw.lower().translate(bytes.maketrans(self.breaks, b" " * len(self.breaks))).split(b" ")
        words = [w for w in words if w]
        return {b" ".join(words[i : i + self.words]) for i in range(max(1, len(words) - self.words + 1))} if words else set()

    @property
    def space(self) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(self.breaks)] = True
        return table


@dataclass
class _Class:
    block: int
    bands: int
    filters: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)


class Index:
    """The signatures of one block of items."""

    def __init__(self, texts: list[bytes], rule: Rule):
        self.rule, self.space, self.texts = rule, rule.space, texts
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words, _, _, first = tokenize(data, at, self.space)
        hashed, of = shingles(words, first, rule.words)
        self.hashes = [np.unique(hashed[a:b]) for a, b in zip(of, of[1:])]
        sizes = np.array([len(x) for x in self.hashes], np.int64)
        by_class: dict[int, list[int]] = {}
        for i, n in enumerate(sizes):
            if n:
                by_class.setdefault(1 << int(n - 1).bit_length(), []).append(i)
        rng = np.random.default_rng(20)
        most = max((self._bands(b) for b in by_class), default=0)
        self.factors = (rng.integers(0, 1 << 31, most, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.masks = rng.integers(0, 1 << 32, most, dtype=np.uint32)
        self.classes = []
        for block, own in sorted(by_class.items()):
            c = _Class(block, self._bands(block))
            joined, starts = np.concatenate([self.hashes[i] for i in own]), np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
            for band in range(c.bands):
                low = np.minimum.reduceat(self._values(joined, band), starts)
                order = np.argsort(low, kind="stable")
                c.values.append(low[order])
                c.items.append(np.array(own)[order])
                table = np.zeros(1 << 16, bool)
                table[low >> np.uint32(16)] = True
                c.filters.append(table)
            self.classes.append(c)

    def _bands(self, block: int) -> int:
        size = block // 2 + 1 if block > 1 else 1
        met = 2 * self.rule.threshold * size / (2 * block + size)
        return math.ceil(-math.log(self.rule.miss) / met)

    def _values(self, hashed: np.ndarray, band: int) -> np.ndarray:
        return ((hashed >> np.uint64(32)).astype(np.uint32) ^ self.masks[band]) * self.factors[band]

    def candidates(self, hashed: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of which a window and the item meet in a band."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(at)
        live = np.flatnonzero(counts)
        if not len(live) or not self.classes:
            return found
        top = (hashed >> np.uint64(32)).astype(np.uint32)
        shapes = []
        for c in self.classes:
            blocks = -(-counts[live] // c.block)
            ends = np.cumsum(blocks)
            firsts = ends - blocks
            within = np.arange(ends[-1]) - np.repeat(firsts, blocks)
            shapes.append((np.repeat(at[live], blocks) + within * c.block, firsts, ends - 1, np.repeat(live, blocks)))
        for band in range(max(c.bands for c in self.classes)):
            values = (top ^ self.masks[band]) * self.factors[band]
            for c, (starts, firsts, lasts, docs) in zip(self.classes, shapes):
                if band >= c.bands:
                    continue
                low = np.minimum.reduceat(values, starts)
                before = np.concatenate([[np.uint32(0xFFFFFFFF)], low[:-1]])
                before[firsts] = 0xFFFFFFFF
                for window, doc in ((np.minimum(low, before), docs), (low[lasts], live)):
                    hit = np.flatnonzero(c.filters[band][window >> np.uint32(16)])
                    if not len(hit):
                        continue
                    lo, hi = (np.searchsorted(c.values[band], window[hit], side) for side in ("left", "right"))
                    for j in np.flatnonzero(hi > lo):
                        found.update((int(doc[hit[j]]), int(i)) for i in c.items[band][lo[j] : hi[j]])
        return found

    def matches(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, shared shingles, the item's shingles, first shared position) of every verified pair."""
        words, starts, ends, first = tokenize(data, at, self.space)
        hashed, of = shingles(words, first, self.rule.words)
        out = []
        for d, i in sorted(self.candidates(hashed, of)):
            own = hashed[of[d] : of[d + 1]]
            places = np.flatnonzero(np.isin(own, self.hashes[i]))
            if len(np.unique(own[places])) < self.rule.threshold * len(self.hashes[i]) - 1e-9:
                continue
            wanted = self.rule.shingle_set(self.texts[i])
            # the first place of each hash decides; others only where hashes collide
            order = np.unique(own[places], return_index=True)[1]
            met: set[bytes] = set()
            for part in (places[order], np.delete(places, order)):
                for lo in range(0, len(part), _PLACES):
                    if len(met) == len(wanted) or lo == 0 and len(met) == len(order):
                        break
                    for p in part[lo : lo + _PLACES]:
                        a = first[d] + p
                        b = min(a + self.rule.words, first[d + 1])
                        met.update(wanted & {b" ".join(LOWER[data[s:e]].tobytes() for s, e in zip(starts[a:b], ends[a:b]))})
            if len(met) >= self.rule.threshold * len(wanted) - 1e-9:
                out.append((d, i, len(met), len(wanted), int(places[0])))
        return out


class Blocks:
    """Blocks of items for the executors: broadcasts of (ids, texts)."""

    def __init__(self, spark, blocks, kind: T.DataType = T.StringType()):
        self.kind, self.name, self.parts = kind, uuid.uuid4().hex, [spark.sparkContext.broadcast((ids, texts)) for ids, texts in blocks]

    def indexes(self, rule: Rule):
        """(ids, Index) of each block in turn."""
        for n, part in enumerate(self.parts):
            key = (self.name, n, rule)
            if key not in _built:
                while len(_built) >= HELD:
                    del _built[next(iter(_built))]
                ids, texts = part.value
                _built[key] = ids, Index(texts, rule)
                if len(self.parts) > HELD:
                    del part._value  # it is read from the broadcast's file again
            yield _built[key]


def _finder(blocks: Blocks, rule: Rule):
    kind = to_arrow_type(blocks.kind)

    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                data, at = text_buffers(group.column(1))
                for ids, index in blocks.indexes(rule):
                    found = index.matches(data, at)
                    rows = group.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    shared, sizes = [f[2] for f in found], [f[3] for f in found]
                    top: dict[tuple[int, int], float] = {}
                    for f in found:
                        top[f[0], f[4]] = max(top.get((f[0], f[4]), 0), f[2] / f[3])
                    yield pa.RecordBatch.from_arrays(
                        [rows, pa.array([ids[f[1]] for f in found], kind), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array([x / n for x, n in zip(shared, sizes)], pa.float64()), pa.array([f[4] for f in found], pa.int64()), pa.array([f[2] / f[3] == top[f[0], f[4]] for f in found], pa.bool_())],
                        ["doc_id", "item", "n_shingles", "n_shared", "containment", "first_word", "best"],
                    )

    return run


def _cleaner(blocks: Blocks, rule: Rule):
    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                data, at = text_buffers(group.column(group.schema.get_field_index("text")))
                keep = np.ones(group.num_rows, bool)
                for _, index in blocks.indexes(rule):
                    keep[[f[0] for f in index.matches(data, at)]] = False
                yield group.filter(pa.array(keep))

    return run


def item_blocks(items: DataFrame) -> Blocks:
    """The blocks of ``items`` (id, text); they are bounded in rows and bytes, and the driver holds one at a time."""
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_TEXT))
    # a null id comes last, and of equal ids the first text
    order = lambda r: (r.id is None, r.id if r.id is not None else 0, r.text or "")

    def rows():
        for b in range(blocks):
            own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
            found = sorted(own.select("id", "text").collect(), key=order)
            yield [r.id for r in found], [(r.text or "").encode() for r in found]

    return Blocks(items.sparkSession, rows(), items.schema["id"].dataType)


def find(docs: DataFrame, blocks: Blocks, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, item, n_shingles, n_shared, containment, first_word, best) of every item in every document.

    ``best``: no other item of its block that the document first shares at that place has a higher
    containment, which tells versions of a text apart.
    """
    kinds = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item", blocks.kind), *(T.StructField(c, T.LongType()) for c in ("n_shingles", "n_shared")), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("best", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(_finder(blocks, rule), kinds)


def without(docs: DataFrame, blocks: Blocks, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    return docs.mapInArrow(_cleaner(blocks, rule), docs.schema)
