"""Substring dedup with difference-cover suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus.
Such strings are called windows.  Sorting every suffix of the corpus moves dozens of bytes for each
byte of text, so the suffixes are first parted by content: each window has an anchor, the smallest hash
among its ``gram``-byte strings.  Equal windows have equal anchors at equal places, so windows of an
anchor that occurs once need no sorting, and those of different anchors never need comparing.

Neighbouring windows with one anchor form a run, and its bytes a segment.  If a segment occurs twice,
all its windows do.  What is left are anchors with different segments, at the ends of repeated
passages: the distinct segments of some anchors at a time are joined to one text, whose suffix array
is built by the difference cover modulo 3 (sort the sampled triples, recurse on their names, merge the
remaining suffixes); windows that are repeated are neighbours there with an equal prefix.  An anchor
with more distinct segments than one such text may hold is parted further first, by the bytes that
neighbouring windows share, so that no group grows with a passage's copies.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import ranges, stage, text_buffers, text_groups, unstage
from framelens.llm.tokens import mix, powers

LENGTH, GRAM = 200, 40
#: Windows of a longer text are taken in slices of so many.
SLICE = 1 << 20
#: Bytes of segments that are sorted at once, and most distinct segments of an anchor for that.
SORT_BYTES, SORT_SEGMENTS = 1 << 20, 2500


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers, by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    top = int(s.max()) + 2
    t = np.zeros(n + 4, np.int64)
    t[:n] = s + 1
    bits = max(top, n + 2).bit_length()
    if 3 * bits > 63:
        raise ValueError("the text is too long to sort at once")
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
    if names.max() + 1 < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << bits) | rank[zero + 1], kind="stable")]
    of_one, of_two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((t[of_one] << bits) | rank[of_one + 1], (t[zero] << bits) | rank[zero + 1])
    wide = lambda i: (t[i] << (2 * bits)) | (t[i + 1] << bits) | rank[i + 2]
    before = before + np.searchsorted(wide(of_two), wide(zero))
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zero)) + before] = zero
    out[out < 0] = sampled
    return out


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the offsets of its windows that also start elsewhere in the segments."""
    sizes = np.array([len(x) for x in segments], np.int64)
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    windows = np.maximum(sizes - length + 1, 0)
    starts = np.zeros(len(text), bool)
    starts[ranges(at[:-1], windows)] = True
    order = suffix_array(text.astype(np.int64))
    order = order[starts[order]]
    a, b = order[:-1], order[1:]
    alike = np.arange(len(a))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    packed = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for lo in [*range(0, length - 7, 8), *([length - 8] if length >= 8 else [])]:
        if not len(alike):
            break
        same = (packed[a[alike] + lo] == packed[b[alike] + lo]).all(axis=1)
        alike = alike[same]
    for lo in range(length if length < 8 else 0):
        alike = alike[text[a[alike] + lo] == text[b[alike] + lo]]
    twice = np.zeros(len(text), bool)
    twice[a[alike]] = twice[b[alike]] = True
    return [np.flatnonzero(twice[p : p + w]) for p, w in zip(at[:-1], windows)]


def spans(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs [from, to) that the windows at sorted ``offsets`` cover."""
    if not len(offsets):
        return offsets, offsets
    cut = np.flatnonzero(offsets[1:] > offsets[:-1] + length)
    return offsets[np.concatenate([[0], cut + 1])], offsets[np.concatenate([cut, [len(offsets) - 1]])] + length


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor, segment hash, document, first window, number of windows and the first one's distance to the anchor of every run."""
    found = []
    for lo, hi, d in _slices(at, length):
        base, x = int(at[lo]) if d < 0 else lo, data[int(at[lo]) : int(at[hi])] if d < 0 else data[lo:hi]
        n, width = len(x), length - gram + 1
        if n < length:
            continue
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        low = (grams >> np.uint64(21) << np.uint64(21)) | np.arange(len(grams), dtype=np.uint64)
        padded = np.full(-(-len(low) // width) * width, np.iinfo(np.uint64).max)
        padded[: len(low)] = low
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = np.minimum(behind[: n - length + 1], ahead[width - 1 : n - gram + 1]) & np.uint64((1 << 21) - 1)
        if d < 0:
            ends = at[lo + 1 : hi + 1] - base
            own = np.maximum(np.diff(at[lo : hi + 1]) - length + 1, 0)
            place = ranges(ends - np.diff(at[lo : hi + 1]), own)
            doc = np.repeat(np.arange(lo, hi), own)
        else:
            place, doc = np.arange(n - length + 1), np.full(n - length + 1, d)
        if not len(place):
            continue
        anchor = anchor[place].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.append(first, len(place)))
        s = place[first]
        e = s + count - 1 + length
        segment = mix((total[e] - total[s]) * down[s] + mix((e - s).astype(np.uint64)))
        doc = doc[first]
        found.append((grams[anchor[first]], segment, doc, s + base - at[doc], count, anchor[first] - s))
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(list(zip(*found)) or [()] * 6, kinds))


def _slices(at: np.ndarray, length: int):
    """(first, last, -1) of documents that are taken together, or (from, to, document) of a slice of one."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        if at[hi] - at[lo] <= SLICE:
            yield lo, hi, -1
        else:
            for a in range(int(at[lo]), int(at[hi]) - length + 1, SLICE):
                yield a, min(a + SLICE + length - 1, int(at[hi])), lo
        lo = hi


_RUN = "anchor long, segment long, id long, print long, start int, windows int, lead int"


def _runs(length, gram):
    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                h, seg, doc, start, count, lead = runs(*text_buffers(group.column(2)), length, gram)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), group.column(0).take(doc), group.column(1).take(doc), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32))], ["anchor", "segment", "id", "print", "start", "windows", "lead"])

    return run


def _cutter(length):
    """Segments' bytes out of texts: columns text, anchors, segments, starts, windows, leads (lists)."""

    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                data, at = text_buffers(group.column(0))
                a, s, p, w, lead = (c.flatten().to_numpy(zero_copy_only=False) for c in group.columns[1:6])
                per = np.array([len(x) for x in group.column(1)])
                begin = np.repeat(at[:-1], per) + p
                raw = [data[x : x + n].tobytes() for x, n in zip(begin, w + length - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), pa.array(lead), pa.array(raw, pa.binary())], ["anchor", "segment", "lead", "bytes"])

    return run


def _found(keys, offsets, length):
    keep = [i for i, o in enumerate(offsets) if len(o)]
    cut = [spans(offsets[i], length) for i in keep]
    return pa.RecordBatch.from_arrays([pa.array([keys[i][0] for i in keep], pa.int64()), pa.array([keys[i][1] for i in keep], pa.int64()), pa.array([c[0].tolist() for c in cut], pa.list_(pa.int32())), pa.array([c[1].tolist() for c in cut], pa.list_(pa.int32()))], ["anchor", "segment", "froms", "tos"])


_FOUND = "anchor long, segment long, froms array<int>, tos array<int>"


def _sorter(length):
    """Rows come sorted by anchor; whole anchors are gathered to texts of bounded size."""

    def run(batches):
        keys, texts, size, last = [], [], 0, None
        for batch in batches:
            for a, s, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last and size >= SORT_BYTES // 2:
                    yield _found(keys, repeated_windows(texts, length), length)
                    keys, texts, size = [], [], 0
                last = a
                keys.append((a, s))
                texts.append(raw)
                size += len(raw)
        if keys:
            yield _found(keys, repeated_windows(texts, length), length)

    return run


def _class_bytes(raw: bytes, lead: int, c: int, length: int, width: int) -> tuple[bytes, bytes, int]:
    """Core, own bytes and first lead of the windows of a piece whose distance to the anchor is in class ``c``."""
    far = min(lead, (c + 1) * width - 1)
    near = max(lead - (len(raw) - length), c * width)
    return raw[lead - c * width : lead + length + 1 - (c + 1) * width], raw[lead - far : lead - near + length], far


def _splitter(length, width):
    """Parts a piece's windows by their distance to the anchor, ``width`` distances to a class; hashes only.

    All windows of a class hold its core, so windows can be equal only where class and core are.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, segment, lead, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for c in range((lead - (len(raw) - length)) // width, lead // width + 1):
                    core, own, far = _class_bytes(raw, lead, c, length, width)
                    digest = hashlib.blake2b(core + struct.pack("<qq", key, c), digest_size=8).digest()
                    own = hashlib.blake2b(own + struct.pack("<q", far), digest_size=8).digest()
                    rows.append((key, segment, c, lead - far, len(raw) - length, *struct.unpack("<q", digest), *struct.unpack("<q", own), far))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["of", "of_segment", "class", "base", "last", "anchor", "segment", "lead"])

    return run


def _parter(length, width):
    """The bytes of the classes asked for: columns lead, bytes, then lists of class, anchor, segment."""

    def run(batches):
        for batch in batches:
            rows = []
            for lead, raw, classes, anchors, segments in zip(*(c.to_pylist() for c in batch.columns)):
                for c, a, s in zip(classes, anchors, segments):
                    _, own, far = _class_bytes(raw, lead, c, length, width)
                    rows.append((a, s, far, own))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["anchor", "segment", "lead", "bytes"])

    return run


_SPLIT = "of long, of_segment long, class int, base int, last int, anchor long, segment long, lead int"


def _repeated(pieces: DataFrame, crowded: DataFrame, length: int, width: int, most: int) -> DataFrame:
    """(anchor, segment, froms, tos): windows that repeat among the different pieces of an anchor.

    ``pieces`` (staged): anchor, segment, lead, bytes; ``crowded``: the anchors with more than
    ``most`` of them, which are parted further until the pieces are single windows.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = pieces.join(crowded, "anchor", "left_anti")
    found = few.select("anchor", "segment", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "segment").mapInArrow(_sorter(length), _FOUND)
    found = stage(found, "found")
    if width == 1 or crowded.isEmpty():
        return found
    width = -(-width // 8)
    hot = pieces.join(crowded, "anchor", "left_semi")
    split = stage(hot.select("anchor", "segment", "lead", "bytes").mapInArrow(_splitter(length, width), _SPLIT), "split")
    unlike = stage(split.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("of", "of_segment", "class")).alias("at")), "unlike")
    per_core = stage(unlike.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "cores")
    live = unlike.join(per_core.select("anchor"), "anchor", "left_semi")
    asked = live.groupBy(F.col("at.of").alias("of"), F.col("at.of_segment").alias("of_segment")).agg(F.collect_list(F.struct(F.col("at.class").alias("class"), "anchor", "segment")).alias("x"))
    cut = hot.withColumnsRenamed({"anchor": "of", "segment": "of_segment"}).join(asked, ["of", "of_segment"])
    cut = cut.select("lead", "bytes", *(F.col(f"x.{c}").alias(c) for c in ("class", "anchor", "segment")))
    cut = stage(cut.mapInArrow(_parter(length, width), "anchor long, segment long, lead int, bytes binary"), "cut")
    inner = _repeated(cut, per_core.where(F.col("kinds") > most).select("anchor"), length, width, most)
    unstage(cut)
    met = split.join(unlike.select("anchor", "segment", "n"), ["anchor", "segment"]).join(inner, ["anchor", "segment"], "left")
    # all windows of a class whose own bytes occur twice repeat
    near = F.greatest(F.col("lead") + F.col("base") - F.col("last"), F.col("class") * width)
    whole = F.col("n") > 1
    met = met.where(whole | F.col("froms").isNotNull()).select("of", "of_segment", "base", F.when(whole, F.array(F.lit(0))).otherwise(F.col("froms")).alias("froms"), F.when(whole, F.array((F.col("lead") - near + length).cast("int"))).otherwise(F.col("tos")).alias("tos"))
    moved = met.select("of", "of_segment", *(F.transform(c, lambda o: o + F.col("base")).alias(c) for c in ("froms", "tos")))
    moved = moved.groupBy("of", "of_segment").agg(F.flatten(F.collect_list("froms")).alias("froms"), F.flatten(F.collect_list("tos")).alias("tos"))
    out = stage(found.unionByName(moved.select(F.col("of").alias("anchor"), F.col("of_segment").alias("segment"), "froms", "tos")), "found")
    unstage(found, split, unlike, per_core, inner)
    return out


def _keeper(length):
    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                data, at = text_buffers(group.column(1))
                rows = []
                for i, (froms, tos) in enumerate(zip(group.column(2).to_pylist(), group.column(3).to_pylist())):
                    raw = data[at[i] : at[i + 1]]
                    change = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(change, np.array(froms or [], np.int64), 1)
                    np.add.at(change, np.array(tos or [], np.int64), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    rows.append((len(raw), int(gone.sum()), edge[::2].tolist(), edge[1::2].tolist(), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
                n, gone, froms, tos, digest = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(froms, pa.list_(pa.int32())), pa.array(tos, pa.list_(pa.int32())), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "froms", "tos", "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sort_segments: int = SORT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, froms, tos (maximal removed runs), kept_sha256 of every row of ``docs``.

    A null text is empty; texts shorter than ``length`` keep all.  Repeated rows are copies of each
    other like any equal texts, so all of them lose their bytes.  A null doc_id stays null.  An empty
    table gives no row.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("print"), text.alias("text"))
    met = keyed.mapInArrow(_runs(length, gram), _RUN)
    anchors = met.groupBy("anchor").agg(F.count("*").alias("n"), F.min("segment").alias("a"), F.max("segment").alias("b")).where("n > 1")
    anchors = stage(anchors.select("anchor", (F.col("a") == F.col("b")).alias("alike")), "anchors")
    met = stage(met.join(anchors, "anchor"), "met")
    unstage(anchors)
    segments = met.where("NOT alike").groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("id", "print", "start", "windows", "lead")).alias("at"))
    segments = stage(segments, "segments")
    crowded = stage(segments.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > sort_segments).select("anchor"), "crowded")
    asked = segments.groupBy("at.id", "at.print").agg(F.collect_list(F.struct("anchor", "segment", "at.start", "at.windows", "at.lead")).alias("x"))
    of = lambda c: F.col(f"x.{c}").alias(c)
    pieces = keyed.join(asked, ["id", "print"]).select("text", of("anchor"), of("segment"), of("start"), of("windows"), of("lead"))
    # rows that repeat both id and text cut each piece twice
    pieces = pieces.mapInArrow(_cutter(length), "anchor long, segment long, lead int, bytes binary").dropDuplicates(["anchor", "segment"])
    pieces = stage(pieces, "pieces")
    found = _repeated(pieces, crowded, length, length - gram + 1, sort_segments)
    unstage(pieces, crowded)
    whole = segments.where("n > 1").select("anchor", "segment", F.lit(True).alias("whole"))
    known = found.join(whole, ["anchor", "segment"], "full_outer")
    fine = met.where("NOT alike").join(known, ["anchor", "segment"])
    all_of = F.array((F.lit(0)).cast("int")), F.array((F.col("windows") + (length - 1)).cast("int"))
    fine = fine.select("id", "print", "start", F.when(F.col("whole"), all_of[0]).otherwise(F.col("froms")).alias("froms"), F.when(F.col("whole"), all_of[1]).otherwise(F.col("tos")).alias("tos"))
    alike = met.where("alike").select("id", "print", "start", all_of[0].alias("froms"), all_of[1].alias("tos"))
    cover = alike.unionByName(fine).select("id", "print", *(F.transform(c, lambda o: o + F.col("start")).alias(c) for c in ("froms", "tos")))
    cover = stage(cover.groupBy("id", "print").agg(F.flatten(F.collect_list("froms")).alias("froms"), F.flatten(F.collect_list("tos")).alias("tos")), "cover")
    unstage(met, segments, found)
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("print"), text.alias("text"), F.col("doc_id").isNull().alias("none"))
    out = texts.join(cover, ["id", "print"], "left").select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "text", "froms", "tos")
    return out.mapInArrow(_keeper(length), "doc_id long, n_bytes long, n_removed long, froms array<int>, tos array<int>, kept_sha256 string")
