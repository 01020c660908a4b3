"""SimHash near-duplicates by covering-code anchors.

The anchors are the words of a product code of length 64: two binary Golay codes of length 23
(covering radius 3) and six repetition codes of length 3 (covering radius 1).  Every fingerprint has
one home anchor, the one within the covering radius in each part.  It is replicated to every anchor
within that radius plus the threshold, counting over the parts.  Two fingerprints at most
``threshold`` bits apart then meet at the home anchor of either, so comparing replicas with the homes
of each anchor finds every link.  An anchor that is home to more than ``home_limit`` fingerprints is
not compared pairwise: the fingerprints replicated there are linked through the points one bit away,
of which two fingerprints share one if and only if they are at most two bits apart.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import keep, stage, staging, text_buffers, text_groups
from framelens.llm.graph import components

#: Generator polynomial of the binary Golay code, a fixed value.
GOLAY = 0b101011100011
LENGTH, RADIUS, PARITY = 23, 3, 11
REPEATS = 6


def fingerprint(raw: bytes, k: int = 3, seed: int = 42) -> int:
    """SimHash over the k-word shingles of UTF-8 text, repeats included; no words give 0."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    ones, done = np.zeros(64, np.int64), 0
    while done < n:
        part = words[done : done + 65536 + k - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        stops = (ends - 1).tolist()[k - 1 :] if len(part) >= k else [len(line)]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += len(h)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(k, seed):
    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                data, at = text_buffers(group.column(1))
                found = [fingerprint(data[a:b].tobytes(), k, seed) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every document; a null text is empty."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(k, seed), "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        x ^= np.where((x >> bit) & 1, GOLAY << (bit - PARITY), 0)
    return x


class Anchors:
    """For each fingerprint its anchors, as 64-bit code words, by excess over the covering radius."""

    def __init__(self, threshold: int = 2):
        self.threshold = threshold
        patterns = [sum(1 << i for i in c) for w in range(RADIUS + threshold + 1) for c in combinations(range(LENGTH), w)]
        weight = np.array([x.bit_count() for x in patterns])
        patterns = np.array(patterns, np.int64)
        syndrome = _syndrome(patterns)
        #: By excess: for each syndrome its error patterns, padded with -1.
        self.golay = [self._padded(syndrome[own], patterns[own], 1 << PARITY) for e in range(threshold + 1) if (own := (weight <= RADIUS) if e == 0 else weight == RADIUS + e) is not None]
        near: list[list[tuple[int, int]]] = [[] for _ in range(threshold + 1)]
        for uneven in range(1 << REPEATS):
            for flip in range(1 << REPEATS):
                cost = sum((1 if uneven >> i & 1 else 2) for i in range(REPEATS) if flip >> i & 1)
                if cost <= threshold:
                    near[cost].append((uneven, flip))
        #: By excess: for each set of uneven triples the triples to turn.
        self.turns = [self._padded(*(np.array(x, np.int64) for x in zip(*own)), 1 << REPEATS) for own in near]

    @staticmethod
    def _padded(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        count = np.bincount(key, minlength=n)
        out = np.full((n, count.max()), -1, np.int64)
        out[key, np.arange(len(key)) - (np.cumsum(count) - count)[key]] = value
        return out

    def of(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, is_home) for unsigned fingerprints."""
        block = (1 << LENGTH) - 1
        x, y, z = (fp & np.uint64(block)).astype(np.int64), ((fp >> np.uint64(LENGTH)) & np.uint64(block)).astype(np.int64), (fp >> np.uint64(2 * LENGTH)).astype(np.int64)
        sx, sy = _syndrome(x), _syndrome(y)
        major, uneven = np.zeros_like(z), np.zeros_like(z)
        for i in range(REPEATS):
            ones = sum((z >> (3 * i + j)) & 1 for j in range(3))
            major |= (ones >= 2).astype(np.int64) << i
            uneven |= ((ones == 1) | (ones == 2)).astype(np.int64) << i
        rows, anchors, home = [], [], []
        for a in range(self.threshold + 1):
            for b in range(self.threshold + 1 - a):
                for c in range(self.threshold + 1 - a - b):
                    p, q, r = self.golay[a][sx], self.golay[b][sy], self.turns[c][uneven]
                    ok = (p >= 0)[:, :, None, None] & (q >= 0)[:, None, :, None] & (r >= 0)[:, None, None, :]
                    row, i, j, k = np.nonzero(ok)
                    u, v, w = x[row] ^ p[row, i], y[row] ^ q[row, j], major[row] ^ r[row, k]
                    rows.append(row)
                    anchors.append(u.astype(np.uint64) | (v.astype(np.uint64) << np.uint64(LENGTH)) | (w.astype(np.uint64) << np.uint64(2 * LENGTH)))
                    home.append(np.full(len(row), a + b + c == 0))
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def _replicas(threshold, homes):
    def run(batches):
        code = Anchors(0 if homes else threshold)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 1024):
                part = fps[lo : lo + 1024]
                row, anchor, _ = code.of(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[row].view(np.int64))], ["anchor", "fp"])

    return run


def _nearby(batches):
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fps), 8192):
            part = fps[lo : lo + 8192]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, 65).view(np.int64))], ["point", "fp"])


def links(prints: DataFrame, threshold: int = 2, home_limit: int = 256) -> DataFrame:
    """(a, b): links between different fingerprints of ``prints`` (fp), enough to connect all that are near."""
    homes = prints.select("fp").mapInArrow(_replicas(threshold, True), "anchor long, fp long")
    crowded = homes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > home_limit).select("anchor", F.lit(True).alias("crowded"))
    homes = homes.join(crowded, "anchor", "left").where("crowded IS NULL").select("anchor", F.col("fp").alias("home"))
    homes = stage(homes.unionByName(crowded.select("anchor", F.lit(None).cast("long").alias("home"))), "homes")
    guests = prints.select("fp").mapInArrow(_replicas(threshold, False), "anchor long, fp long")
    # not by broadcast: Spark takes the replicas, many a fingerprint, for as small as what they are made of
    met = guests.hint("merge").join(homes, "anchor").where(F.col("home").isNull() | ((F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= threshold) & (F.col("fp") != F.col("home"))))
    met = stage(met.select("fp", "home"), "met")
    direct = met.where("home IS NOT NULL").select(F.col("fp").alias("a"), F.col("home").alias("b"))
    hot = met.where("home IS NULL").select("fp").distinct()
    if threshold > 2:
        raise ValueError("links through single bits hold for thresholds up to 2")
    points = hot.mapInArrow(_nearby, "point long, fp long").groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    through = points.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    if threshold < 2:
        through = through.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return direct.unionByName(through)


def linked(prints: DataFrame, threshold: int = 2, home_limit: int = 256) -> DataFrame:
    """(node, root), staged, for every fingerprint of ``prints`` (fp, all different) that isn't its component's smallest."""
    with staging():
        return keep(stage(components(links(prints, threshold, home_limit)), "roots"))


def _labels(prints: DataFrame, threshold: int, home_limit: int) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``prints`` (doc_id, fp)."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = linked(distinct, threshold, home_limit)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, threshold: int = 2, k: int = 3, seed: int = 42, home_limit: int = 256) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other.  Documents without a
    doc_id are linked too; a component of only such documents has a null component_id.  Repeated rows
    stay; an empty table gives no row.  Other columns of the input are not read.
    """
    prints = stage(fingerprints(docs, k, seed), "prints")
    return prints.join(_labels(prints, threshold, home_limit), "fp").select("doc_id", "fp", "component_id")
