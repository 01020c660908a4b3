"""Semantic mask consistency: label flips, component matching and class distribution.

Masks are packed, a row a frame (keys, t, h, w, mask, num_classes): one window brings each frame's
predecessor beside it, and one vectorised function gives all terms of the pair, so that whole frames
move once and pixels never become rows.  Flips and histograms also take long masks (keys, t, y, x,
class_id), by window and aggregate operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.numeric import clamp01

IGNORE = -1
CLIP = ("sample_id", "view")
PARTS = ("lfr", "sac", "cds")


def exploded(masks: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """Packed masks (keys, t, h, w, mask) to a row a pixel."""
    out = masks.select(*keys, "t", "w", F.posexplode("mask").alias("i", "class_id"))
    return out.select(*keys, "t", F.expr("i div w").alias("y"), F.expr("i % w").alias("x"), "class_id")


def valid_pixels(pixels: DataFrame, classes: str, ignore: int = IGNORE) -> DataFrame:
    return pixels.where((F.col("class_id") != ignore) & (F.col("class_id") >= 0) & (F.col("class_id") < F.col(classes)))


def class_counts(pixels: DataFrame, given: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """keys, num_classes: the view's number, else the sample's, else the largest valid class plus one.

    ``given``: sample_id, per_view (map), overall (int).
    """
    found = pixels.where(F.col("class_id") >= 0).groupBy(*keys).agg((F.max("class_id") + 1).alias("_most"))
    clips = pixels.select(*keys).distinct().join(found, list(keys), "left").join(given, "sample_id", "left")
    return clips.select(*keys, F.coalesce(F.try_element_at("per_view", F.col("view")), F.col("overall"), F.col("_most")).cast("int").alias("num_classes"))


def interior(pixels: DataFrame, keys: Sequence[str] = CLIP, up: int = 1, left: int = 1) -> DataFrame:
    """Adds ``inside``: the pixel, its upper, left and upper left neighbours have one class; the border repeats.

    ``up`` and ``left`` are the offsets of the footprint of two by two; 0 takes the pixel itself.
    """
    row = Window.partitionBy(*keys, "t", "y").orderBy("x")
    column = Window.partitionBy(*keys, "t", "x").orderBy("y")
    same = lambda c: F.coalesce(c == F.col("class_id"), F.lit(True))
    out = pixels.withColumn("_l", same(F.lag("class_id", left).over(row)) if left else F.lit(True))
    out = out.withColumn("_u", same(F.lag("class_id", up).over(column)) if up else F.lit(True))
    # the upper left pixel is the left one of the pixel above, or that above where there is no left one
    above = F.coalesce(F.lag("_l", up).over(column), F.lit(True)) if up else F.lit(True)
    return out.withColumn("inside", F.col("_l") & F.col("_u") & above).drop("_l", "_u")


def flip_rates(pixels: DataFrame, keys: Sequence[str] = CLIP, ignore: int = IGNORE, classes: str | None = None) -> DataFrame:
    """keys, lfr: 1 - the mean, over pairs of frames, of the flipped share of pixels inside on both sides."""
    if "mask" in pixels.columns:
        return clip_scores(pixels, keys, ignore, parts=("lfr",)).select(*keys, "lfr")
    rows = interior(pixels, keys)
    if classes:
        rows = rows.withColumn("inside", F.col("inside") & (F.col("class_id") >= 0) & (F.col("class_id") < F.col(classes)))
    w = Window.partitionBy(*keys, "y", "x").orderBy("t")
    rows = rows.withColumn("_c", F.lag("class_id").over(w)).withColumn("_in", F.lag("inside").over(w))
    both = F.col("inside") & F.col("_in") & (F.col("class_id") != ignore) & (F.col("_c") != ignore)
    pairs = rows.groupBy(*keys, "t").agg(F.avg(F.when(both, (F.col("class_id") != F.col("_c")).cast("double"))).alias("flips"))
    return pairs.groupBy(*keys).agg(F.coalesce(clamp01(1 - F.avg("flips")), F.lit(1.0)).alias("lfr"))


def histograms(pixels: DataFrame, num_classes: int, keys: Sequence[str] = CLIP, ignore: int = IGNORE) -> DataFrame:
    """keys, t, class_id, p: smoothed class shares of every frame with a valid pixel, all classes given."""
    valid = valid_pixels(pixels.withColumn("_k", F.lit(num_classes)), "_k", ignore)
    counts = valid.groupBy(*keys, "t").agg(F.count("*").alias("n"), *[F.count_if(F.col("class_id") == c).alias(f"_{c}") for c in range(num_classes)])
    wide = F.array(*[F.struct(F.lit(c).alias("class_id"), ((F.col(f"_{c}") + 1e-8) / (F.col("n") + 1e-8 * num_classes)).alias("p")) for c in range(num_classes)])
    return counts.select(*keys, "t", F.explode(wide).alias("h")).select(*keys, "t", "h.class_id", "h.p")


def distribution_shift(pixels: DataFrame, num_classes: int, keys: Sequence[str] = CLIP, ignore: int = IGNORE) -> DataFrame:
    """keys, cds: 1 - the mean Jensen-Shannon divergence, in nats, of neighbouring frames' histograms; 1 without pairs."""
    if "mask" in pixels.columns:
        return clip_scores(pixels.withColumn("num_classes", F.lit(num_classes)), keys, ignore, parts=("cds",)).select(*keys, "cds")
    frames = pixels.select(*keys, "t").distinct()
    w = Window.partitionBy(*keys).orderBy("t")
    before = frames.withColumn("_prev", F.lag("t").over(w)).where("_prev IS NOT NULL")
    h = histograms(pixels, num_classes, keys, ignore)
    pairs = before.join(h, [*keys, "t"]).join(h.select(*keys, F.col("t").alias("_prev"), "class_id", F.col("p").alias("q")), [*keys, "_prev", "class_id"])
    m = (F.col("p") + F.col("q")) / 2
    term = 0.5 * F.col("p") * F.log(F.col("p") / m) + 0.5 * F.col("q") * F.log(F.col("q") / m)
    per_pair = pairs.groupBy(*keys, "t").agg(F.sum(term).alias("js"))
    scored = per_pair.groupBy(*keys).agg(clamp01(1 - F.avg("js")).alias("cds"))
    return frames.select(*keys).distinct().join(scored, list(keys), "left").select(*keys, F.coalesce("cds", F.lit(1.0)).alias("cds"))


def components(mask: np.ndarray) -> np.ndarray:
    """Components of equal class under 4-neighbourhood, numbered from 1 in row order; negative classes are 0."""
    h, w = mask.shape
    ids = np.arange(h * w).reshape(h, w)
    new = np.ones((h, w), bool)
    new[:, 1:] = mask[:, 1:] != mask[:, :-1]
    root = np.maximum.accumulate(np.where(new, ids, 0).ravel())  # each pixel's run begins there
    below = mask[1:] == mask[:-1]
    a, b = ids[1:][below], ids[:-1][below]
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            break
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not ((up := root[root]) == root).all():
            root = up
    flat = mask.ravel()
    used = np.unique(root[flat >= 0])
    return np.where(flat >= 0, np.searchsorted(used, root) + 1, 0).reshape(h, w)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """An optimal one-to-one matching of the smaller side, by shortest augmenting paths."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[at]:
            done[at] = True
            slack = cost[match[at] - 1] - u[match[at]] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            free = np.where(done[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            delta = free[nxt - 1]
            u[match[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            at = nxt
        while at:
            match[at] = match[back[at]]
            at = back[at]
    return sorted((int(match[c]) - 1, c - 1) for c in range(1, m + 1) if match[c])


class Frame:
    """What the pairs of a frame need of it, each found once and only if asked for."""

    def __init__(self, mask: np.ndarray, classes: int, ignore: int = IGNORE, erosion: int = 2, offset: int | None = None):
        self.mask, self.n, self.erosion = mask, classes, erosion
        self.offset = erosion // 2 if offset is None else offset
        self.valid = (mask != ignore) & (mask >= 0) & (mask < classes)

    @cached_property
    def labels(self) -> np.ndarray:
        """The component of each pixel, from 1; 0 for none."""
        return components(np.where(self.valid, self.mask, -1)).ravel()

    @cached_property
    def areas(self) -> np.ndarray:
        return np.bincount(self.labels, minlength=1)[1:].astype(float)

    @cached_property
    def classes(self) -> np.ndarray:
        """The class of each component."""
        out, own = np.zeros(len(self.areas), np.int64), self.labels > 0
        out[self.labels[own] - 1] = self.mask.ravel()[own]
        return out

    @cached_property
    def inside(self) -> np.ndarray:
        """Where a square footprint, of which ``offset`` rows and columns lie before the pixel, has one class; the border repeats."""
        h, w = self.mask.shape
        wide = np.pad(self.mask, ((self.offset, self.erosion - 1 - self.offset),) * 2, mode="edge")
        out = self.valid.copy()
        for y in range(self.erosion):
            for x in range(self.erosion):
                out &= wide[y : y + h, x : x + w] == self.mask
        return out

    @cached_property
    def shares(self) -> np.ndarray | None:
        """Smoothed shares of the classes; none without a valid pixel."""
        counts = np.bincount(self.mask[self.valid], minlength=self.n)[: self.n].astype(float)
        return (counts + 1e-8) / (counts.sum() + 1e-8 * self.n) if counts.sum() else None

    def overlaps(self, after: "Frame") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of components, from 0, that share pixels, and how many."""
        both, n = (self.labels > 0) & (after.labels > 0), len(after.areas) + 1
        code, count = np.unique(self.labels[both].astype(np.int64) * n + after.labels[both], return_counts=True)
        return code // n - 1, code % n - 1, count

    def matched(self, after: "Frame", min_iou: float) -> tuple[float, float]:
        """(sum of IoU times area, sum of area) over the components; those that vanish or match less than ``min_iou`` count 0."""
        a, b, count = self.overlaps(after)
        score = 0.0
        for c in np.intersect1d(self.classes, after.classes):
            mine, other = np.flatnonzero(self.classes == c), np.flatnonzero(after.classes == c)
            own = (self.classes[a] == c) & (after.classes[b] == c)
            shared = np.zeros((len(mine), len(other)))
            shared[np.searchsorted(mine, a[own]), np.searchsorted(other, b[own])] = count[own]
            iou = shared / (self.areas[mine][:, None] + after.areas[other][None] - shared)
            score += sum(iou[i, k] * self.areas[mine[i]] for i, k in assignment(1 - iou) if iou[i, k] >= min_iou)
        return score, float(self.areas.sum())

    def flips(self, after: "Frame") -> float | None:
        """The share of pixels inside on both sides whose class changes."""
        both = self.inside & after.inside
        return float((self.mask[both] != after.mask[both]).mean()) if both.any() else None

    def shift(self, after: "Frame") -> float | None:
        """Jensen-Shannon divergence of the class shares, in nats."""
        if self.shares is None or after.shares is None:
            return None
        p, q, m = self.shares, after.shares, (self.shares + after.shares) / 2
        return float(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum())


def frame_terms(masks: DataFrame, keys: Sequence[str] = CLIP, ignore: int = IGNORE, min_iou: float = 0.1, erosion: int = 2, offset: int | None = None, parts: Sequence[str] = PARTS) -> DataFrame:
    """keys, t, flips, matched, area, js of every frame with the one before; a term that has no pixels, or isn't among ``parts``, is null."""
    w = Window.partitionBy(*keys).orderBy("t")
    pairs = masks.withColumn("_m", F.lag("mask").over(w)).where("_m IS NOT NULL")

    @F.pandas_udf("struct<flips double, matched double, area double, js double>")
    def terms(before: pd.Series, after: pd.Series, width: pd.Series, classes: pd.Series) -> pd.DataFrame:
        rows, last = [], None
        for x, y, n, k in zip(before, after, width, classes):
            x, y = (np.asarray(m, np.int64).reshape(-1, n) for m in (x, y))
            # a frame is mostly the second of one pair and the first of the next
            one = last[1] if last and last[0] == k and last[1].mask.shape == x.shape and (last[1].mask == x).all() else Frame(x, int(k), ignore, erosion, offset)
            two = Frame(y, int(k), ignore, erosion, offset)
            last = k, two
            matched = one.matched(two, min_iou) if "sac" in parts else (None, None)
            rows.append((one.flips(two) if "lfr" in parts else None, *matched, one.shift(two) if "cds" in parts else None))
        return pd.DataFrame(rows, columns=["flips", "matched", "area", "js"], dtype=object)

    return pairs.select(*keys, "t", terms("_m", "mask", "w", "num_classes").alias("x")).select(*keys, "t", "x.*")


def component_table(masks: DataFrame, keys: Sequence[str] = CLIP, ignore: int = IGNORE) -> DataFrame:
    """keys, t, component, class_id, area of every component of packed masks, numbered from 1 in row order."""

    @F.pandas_udf("array<struct<component int, class_id int, area long>>")
    def found(mask: pd.Series, width: pd.Series, classes: pd.Series) -> pd.Series:
        frames = (Frame(np.asarray(m, np.int64).reshape(-1, n), int(k), ignore) for m, n, k in zip(mask, width, classes))
        return pd.Series([[{"component": i + 1, "class_id": int(c), "area": int(a)} for i, (c, a) in enumerate(zip(f.classes, f.areas))] for f in frames])

    return masks.select(*keys, "t", F.explode(found("mask", "w", "num_classes")).alias("x")).select(*keys, "t", "x.*")


def component_overlaps(masks: DataFrame, keys: Sequence[str] = CLIP, ignore: int = IGNORE) -> DataFrame:
    """keys, t, component, after, shared: pixels that a component of the frame before shares with one of frame t of its class."""
    w = Window.partitionBy(*keys).orderBy("t")

    @F.pandas_udf("array<struct<component int, after int, shared long>>")
    def found(before: pd.Series, after: pd.Series, width: pd.Series, classes: pd.Series) -> pd.Series:
        out = []
        for x, y, n, k in zip(before, after, width, classes):
            one, two = (Frame(np.asarray(m, np.int64).reshape(-1, n), int(k), ignore) for m in (x, y))
            a, b, shared = one.overlaps(two)
            same = one.classes[a] == two.classes[b]
            out.append([{"component": int(i) + 1, "after": int(j) + 1, "shared": int(s)} for i, j, s in zip(a[same], b[same], shared[same])])
        return pd.Series(out)

    pairs = masks.withColumn("_m", F.lag("mask").over(w)).where("_m IS NOT NULL")
    return pairs.select(*keys, "t", F.explode(found("_m", "mask", "w", "num_classes")).alias("x")).select(*keys, "t", "x.*")


def clip_scores(masks: DataFrame, keys: Sequence[str] = CLIP, ignore: int = IGNORE, min_iou: float = 0.1, weights: Sequence[float] = (0.5, 0.4, 0.1), erosion: int = 2, parts: Sequence[str] = PARTS) -> DataFrame:
    """keys, lfr, sac, cds, score of packed masks, all in one pass; a part without pairs is 1.

    lfr: 1 - mean flipped share.  sac: matched IoU weighted by area, where new components don't count.
    cds: 1 - mean divergence.  score: their weighted sum.
    """
    terms = frame_terms(masks, keys, ignore, min_iou, erosion, parts=parts).groupBy(*keys).agg(F.avg("flips").alias("flips"), F.sum("matched").alias("matched"), F.sum("area").alias("area"), F.avg("js").alias("js"))
    out = masks.select(*keys).distinct().join(terms, list(keys), "left")
    one = lambda c: F.coalesce(clamp01(c), F.lit(1.0))
    out = out.select(*keys, one(1 - F.col("flips")).alias("lfr"), F.when(F.col("area") > 0, clamp01(F.col("matched") / (F.col("area") + 1e-8))).otherwise(1.0).alias("sac"), one(1 - F.col("js")).alias("cds"))
    return out.withColumn("score", clamp01(sum((w * F.col(c) for w, c in zip(weights, ("lfr", "sac", "cds"))), F.lit(0.0))))


def area_consistency(masks: DataFrame, keys: Sequence[str] = CLIP, min_iou: float = 0.1) -> DataFrame:
    """keys, sac of packed masks."""
    return clip_scores(masks, keys, min_iou=min_iou, parts=("sac",)).select(*keys, "sac")


def matching_label(clips: DataFrame, ignore: int = IGNORE) -> DataFrame:
    """Clips whose declared ignore label (a view's, else the sample's, else the default) is the configured one."""
    return clips.where(F.coalesce(F.try_element_at("label_per_view", F.col("view")), F.col("label_overall"), F.lit(ignore)) == ignore)


def evaluate(samples: DataFrame, scores: DataFrame, num_classes: DataFrame) -> DataFrame:
    """View -> sample; a view without classes fails the whole sample."""
    bad = num_classes.groupBy("sample_id").agg(F.bool_or(F.col("num_classes") <= 0).alias("bad"))
    per = scores.groupBy("sample_id").agg(F.avg("score").alias("mean"))
    out = samples.select("sample_id").join(bad, "sample_id", "left").join(per, "sample_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    status = F.when(F.col("bad"), "failed").when(F.col("mean").isNotNull(), "success").otherwise("skipped")
    reason = F.when(F.col("bad"), "ValueError: num_classes must be positive").when(F.col("mean").isNull(), "no view could be scored")
    return out.select(F.lit("semantic_consistency").alias("metric"), "sample_id", F.when(~F.col("bad"), F.col("mean")).alias("score"), status.alias("status"), reason.alias("reason"))
