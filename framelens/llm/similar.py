"""Near-duplicates at a Jaccard similarity of word shingles: SimHash by covering-code anchors, then MinHash bands, for candidates, exact sets to decide.

Two texts link when their whole sets of shingles (64-bit hashes) have a similarity of 0.8 or more;
texts of one set are one node.  Candidates are, first, all that op8's operator connects: nodes whose
SimHashes of 64 bits differ in at most two, by the anchors of a covering code, without a miss.  A pair of
similarity 0.8 differs in about ten, where replicas would be too many; so those that share one of 24
bands of four MinHash values are candidates too, which a pair of similarity s misses with a chance of
(1 - s^4)^24 whatever its sizes: 3e-6 for s = 0.8.  A component of SimHashes is one band more.

Longer fingerprints sort out candidates before.  They have 256 bits, the majority of the hashes of a text's
distinct shingles.  Two texts of similarity 0.8 differ in 0.15 of the bits, in small sets in up to
0.19 (four of five shingles shared, 48 +- 6.2 bits), so ``THRESHOLD`` leaves five standard
deviations; 64 of the bits, in turn by band, part the rows of a band before.

Links are decided on whole texts, in two rounds.  First each node is compared with one other, the
smallest node of those bands that it shares with most: groups of copies become stars, at one text a
node.  Then only bands that hold several components are left; in these the rows outside the largest
component are compared with all rows of other components, which loses no link.  Both sides are cut
into blocks, every pair of blocks a group of its own, and a star's rows into tasks of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import keep, ranges, stage, staging, text_buffers, text_groups, unstage
from framelens.llm.graph import components, local_roots
from framelens.llm.simhash import linked
from framelens.llm.tokens import mix, shingles, tokenize

BITS, BANDS, BAND_VALUES = 256, 24, 4
#: Differing bits at which two fingerprints, and 64 bits of them, may belong to texts that link.
THRESHOLD, SKETCH = 80, 22
#: Least similarity of linked sets, as a fraction.
SIMILAR = (4, 5)
#: Rows of a band's key that one task holds; rows, and bytes of text, of a block of a larger group.
RUN_ROWS, BLOCK_ROWS, BLOCK_BYTES = 1 << 18, 4096, 8 << 20
#: Rows of a star that one task compares with its hub, of which each task reads the text.
STAR_ROWS = 512
_PAIRS = 1 << 16
#: Bytes of sets that are held before whole groups are compared, and shingles compared at once.
_HELD, _SLICE = 1 << 24, 1 << 20
_STREAMS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SALTS = mix(np.arange(1, BANDS * BAND_VALUES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FACTORS = mix(_SALTS) | np.uint64(1)


def fingerprint(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set of shingles; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 255 * 32):
        words = mix(hashes[lo : lo + 255 * 32, None] ^ _STREAMS)
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):
            ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def bands(hashes: np.ndarray) -> np.ndarray:
    """The key of each band of a set of shingles: the band's number and 58 bits of its MinHash values; none for no shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * BAND_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[lo : lo + 1024, None] ^ _SALTS) * _FACTORS).min(axis=0), out=least)
    key = np.zeros(BANDS, np.uint64)
    for value in least.reshape(BANDS, BAND_VALUES).T:
        key = mix(key ^ value) + np.uint64(1)
    return np.arange(BANDS, dtype=np.uint64) << np.uint64(58) | key >> np.uint64(6)


def _sets(batch: pa.RecordBatch, column: str, k: int):
    """The sorted distinct shingles of each text."""
    data, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    words, _, _, first = tokenize(data, at)
    found, of = shingles(words, first, k)
    return [np.unique(found[a:b]) for a, b in zip(of, of[1:])]


def _name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _fingerprints(k):
    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                sets = _sets(group, "text", k)
                made = [[f(x) for x in sets] for f in (_name, fingerprint, lambda x: bands(x).tobytes())]
                yield pa.RecordBatch.from_arrays([*group.columns[:4], *(pa.array(x, pa.binary()) for x in made)], [*KEYS, "fp", "print", "bands"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    data, at = text_buffers(column)
    return data[at[0] : at[-1]].copy().view(np.uint64).reshape(len(column), BITS // 64)


def _homes(batches):
    for batch in batches:
        node = batch.column(0).to_numpy(zero_copy_only=False)
        prints = _matrix(batch.column(1)).view(np.int64)
        data, at = text_buffers(batch.column(2))
        keys = data[at[0] : at[-1]].copy().view(np.int64).reshape(len(node), BANDS)
        for t in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (keys[:, t], node, node, prints[:, t % (BITS // 64)])], ["key", "node", "root", "sketch"])


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def _pairs(rows: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Slices of all pairs of each of ``rows`` with its run's rows; ``first`` and ``size`` by row."""
    count, lo = size[rows], 0
    ends = np.cumsum(count)
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
        own = rows[lo:hi]
        yield np.repeat(own, count[lo:hi]), ranges(first[own], count[lo:hi])
        lo = hi


def _meeting(key, node, root, sketch):
    """(key, n, node) of rows with a row of another component near by, n such rows of that key."""
    first, size = _runs(key)
    several = np.repeat(size > 1, size)
    key, node, root, sketch = key[several], node[several], root[several], sketch[several]
    first, size = _runs(key)
    if not len(first):
        return [np.zeros(0, np.int64)] * 3
    by_first, by_size = np.repeat(first, size), np.repeat(size, size)
    near = np.bitwise_count(sketch ^ sketch[by_first]).astype(np.int64) <= SKETCH
    segment, length = _runs(key, root)
    met = np.zeros(len(key), bool)
    if len(segment) == len(key):
        near[first] = np.logical_or.reduceat(near & (np.arange(len(key)) != by_first), first)
        met |= near
        rest = np.flatnonzero(~near)
    else:
        longest = np.maximum.reduceat(length, np.searchsorted(segment, first))
        spared = np.zeros(len(key), bool)
        run_of = np.searchsorted(first, segment, "right") - 1
        at_most = np.flatnonzero(length == longest[run_of])
        chosen = at_most[np.unique(run_of[at_most], return_index=True)[1]]
        spared[ranges(segment[chosen], length[chosen])] = True
        rest = np.flatnonzero(~spared)
    for a, b in _pairs(rest, by_first, by_size):
        hit = (np.bitwise_count(sketch[a] ^ sketch[b]) <= SKETCH) & (root[a] != root[b])
        met[a[hit]] = met[b[hit]] = True
    key, node = key[met], node[met]
    _, size = _runs(key)
    return [key, np.repeat(size, size), node]


def _meetings(batches):
    """Runs of equal keys, whole; of one with over RUN_ROWS rows all rows are given, as -1 many."""
    names = ["key", "n", "node"]
    held, wide = np.zeros((4, 0), np.int64), None
    for batch in batches:
        held = np.concatenate([held, np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        if not held.shape[1]:
            continue
        if wide is not None:
            cut = int(np.searchsorted(held[0], wide, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(held[0, :cut]), pa.array(np.full(cut, -1)), pa.array(held[1, :cut])], names)
            wide, held = wide if cut == held.shape[1] else None, held[:, cut:]
            if not held.shape[1]:
                continue
        cut = int(np.searchsorted(held[0], held[0, -1]))
        if cut > RUN_ROWS // 4:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _meeting(*held[:, :cut])], names)
            held = held[:, cut:]
        elif held.shape[1] - cut > RUN_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _meeting(*held[:, :cut])], names)
            wide = int(held[0, -1])
            yield pa.RecordBatch.from_arrays([pa.array(held[0, cut:]), pa.array(np.full(held.shape[1] - cut, -1)), pa.array(held[1, cut:])], names)
            held = held[:, :0]
    if held.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _meeting(*held)], names)


def _alike(values: np.ndarray, at: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Which of the sets ``others`` have the similarity with set x; set i is values[at[i]:at[i + 1]], sorted."""
    own, size = values[at[x] : at[x + 1]], np.diff(at)
    shared = np.zeros(len(others), np.int64)
    ends, lo = np.cumsum(size[others]), 0
    while lo < len(others) and len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _SLICE, "right")))
        part = others[lo:hi]
        found = values[ranges(at[part], size[part])]
        hit = own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
        shared[lo:hi] = np.bincount(np.repeat(np.arange(len(part)), size[part]), hit, len(part))
        lo = hi
    p, q = SIMILAR
    return (p + q) * shared >= p * (len(own) + size[others])


def _linked(threshold, pair, key, node, prints, root=None, values=None, at=None):
    """Links (a, b), b the smallest node, that connect what is near in each run of (key, pair).

    Near are fingerprints with ``threshold`` differing bits at most, whose sets, where given, have the similarity.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size, (p, q) = None if at is None else np.diff(at), SIMILAR
    for lo, n in zip(*_runs(key, pair)):
        label = (node if root is None else root)[lo : lo + n].copy()
        for x in range(n):
            if x and label[x] == label[0]:
                continue  # others come to it
            other = lo + np.flatnonzero(label != label[x])
            if size is not None:
                other = other[q * np.minimum(size[other], size[lo + x]) >= p * np.maximum(size[other], size[lo + x])]
            other = other[np.bitwise_count(prints[other] ^ prints[lo + x]).sum(axis=1, dtype=np.int64) <= threshold]
            if size is not None:
                other = other[_alike(values, at, lo + x, other)]
            if len(other):
                left.append(node[other])
                right.append(np.full(len(other), node[lo + x]))
                label[np.isin(label, label[other - lo])] = label[x]
    found, roots = local_roots(np.concatenate(left), np.concatenate(right))
    keep = found != roots
    return pa.RecordBatch.from_arrays([pa.array(found[keep]), pa.array(roots[keep])], ["a", "b"])


def _links(threshold, k):
    def linked(held):
        key, pair, node, root, prints, sizes, values = held
        return _linked(threshold, pair, key, node, prints, root, values, np.concatenate([[0], np.cumsum(sizes)]))

    def run(batches):
        held = None
        for batch in batches:
            for group in text_groups(batch):
                sets = _sets(group, "text", k)
                now = [*(group.column(i).to_numpy(zero_copy_only=False) for i in range(4)), _matrix(group.column(4)), np.array([len(x) for x in sets], np.int64), np.concatenate(sets)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                cut = int(_runs(held[0], held[1])[0][-1]) if len(held[0]) else 0
                if cut > BLOCK_ROWS or cut and held[6].nbytes > _HELD:
                    end = int(held[5][:cut].sum())
                    yield linked([*(x[:cut] for x in held[:6]), held[6][:end]])
                    held = [*(x[cut:] for x in held[:6]), held[6][end:]]
        if held is not None and len(held[0]):
            yield linked(held)

    return run


def _stars(k):
    """Rows come by hub and part, each part led by the hub's own text: links of the others with it."""

    def run(batches):
        own, hub, (p, q) = None, None, SIMILAR
        for batch in batches:
            for group in text_groups(batch):
                found = []
                for at, node, mine in zip(group.column(0).to_pylist(), group.column(1).to_pylist(), _sets(group, "text", k)):
                    if node == at:
                        hub, own = at, mine
                    elif q * min(len(own), len(mine)) >= p * max(len(own), len(mine)):
                        shared = len(own) + len(mine) - len(np.union1d(own, mine))
                        if (p + q) * shared >= p * (len(own) + len(mine)):
                            found.append((node, hub))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def meetings(nodes: DataFrame) -> DataFrame:
    """(key, n, node): the rows of bands where nodes of ``nodes`` (node, print, bands) meet near ones."""
    homes = nodes.where(F.length("bands") > 0).select("node", "print", "bands").mapInArrow(_homes, "key long, node long, root long, sketch long")
    return homes.repartition("key").sortWithinPartitions("key", "root").mapInArrow(_meetings, "key long, n long, node long")


def _simhashes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(_matrix(batch.column(1))[:, 0]).view(np.int64))], ["node", "fp"])


def anchored(nodes: DataFrame) -> DataFrame:
    """(key, node), staged: of ``nodes`` (node, print, bands) all whose SimHash, the first 64 bits, is that of another or linked with one."""
    with staging():
        prints = stage(nodes.where(F.length("bands") > 0).select("node", "print").mapInArrow(_simhashes, "node long, fp long"), "simhashes")
        roots = linked(stage(prints.select("fp").distinct(), "distinct")).withColumnRenamed("node", "a")
        root = F.coalesce("root", "fp")
        key = F.lit(BANDS << 58).bitwiseOR(F.shiftrightunsigned(F.xxhash64(root), 6)).alias("key")
        own = stage(prints.join(roots, F.col("fp") == F.col("a"), "left").select(key, "node"), "classes")
        several = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        return keep(stage(own.join(several, "key"), "anchored"))


def stars(met: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """(a, b): links between each node of ``met`` (key, node) and the smallest node of those keys that it shares with most."""
    hubs = met.groupBy("key").agg(F.min("node").alias("hub"))
    pairs = met.select("key", "node").join(hubs, "key").where("hub < node").groupBy("node", "hub").count()
    pairs = pairs.groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("hub"))).alias("x")).select("node", (-F.col("x.hub")).alias("hub"))
    pairs = stage(pairs.join(texts.select("node", F.octet_length("text").alias("size")), "node"), "pairs")
    wide = pairs.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / STAR_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("parts"))
    wide = stage(wide, "hubs")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    members = pairs.join(wide, "hub").select("hub", part, "node")
    leaders = wide.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
    rows = members.unionByName(leaders).join(texts.select("node", "text"), "node").withColumn("last", F.col("node") != F.col("hub"))
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "last").select("hub", "node", "text")
    out = stage(rows.mapInArrow(_stars(k), "a long, b long"), "stars")
    unstage(pairs, wide)
    return out


def links(met: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, k: int = 5) -> DataFrame:
    """(a, b): links between nodes of ``met`` (key, node, root) with different roots, enough to connect all that ``texts`` (node, print, text) show to be near."""
    known = stage(met.join(texts.select("node", F.octet_length("text").alias("size")), "node"), "known")
    # of each key the component with most rows; only the others are compared with all
    by_root = known.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", (-F.col("root")).alias("root"), "size")).alias("most")
    keys = by_root.groupBy("key").agg(most, F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    keys = keys.select("key", (-F.col("most.root")).alias("most"), blocks(F.col("most.n"), F.col("most.size")).alias("wide"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("narrow"))
    rows = known.join(keys, "key").withColumn("other", F.col("root") != F.col("most"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("narrow")).otherwise(F.col("wide"))).cast("long")
    rows = rows.withColumn("own", own)
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1)
    cell = lambda kind, x, y: F.lit(kind).cast("long") * (1 << 62) + x * (1 << 31) + y
    mine = F.transform(upto("narrow"), lambda o: cell(0, F.col("own"), o))
    all_of_most = F.transform(upto("wide"), lambda m: cell(0, m, F.col("own")))
    among = F.transform(F.filter(upto("narrow"), lambda o: o != F.col("own")), lambda o: cell(1, F.least(F.col("own"), o), F.greatest(F.col("own"), o)))
    rows = rows.select("key", F.explode(F.when(F.col("other"), F.concat(all_of_most, among)).otherwise(mine)).alias("pair"), "node", "root", "other")
    rows = rows.join(texts, "node").select("key", "pair", "node", "root", "print", "text", "other")
    out = stage(rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "other").drop("other").mapInArrow(_links(threshold, k), "a long, b long"), "links")
    unstage(known)
    return out


def _row_keys(docs: DataFrame) -> list:
    """What tells rows apart: doc_id, and 96 bits of the text's hashes."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), F.hash(text).alias("g")]


KEYS = ["no_id", "id", "h", "g"]


def labels(docs: DataFrame, prints: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """(root, and KEYS of a row) for every set of ``prints`` (KEYS, fp, print, bands), made of ``docs``: those with one root are connected."""
    nodes = prints.groupBy("fp").agg(F.min(F.struct(*KEYS)).alias("of"), F.any_value("print").alias("print"), F.any_value("bands").alias("bands"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = anchored(nodes)
    met = stage(meetings(nodes).select("key", "node").unionByName(near), "met")
    unstage(near)
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "print", "of.*")
    texts = docs.select(*_row_keys(docs), F.coalesce("text", F.lit("")).alias("text")).join(wanted, KEYS)
    texts = stage(texts.select("node", "print", "text").dropDuplicates(["node"]), "texts")
    first = stars(met, texts, k)
    found = components(first)
    now = met.join(found.select(F.col("node").alias("a"), "root"), F.col("node") == F.col("a"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    more = links(now, texts, threshold, k)
    if not more.isEmpty():
        found = components(first.unionByName(more))
    out = nodes.select("node", "of").join(found.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left").select(F.coalesce("root", "node").alias("root"), "of.*")
    out = stage(out, "labels")
    unstage(nodes, met, texts, first, more)
    return out


def representatives(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs``, all columns, of each component: that with the smallest doc_id, a null last.

    Words are runs outside white space with A-Z lower-cased; a text of fewer than k words is one
    shingle.  Null texts and those without words are copies of each other.  Of different texts with
    that doc_id the one with the smallest hash stays, and of rows that repeat both the first by the
    other columns; an empty table gives no row.
    """
    prints = docs.select(*_row_keys(docs), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_fingerprints(k), "no_id boolean, id long, h long, g int, fp binary, print binary, bands binary")
    prints = stage(prints, "prints")
    own = labels(docs, prints, k, threshold)
    won = stage(own.groupBy("root").agg(F.min(F.struct(*KEYS)).alias("x")).select("x.*"), "won")
    unstage(prints, own)
    rows = docs.select(*_row_keys(docs), F.struct(*docs.columns).alias("row")).join(won, KEYS, "left_semi")
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.to_json(F.struct(*(F.col("row")[c] for c in docs.columns if c != "text")))))
    return rows.withColumn("n", first).where("n = 1").select("row.*")
