"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import json
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from framelens.llm import common, containment, decontam, exact_dedup, graph, licenses, lm, mixing, quality, sharding, similar, simhash, suffix, tokens, wrappers
from framelens.llm import queries as llm_queries
from framelens.llm.mixing import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, stats string, row string, shard string, target string, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows):
    """Rows of (doc_id, text, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, "x", "y", "z", "s", "t", "f") for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [(i, prose(rng, int(rng.integers(1, 120))), f"s{i % 4}") for i in range(80)]
    passage = prose(rng, 60)
    out += [(100 + i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}", "s0") for i in range(20)]
    out += [(200 + i, out[3][1] if i % 2 else out[3][1].upper(), "s1") for i in range(12)]
    out += [(300, None, None), (301, "", "s2"), (302, " \t\n\x0b", "é"), (None, "no id", "s0"), (None, None, None), (303, "É ÀB " * 30, "\U0001f600")]
    out += [(400, "twice " * 90, "s3"), (400, "twice " * 90, "s3"), (401, "x" * 5000, "s3"), (402, prose(rng, 30_000), "s0")]
    return out


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]


def test_tokenize_agrees_with_split(rows, monkeypatch):
    monkeypatch.setattr(tokens, "_PIECE", 100)
    texts = [(t or "").encode() for _, t, _ in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h, s, e, first = tokens.tokenize(data, at)
    found = [data[a:b].tobytes().lower() for a, b in zip(s, e)]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [t.lower().split() for t in texts]
    assert len(set(h.tolist())) == len(set(found)) == len(set(zip(h.tolist(), found)))
    shingled, of = tokens.shingles(h, first, 5)
    brute = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in (t.lower().split() for t in texts)]
    assert np.diff(of).tolist() == [len(x) for x in brute]
    flat = [y for x in brute for y in x]
    assert len(set(shingled.tolist())) == len(set(flat)) == len(set(zip(shingled.tolist(), flat)))


def test_components_of_random_links(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for l in links for x in l}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# exact dedup


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27, 0])
def test_exact_dedup(spark, rows, bits, monkeypatch):
    if not bits:  # several classes, each with a filter
        monkeypatch.setattr(exact_dedup, "FEWEST", 1000)
    out = exact_dedup.exact_duplicates(frame(spark, rows), bits).collect()
    norm = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            expected[(i, keep, len(ids), i == keep and not kept, hashlib.sha256(text.encode()).hexdigest())] += 1
            kept = kept or i == keep
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in out) == expected
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


# SimHash


def fingerprint(text):
    w = words_of(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("limit", [0, 256])
def test_simhash(spark, rows, limit):
    rng = np.random.default_rng(3)
    base = prose(rng, 400)
    near = rows + [(500 + i, base.replace(" ", "  ") + f" {WORDS[i]} {WORDS[i]}", "s0") for i in range(15)]
    out = simhash.near_duplicates(frame(spark, near), home_limit=limit).collect()
    prints = [fingerprint(t) for _, t, _ in near]
    root = components_of(prints)
    least = {}
    for (i, _, _), p in zip(near, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    expected = Counter((i, p, least.get(root[p])) for (i, _, _), p in zip(near, prints))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == expected
    assert len(set(root.values())) < len(root)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_every_near_pair_meets_at_a_home_anchor():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    _, home, _ = simhash.Anchors(0).of(a)
    row, anchor, is_home = simhash.Anchors(2).of(b)
    for i in range(300):
        own = anchor[row == i]
        assert home[i] in own and len(set(own.tolist())) == len(own) and is_home[row == i].sum() == 1


def test_replicas_are_not_broadcast(spark, rows, monkeypatch):
    plans = {}

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.stage(df, name)

    monkeypatch.setattr(simhash, "stage", staged)
    simhash.near_duplicates(frame(spark, rows))
    assert "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]


def shingle_set(text, k=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_texts(spark, rows):
    rng = np.random.default_rng(11)
    near = [r for r in rows if len(r[1] or "") < 100_000]
    for i in range(40):
        w = prose(rng, 400).split()
        near.append((1000 + 10 * i, " ".join(w), "s0"))
        for j in range(1, 4):
            edits = w.copy()
            for at in rng.choice(len(w), 2 * j * (1 + i % 8), replace=False):
                edits[at] = f"edit{at}"
            near.append((1000 + 10 * i + j, " ".join(edits), "s1"))
    kept = similar.representatives(frame(spark, near))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    found = kept.collect()
    sets = [shingle_set(r.text) for r in found]
    far = [(a, b) for a in range(len(sets)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.85]
    assert not far
    own = [(r.doc_id, s) for r, s in zip(found, sets)]
    gone = list((Counter(i for i, _, _ in near) - Counter(r.doc_id for r in found)).elements())
    texts = [(i, shingle_set(t)) for i, t, _ in near]
    for doc in gone:
        mine = [s for i, s in texts if i == doc]
        assert any(similarity(m, s) >= 0.7 for m in mine for i, s in texts if i != doc) or len(mine) > 1
    ids = {i for i, _ in own}
    assert {1000 + 10 * i for i in range(40)} | {3, 300, 400} <= ids and not ids & {*range(201, 212), 301, 302}
    assert sum((i or 0) >= 1000 for i in ids) > 60 and similar.representatives(frame(spark, [])).count() == 0


def test_meetings_are_what_brute_force_finds(monkeypatch):
    rng = np.random.default_rng(12)
    for several in (False, True):
        n = 600
        key = np.sort(rng.integers(0, 40, n))
        root = rng.integers(0, 60, n) if several else rng.permutation(n)
        order = np.lexsort((root, key))
        root, node = root[order], np.arange(n)
        base = rng.integers(-(1 << 62), 1 << 62, 25)
        sketch = base[rng.integers(0, 25, n)] ^ (1 << rng.integers(0, 62, n)) ^ (rng.integers(-(1 << 62), 1 << 62, n) * (rng.random(n) < 0.3))
        near = (np.bitwise_count(sketch[:, None] ^ sketch) <= similar.SKETCH) & (key[:, None] == key) & (root[:, None] != root)
        monkeypatch.setattr(similar, "_PAIRS", 50)
        k, count, found = similar._meeting(key, node, root, sketch)
        assert set(found.tolist()) == set(np.flatnonzero(near.any(axis=1)).tolist()) and len(found) == len(set(found.tolist()))
        assert dict(zip(k.tolist(), count.tolist())) == Counter(key[found].tolist())


@pytest.mark.parametrize("most", [10, 1 << 18])
def test_runs_of_anchors_are_held_whole(monkeypatch, most):
    monkeypatch.setattr(similar, "RUN_ROWS", most)
    key = np.repeat(np.arange(12), [1, 2, 40, 3, 1, 7, 12, 1, 90, 2, 2, 4])
    node = np.arange(len(key))
    whole = similar.pa.RecordBatch.from_arrays([similar.pa.array(x) for x in (key, node, node, np.zeros(len(key), np.int64))], ["key", "node", "root", "sketch"])
    out = [tuple(r.values()) for b in similar._meetings(whole.slice(i, 9) for i in range(0, len(key), 9)) for r in b.to_pylist()]
    size = Counter(key.tolist())
    assert sorted((k, v) for k, _, v in out) == [(k, v) for k, v in zip(key.tolist(), node.tolist()) if size[k] > 1]
    for k, n, _ in out:
        assert n in (size[k], -1) and (n == size[k] or size[k] > most)
    assert len({(k, n) for k, n, _ in out}) == len({k for k, _, _ in out})


def test_links_connect_all_that_is_near():
    rng = np.random.default_rng(13)
    prints = np.packbits(rng.integers(0, 2, (8, similar.BITS)).astype(np.uint8), axis=1)[rng.integers(0, 8, 200)]
    for i in range(200):
        bits = np.unpackbits(prints[i])
        bits[rng.choice(similar.BITS, rng.integers(0, 160), replace=False)] ^= 1
        prints[i] = np.packbits(bits)
    wide = prints.view(np.uint64)
    key = np.sort(rng.integers(0, 6, 200))
    out = similar._linked(similar.THRESHOLD, np.zeros(200, np.int64), key, np.arange(200), wide)
    near = (np.bitwise_count(wide[:, None] ^ wide).sum(axis=2) <= similar.THRESHOLD) & (key[:, None] == key)
    a, b = np.nonzero(near)
    node, root = graph.local_roots(a, b)
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == {n: r for n, r in zip(node.tolist(), root.tolist()) if n != r}


def test_similar_texts_link_by_their_exact_sets(spark):
    words = iter(f"w{i}" for i in range(1 << 20))
    rows, kept, pairs = [], set(), [(5, 4), (6, 5), (10, 8), (500, 400), (8, 6), (16, 12), (7, 5), (400, 300), (499, 399), (4, 3), (1, 1)]
    for _ in range(12):
        for whole, part in pairs:  # shingles of a text, and of its beginning
            text = [next(words) for _ in range(whole + 4)]
            rows += [(len(rows), " ".join(text), "s"), (len(rows) + 1, " ".join(text[: part + 4]), "s")]
            kept |= {len(rows) - 2, *([len(rows) - 1] if part * 5 < whole * 4 else [])}
    base = [next(words) for _ in range(144)]
    chain = [base[i * 10 : i * 10 + 104] for i in range(5)]  # 90 of 110 shared with the next, 80 of 120 with the one after
    kept.add(len(rows))
    rows += [(len(rows) + i, " ".join(x), "s") for i, x in enumerate(chain)]
    assert {r.doc_id for r in similar.representatives(frame(spark, rows)).collect()} == kept


def test_simhashes_near_by_anchors_are_candidates(spark, monkeypatch):
    """Without any MinHash band: what the anchors find is what all pairs of fingerprints give."""
    monkeypatch.setattr(similar, "meetings", lambda nodes: nodes.select(F.col("node").alias("key"), "node").where("node < 0"))
    rng = np.random.default_rng(61)
    texts = []
    for i in range(40):
        w = prose(rng, 300 + i).split()
        texts += [" ".join(w), " ".join([*w[:-1], f"edit{i}"]), " ".join([*w[:20], f"edit{i}", *w[21:]])]
    sets = [similar._sets(similar.pa.RecordBatch.from_arrays([similar.pa.array([t])], ["text"]), "text", 5)[0] for t in texts]
    prints = [int.from_bytes(similar.fingerprint(s)[:8], "little") for s in sets]
    near = np.array([(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    node, root = graph.local_roots(*near.T)
    expected = set(range(len(texts))) - {int(n) for n, r in zip(node, root) if n != r}
    assert 40 <= len(expected) < 100
    assert {r.doc_id for r in similar.representatives(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()} == expected


@pytest.mark.parametrize("block", [2, 4096])
def test_bands_of_several_components(spark, monkeypatch, block):
    """Texts that share bands but not all links: half of them grow out of one base by edits, so that some pairs reach 0.8 and many don't."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    monkeypatch.setattr(similar, "STAR_ROWS", block)
    rng = np.random.default_rng(51)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(160):
        w = list(base) if i % 4 else [f"c{i % 3}x{j}" for j in range(50)]
        for at in rng.choice(len(w), int(rng.integers(0, 4)), replace=False):
            w[at] = f"e{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    node, root = graph.local_roots(*np.array(near).T)
    expected = set(range(len(texts))) - {int(n) for n, r in zip(node, root) if n != r}
    assert 3 < len(expected) < 120
    assert {r.doc_id for r in similar.representatives(frame(spark, rows)).collect()} == expected


# containment


def brute_containment(rule, docs, items):
    out = []
    for i, t, _ in docs:
        own = rule.shingle_set((t or "").encode())
        for k, item in items:
            shingles = rule.shingle_set((item or "").encode())
            if shingles and len(shingles & own) >= 0.8 * len(shingles):
                out.append((i, k, len(shingles), len(shingles & own)))
    return Counter(out)


def test_decontamination(spark, rows):
    rng = np.random.default_rng(5)
    items = [(i, prose(rng, int(rng.integers(1, 90)))) for i in range(60)] + [(60, None), (61, ""), (62, "alpha beta"), (63, rows[5][1])]
    docs = list(rows)
    for i, (k, text) in enumerate(items[:50]):
        w = text.split()
        w[len(w) // 2 : len(w) // 2 + i % 4] = ["changed"] * (i % 4)
        half = len(w) // 2
        scattered = f"{' '.join(w[:half])} {prose(rng, 300)} {' '.join(w[max(0, half - 4):])}"
        docs.append((1000 + i, f"{prose(rng, 200)} {' '.join(w).upper() if i % 3 else scattered} {prose(rng, 500)}", "s0"))
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = decontam.contaminated(frame(spark, docs), benchmark).collect()
    expected = brute_containment(decontam.RULE, docs, items)
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in out) == expected and len(expected) > 20
    clean = decontam.decontaminated(frame(spark, docs), benchmark)
    assert len(clean.columns) == 11
    dirty = {k[0] for k in expected}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _, _ in docs if i not in dirty)
    empty = benchmark.limit(0)
    assert decontam.contaminated(frame(spark, docs), empty).count() == 0 and decontam.decontaminated(frame(spark, docs), empty).count() == len(docs)
    assert decontam.contaminated(frame(spark, []), benchmark).count() == 0


def test_items_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_ITEMS", 7)
    items = [(i, t) for i, (_, t, _) in enumerate(rows[:40])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contaminated(frame(spark, rows), benchmark).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in out) == brute_containment(decontam.RULE, rows, items)


def test_license_scan(spark, rows):
    docs = rows + [(600 + i, f"{prose(np.random.default_rng(i), 40)}\n{t[2]}\nmore text here", "s0") for i, t in enumerate(licenses.TEMPLATES)]
    docs += [(700, "RELEASED   under-the\nMIT license", "s0"), (701, "Released under the terms of MIT", "s0")]
    out = licenses.scan(frame(spark, docs)).collect()
    expected = brute_containment(licenses.RULE, docs, [(i, t[2]) for i, t in enumerate(licenses.TEMPLATES)])
    assert Counter((r.doc_id, r.template, r.n_shingles, r.n_shared) for r in out) == expected
    found = {(r.doc_id, r.license) for r in out}
    assert all((600 + i, t[0]) in found for i, t in enumerate(licenses.TEMPLATES)) and (700, "MIT") in found and not any(d == 701 for d, _ in found)
    assert licenses.scan(frame(spark, [])).count() == 0


# quality


def test_quality_rules_compile_to_the_same_scores(spark, rows):
    rng = np.random.default_rng(6)
    docs = [(i, prose(rng, 60) if i % 3 else prose(rng, 60).upper().replace(" ", "!! "), "s0") for i in range(300)] + [(i + 1000 if i is not None else None, t, s) for i, t, s in rows]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (7, 1, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    model = quality.train(df, labels)
    assert model.rules and model == quality.train(df.repartition(5), labels)
    out = quality.scored(df, model).select("doc_id", "stats", "score").collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    assert np.allclose([r.score for r in out], model.score(np.array([list(r.stats) for r in out])))
    held = [r for r in out if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    kept = quality.kept(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.score >= 0.5 for r in out)
    assert quality.scored(frame(spark, []), model).count() == 0


def test_quality_without_labels_or_with_one_class(spark, rows):
    df = frame(spark, rows)
    none = quality.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.scored(df, none).collect()} == {0.5}
    one = quality.train(df, spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int"))
    assert {r.score > 0.9 for r in quality.scored(df, one).collect()} == {True}


def test_statistics_of_empty_and_plain_texts():
    texts = [b"", "Élan VITAL go go.\nÉlan VITAL go go.".encode(), b"   "]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x = quality.statistics_of(np.frombuffer(b"".join(texts), np.uint8), at)
    of = dict(zip(quality.STATISTICS, x[1]))
    assert (x[0] == 0).all() and np.isfinite(x).all()
    assert of["log_words"] == pytest.approx(math.log1p(8)) and of["upper"] == pytest.approx(12 / 26) and of["line_repeats"] == 0.5
    assert of["distinct_words"] == 0.5 and of["top_word"] == 0.25 and of["upper_words"] == 0.25 and of["stops"] == 0.25


# sharding


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding_is_minimax(spark, rows, shards, monkeypatch):
    monkeypatch.setattr(sharding, "DIGIT_BITS", 3)
    monkeypatch.setattr(sharding, "FANOUT", 8)
    monkeypatch.setattr(sharding, "LEVELS", 20)
    out = sharding.shard(frame(spark, rows), shards, rows_per_bucket=7).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.shard < shards
    sizes = Counter()
    for r in out:
        sizes[r.text_key] += r.size
    key_of = {r.text_key: r.shard for r in out}
    assert all(key_of[r.text_key] == r.shard for r in out)
    assert len(sizes) == len({t or "" for _, t, _ in rows})
    order = [sizes[k] for k in sorted(sizes)]
    assert [key_of[k] for k in sorted(sizes)] == sorted(key_of[k] for k in sorted(sizes))

    def feasible(cap):
        used, load = 1, 0
        for s in order:
            if s > cap:
                return False
            if load + s > cap:
                used, load = used + 1, 0
            load += s
        return used <= shards

    low, high = max(order), sum(order)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) == low
    for s in range(shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    by_id = {(r.doc_id, r.size, r.text_crc32) for r in out}
    assert by_id == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}


def test_sharding_whole_rows_and_empty_tables(spark, rows):
    out = sharding.sharded(frame(spark, rows), 4)
    assert out.columns == [c for c in frame(spark, rows).columns if c != "shard"] + ["shard", "slot"] and out.count() == len(rows)
    assert sharding.shard(frame(spark, []), 4).count() == 0


# language model


def test_lm_base_scores_and_normalisation(spark, rows):
    out = lm.language_model(frame(spark, rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [words_of(t) for i, t, _ in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    ends, n, v = len(train), sum(c.values()) + len(train), len(c) + 1
    log = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    expected = Counter((i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(log(c[x]) for x in w) + log(ends), 6)) for i, w in ((i, words_of(t)) for i, t, _ in rows))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert lm.language_model(frame(spark, [])).count() == 0


def test_lm_probabilities_sum_to_one(spark, rows):
    docs = frame(spark, rows)
    vocab = lm.vocabulary(docs.select(F.coalesce("text", F.lit("")).alias("text")), words=10, head=7)
    types = vocab.types.collect()
    assert sum(r.c for r in types) + vocab.ends == vocab.tokens and len(types) + 1 == vocab.distinct and len(vocab.hashes) <= 7
    model = lm.Parameters(len(vocab.outputs), 8, 3, np.log(vocab.outputs / vocab.outputs.sum()))
    before = np.random.default_rng(7).integers(0, len(vocab.outputs), (5, 3))
    for row in before:
        everything = lm.log_probabilities(model.tables(), np.arange(len(vocab.outputs)), np.tile(row, (len(vocab.outputs), 1)))
        assert np.exp(everything).sum() == pytest.approx(1, abs=1e-5)
    words = set(vocab.words.view(np.int64).tolist())
    for b in {r.bucket for r in types}:
        share = [r.c + 0.5 for r in types if r.bucket == b and r.word not in words]
        assert sum(share) + 0.5 == pytest.approx(vocab.outputs[1 + len(words) + b])


def test_nce_learns_a_pattern():
    rng = np.random.default_rng(8)
    target = np.tile([1, 2, 3], 4000)
    before = np.stack([np.roll(target, 1), np.roll(target, 2), np.roll(target, 3)], axis=1)
    p = np.array([0.01, 0.33, 0.33, 0.33])
    model = lm.Parameters(4, 8, 3, np.log(p))
    seen = [np.full_like(x, 1e-4) for x in model.parts]
    for lo in range(0, len(target), 100):
        model.nce(target[lo : lo + 100], before[lo : lo + 100], np.searchsorted(np.cumsum(p), rng.random(64)), np.log(p * 64), 0.1, seen)
    assert lm.log_probabilities(model.tables(), target[:99], before[:99]).mean() > -0.2


# suffix arrays


def test_nce_trains_on_every_position(spark, monkeypatch):
    monkeypatch.setattr(lm, "_COPIES", 8)
    texts = [f"the {' '.join(WORDS[:i % 7])} end{i}" for i in range(300)] + ["", *["same"] * 1001]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = lm.vocabulary(df, words=6)
    codes = lm.encoded(df, vocab, 4)
    n, trained = 1 + 6 + 4, 0
    for round_ in range(lm.ROUNDS):
        rows = [(0, r["at"], r.n, bytes(r.codes)) for r in codes.where(lm.in_round(round_, lm.ROUNDS)).orderBy("at").collect()]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([])] * 4, ["shard", "at", "n", "codes"])
        flat = np.concatenate([lm.Parameters(n, 4, 2, np.zeros(n)).flat(), np.full(8 * n + n + 8, 1e-4)])
        trained += sum(b.column(2)[0].as_py() for b in lm._trainer(flat, np.full(n, 1 / n), 4, 2, 0.1, round_)([batch]))
    assert trained == sum(len(x.split()) + 1 for x in texts)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER", 3000)
    rng = np.random.default_rng(8)
    docs = [(i if i % 9 else None, " ".join(WORDS[int(j)] for j in rng.integers(0, len(WORDS), i % 60)) if i % 11 else None, "s") for i in range(400)]
    found = []
    for parts in (1, 8, 64):
        out = lm.language_model(frame(spark, docs).repartition(parts)).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out))
    assert found[0] == found[1] == found[2]
    held = [r for r in out if r.held_out and r.n_tokens > 20]
    assert len(held) > 20 and all(np.isfinite(r.score) for r in held)


@pytest.mark.parametrize("head", [0, 1, 3])
def test_counts_in_memory_keep_their_limit(spark, head):
    docs = spark.createDataFrame([("a a a b b b c c c d d d e",)] * 5, "text string")
    vocab = lm.vocabulary(docs, words=2, head=head)
    assert len(vocab.hashes) <= head and vocab.tokens == 70 and vocab.distinct == 6


def test_suffix_array():
    rng = np.random.default_rng(9)
    for n in [*range(1, 30), 700]:
        for k in (1, 2, 5, 300):
            s = rng.integers(0, k, n)
            assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("most", [1, 2500])
def test_repeated_spans(spark, rows, most, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 3000)
    out = suffix.repeated_spans(frame(spark, rows), sort_segments=most).collect()
    texts = [(t or "").encode() for _, t, _ in rows]
    count = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    expected = Counter()
    for (i, _, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                gone[p + 1 : p + 201] = True
        kept = np.frombuffer(t, np.uint8)[~gone[1:-1]].tobytes()
        expected[(i, len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.froms), r.kept_sha256) for r in out) == expected
    assert suffix.repeated_spans(frame(spark, [])).count() == 0


# wrappers


def test_wrapper_extraction(spark):
    page = '<html><head><title>x</title><script>var a="</p>";</script></head><body><nav><ul><li>Home<li>About</ul></nav><div class="ad">BUY</div><article><h1>Title {0}</h1><p><b>One &amp; {0}<br><p>two <a href="/">li</a>nk\n three<div class="comments"><p>first!</p></div></article><footer>&copy; f</footer>'
    pages = [(i, f"http://a.example.org/{i}", page.format(i)) for i in range(5)] + [(9, None, None), (10, "http://a.example.org/", ""), (11, "x", "just text"), (12, "http://b.example.org/1", "<main><p>é &eacute;</main>"), (12, "http://b.example.org/1", "<main><p>é &eacute;</main>")]
    df = spark.createDataFrame([(*p, "w", "h") for p in pages], "page_id long, url string, html string, wrapper string, host string")
    out = wrappers.main_texts(df).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in out) == Counter([(i, t := f"Title {i} One & {i} two link three", len(t)) for i in range(5)] + [(9, "", 0), (10, "", 0), (11, "just text", 9), (12, "é é", 3), (12, "é é", 3)])
    assert wrappers.main_texts(df.limit(0)).count() == 0


def test_template_texts_are_dropped_without_an_article():
    page = '<body><div class="top"><a href="/">Home</a></div><div class="x"><h1>T{0}</h1><p>Body {0}.</p>{1}</div><div class="y">All rights</div></body>'
    sources = [page.format(i, "<p>More</p>" * (i % 3)) for i in range(6)]
    made = wrappers.expression(wrappers.parse(sources[0]))
    for s in sources[1:]:
        made = wrappers.merge(made, wrappers.expression(wrappers.parse(s)))
    assert wrappers.extract(wrappers.parse(sources[1]), wrappers.program(made, 6)) == "T1 Body 1. More"


@pytest.mark.parametrize("parts", [1, 6])
def test_copies_of_a_page_are_one_page(spark, parts):
    page, other = "<body><div><h1>Title</h1><p>Only text.</p></div></body>", "<body><div><h1>Title</h1><p>Other.</p></div></body>"
    rows = [(i, "http://c.example.org/", page) for i in range(12)] + [(20 + i, "http://d.example.org/", x) for i in range(6) for x in (page, other)]
    out = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts))
    assert {(r.url[7], r.text) for r in out.collect()} == {("c", "Title Only text."), ("d", "Title Only text."), ("d", "Title Other.")}
    assert wrappers.extract(wrappers.parse(page), wrappers.program(wrappers.expression(wrappers.parse(page)), 3)) == "Title Only text."


class PlainExtractor(HTMLParser):
    """Another way to the texts of pages whose article has only p, h1, ul and blocks to leave out: by a stack of tags, for one page."""

    def __init__(self, drop):
        super().__init__()
        self.drop, self.stack, self.blocks = drop, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img", "b", "i", "a"):
            self.stack.append((tag, dict(attrs).get("class")))
            self.blocks.append("")
        elif tag == "br" and self.blocks:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag not in ("br", "b", "i", "a"):
            while self.stack.pop()[0] != tag:
                pass
            self.blocks.append("")

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "article" in tags and not self.drop & {c for _, c in self.stack} and not {"nav", "script", "form", "aside"} & set(tags):
            self.blocks[-1] += data

    def text(self):
        return " ".join(" ".join(self.blocks).split())


KEPT = ["share-price", "related-work", "comment-free", "notice-period", "advertising-history", "search-results-summary", "note"]


def generated_page(rng, h, i):
    say = lambda n: " ".join(WORDS[int(j)] for j in rng.integers(0, len(WORDS), n))
    blocks = [f"<h1>{say(3)} {i}</h1>"]
    for _ in range(int(rng.integers(1, 12))):
        kind = int(rng.integers(0, 6))
        if kind < 3:
            blocks.append(f"<p>{say(8)} &amp; <b>{say(2)}</b>\n {say(3)}<br>{say(1)}</p>")
        elif kind == 3:
            blocks.append("<ul>" + "".join(f"<li>{say(4)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
        elif kind == 4:
            blocks.append(f'<div class="{KEPT[int(rng.integers(0, len(KEPT)))]}"><p>{say(9)}</p></div>')
        else:
            blocks.append(f'<div class="{["ad-box", "comments"][int(rng.integers(0, 2))]}"><p>{say(5)}</p></div>')
    menu = "".join(f'<li><a href="/{k}">{say(1)}</a></li>' for k in range(5))
    return f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><script>if (a<b) x()</script><div class='h{h}'><article>{''.join(blocks)}</article></div><aside>{say(4)}</aside><footer>{say(3)}</footer></body></html>"


def test_main_texts_are_those_of_a_plain_extractor_in_every_layout(spark):
    rng = np.random.default_rng(23)
    pages = [(i, f"http://h{i % 5}.example.org/{i}", generated_page(rng, i % 5, i)) for i in range(120)]
    pages += [(200 + i, "http://h0.example.org/copy", pages[0][2]) for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = []
    for parts in (1, 4, 16):
        found.append({r.page_id: r.text for r in wrappers.main_texts(df.repartition(parts)).collect()})
    assert found[0] == found[1] == found[2]
    for i, _, source in pages:
        plain = PlainExtractor({"ad-box", "comments"})
        plain.feed(source)
        assert found[0][i] == plain.text()


def test_names_of_blocks():
    noise = "ad ad-box banner-top user-comments article-share related-posts cookie-notice site-header sidebar-left comment-body newsletter-signup"
    assert all(wrappers.noise_mark(m) for m in noise.split())
    assert not any(wrappers.noise_mark(m) for m in (*KEPT, "adventure", "content", "article-body", "main-text", "story", "post", "formal", "header-files-explained"))
    assert wrappers._marks('class="Ad3 mainText ad_box" id=post-12 role="main"') == ("ad", "ad-box", "main", "main-text", "post")


def test_deep_and_wide_pages():
    deep = '<div class="page"><article><h1>T</h1>' + "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>one</p><p>two</p></article></div><p>out</p>"
    wide = "<article>" + "".join(f'<{t} class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}">{i}</{t}>' for i, t in enumerate(np.random.default_rng(3).choice(["p", "h2", "ul", "div"], 20_000))) + "</article>"
    began = time.time()
    for source, text in ((deep, "T deep one two"), (wide, " ".join(map(str, range(20_000))))):
        root = wrappers.parse(source)
        made = wrappers.expression(root)
        both = wrappers.merge(made, wrappers.expression(wrappers.parse(source.replace("T", "U").replace("h2", "h3"))))
        assert len(json.dumps(both)) < 1 << 20
        assert wrappers.extract(root, wrappers.program(both, 2)) == text
    assert time.time() - began < 20


def test_template_within_an_article_needs_ten_pages():
    page = "<body><article><h1>Title {0}</h1><p>Text number {0} and more.</p><p>Subscribe now for more</p></article></body>"
    for n, kept in ((9, True), (10, False)):
        made = wrappers.expression(wrappers.parse(page.format(0)))
        for i in range(1, n):
            made = wrappers.merge(made, wrappers.expression(wrappers.parse(page.format(i))))
        assert wrappers.extract(wrappers.parse(page.format(3)), wrappers.program(made, n)) == "Title 3 Text number 3 and more." + " Subscribe now for more" * kept


def test_lists_of_links_outside_the_article_are_menus():
    page = '<body><div class="x"><div><a href="1">Red {0}</a></div><div><a href="2">Blue {0}</a></div></div><div class="z"><p>Long text {0} about <a href="3">one</a> thing.</p><p>More {0}.</p></div></body>'
    made = wrappers.expression(wrappers.parse(page.format(0)))
    for i in range(1, 4):
        made = wrappers.merge(made, wrappers.expression(wrappers.parse(page.format(i))))
    assert wrappers.extract(wrappers.parse(page.format(2)), wrappers.program(made, 4)) == "Long text 2 about one thing. More 2."


def test_alignment_finds_optional_and_repeated_groups():
    tree = lambda s: wrappers.expression(wrappers.parse(s))
    merged = wrappers.merge(tree("<h1>a</h1><p>b</p>"), tree("<h1>a</h1><table>t</table><p>c</p><p>d</p>"))
    assert [(x[0], x[1], x[2]) for x in merged[3]] == [("h1", 0, 0), ("table", 1, 0), ("p", 0, 1)]
    assert merged[3][0][3][0][1] != 0 and merged[3][2][3][0][1] == 0
    group = tree("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>")[3]
    assert [x[0] for x in group] == ["+"] and [x[0] for x in group[0][3]] == ["h2", "p"]


# mixing


def test_targets_and_apportionment():
    goal = mixing.targets([100, 10, 1000], [5, 2, 1])
    assert sum(goal) == 1110 and goal[0] == 300 and goal[1] == 30 and goal[2] == 780
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []
    votes, most = [53000, 24000, 23000], [99] * 3
    for seats in range(0, 60):
        given = [0, 0, 0]
        for _ in range(seats):
            given[max(range(3), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats, most).tolist() == given
    assert mixing.sainte_lague([5, 5, 5], 4, [9, 9, 9]).tolist() == [2, 1, 1]
    assert mixing.sainte_lague([9, 1], 8, [2, 9]).tolist() == [2, 6]
    quotas = mixing.quotas([1000, 5000], [3000, 3000], 4, 10)
    assert quotas.shape == (4, 2) and quotas.sum(axis=0).tolist() == [300, 300] and (quotas >= 0).all()


def test_mixing(spark, rows):
    df = frame(spark, rows)
    out = mixing.mix(df, block=4, rows_per_bucket=9).collect()
    size = lambda t: len(words_of(t))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, size(t)) for i, t, _ in rows)
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s in rows if s == x) for x in sources]
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    for s, n, g in zip(sources, sizes, goal):
        own = [r for r in out if r.source == s]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(n, round(float(g), 6))}
        assert abs(sum(r.taken for r in own) - float(g)) <= 16
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, out), key=str) == sorted(map(key, mixing.mix(df.repartition(3), block=4, rows_per_bucket=9).collect()), key=str)
    mixed = mixing.mixed(df, block=4, rows_per_bucket=9)
    assert mixed.columns == df.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text)
    expected = Counter()
    for r in out:
        expected[r.doc_id] += r.taken
    assert +taken == +expected
    assert mixing.mix(frame(spark, [])).count() == mixing.mixed(frame(spark, [])).count() == 0


def test_quotas_are_met_by_shard_in_every_layout(spark):
    rng = np.random.default_rng(17)
    rows = [(None if i % 3 == 0 else i % 40, " ".join(["w%d" % (i % 90)] * int(rng.integers(0, 30))) or None, [None, "a", "b", "c"][i % 4]) for i in range(400)]
    df = frame(spark, rows)
    seen = set()
    for parts in (1, 3, 7):
        out = mixing.mix(df.repartition(parts), block=4, shards=5, rows_per_bucket=9, whole=True).collect()
        seen.add(tuple(sorted(((str(r.doc_id), str(r.source), str(r.row.text), str(r.pieces)) for r in out))))
        text = Counter((r.doc_id, r.source, r.text) for r in mixing.mixed(df.repartition(parts), block=4, shards=5, rows_per_bucket=9).collect())
        seen.add(tuple(sorted(text.items(), key=str)))
    assert len(seen) == 2
    sources = ["a", "b", "c", None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in sources]
    quotas = mixing.quotas(sizes, mixing.targets(sizes, [5, 2, 1, 5]), 5, 4)
    words = Counter()
    for r in out:
        for p in r.pieces:
            words[p.shard, r.source] += p.to - p["from"]
    for k in range(5):
        for s, x in enumerate(sources):
            short = sizes[s] % 4 and 4 - sizes[s] % 4
            assert 4 * quotas[k][s] - 3 * short <= words[k, x] <= 4 * quotas[k][s]


def test_word_count(spark):
    texts = ["", " ", "a b", "a b c", "\tx\x0by\x0c", None, "\x1ca b"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select(word_count()).collect()
    assert [r[0] for r in out] == [0, 0, 2, 2, 2, 0, 2]


# the pipeline


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    item = prose(rng, 40)
    docs = [(i, prose(rng, 80), f"s{i % 3}") for i in range(120)]
    docs += [(200 + i, docs[i][1].upper().lower(), "s0") for i in range(10)]
    docs += [(300 + i, " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split()), "s1") for i in range(60)]
    docs += [(400, f"{prose(rng, 50)} {item} {prose(rng, 50)}", "s2")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        state = function(spark, state, str(tmp_path))
        state.write.parquet(f"{tmp_path}/{i}")
        state = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = {r.doc_id for r in state.select("doc_id").collect()}
        if i < 4:
            assert state.columns == columns.replace(" long", "").replace(" string", "").split(", ")
    assert kept["quality"] == {i for i, _, _ in docs if i < 300 or i == 400} or kept["quality"] == {i for i, _, _ in docs if i < 300}
    root = components_of([fingerprint(t) for i, t, _ in docs if i in kept["quality"]])
    assert len(kept["near_dedup"]) == len(set(root.values())) and not kept["near_dedup"] & set(range(200, 210))
    assert kept["decontamination"] == kept["near_dedup"] - {400}
    assert kept["mixing"] <= kept["decontamination"] and kept["sharding"] == kept["mixing"]
    assert state.columns[-2:] == ["shard", "slot"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in rows) == Counter((r.doc_id, r.text, r.shard) for r in state.collect())


# ids of any kind, long texts, many items


@pytest.mark.parametrize("kind", ["string", "long"])
def test_item_ids_keep_their_type_and_may_be_null(spark, kind):
    text = "one two three four five six seven eight nine ten"
    ids = ["a", None, "b"] if kind == "string" else [7, None, 8]
    benchmark = spark.createDataFrame([(ids[0], text), (ids[1], text), (ids[2], None)], f"item_id {kind}, text string")
    docs = frame(spark, [(1, f"x {text} y", "s"), (None, text.upper(), "s"), (2, None, "s")])
    out = decontam.contaminated(docs, benchmark)
    assert dict(out.dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
    assert Counter((r.doc_id, r.item_id) for r in out.collect()) == Counter([(1, ids[0]), (1, None), (None, ids[0]), (None, None)])
    assert [r.doc_id for r in decontam.decontaminated(docs, benchmark).collect()] == [2]


def test_an_item_in_a_text_of_20_megabytes():
    rng = np.random.default_rng(31)
    item = prose(rng, 60)
    words = np.array([f"w{i}" for i in range(5000)])[rng.integers(0, 5000, 3_600_000)]
    long = f"{' '.join(words[:2_000_000])} {item} {' '.join(words[2_000_000:])} {item.upper()}".encode()
    assert len(long) > 20_000_000
    index = containment.Index([item.encode(), b"w1 w2 w3 absent here", prose(rng, 40).encode()], containment.Rule())
    n = len(containment.Rule().shingle_set(item.encode()))
    assert index.matches(np.frombuffer(long, np.uint8), np.array([0, len(long)])) == [(0, 0, n, n, 2_000_000)]


def test_ten_thousand_items_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_ITEMS", 3000)
    items = [(i, " ".join(f"item{i}word{j}" for j in range(12))) for i in range(10_000)]
    docs = [(i, f"before {items[(i * 397) % 10_000][1]} after", "s") for i in range(200)]
    out = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(i, (i * 397) % 10_000) for i in range(200)]


def test_versions_of_a_license_are_told_apart(spark):
    number = {t[:2]: i for i, t in enumerate(licenses.TEMPLATES) if t[0].startswith("GPL")}
    docs = [(i, f"some words before. {licenses.TEMPLATES[k][2]} Some words after.", "s") for i, k in enumerate(number.values())]
    out = licenses.scan(frame(spark, docs)).collect()
    for i, k in enumerate(number.values()):
        assert [r.template for r in out if r.doc_id == i and r.best] == [k]
    assert len(out) > len(docs)


# the queries themselves


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm_queries.QUERIES))
def test_query(spark, name):
    df = llm_queries.QUERIES[name](spark, SF)
    found = df.collect()
    rows_in = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op7') else 'documents'}.parquet").count()
    assert len(found) == rows_in or name[:4] in ("op1_", "op9_")
    if name not in llm_queries.ORACLE_SQL:
        return
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cursor = db.execute(llm_queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda r, c: [round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for _, v in sorted(zip(c, r))]
    assert sorted(map(str, (plain(r, df.columns) for r in found))) == sorted(map(str, (plain(r, names) for r in cursor.fetchall())))


def test_staged_tables_go_with_their_scope(spark):
    with common.staging():
        stays = common.keep(common.stage(spark.range(4), "stays"))
        kept = common.stage(spark.range(3), "kept")
        gone = common.stage(spark.range(3), "gone")
        paths = [common._PATHS[x].removeprefix("file:") for x in (kept, gone)]
        common.unstage(gone)
        assert os.path.isdir(paths[0]) and not os.path.isdir(paths[1]) and kept.count() == 3
        with common.staging():
            inner = common.keep(common.stage(spark.range(2), "inner"))
        assert inner.count() == 2
        paths.append(common._PATHS[inner].removeprefix("file:"))
    assert not os.path.isdir(paths[0]) and not os.path.isdir(paths[2]) and stays.count() == 4
    common.unstage(stays)


def test_cuts_need_few_jobs(spark):
    groups = spark.range(200_000).select(F.shiftrightunsigned(F.xxhash64("id"), 4).alias("key"), (F.col("id") % 90 + 1).alias("bytes")).sort("key").cache()
    order = sharding._Order(groups)
    low = -(-order.total // 16)
    for cap in (low + 50, low + 2000):
        before = order.jobs
        assert order.cuts(cap, 16) is not None and order.jobs - before <= 6


def test_texts_beyond_a_group(spark, rows):
    rng = np.random.default_rng(41)
    words = np.array([f"w{i}" for i in range(3000)])[rng.integers(0, 3000, 600_000)]
    item = prose(rng, 40)
    near = words.copy()
    near[::5000] = "edit"
    far = rng.permutation(words)
    docs = [r for r in rows if len(r[1] or "") < 50_000][:60]
    docs += [(9000 + i, t, "s1") for i, t in enumerate((" ".join(words), " ".join(near), f"{' '.join(far[:300_000])} {item} {' '.join(far[300_000:])}"))]
    assert len(docs[-1][1]) > 3 << 20
    df = frame(spark, docs)
    kept = {r.doc_id for r in similar.representatives(df).select("doc_id").collect()}
    assert {9000, 9002} <= kept and 9001 not in kept
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(df, benchmark).collect()] == [9002]
    scored = {r.doc_id: r for r in lm.language_model(df).collect()}
    for i, t, _ in docs[-3:]:
        assert scored[i].n_tokens == len(t.split()) + 1 and np.isfinite(scored[i].score) and scored[i].score < 0
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, _, _ in docs if i is not None], "doc_id long, quality int, toxic int")
    found = quality.scored(df, quality.train(df, labels)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    taken = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert all(taken[i].size == len(t.split()) for i, t, _ in docs[-3:])


def test_a_log_probability_does_not_depend_on_its_place():
    rng = np.random.default_rng(43)
    model = lm.Parameters(40, 16, 3, rng.normal(size=40))
    target, before = rng.integers(0, 40, 9001), rng.integers(0, 40, (9001, 3))
    whole, order = lm.log_probabilities(model.tables(), target, before), rng.permutation(9001)
    assert (lm.log_probabilities(model.tables(), target[order], before[order]) == whole[order]).all()
    assert (lm.log_probabilities(model.tables(), target[:77], before[:77]) == whole[:77]).all()
    model.b[3] += 300  # beyond the range of floats
    far = lm.log_probabilities(model.tables(), target, before)
    assert np.isfinite(far).all() and (far[target != 3] < -200).all()


def test_contexts_are_the_words_before():
    rng = np.random.default_rng(42)
    for n in ([], [0], [1, 0, 5, 2, 0], [0, 0, 3]):
        out = rng.integers(1, 9, sum(n))
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        target, before, at = lm._contexts(out, first, 3)
        expected = [(list(out[a:b]) + [0]) for a, b in zip(first, first[1:])]
        assert target.tolist() == [int(x) for d in expected for x in d] and at.tolist() == np.concatenate([[0], np.cumsum([len(d) for d in expected])]).tolist()
        assert before.tolist() == [[int(d[p - k - 1]) if p > k else 0 for k in range(3)] for d in expected for p in range(len(d))]
