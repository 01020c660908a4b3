"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are made in one Arrow pass.  Boosted shallow trees on a bounded sample
of labelled rows give the candidate rules, the conjunctions along their paths; lasso logistic
regression keeps few of them; those are compiled to one Spark column expression that scores all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm.common import text_buffers, text_groups
from framelens.llm.tokens import tokenize

STATISTICS = (
    "log_words", "word_length", "upper", "upper_words", "symbols", "symbol_words", "digits", "commas", "stops",
    "short_words", "distinct_words", "repeats", "top_word", "lines", "line_repeats", "entropy",
)
#: Most labelled rows that the fit uses.
SAMPLE_ROWS = 20_000
#: Rows of those that one tree is grown on, drawn anew for each.
TREE_ROWS = 2000

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_DIGIT[48:58] = True
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *b".,;:'\"-()?"]] = False
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def _runs(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: the number of distinct keys and the count of the most frequent one."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, d[starts], length)
    return np.bincount(d[starts], minlength=n).astype(float), most


def statistics_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; those of an empty text are all 0."""
    n = len(at) - 1
    base, end = int(at[0]), int(at[-1])
    x, rel = data[base:end], at - base
    words, s, e, first = tokenize(data, at)
    count = np.diff(first).astype(float)
    per_word = np.maximum(count, 1)
    upper = _UPPER[x]
    upper[1:] |= (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
    letter, symbol = _LETTER[x], _SYMBOL[x]
    chars = _sums((x & 0xC0) != 0x80, rel)
    per_char = np.maximum(chars, 1)
    letters = np.maximum(_sums(letter, rel), 1)
    tops, syms, lets = (np.concatenate([[0], np.cumsum(f, dtype=np.int64)]) for f in (upper, symbol, letter))
    in_word = lambda c: c[e - base] - c[s - base]
    shout = (in_word(tops) == in_word(lets)) & (in_word(lets) >= 2)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = False
    distinct, most = _runs(words, first)
    lines, _, _, line_first = tokenize(data, at, _LINE)
    n_lines = np.diff(line_first).astype(float)
    unlike, _ = _runs(lines, line_first)
    entropy = np.zeros(n)
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        doc = np.repeat(np.arange(hi - lo), np.diff(rel[lo : hi + 1]))
        h = np.bincount(doc * 256 + x[rel[lo] : rel[hi]], minlength=(hi - lo) * 256).reshape(-1, 256)
        p = h / np.maximum(h.sum(axis=1, keepdims=True), 1)
        entropy[lo:hi] = (p * -np.log2(np.where(p > 0, p, 1))).sum(axis=1) + 0.0
    return np.stack([
        np.log1p(count), chars / per_word, _sums(upper, rel) / letters, _sums(shout, first) / per_word, _sums(symbol, rel) / per_char,
        _sums(in_word(syms) > 0, first) / per_word, _sums(_DIGIT[x], rel) / per_char, _sums(x == 44, rel) / per_word, _sums(x == 46, rel) / per_word,
        _sums((e - s) <= 2, first) / per_word, distinct / per_word, _sums(same, first) / per_word, most / per_word, n_lines / per_word,
        (n_lines - unlike) / np.maximum(n_lines, 1), entropy,
    ], axis=1)


def _measure(batches):
    for batch in batches:
        for group in text_groups(batch):
            data, at = text_buffers(group.column(group.schema.get_field_index("text")))
            found = statistics_of(data, at)
            stats = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(STATISTICS))], list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*group.columns, stats], [*group.schema.names, "stats"])


def statistics(docs: DataFrame, name: str = "stats") -> DataFrame:
    """All columns of ``docs``, which has a text, and a struct of STATISTICS."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for batch in _measure(batches):
            yield batch.rename_columns([*batch.schema.names[:-1], name])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, bound): above the bound, or at most it."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, bound in self.terms:
            out &= (x[:, i] > bound) == above
        return out

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for i, above, bound in self.terms:
            value = F.col(f"{stats}.{STATISTICS[i]}")
            out = out & (value > bound if above else value <= bound)
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str = "stats") -> Column:
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _split(x: np.ndarray, target: np.ndarray, least: int):
    """The (statistic, bound) whose halves differ most in the mean of ``target``."""
    best = (1e-12, None)
    n, total = len(x), target.sum()
    for i in range(x.shape[1]):
        order = np.argsort(x[:, i], kind="stable")
        v, left = x[order, i], np.cumsum(target[order])[:-1]
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        gain = np.where(ok, left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n, -1)
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (float(gain[j]), (i, float((v[j] + v[j + 1]) / 2)))
    return best[1]


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, rows: int = TREE_ROWS, seed: int = 0) -> list[Rule]:
    """The paths of boosted regression trees, each grown on a seeded subsample."""
    rng, rules = np.random.default_rng(seed), {}
    z = np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        own = rng.permutation(len(x))[:rows]
        rest = y - 1 / (1 + np.exp(-z))
        step = np.zeros(len(x))
        stack = [((), own, np.arange(len(x)))]
        while stack:
            terms, sample, reach = stack.pop()
            found = _split(x[sample], rest[sample], max(3, rows // 200)) if len(terms) < depth and len(sample) > 6 else None
            if found is None:
                p = y[sample].mean() if len(sample) else 0.5
                step[reach] = rest[sample].mean() / max(0.05, p * (1 - p)) if len(sample) else 0
                continue
            i, bound = found
            for above in (False, True):
                longer = (*terms, (i, above, bound))
                rules[Rule(longer)] = None
                stack.append((longer, sample[(x[sample, i] > bound) == above], reach[(x[reach, i] > bound) == above]))
        z += rate * step
    return list(rules)


def lasso(features: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the intercept, by accelerated proximal steps."""
    n, m = features.shape
    a = np.column_stack([np.ones(n), features])
    rate = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    w, v, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    w[0] = v[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(steps):
        u = v - rate * a.T @ (1 / (1 + np.exp(-a @ v)) - y) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t2 * (u - w), u, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4, most_rules: int = 60) -> Model:
    """Without rows the score is 0.5; with one class only it is a constant near that class."""
    if not len(y):
        return Model(0.0, (), ())
    if y.min() == y.max():
        return Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), (), ())
    rules = grow(x, y)
    held = np.stack([r.holds(x) for r in rules], axis=1)
    _, first = np.unique(held, axis=1, return_index=True)
    first = np.sort(first)
    rules, held = [rules[i] for i in first], held[:, first].astype(float)
    intercept, w = lasso(held, y, penalty)
    keep = np.argsort(-np.abs(w) * held.std(axis=0), kind="stable")[:most_rules]
    keep = np.sort(keep[np.abs(w[keep]) > 1e-6])
    return Model(intercept, tuple(rules[i] for i in keep), tuple(float(w[i]) for i in keep))


def held_out(name: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` labelled documents outside the held-out fold, the same each time."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text").where("doc_id IS NOT NULL"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "stats")).alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return np.array([list(r.x.stats) for r in rows], float).reshape(-1, len(STATISTICS)), np.array([float(r.x.quality) for r in rows])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    return fit(*training_rows(docs, labels, sample))


def scored(docs: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns asked for and score, of every row of ``docs``. A null text is empty; repeated rows score alike."""
    return statistics(docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)).withColumn("score", model.column())


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more."""
    name = "stats"
    while name in docs.columns:
        name += "_"
    return statistics(docs, name).where(model.column(name) >= 0.5).select(*docs.columns)
