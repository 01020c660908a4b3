"""Log-bilinear language model with noise-contrastive estimation.

The model predicts one of a few hundred outputs: text end, the most frequent words, and buckets of all
other words by their last two bytes.  A context vector is the sum of the last three outputs' vectors,
each scaled by a diagonal matrix of its place; its products with all output vectors, plus biases,
normalise to log-probabilities by batched matrix products.  Within a bucket a word has its smoothed
share of the bucket's training counts, with one further share for all unseen words.

Word counts are exact over all training documents.  For training every document becomes a string of
output numbers, a byte a word.  The strings are dealt by hash over trainers, whose number follows from
the number of tokens, and over rounds that double in size; a trainer takes its strings in hash order
and mixes the positions of some thousands at a time.  After each round the parameters are averaged by
sums that are exact, so every position is trained on once and the layout of the input makes no
difference.  Copies of a text are counted first and then dealt like different ones.  Scoring holds the
counts of frequent words in memory, at most ``HEAD_TYPES`` of them, and joins the rest in one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import stage, text_buffers, text_groups, unstage
from framelens.llm.tokens import LOWER, mix, tokenize

WORDS, BUCKETS, SIZE, CONTEXT = 191, 64, 16, 3
#: Most words whose counts are held in memory.
HEAD_TYPES = 1 << 19
#: Positions of one trainer at least, if there are several, and most trainers.
TRAINER, TRAINERS = 1 << 22, 4096
#: Rounds, of which each is as large as all before; positions of a step and its noise samples; positions that are mixed.
ROUNDS, BATCH, NOISE, MIXED = 6, 512, 64, 1 << 17
#: Rows that the copies of a text make at most; each stands for its share of them.
_COPIES = 1024
_SCORE_ROWS = 1 << 12


def held_out(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _words(data: np.ndarray, at: np.ndarray, buckets: int):
    """Hash and bucket of each word, and the first word of each document."""
    h, s, e, first = tokenize(data, at)
    last = LOWER[data[e - 1]].astype(np.uint64)
    before = np.where(e - s > 1, LOWER[data[np.maximum(e - 2, 0)]], 0).astype(np.uint64)
    return h, (mix(last * np.uint64(256) + before) % np.uint64(buckets)).astype(np.int64), first


def _merge(h: np.ndarray, b: np.ndarray, c: np.ndarray):
    order = np.argsort(h, kind="stable")
    h, b, c = h[order], b[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[starts], b[starts], np.add.reduceat(c, starts) if len(h) else c


def _counter(buckets: int, most: int = 1 << 20):
    def out(parts):
        h, b, c = _merge(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b.astype(np.int32)), pa.array(c)], ["word", "bucket", "c"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for group in text_groups(batch):
                h, b, _ = _words(*text_buffers(group.column(0)), buckets)
                parts.append(_merge(h, b, np.ones(len(h), np.int64)))
                held += len(parts[-1][0])
                if held >= most:
                    parts = [_merge(*(np.concatenate(x) for x in zip(*parts)))]
                    held = len(parts[0][0])
                    if held >= most // 2:
                        yield out(parts)
                        parts, held = [], 0
        if parts:
            yield out(parts)

    return run


@dataclass
class Vocabulary:
    """``types`` is the staged table of all counts; the arrays hold its frequent part, by hash."""

    types: DataFrame
    tokens: int
    distinct: int
    ends: int
    hashes: np.ndarray
    counts: np.ndarray
    words: np.ndarray  # hashes of the words that are outputs, sorted
    outputs: np.ndarray  # counts of all outputs: end, words, buckets

    @property
    def lookup(self):
        return self.hashes, self.counts, self.words


def vocabulary(train: DataFrame, words: int = WORDS, buckets: int = BUCKETS, head: int = HEAD_TYPES) -> Vocabulary:
    """Counts of all words of ``train`` (text)."""
    types = stage(train.select("text").mapInArrow(_counter(buckets), "word long, bucket int, c long").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c")), "types")
    ends = train.count()
    # classes of counts that differ by one in a hundred, some thousands at most
    by_size = types.groupBy(F.floor(F.log2("c") * 64).alias("size")).agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.min("c").alias("least")).orderBy(F.desc("size")).collect()
    least, held = (1 << 63) - 1, 0
    for r in by_size:
        if held + r.n > head:
            break
        least, held = r.least, held + r.n
    top = types.orderBy(F.desc("c"), "word").limit(words).collect()
    frequent = types.where(F.col("c") >= least).select("word", "c").toArrow()
    h = frequent.column("word").to_numpy().view(np.uint64)
    order = np.argsort(h)
    own = np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))
    of = {r.word: r.c for r in top}
    per_bucket = np.zeros(buckets, np.int64)
    for r in types.groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        per_bucket[r.bucket] += r.c
    for r in top:
        per_bucket[r.bucket] -= r.c
    outputs = np.concatenate([[ends], [of[int(w)] for w in own.view(np.int64)], per_bucket]).astype(float)
    in_buckets = np.zeros(buckets)
    for r in types.groupBy("bucket").count().collect():
        in_buckets[r.bucket] += r["count"]
    for r in top:
        in_buckets[r.bucket] -= 1
    outputs[1 + len(own) :] += 0.5 * in_buckets + 0.5  # what the shares within a bucket sum to
    total, distinct = sum(r.total for r in by_size), sum(r.n for r in by_size)
    return Vocabulary(types, total + ends, distinct + (ends > 0), ends, h[order], frequent.column("c").to_numpy()[order], own, outputs)


def _outputs(h: np.ndarray, bucket: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The output of each word: 1 and on for frequent words, then the buckets."""
    out = 1 + len(words) + bucket
    if len(words):
        i = np.minimum(np.searchsorted(words, h), len(words) - 1)
        out = np.where(words[i] == h, 1 + i, out)
    return out


def _contexts(out: np.ndarray, first: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets with an end after each document, their contexts (the end fills up), and each document's first target."""
    target, at = _targets(out, first)
    before = np.zeros((len(target), context), np.uint16)
    for k in range(context):
        before[k + 1 :, k] = target[: -k - 1]
        for j in range(k + 1):  # a document's first targets have no such predecessor
            before[at[:-1][np.diff(at) > j] + j, k] = 0
    return target, before, at


def _targets(out: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs with an end after each document, and each document's first one."""
    n = np.diff(first)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    target = np.zeros(int(at[-1]), np.uint16)
    own = np.ones(len(target), bool)
    own[at[1:] - 1] = False
    target[own] = out
    return target, at


class Parameters:
    """Context vectors r, output vectors q, diagonal matrices c and biases b."""

    def __init__(self, outputs: int, size: int, context: int, bias: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (outputs, size))
        self.q = rng.normal(0, 0.1, (outputs, size))
        self.c = np.ones((context, size))
        self.b = bias.astype(float).copy()

    @property
    def parts(self):
        return [self.r, self.q, self.c, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, values: np.ndarray) -> "Parameters":
        at = 0
        for p in self.parts:
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def nce(self, target: np.ndarray, before: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, rate: float, seen: list[np.ndarray]) -> None:
        """One step on a batch; ``log_noise``: log of the noise samples times each output's noise probability."""
        outputs, size, n = *self.r.shape, len(target)
        near = [self.r[before[:, k]] for k in range(before.shape[1])]
        hat = sum(x * c for x, c in zip(near, self.c))
        qt, qn = self.q[target], self.q[noise]
        up = 1 / (1 + np.exp(log_noise[target] - self.b[target] - np.einsum("ns,ns->n", hat, qt))) - 1
        fake = 1 / (1 + np.exp((log_noise[noise] - self.b[noise])[None] - hat @ qn.T))
        d_hat = up[:, None] * qt + fake @ qn
        place = np.arange(size)
        added = lambda at, v: np.bincount((at.astype(np.int64)[:, None] * size + place).ravel(), v.ravel(), outputs * size).reshape(outputs, size)
        grad_q = added(target, up[:, None] * hat) + added(noise, fake.T @ hat)
        grad_b = np.bincount(target, up, outputs) + np.bincount(noise, fake.sum(axis=0), outputs)
        grad_r = sum(added(before[:, k], d_hat) * self.c[k] for k in range(len(near)))
        grad_c = np.stack([np.einsum("ns,ns->s", x, d_hat) for x in near])
        for p, g, s in zip(self.parts, (grad_r, grad_q, grad_c, grad_b), seen):
            g = g / n
            s += g * g
            p -= rate * g / np.sqrt(s + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (self.r[None] * self.c[:, None]).astype(np.float32), self.q.T.astype(np.float32).copy(), self.b.astype(np.float32)


def log_probabilities(tables, target: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities of the targets.

    Products are of one shape, the last block's too, so that a position's digits don't depend on its place.
    """
    scaled, q, b = tables
    biased, ones = np.vstack([q, b[None]]), np.ones(len(b), np.float32)
    out = np.empty(len(target))
    hat = np.ones((_SCORE_ROWS, len(biased)), np.float32)
    for lo in range(0, len(target), _SCORE_ROWS):
        t, c = target[lo : lo + _SCORE_ROWS], before[lo : lo + _SCORE_ROWS]
        part = hat[: len(t)]
        part[:, :-1] = scaled[0][c[:, 0]]
        for k in range(1, len(scaled)):
            part[:, :-1] += scaled[k][c[:, k]]
        logits = hat @ biased
        own = logits[np.arange(len(t)), t].astype(float)
        top = 0.0
        with np.errstate(over="ignore"):
            total = (np.exp(logits) @ ones)[: len(t)]
        if not (np.isfinite(total) & (total > 1e-30)).all():  # out of the range of floats without a shift
            top = logits.max(axis=1)[: len(t)]
            total = np.exp(logits[: len(t)] - top[:, None]).sum(axis=1)
        out[lo : lo + _SCORE_ROWS] = own - top - np.log(total.astype(float))
    return out


def _encoder(words: np.ndarray, buckets: int):
    kind = np.uint8 if 1 + len(words) + buckets <= 256 else np.uint16

    def run(batches):
        for batch in batches:
            for group in text_groups(batch):
                h, bucket, first = _words(*text_buffers(group.column(1)), buckets)
                codes = _outputs(h, bucket, words).astype(kind)
                raw = [codes[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(raw, pa.binary())], ["h", "codes"])

    return run


def encoded(texts: DataFrame, vocab: Vocabulary, buckets: int = BUCKETS) -> DataFrame:
    """(at, n, codes): every different text of ``texts`` (text) as output numbers, with a draw and the number of its copies.

    Of many copies there are several rows, each with its own draw.
    """
    made = texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(_encoder(vocab.words, buckets), "h long, codes binary")
    made = made.groupBy("h", "codes").agg(F.count("*").alias("n"))
    rows = F.least(F.col("n"), F.lit(_COPIES)).cast("int")
    made = made.select("h", "codes", "n", rows.alias("rows"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("j"))
    share = F.expr("n div rows") + (F.col("j") < F.col("n") % F.col("rows")).cast("long")
    return stage(made.select(F.xxhash64("h", "j").alias("at"), share.alias("n"), "codes"), "codes")


def in_round(r: int, rounds: int):
    """Whether a row of ``encoded`` belongs to round ``r``: the last has half of all draws, the one before a quarter."""
    draw = F.pmod(F.xxhash64("at"), F.lit(1 << rounds - 1))
    return draw == 0 if r == 0 else (draw >= 1 << r - 1) & (draw < 1 << r)


def _trainer(flat: np.ndarray, probabilities: np.ndarray, size: int, context: int, rate: float, round_: int):
    """Rows (shard, at, n, codes) come sorted by shard; each shard trains a model of its own."""
    outputs = len(probabilities)
    kind = np.uint8 if outputs <= 256 else np.uint16

    def run(batches):
        log_noise, seat = np.log(probabilities * NOISE), np.cumsum(probabilities)
        shard, held, waiting, steps = None, [], 0, 0
        model = seen = rng = None

        def learn():
            nonlocal held, waiting, steps
            first = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            target, at = _targets(np.concatenate(held), first)
            # a text of any length is mixed in slices
            cuts = np.linspace(0, len(target), max(1, len(target) // MIXED) + 1).astype(np.int64)
            for begin, stop in zip(cuts, cuts[1:]):
                order = begin + rng.permutation(stop - begin)
                place = order - at[np.searchsorted(at, order, "right") - 1]
                before = np.stack([np.where(place > k, target[order - k - 1], 0) for k in range(context)], axis=1)
                for lo in range(0, len(order), BATCH):
                    part = order[lo : lo + BATCH]
                    noise = np.minimum(np.searchsorted(seat, rng.random(NOISE)), outputs - 1)
                    model.nce(target[part], before[lo : lo + BATCH], noise, log_noise, rate, seen)
            steps += len(target)
            held, waiting = [], 0

        def out():
            if held:
                learn()
            values = np.concatenate([model.flat(), *(s.ravel() for s in seen)])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values * steps), pa.array(np.full(len(values), steps))], ["k", "v", "n"])

        for batch in batches:
            for own, _, n, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if own != shard:
                    if shard is not None:
                        yield out()
                    shard, steps = own, 0
                    model = Parameters(outputs, size, context, np.zeros(outputs)).load(flat)
                    at, seen = len(flat) // 2, []
                    for p in model.parts:
                        seen.append(flat[at : at + p.size].reshape(p.shape).copy())
                        at += p.size
                    rng = np.random.default_rng([11, round_, shard])
                codes = np.frombuffer(codes, kind)
                for _ in range(n):
                    held.append(codes)
                    waiting += len(codes) + 1
                    if waiting >= MIXED:
                        learn()
        if shard is not None:
            yield out()

    return run


def train(texts: DataFrame, vocab: Vocabulary, buckets: int = BUCKETS, size: int = SIZE, context: int = CONTEXT, rounds: int = ROUNDS, rate: float = 0.1) -> Parameters:
    """Parameters after one pass over all positions of ``texts`` (text), in ``rounds`` parts; without texts all outputs are alike."""
    counts = vocab.outputs + (vocab.outputs == 0) * 0.5
    probabilities = counts / counts.sum()
    model = Parameters(len(counts), size, context, np.log(probabilities))
    if not vocab.ends:
        return model
    codes = encoded(texts, vocab, buckets)
    trainers = max(1, min(TRAINERS, vocab.tokens // TRAINER))
    shard = F.pmod(F.col("at"), F.lit(trainers)).cast("int").alias("shard")
    state = np.concatenate([model.flat(), np.full(len(model.flat()), 1e-4)])
    for r in range(rounds):
        own = codes.where(in_round(r, rounds)).select(shard, "at", "n", "codes").repartitionById(trainers, "shard").sortWithinPartitions("shard", "at", "codes")
        run = _trainer(state, probabilities, size, context, rate, r)
        sums = own.mapInArrow(run, "k long, v double, n long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,9)")).alias("v"), F.sum("n").alias("n"))
        sums = sums.select("k", (F.col("v").cast("double") / F.col("n")).alias("v")).orderBy("k").toArrow()
        if sums.num_rows:
            state = sums.column("v").to_numpy().copy()
    unstage(codes)
    return model.load(state)


def _scorer(tables, lookup, outputs, tokens: int, distinct: int, ends: int, buckets: int, context: int):
    from_head = lookup.value if hasattr(lookup, "value") else lookup

    def run(batches):
        hashes, counts, words = lookup.value if hasattr(lookup, "value") else from_head
        base = np.log10(tokens + 0.5 * (distinct + 1))
        within = np.log10(np.maximum(outputs[1 + len(words) :], 0.5))
        end = np.log10(ends + 0.5) - base
        rows = TaskContext.get().partitionId() << 40
        for batch in batches:
            for group in text_groups(batch):
                h, bucket, first = _words(*text_buffers(group.column(1)), buckets)
                out = _outputs(h, bucket, words)
                target, before, at = _contexts(out, first, context)
                ln = log_probabilities(tables, target, before) / np.log(10)
                i = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                known = hashes[i] == h if len(hashes) else np.zeros(len(h), bool)
                share = np.where(known, np.log10((counts[i] if len(hashes) else 0) + 0.5), 0.0)
                in_bucket = out > len(words)
                extra = np.where(in_bucket, share - within[np.where(in_bucket, out - 1 - len(words), 0)], 0.0)
                doc = np.repeat(np.arange(group.num_rows), np.diff(first))
                total = lambda v: np.bincount(doc, v, minlength=group.num_rows)
                model = np.add.reduceat(ln, at[:-1]) + total(extra) if group.num_rows else np.zeros(0)
                tail = np.flatnonzero(~known)
                n_tail = np.bincount(doc[tail], minlength=group.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_tail)]).astype(np.int32)), pa.array(h[tail].view(np.int64)))
                n = np.diff(first)
                ids = np.arange(rows, rows + group.num_rows)
                rows += group.num_rows
                yield pa.RecordBatch.from_arrays(
                    [group.column(0), pa.array(ids), pa.array((n + 1).astype(np.int64)), pa.array(total(known.astype(float)).astype(np.int64) + int(ends > 0)), pa.array(total(share - base) + end), pa.array(model), lists],
                    ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "tail"],
                )

    return run


def score(docs: DataFrame, vocab: Vocabulary, model: Parameters, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    A null text is empty and has one token, its end.  Repeated rows score alike.  Without training
    documents every base score is that of unseen words only.  Other columns are not read.
    """
    context = len(model.c)
    lookup = docs.sparkSession.sparkContext.broadcast(vocab.lookup)
    run = _scorer(model.tables(), lookup, vocab.outputs, vocab.tokens, vocab.distinct, vocab.ends, buckets, context)
    rows = stage(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base_score double, score double, tail array<long>"), "scores")
    tail = rows.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    tail = tail.join(vocab.types.select("word", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("share"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    out = rows.drop("tail").join(tail, "row", "left")
    share = F.coalesce("share", F.lit(0.0))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + share).alias("base_score"), (F.col("score") + share).alias("score"))


def language_model(docs: DataFrame) -> DataFrame:
    """Learns from the documents outside the held-out fold and scores all."""
    known = docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text"))
    vocab = vocabulary(known)
    return score(docs, vocab, train(known, vocab))
