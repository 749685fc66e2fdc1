"""Masked pseudo-likelihood scores from a bidirectional window network (operator 6).

The network predicts every word's symbol from the two words on either side:
their embeddings, a hidden layer, a softmax over classes and one over the
symbols of a class. The commonest ``FREQUENT`` words of the whole corpus are
symbols of their own, in classes by rank; the others share ``SHARED`` symbols
by hash. A word of a shared symbol also has its own share of it,
(n + 1) / (N + T + 1), from its count n and the N words and T distinct words of
the symbol in the whole corpus. A document's score is the sum of the
conditional log-probabilities of its words, log P(symbol | both sides) +
log P(word | symbol).

1. Words are counted over all documents. Counts of the commonest words, at
   most ``KNOWN``, are broadcast; those of all others stay distributed.
2. Texts become sequences of symbols, dealt to trainers by a hash of the row
   and sorted by it. The number of trainers follows the number of words.
3. In each of ``ROUNDS`` rounds every trainer goes along its sequence from the
   same start and learns from the round's share of the steps; the rounds
   together learn from every position once (a corpus of fewer than
   ``LEAST_WORDS`` words more often, by its number of words alone). Weights become integers and are
   averaged by the number of steps.
4. The sequences are scored; words whose count was not broadcast are joined
   with the counts by word.

Rows are dealt and sorted by their content, and what tasks give is added up as
integers, so neither weights nor scores depend on how the table is partitioned.
The driver gets the broadcast counts, sums by symbol, and the network's ``N``
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_pieces, text_or_empty, word_hashes

CLASSES, EACH = 16, 64
SYMBOLS = CLASSES * EACH
SHARED = 64
FREQUENT = SYMBOLS - SHARED
EDGE = SYMBOLS  #: stands before and after a document
SIDE, WIDTH, HIDDEN = 2, 8, 16
ROUNDS, RATE, STEP = 2, 0.1, 2048
SCORED = 4096  #: positions scored at once
LEAST_WORDS = 1 << 20  #: that a round goes over; the positions of a smaller corpus are repeated, at most MOST_PASSES times
MOST_PASSES = 100
RUN = 1 << 15  #: positions laid out at once, about
KNOWN = 1 << 18  #: words whose counts are broadcast, at most
TRAINER, MOST_TRAINERS = 1 << 21, 1 << 12  #: words of a trainer, about; trainers (beyond, each gets more words)
SHAPES = {"embed": (SYMBOLS + 1, WIDTH), "mix": (2 * SIDE * WIDTH, HIDDEN), "mix0": (HIDDEN,), "top": (HIDDEN, CLASSES), "top0": (CLASSES,), "out": (CLASSES, HIDDEN, EACH), "out0": (CLASSES, EACH)}
N = sum(int(np.prod(s)) for s in SHAPES.values())
UNIT = 1 << 20  #: weights and log-probabilities are added up as integers of 1 / UNIT
CHUNK = 1 << 19  #: bytes of text hashed at once


def units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


class Network:
    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers, self.gains, at = numbers, None, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, numbers[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 11) -> Network:
        """Small random weights; the output biases are the log frequencies of classes and symbols."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(N))
        net.embed[:] = rng.normal(0, 0.3, net.embed.shape)
        net.mix[:] = rng.normal(0, 0.2, net.mix.shape)
        net.top[:] = rng.normal(0, 0.05, net.top.shape)
        net.out[:] = rng.normal(0, 0.05, net.out.shape)
        by_class = counts.reshape(CLASSES, EACH) + 1.0
        net.top0[:] = np.log(by_class.sum(1) / by_class.sum())
        net.out0[:] = np.log(by_class / by_class.sum(1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed[context].reshape(len(context), -1)
        return x, np.tanh(x @ self.mix + self.mix0)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        hidden, of, within = self.hidden(context)[1], target // EACH, target % EACH
        out = _log_softmax(hidden @ self.top + self.top0, of)
        for k, rows in _by_class(of):
            out[rows] += _log_softmax(hidden[rows] @ self.out[k] + self.out0[k], within[rows])
        return out

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        """One gradient step, with per-weight rates."""
        if self.gains is None:
            self.gains, self.slope = np.full(N, 1e-2, self.numbers.dtype), Network(np.zeros(N, self.numbers.dtype))
        g, of, within = self.slope, target // EACH, target % EACH
        x, hidden = self.hidden(context)
        p = _error(hidden @ self.top + self.top0, of, len(of))
        g.top[:], g.top0[:] = hidden.T @ p, p.sum(0)
        back = p @ self.top.T
        g.out[:], g.out0[:] = 0, 0
        for k, rows in _by_class(of):
            h = hidden[rows]
            p = _error(h @ self.out[k] + self.out0[k], within[rows], len(of))
            g.out[k], g.out0[k] = h.T @ p, p.sum(0)
            back[rows] += p @ self.out[k].T
        back *= 1 - hidden * hidden
        g.mix[:], g.mix0[:] = x.T @ back, back.sum(0)
        into = (self.mix @ back.T).reshape(2 * SIDE, WIDTH, -1).swapaxes(0, 1).reshape(WIDTH, -1)
        seen = context.T.ravel()
        for d in range(WIDTH):
            g.embed[:, d] = np.bincount(seen, into[d], SYMBOLS + 1)
        self.gains += g.numbers * g.numbers
        self.numbers -= RATE * g.numbers / np.sqrt(self.gains)


def _by_class(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(of.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=CLASSES))
    for k, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
        if a < b:
            yield k, order[a:b]


def _log_softmax(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each row's target. A row's result does not depend on the others, as a shared maximum would make it."""
    own = logits[np.arange(len(target)), target]
    return own - np.log(np.exp(np.minimum(logits, 600, out=logits), out=logits) @ np.ones(logits.shape[1]))


def _error(logits: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Softmax less the truth, over ``n``."""
    p = np.exp(np.clip(logits, -80, 80, out=logits), out=logits)
    p *= (1 / (n * (p @ np.ones(p.shape[1], p.dtype))))[:, None]
    p[np.arange(len(target)), target] -= 1 / n
    return p


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def _hashed(texts: list[str]):
    """Yields (place of the first text, word hashes, where each text's words begin) for runs of the texts."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    at = 0
    while at < len(data):
        to, size = at, 0
        while to < len(data) and (to == at or size + len(data[to]) < CHUNK):
            size += len(data[to])
            to += 1
        yield at, *word_hashes(data[at:to])
        at = to


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word (by 64-bit hash, A-Z lower-cased) occurs in all documents."""

    def run(batches):
        held, size = [], 0

        def counted():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for batch in batches:
            for _, h, _ in _hashed(batch.column(0).to_pylist()):
                held.append(h)
                size += len(h)
                if size >= 1 << 21:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return _texts(docs).select("text").mapInArrow(in_pieces(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The commonest words (sorted hashes) with counts and symbols, and the count of each symbol's words and of its distinct ones."""

    known: np.ndarray
    times: np.ndarray
    symbol: np.ndarray
    words: np.ndarray
    distinct: np.ndarray

    def __post_init__(self) -> None:
        self.start = np.searchsorted(self.known, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(self.known)))
        self.own = np.append(units(np.log(self.times + 1.0)), 0)
        self.whole = units(np.log(self.words + self.distinct + 1.0))

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        # Bins of counts, narrow enough that few words are lost to the last one; bounded, unlike the counts themselves.
        fine = F.floor(F.log2(F.col("n")) * 64)
        bins = sorted(((r["b"], r["k"]) for r in counts.groupBy(fine.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
        taken, least = 0, None
        for b, k in bins:
            taken += k
            if taken > KNOWN:
                break
            least = b
        got = counts.filter(fine >= least if least is not None else F.lit(False)).select("word", "n").toArrow()
        words, n = got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -n))] = np.arange(len(words))
        symbol = np.where(rank < FREQUENT, rank, shared_symbol(words))
        seen, distinct = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for r in counts.groupBy(F.shiftrightunsigned("word", 58).cast("int").alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
            seen[FREQUENT + r["s"]], distinct[FREQUENT + r["s"]] = r["n"], r["k"]
        for k in np.flatnonzero(rank < FREQUENT):
            s = shared_symbol(words[k])
            seen[s], distinct[s] = seen[s] - n[k], distinct[s] - 1
            seen[rank[k]], distinct[rank[k]] = n[k], 1
        order = np.argsort(words)
        return cls(words[order], n[order], symbol[order].astype(np.int64), seen, distinct)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of words among the known ones; len(known) for others."""
        top = (h >> np.uint64(44)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        found, todo = np.full(len(h), len(self.known)), np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            hit = self.known[here] == h[todo]
            found[todo[hit]] = here[hit]
            at[todo] += 1
            todo = todo[~hit & (here + 1 < end[todo])]
        return found


def shared_symbol(words: np.ndarray):
    return FREQUENT + (words >> np.uint64(58)).astype(np.int64)


_ENCODED = "at long, trainer long, key long, doc_id long, share long, symbols binary, rare array<long>"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each row as symbols, with the sum of the known words' shares and the words whose counts must be looked up."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    trainers = min(MOST_TRAINERS, max(1, -(-int(vocabulary.words.sum()) // TRAINER)))

    def run(batches):
        v = shared.value
        code, sized = np.append(v.symbol, -1), v.whole
        for batch in batches:
            for at, h, first in _hashed(batch.column("text").to_pylist()):
                found = v.find(h)
                symbol = code[found]
                unknown = found == len(v.known)
                symbol[unknown] = shared_symbol(h[unknown])
                own = np.where(symbol >= FREQUENT, v.own[found] - sized[symbol], 0)
                share = np.concatenate(([0], np.cumsum(own)))[first]
                rare = np.concatenate(([0], np.cumsum(unknown)))[first]
                n = len(first) - 1
                symbols = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(symbol.astype("<u2").tobytes())])
                words = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(h[unknown].view(np.int64)))
                columns = [batch.column(c).slice(at, n) for c in ("at", "trainer", "key", "doc_id")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(share)), symbols, words], [x.split()[0] for x in _ENCODED.split(", ")])

    texts = _texts(docs).withColumn("at", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("doc_id", "text"))
    made = texts.select("at", F.pmod("key", F.lit(trainers)).alias("trainer"), "key", "doc_id", "text").mapInArrow(in_pieces(run), _ENCODED)
    return cut(made.repartition("trainer").sortWithinPartitions("trainer", "key"))


def sequences(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """Yields (trainer, laid-out symbols, places of the words among them, rows) for runs of rows of one trainer."""
    edge, held, trainer, size = np.full(SIDE, EDGE, np.uint16), [], None, 0

    def laid():
        stream = np.concatenate([edge, *(x for r in held for x in (np.frombuffer(r["symbols"], "<u2"), edge))])
        return trainer, stream, np.flatnonzero(stream != EDGE), held

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["trainer"] != trainer or size >= RUN):
                yield laid()
                held, size = [], 0
            trainer = row["trainer"]
            held.append(row)
            size += len(row["symbols"]) // 2
    if held:
        yield laid()


def steps(stream: np.ndarray, places: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, target) of ``size`` positions at a time; the word itself is never part of its context."""
    for at in range(0, len(places), size):
        here = places[at : at + size]
        yield np.stack([stream[here + d] for d in range(-SIDE, SIDE + 1) if d], 1).astype(np.int64), stream[here].astype(np.int64)


def fit(docs: DataFrame) -> tuple[Network, Vocabulary, DataFrame, DataFrame]:
    """The network, the vocabulary, all word counts and the encoded rows."""
    counts = cut(word_counts(docs))
    vocabulary = Vocabulary.of(counts)
    encoded = encode(docs, vocabulary)
    net = Network.start(vocabulary.words)
    passes = min(MOST_PASSES, -(-LEAST_WORDS // max(1, int(vocabulary.words.sum()))))
    for turn in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(net.numbers)

        def run(batches):
            total, weight = np.zeros(N, np.int64), 0
            local, now, step, learned, again = None, None, 0, 0, []

            def ended():
                for _ in range(passes - 1):
                    for context, target in again:
                        local.learn(context, target)
                return total + units(local.numbers.astype(np.float64)) * learned, weight + learned

            for trainer, stream, places, _ in sequences(batches):
                if trainer != now:
                    if learned:
                        total, weight = ended()
                    local, now, step, learned, again = Network(shared.value.astype(np.float32)), trainer, 0, 0, []
                for context, target in steps(stream, places, STEP):
                    if step % ROUNDS == turn:
                        local.learn(context, target)
                        learned += 1
                        if passes > 1:  # fewer than LEAST_WORDS in the whole corpus
                            again.append((context, target))
                    step += 1
            if learned:
                total, weight = ended()
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(N, dtype=np.int32)), pa.array(total), pa.array(np.full(N, weight, np.int64))], ["i", "x", "n"])

        got = encoded.select("trainer", "symbols").mapInArrow(in_pieces(run), "i int, x long, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
        if len(got):
            numbers = np.empty(N)
            numbers[got["i"].to_numpy()] = got["x"].to_numpy() / got["n"].to_numpy() / UNIT
            net = Network(numbers)
    return net, vocabulary, counts, encoded


def document_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_probability (the sum) and mean_log_probability of each row's whole text.

    A text without words, or a null one, has the sum 0 and a null mean.
    Repeated rows and equal texts get the same score. An empty table gives no rows.
    """
    net, _, counts, encoded = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net.numbers)

    def run(batches):
        network = Network(shared.value)
        for _, stream, places, rows in sequences(batches):
            each = np.concatenate([np.zeros(1, np.int64), *(units(network.log_probability(c, t)) for c, t in steps(stream, places, SCORED))])
            n = np.array([len(r["symbols"]) // 2 for r in rows])
            ends = np.cumsum(n)
            to = np.cumsum(each)
            net_sum = to[ends] - to[ends - n]
            share = np.array([r["share"] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in ("at", "doc_id")] + [pa.array(n), pa.array(net_sum + share)], ["at", "doc_id", "n_words", "score"])

    scored = encoded.select("at", "doc_id", "trainer", "share", "symbols").mapInArrow(in_pieces(run), "at long, doc_id long, n_words long, score long")
    asked = encoded.select("at", F.explode("rare").alias("word"))
    looked_up = asked.join(counts, "word").groupBy("at").agg(F.sum(F.rint(F.log(F.col("n") + 1) * UNIT).cast("long")).alias("rare"))
    total = F.round((F.col("score") + F.coalesce("rare", F.lit(0))) / UNIT, 4)
    out = scored.join(looked_up, "at", "left").select("doc_id", "n_words", total.alias("log_probability"))
    return out.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))
