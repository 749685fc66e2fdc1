"""Quality classifier: a factorisation machine over text features (operator 1).

Features of a document are its hashed words, one bin of each structure
statistic, and one bin of its stated length (metadata). The score is the
logistic of

    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)

so that all pairs of features interact in time linear in their number.
Language, source, ids and labels are no inputs.

The machine is fitted on the driver to a bounded sample of labelled rows
(``PER_CLASS`` of each class, the smallest by a hash of doc_id); everything
else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, in_pieces, release, splitmix, text_or_empty, word_hashes

WORD_BINS = 1 << 15
FACTORS = 8
PER_CLASS = 3000  #: labelled rows of each class that the machine is fitted to, at most
EPOCHS, STEPS, RATE, DECAY, BATCH = 12, 400, 0.06, 1e-4, 128  # at least EPOCHS passes and STEPS steps
THRESHOLD = 0.3

# Byte classes for the statistics.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "mark": b"#$%&*@^~",
    "bar": b"|<>{}[]\\/_=+",
    "line": b"\n",
    "blank": b" \t\r",
}
_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES.values(), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = len(_CLASSES) + 1
N_KINDS = len(_CLASSES) + 2

STATISTICS = ("upper", "digit", "stop", "shout", "mark", "bar", "line", "blank", "beyond", "other", "distinct", "top", "word", "words", "pairs")
LEVELS = 12
META = "stated"
N_FEATURES = WORD_BINS + (len(STATISTICS) + 1) * LEVELS


def _level(share: np.ndarray) -> np.ndarray:
    """Bins of a share: 0, then by powers of two up to 1."""
    return np.where(share <= 0, 0, np.clip(LEVELS - 1 + np.floor(np.log2(np.maximum(share, 1e-9))), 1, LEVELS - 1)).astype(np.int64)


def _size(n: np.ndarray) -> np.ndarray:
    """Bins of a count, by powers of three."""
    return np.clip(np.floor(np.log(np.maximum(n, 0) + 1) / np.log(3)), 0, LEVELS - 1).astype(np.int64)


def features(texts: list[str], stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, values, where each text's features begin, one more at the end); ``stated`` is each text's stated length."""
    parts, at = [], 0
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    while at < len(data):
        to, size = at, 0
        while to < len(data) and (to == at or size + len(data[to]) < 1 << 18):
            size += len(data[to])
            to += 1
        parts.append(_features(data[at:to], stated[at:to]))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(([0], np.cumsum(sizes)))


def _features(data: list[bytes], stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    lengths = np.fromiter(map(len, data), np.int64, n)
    joined = np.frombuffer(b"".join(data), np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(owner * N_KINDS + _KIND[joined], minlength=n * N_KINDS).reshape(n, N_KINDS)
    h, first = word_hashes([d.lower() for d in data])
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    key = (doc << 15) | (h & np.uint64(WORD_BINS - 1)).astype(np.int64)
    unique, count = np.unique(key, return_counts=True)
    of, index = unique >> 15, unique & (WORD_BINS - 1)
    x = np.log1p(count)
    norm = np.sqrt(np.bincount(of, x * x, minlength=n))
    x = x / norm[of] if len(of) else x
    distinct = np.bincount(of, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    pair = (doc[:-1] << 40) | (splitmix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(24)).astype(np.int64)
    pair = pair[doc[:-1] == doc[1:]] if len(doc) else pair
    pairs = np.bincount(np.unique(pair) >> 40, minlength=n) if len(pair) else np.zeros(n)
    bytes_ = np.maximum(lengths, 1)
    share = {k: kinds[:, i] / bytes_ for i, k in enumerate((*("other",), *_CLASSES, "beyond"))}
    w = np.maximum(words, 1)
    levels = {k: _level(share[k]) for k in share if k in STATISTICS} | {
        "distinct": _level(1 - distinct / w),
        "top": _level(top / w),
        "pairs": _level(1 - pairs / np.maximum(words - 1, 1)),
        "word": np.clip((lengths / w).astype(np.int64), 0, LEVELS - 1),
        "words": _size(words),
        META: _size(stated),
    }
    fixed = np.stack([WORD_BINS + i * LEVELS + levels[k] for i, k in enumerate((*STATISTICS, META))], 1)
    per = distinct + fixed.shape[1]
    to = np.concatenate(([0], np.cumsum(per)))
    indices, values = np.empty(to[-1], np.int64), np.empty(to[-1], np.float32)
    place = np.arange(len(of)) + fixed.shape[1] * of
    indices[place], values[place] = index, x
    rest = (to[1:, None] - fixed.shape[1] + np.arange(fixed.shape[1])).ravel()
    indices[rest], values[rest] = fixed.ravel(), 0.5
    return indices, values, to


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, indices: np.ndarray, values: np.ndarray, to: np.ndarray) -> np.ndarray:
        vx = self.v[indices] * values[:, None]
        linear = np.add.reduceat(self.w[indices] * values, to[:-1])
        summed, squares = np.add.reduceat(vx, to[:-1], axis=0), np.add.reduceat(vx * vx, to[:-1], axis=0)
        return self.bias + linear + 0.5 * (summed * summed - squares).sum(1)

    def score(self, texts: list[str], stated: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts, stated)), -30, 30).astype(np.float64))) if texts else np.zeros(0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the weighted logistic loss; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(seed)
    share = float((weights * labels).sum() / max(weights.sum(), 1e-9))
    share = min(max(share, 0.01), 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, FACTORS)).astype(np.float32))
    gw, gv, gb = np.full(N_FEATURES, 1e-3, np.float32), np.full((N_FEATURES, FACTORS), 1e-3, np.float32), 1e-3
    batches = max(1, len(rows) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // batches)) if len(rows) else 0):
        for pick in np.array_split(rng.permutation(len(rows)), batches):
            sizes = np.array([len(rows[i][0]) for i in pick])
            indices, values = (np.concatenate([rows[i][k] for i in pick]) for k in (0, 1))
            to = np.concatenate(([0], np.cumsum(sizes)))
            p = 1 / (1 + np.exp(-np.clip(m.raw(indices, values, to), -30, 30)))
            g = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
            each = np.repeat(g, sizes) * values
            summed = np.add.reduceat(m.v[indices] * values[:, None], to[:-1], axis=0)
            step = each[:, None] * (np.repeat(summed, sizes, axis=0) - m.v[indices] * values[:, None])
            used, inverse = np.unique(indices, return_inverse=True)
            dw = np.bincount(inverse, each, len(used)).astype(np.float32) + DECAY * m.w[used]
            dv = np.stack([np.bincount(inverse, step[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + DECAY * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            gb += float(g.sum()) ** 2
            m.bias -= RATE * float(g.sum()) / gb**0.5
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stated_length(docs: DataFrame) -> Column:
    """n_chars where the table has it as a number, else the text's length."""
    length = F.length(text_or_empty())
    return F.coalesce(F.expr("try_cast(n_chars AS bigint)"), length) if "n_chars" in docs.columns else length


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit to at most PER_CLASS rows of each class that are not held out. Without labels, every score is the same."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("label"))
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = None
    for label in sorted(totals):
        some = usable.filter(F.col("label") == label).orderBy(order, "doc_id").limit(PER_CLASS)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return fit([], np.zeros(0), np.zeros(0))

    def run(batches):
        for b in batches:
            indices, values, to = features(b["text"].to_pylist(), b["stated"].to_numpy(zero_copy_only=False))
            cut = list(zip(to[:-1], to[1:], strict=True))
            found = [pa.array([indices[x:y].astype("<i4").tobytes() for x, y in cut], pa.binary()), pa.array([values[x:y].astype("<f4").tobytes() for x, y in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], *found], ["doc_id", "label", "indices", "values"])

    # At most 2 * PER_CLASS rows of two numbers: small enough to send to every task, so no text is shuffled.
    joined = docs.select("doc_id", text_or_empty().alias("text"), stated_length(docs).cast("double").alias("stated")).join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text", "stated")
    made = joined.mapInArrow(in_pieces(run), "doc_id long, label int, indices binary, values binary")
    # One row for each doc_id, the same whatever the partitions, also where one has several texts.
    one = made.groupBy("doc_id", "label").agg(F.min(F.struct("indices", "values")).alias("x")).select("doc_id", "label", "x.*")
    got = one.toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(i.as_buffer(), "<i4").astype(np.int64), np.frombuffer(v.as_buffer(), "<f4")) for i, v in zip(got["indices"], got["values"], strict=True)]
    y = got["label"].to_numpy().astype(np.float64)
    seen = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    share = {k: totals.get(k, 0) / sum(totals.values()) for k in (0, 1)}
    machine = fit(rows, y, np.array([share[int(k)] * len(y) / seen[int(k)] for k in y]))
    del got, rows
    release()
    return machine


def scorer(docs: DataFrame, machine: Machine) -> Column:
    """Score of each row's whole text; the machine (about 1.2 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(text: pa.Array, stated: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for at in range(0, len(text), PIECE):
            out.append(shared.value.score(text.slice(at, PIECE).to_pylist(), stated.slice(at, PIECE).to_numpy(zero_copy_only=False)))
        release()
        return pa.array(np.concatenate(out))

    run.__annotations__ = {"text": pa.Array, "stated": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text_or_empty(), stated_length(docs).cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row's whole text.

    A null text counts as empty; a null doc_id is not held out; a missing or
    null n_chars is replaced by the text's length; repeated rows get the same
    score; without labels every score is the same.
    """
    machine = train(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), scorer(docs, machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
