"""Approximate nearest neighbours with a permutation index (operator 7).

Pivots come from a bounded sample of ``SAMPLE`` distinct vectors; those too near
to another pivot are passed over, as many pivots in one dense group would tell
neither its vectors nor others apart. A vector is represented by its
``PREFIX`` nearest pivots in order; each of them posts the vector, with its
place, in that pivot's inverted file. For a query, the files of its own
nearest pivots give every vector's footrule distance (a pivot that only one of
both lists counts as if it stood at place PREFIX). The vectors of least
footrule are reranked by their true distance.

All vectors are indexed; their pivots are found once and stored with them.
Rows are dealt into shards; a task holds the inverted files of one shard and a
block of queries, both of bounded size. In each shard the same share of the
distinct vectors is reranked, at least ``LEAST``, and all that tie with the
last of them. A shard's files hold each distinct vector once; those reranked
are expanded to the ids of all their rows, smallest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIVOTS, PREFIX = 256, 64
SAMPLE, APART = 1024, 0.25  #: vectors that pivots are chosen from; least distance of two pivots, as a share of the sample's median distance
SHARE, LEAST = 0.2, 100
SHARD, BLOCK = 16384, 8192  #: vectors and queries in a task, about; a vector is copied once for each block, a query once for each shard


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """PIVOTS vectors of the sample, in its order: those apart from all chosen before, then as many others as are missing."""
    squares = (sample * sample).sum(1)
    far = np.sqrt(np.maximum(0, squares[:, None] + squares - 2 * sample @ sample.T))
    least, near, chosen, others = APART * np.median(far), np.full(len(sample), np.inf), [], []
    for i in range(len(sample)):
        if len(chosen) < PIVOTS and near[i] > least:
            chosen.append(i)
            near = np.minimum(near, far[i])
        else:
            others.append(i)
    return sample[sorted((chosen + others)[:PIVOTS])]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Of each vector its ``prefix`` nearest pivots, nearest first, ties to the smaller number."""
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    def __init__(self, orders: np.ndarray, n_pivots: int) -> None:
        self.n, self.prefix = orders.shape
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.place = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int32)
        self.start = np.searchsorted(flat[by], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every posted vector to a query's pivots."""
        # Without common pivots: every pivot of both lists counts its distance to the place after the last one.
        total = np.full(self.n, self.prefix * (self.prefix + 1), np.int64)
        for place, pivot in enumerate(order.tolist()):
            at = slice(self.start[pivot], self.start[pivot + 1])
            rows, there = self.row[at], self.place[at]
            total[rows] += np.abs(there - place) - (self.prefix - place) - (self.prefix - there)
        return total


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed component by component in order."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        d = x[:, k] - q[k]
        total += d * d
    return np.sqrt(total)


class Distinct:
    """The distinct vectors of some rows with their pivots, and the sorted ids of the rows of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, orders: np.ndarray) -> None:
        rows = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * x.shape[1]))).ravel()  # + 0.0: no negative zeros
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        by = np.lexsort((ids, group))
        self.x, self.orders, self.ids = x[first], orders[first], ids[by]
        self.start = np.searchsorted(group[by], np.arange(len(first) + 1))

    def nearest(self, pick: np.ndarray, query: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest rows among the vectors ``pick``, without the query's own row, ties to the smaller id."""
        score = distances(self.x[pick], vector)
        ids, far, last = [], [], None
        n = 0
        for at in np.argsort(score, kind="stable").tolist():
            if n >= k and score[at] > last:
                break
            these = self.ids[self.start[pick[at]] : self.start[pick[at] + 1]]
            if score[at] == 0 and np.array_equal(self.x[pick[at]], vector):
                own = int(np.searchsorted(these, query))
                if own < len(these) and these[own] == query:
                    these = np.concatenate((these[:own][:k], these[own + 1 :][:k]))
            these = these[:k]
            ids.append(these)
            far.append(np.full(len(these), score[at]))
            n, last = n + len(these), score[at]
        ids, far = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0), *far])
        best = np.lexsort((ids, far))[:k]
        return ids[best], far[best]


def _columns(table: pa.Table | pa.RecordBatch, width: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows, vectors and pivots."""
    orders = np.frombuffer(b"".join(table["seen"].to_pylist()), np.uint16).reshape(-1, prefix)
    return table["vec_id"].to_numpy(), _vectors(table["v"], width), orders


def _vectors(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, and neither do rows without id or of another length than the
    commonest. Rows with the same id are separate candidates and separate
    queries, each with ranks of its own; only a query's own row is no candidate
    for it. Ties go to the smaller id. An empty table gives no rows.
    """
    v = F.col(vector_column).cast("array<double>")
    good = F.size(v) > 0
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    sizes = usable.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = sizes[0]["width"], sizes[0]["n"]
    usable = usable.filter(F.size("v") == width)
    # The distinct vectors that come first in the order of their hashes.
    of = F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))  # + 0.0: no negative zeros
    chosen = [r["h"] for r in usable.select(of.alias("h")).distinct().orderBy("h").limit(SAMPLE).collect()]
    pivots = choose_pivots(np.array([r["v"] for r in usable.select(of.alias("h"), "v").filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()]))
    prefix = min(PREFIX, len(pivots))

    def represent(batches):
        for batch in batches:
            orders = nearest_pivots(_vectors(batch["v"], width), pivots, prefix).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array([o.tobytes() for o in orders], pa.binary())], ["vec_id", "v", "seen"])

    def run(here: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(here) and len(asked):
            points = Distinct(*_columns(here, width, prefix))
            files = InvertedFiles(points.orders, len(pivots))
            budget = min(files.n, max(LEAST, int(np.ceil(SHARE * files.n))))
            for number, query, vector, seen in zip(asked["query"].to_numpy(), *_columns(asked, width, prefix), strict=True):
                near = files.footrule(seen)
                pick = np.flatnonzero(near <= np.partition(near, budget - 1)[budget - 1])
                found, score = points.nearest(pick, query, vector, k)
                out.append((np.full(len(found), number), np.full(len(found), query), found, score))
        return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    index = cut(usable.mapInArrow(represent, "vec_id long, v array<double>, seen binary"))
    # Written, so that the numbers of the query rows stay as they are when a task is lost.
    queries = cut(index.filter(F.col("vec_id") % every == 0).withColumn("query", F.monotonically_increasing_id()))
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-queries.count() // BLOCK))
    # Both sides' keys must have one type: an int and a bigint of equal value lie in different partitions.
    cell = lambda other: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    dealt = lambda column, salt, n: F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")
    rows = index.select(dealt("vec_id", 1, shards).alias("shard"), cell(blocks).alias("block"), "vec_id", "v", "seen")
    asked = queries.select(dealt("query", 2, blocks).alias("block"), cell(shards).alias("shard"), "query", "vec_id", "v", "seen")
    keys = ["shard", "block"]
    found = cut(rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query long, query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
