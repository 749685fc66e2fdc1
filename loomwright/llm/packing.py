"""Best-fit packing by exact-complement hashing (operator 10).

Documents become pieces of at most ``capacity`` tokens. Only the number of
pieces of each length, at most ``capacity`` numbers, goes to the driver, which
packs lengths instead of pieces: a plan says how many sequences hold which
lengths. Each piece then takes the slot that its rank among the pieces of its
length has in the plan. Ranks come from counts by (length, bucket) and row
numbers inside a bucket, so no task holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_pieces, text_or_empty
from .tokens import _encoded, texts_in, vocabulary

#: Pieces in a bucket of one length, about.
BUCKET = 1_000_000


class SumIndex:
    """Combinations of one, two and three lengths, hashed by their sum, under availability counts.

    Pairs lie by sum, the longest first length first; triples lie by sum as a
    third length and the sum of a pair, the shortest third first. Counts only
    go down, so a combination that has run out is passed over for good.
    """

    def __init__(self, have: np.ndarray, capacity: int) -> None:
        self.have = have
        sizes = np.flatnonzero(have[:capacity])
        a, b = (x[::-1] for x in np.nonzero(np.tri(len(sizes), dtype=bool)))
        self.pairs, self.pair_at = self._by_sum(sizes[a], sizes[b], capacity)
        sums = np.flatnonzero(np.diff(self.pair_at))
        c, s = np.repeat(np.arange(len(sizes)), len(sums)), np.tile(np.arange(len(sums)), len(sizes))
        self.triples, self.triple_at = self._by_sum(sizes[c], sums[s], capacity)
        self.pair_next, self.triple_next = self.pair_at[:-1].tolist(), self.triple_at[:-1].tolist()

    @staticmethod
    def _by_sum(x: np.ndarray, y: np.ndarray, capacity: int) -> tuple[list[list[int]], np.ndarray]:
        """The rows (x, y) ordered by their sum, and where each sum up to ``capacity`` begins."""
        total = x + y
        rows = np.flatnonzero(total <= capacity)
        rows = rows[np.argsort(total[rows], kind="stable")]
        return np.stack([x[rows], y[rows]], 1).tolist(), np.searchsorted(total[rows], np.arange(capacity + 2))

    def single(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        return (total,) if self.have[total] > held.count(total) else None

    def pair(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        at, end = self.pair_next[total], self.pair_at[total + 1]
        while at < end and not self._left(self.pairs[at]):
            at += 1
        self.pair_next[total] = at
        return next((tuple(two) for two in self.pairs[at:end] if all(self.have[x] > held.count(x) + (k and two[0] == x) for k, x in enumerate(two))), None)

    def triple(self, total: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        at, end = self.triple_next[total], self.triple_at[total + 1]
        gone = True
        for k in range(at, end):
            third, rest = self.triples[k]
            ran_out = not self.have[third] or self.pair_next[rest] == self.pair_at[rest + 1]
            if gone and ran_out:
                self.triple_next[total] = k + 1
            gone &= ran_out
            if not ran_out and self.have[third] > held.count(third) and (two := self.pair(rest, (*held, third))):
                return (*two, third)
        return None

    def _left(self, two: list[int]) -> bool:
        return self.have[two[0]] > (two[0] == two[1]) and self.have[two[1]] > 0

    def filling(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths with this sum that are available besides those held."""
        return self.single(gap, held) or self.pair(gap, held) or self.triple(gap, held)


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold exactly these) for ``counts`` pieces of each length.

    From the longest length down, gaps are filled exactly by a combination of
    one, two or three available lengths from the index; what stays is packed
    best fit, longest first.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    index = SumIndex(have, capacity)
    for length in range(capacity, 0, -1):
        while have[length]:
            rest = () if length == capacity else index.filling(capacity - length, (length,))
            if rest is None:
                break
            used = (length, *rest)
            need = {x: used.count(x) for x in used}
            n = min(int(have[x]) // k for x, k in need.items())
            for x, k in need.items():
                have[x] -= n * k
            plan[used] += n

    bins: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, number of sequences]
    open_gaps = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            fits = np.flatnonzero(open_gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                used, n = bins[gap][-1]
                take = min(left, n)
                if take == n:
                    bins[gap].pop()
                    open_gaps[gap] = bool(bins[gap])
                else:
                    bins[gap][-1][1] -= take
                left -= take
            else:
                used, gap, k = (), capacity, capacity // length
                take = max(1, left // k)
                fill = min(k, left)
                left -= take * fill
                used, gap = (length,) * (fill - 1), capacity - length * (fill - 1)
            bins[gap - length].append([(*used, length), take])
            open_gaps[gap - length] = True
    for group in bins.values():
        for used, n in group:
            plan[used] += n
    return sorted(plan.items(), reverse=True)


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length, with the sequence of each range's first rank and the offset there."""
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            rows.append((length << 44 | used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    key, seq, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return {"key": key, "sequence": seq, "offset": offset}


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row's whole text, ``end_id`` at its end.

    Texts of more than ``capacity`` tokens are cut into pieces of ``capacity``;
    the first one takes the remainder. A null or empty text is one piece, the
    end token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        for batch in batches:
            texts = texts_in(batch)
            for begin, _, ids, to in _encoded(texts, shared.value):
                ids = np.insert(ids, to[1:], end_id).astype("<u4")
                to = to + np.arange(len(to))
                n = np.diff(to)
                first = np.where(n % capacity == 0, np.minimum(n, capacity), n % capacity)
                pieces = 1 + (n - first) // capacity
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                raw = memoryview(ids.tobytes())
                at = 4 * (to[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                ids_of = batch.column("doc_id").take(pa.array(begin + doc))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(in_pieces(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Each piece of ``docs`` (see ``token_pieces``) with its sequence_id and offset.

    Sequences hold at most ``capacity`` tokens and have no gaps. An empty table
    gives no rows; repeated rows are packed as often as they come.
    """
    # Tokenized once; the row number is stored, so that a lost task finds the same numbers again.
    pieces = cut(token_pieces(docs, path, capacity, end_id).withColumn("at", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(pack_counts(counts, capacity))
    buckets = 16 + max(counts.values(), default=0) // BUCKET
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("at")).cast("long") + F.col("before") - 1
    ranked = pieces.join(before, ["length", "bucket"]).withColumn("rank", rank)

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        want = (length.to_numpy() << 44) | rank.to_numpy()
        at = np.searchsorted(table["key"], want, "right") - 1
        return pa.StructArray.from_arrays([pa.array(table["sequence"][at] + want - table["key"][at]), pa.array(table["offset"][at])], ["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    return ranked.withColumn("slot", F.arrow_udf(place, "sequence_id long, offset long")("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")
