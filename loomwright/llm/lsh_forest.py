"""Near duplicates with an LSH forest over MinHash signatures (operator 4).

Each distinct set of shingles has a signature of ``TREES * DEPTH`` minima. A
tree of the forest orders the signatures from its own starting minimum on.
Sets that agree on a tree's first ``DEPTH`` minima (fewer for a limit below 85)
form a region of it. The
orders of all trees are cut into ranges, one for each task, and neighbours are
found by going along a range and once more across the ends of ranges. In a
small region every two sets are candidates. In a larger one the order goes on
to deeper minima, and a set's candidates are the neighbours with the longest
common prefix. Candidates whose signatures agree on too few minima are left
out; the others are confirmed on their full sets.

Neighbours alone could miss a link of a large region. So, once components are
known, every larger region that still holds sets of several components is
settled by an exact prefix filter on the rarest shingles of the sets: those
outside a region's commonest component meet the others only where a link is
still possible, and such pairs are confirmed on full sets.

A pair with similarity 0.85 shares no region with probability
(1 - 0.85**4)**20 = 4e-7, and agrees on fewer than 50 of 80 minima with
probability 1e-7. For a limit of 0.8 regions are of 3 minima and 45 must be
shared: (1 - 0.8**3)**20 = 6e-7, and 4e-07.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, merged, settled, splitmix, text_or_empty, word_hashes
from .components import components

TREES, DEPTH = 20, 4
MINIMA = TREES * DEPTH
AGREE = 50  #: minima that a candidate pair must share
MISS = 1e-6  #: at most so often a pair at the limit shares no region, or too few minima, where the limit is below 85
SMALL = 8  #: sets of a region whose pairs are all candidates
NEAR = 2  #: neighbours in the order of a larger region
TEXT = 1 << 19  #: bytes of text hashed at once

_PLACES = splitmix(np.arange(1001, 1100, dtype=np.uint64)) | np.uint64(1)
_SCALE = (splitmix(np.arange(5001, 5001 + MINIMA, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (splitmix(np.arange(9001, 9001 + MINIMA, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def bounds(percent: int) -> tuple[int, int]:
    """Minima of a region, and minima that a candidate pair must share: DEPTH and AGREE for 85 and more, else the most that keep to MISS."""
    if percent >= 85:
        return DEPTH, AGREE
    p = percent / 100
    depth = max([d for d in range(1, DEPTH + 1) if (1 - p**d) ** TREES <= MISS], default=1)
    fewer = np.cumsum([math.comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k) for k in range(MINIMA + 1)])
    return depth, int((fewer <= MISS).sum())


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its runs of ``words`` words (all words, if fewer)."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(data):
        to, size = at, 0
        while to < len(data) and (to == at or size + len(data[to]) < TEXT):
            size += len(data[to]) + 1
            to += 1
        out += _sets(data[at:to], words)
        at = to
    return out


def _sets(data: list[bytes], words: int) -> list[np.ndarray]:
    h, first = word_hashes(data)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - words + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(words):
            runs += h[k : k + n] * _PLACES[k]
        runs = splitmix(runs)
        out = []
        for b, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - b >= words:
                out.append(np.unique(runs[b : e - words + 1]))
            elif e > b:
                out.append(splitmix(np.array([(h[b:e] * _PLACES[: e - b]).sum(dtype=np.uint64) + _PLACES[50 + e - b]], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """MINIMA big-endian 32-bit minima of each set, so that bytes sort as numbers do; empty for an empty set."""
    out = []
    for s in sets:
        if not len(s):
            out.append(b"")
            continue
        best = None
        x = (s >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(x), 4096):
            least = (x[k : k + 4096, None] * _SCALE + _SHIFT).min(0)
            best = least if best is None else np.minimum(best, least)
        out.append(best.astype(">u4").tobytes())
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for at in range(0, len(texts), 512):
            sets = shingle_sets(texts[at : at + 512])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 512), batch.column(2).slice(at, 512), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array(signatures(sets), pa.binary())],
                ["doc_id", "key", "n", "print", "signature"],
            )


def _full_sets(batches):
    for batch in batches:
        ids, prints, texts = (batch.column(i).to_pylist() for i in range(3))
        for at in range(0, len(texts), 512):
            sets = shingle_sets([t or "" for t in texts[at : at + 512]])
            keep = [(i, s.view(np.int64)) for i, p, s in zip(ids[at : at + 512], prints[at : at + 512], sets, strict=True) if fingerprint(s) == p]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.int64()), pa.array([s for _, s in keep], pa.list_(pa.int64()))], ["node", "shingles"])


def _agreeing(least: int):
    """Keeps the pairs whose signatures agree on ``least`` minima."""

    def run(batches):
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((p == q).sum(1) >= least))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and what else they carry) whose full sets are similar enough."""
    both = merged(merged(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter((100 + percent) * common >= percent * (F.size("x") + F.size("y"))).select(*pairs.columns)


_WALKED = "kind string, region long, deeper binary, node long, n long, other long"


def _walk(percent: int):
    """Goes along one range of the trees' orders.

    Gives the candidate ``pair``s of sets of one region, the members of larger
    regions (``crowd``), and the first and last SMALL sets of the range
    (``edge``), where a region may go on in another range. Sets within SMALL
    places tell whether a region is larger, so no more are held.
    """

    def rows(kind: str, batch: pa.RecordBatch, at: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        taken = batch.take(pa.array(at))
        deeper = taken.column("deeper") if kind == "edge" else pa.nulls(len(at), pa.binary())
        to = pa.nulls(len(at), pa.int64()) if other is None else batch.column("node").take(pa.array(other))
        columns = [pa.repeat(kind, len(at)), taken.column("region"), deeper, taken.column("node"), taken.column("n"), to]
        return pa.RecordBatch.from_arrays(columns, ["kind", "region", "deeper", "node", "n", "other"])

    def visit(batch: pa.RecordBatch, lo: int, hi: int):
        """Pairs of the rows lo to hi with later ones, and which of them are in larger regions."""
        region, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "n"))
        together = np.ones(len(n), np.int64)
        same = [region[: max(0, len(n) - k)] == region[k:] for k in range(SMALL + 1)]
        for k in range(1, SMALL + 1):
            together[: len(same[k])] += same[k]
            together[len(n) - len(same[k]) :] += same[k]
        crowd = together > SMALL
        for k in range(1, SMALL):
            at = lo + np.flatnonzero(same[k][lo:hi])
            if k > NEAR:
                at = at[~crowd[at]]
            at = at[100 * np.minimum(n[at], n[at + k]) >= percent * np.maximum(n[at], n[at + k])]
            yield rows("pair", batch, at, at + k)
        yield rows("crowd", batch, lo + np.flatnonzero(crowd[lo:hi]))

    def run(batches):
        held, lo, seen = None, 0, 0  # rows kept, how many of them are done, rows of this range before ``held``
        for batch in batches:
            if held is not None:
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(held.columns, batch.columns, strict=True)], batch.schema.names)
            hi = max(lo, len(batch) - SMALL)
            yield from visit(batch, lo, hi)
            yield rows("edge", batch, np.arange(lo, min(hi, SMALL - seen)))
            begin = max(0, hi - SMALL)
            held, lo, seen = batch.slice(begin), hi - begin, seen + begin
        if held is not None:
            yield from visit(held, lo, len(held))
            yield rows("edge", held, np.arange(lo, len(held)))

    return run


def _across(edges: DataFrame, percent: int) -> DataFrame:
    """Pairs and larger regions among the sets at the ends of ranges.

    A small region that several ranges share lies here as a whole, and of a
    larger one enough to tell that it is larger. There are at most 2 * SMALL
    rows for each range.
    """
    whole, ordered = Window.partitionBy("region"), Window.partitionBy("region").orderBy("deeper", "node")
    near = [F.lead(F.struct("node", "n"), k).over(ordered) for k in range(1, SMALL)]
    rows = edges.select("region", "node", "n", F.count("*").over(whole).alias("size"), F.array(*near).alias("near"))
    close = "filter(near, (x, i) -> x IS NOT NULL AND (size <= {0} OR i < {1}) AND 100 * least(n, x.n) >= {2} * greatest(n, x.n))".format(SMALL, NEAR, percent)
    pairs = rows.select(F.lit("pair").alias("kind"), "region", "node", F.explode(F.expr(close)).alias("x")).select("kind", "region", "node", F.col("x.node").alias("other"))
    return pairs.unionByName(rows.filter(f"size > {SMALL}").select(F.lit("crowd").alias("kind"), "region", "node", F.lit(None).cast("long").alias("other")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``.

    A row without doc_id takes no part: its component_id is null and it is
    kept. Rows without words are linked with nothing, not even each other, so
    each is its own component. Repeated rows get the same component. An empty
    table gives no rows.
    """
    return classes(docs, percent).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def classes(docs: DataFrame, percent: int = 85, key: Column | None = None) -> DataFrame:
    """doc_id, key, n_shingles, component_id and component of each row of ``docs``.

    ``component`` tells components apart where two of them have the same
    smallest doc_id; it is null for a row that takes no part or has no words.
    ``key`` (null by default) is handed on, to find a row again.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (F.lit(None) if key is None else key).cast("binary").alias("key"))
    signed = settled(source.mapInArrow(in_pieces(_sign), "doc_id long, key binary, n long, print binary, signature binary").withColumn("at", F.monotonically_increasing_id()))
    some = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # One node for each distinct set: copies never meet in a pair.
    nodes = settled(some.groupBy("print").agg(F.min("at").alias("node"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")))

    depth, agree = bounds(percent)
    twice = F.concat("signature", "signature")
    trees = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(t), F.substring("signature", 4 * DEPTH * t + 1, 4 * depth)).alias("region"), F.substring(twice, 4 * (DEPTH * t + depth) + 1, 16).alias("deeper")) for t in range(TREES)]))
    posted = nodes.select("node", "n", trees.alias("t")).select("t.region", "t.deeper", "node", "n")
    # The trees' orders are cut into ranges, so that a region with very many sets lies in several tasks.
    order = ["region", "deeper", "node"]
    walked = settled(posted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk(percent), _WALKED))
    met = walked.drop("deeper", "n").unionByName(_across(walked.filter("kind = 'edge'"), percent))
    found = met.filter("kind = 'pair'").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    signs = nodes.select("node", "signature")
    pairs = merged(merged(found, signs.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a"), signs.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    pairs = settled(pairs.select("a", "b", "sa", "sb").mapInArrow(_agreeing(agree), "a long, b long"))

    crowds = met.filter("kind = 'crowd'").select("region", "node").distinct()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowds.select("node")).distinct()
    wanted = merged(needed, nodes.select("node", "doc_id", "print"), "node")
    sets = merged(source, wanted, "doc_id").select("node", "print", "text").mapInArrow(in_pieces(_full_sets), "node long, shingles array<long>")
    sets = settled(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))

    roots = components(_confirmed(pairs, sets, percent))
    # Links found late join whole components, so only these are gone through again.
    above = components(_confirmed(_rest(crowds, roots, sets, percent), sets, percent), "root_a", "root_b")
    above = above.select(F.col("node").alias("root"), F.col("root").alias("top"))

    # A component or a group of copies can hold a third of all rows; it is then the long side of these joins, which adaptive
    # execution splits. It can do so as the short side is read from a table (here and in _rest) or shuffled, not aggregated in place.
    rooted = merged(merged(nodes, roots, "node", "left").withColumn("root", F.coalesce("root", "node")), above, "root", "left").select("print", "doc_id", F.coalesce("top", "root").alias("component"))
    least = settled(rooted.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = merged(rooted, least, "component").select("print", "component_id", "component")
    columns = ["doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "component"]
    alone = signed.filter("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    return merged(some, named, "print").select(*columns).unionByName(alone.select(*columns))


def _rest(crowds: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of sets in larger regions that may be linked and are not in one component yet.

    An exact prefix filter over the sets of all regions that hold several
    components, one side outside its region's commonest component. Each set's
    shingles are ordered from the rarest on. Of two linked sets, the first
    common shingle lies among the first n - percent * n / 100 + 1 of each, and
    all common ones are among those from there on; so pairs are only formed on
    shingles of these prefixes, and only where enough shingles are left behind
    the place. Shingles of one set alone take places but are never posted.
    """
    member = merged(crowds, roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root"))
    share = member.groupBy("region", "root").agg(F.count("*").alias("n"))
    mixed = settled(share.groupBy("region").agg(F.count("*").alias("groups"), F.max(F.struct("n", "root")).alias("most")).filter("groups > 1").select("region", F.col("most.root").alias("main")))
    open_sets = merged(member, mixed, "region").groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("outside"))
    open_sets = settled(merged(open_sets, sets, "node"))
    shingles = open_sets.select("node", F.explode("shingles").alias("shingle"))
    times = settled(shingles.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1"))
    ordered = merged(shingles, times, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("known"))
    placed = merged(open_sets.select("node", "root", "outside", F.size("shingles").cast("long").alias("n")), ordered, "node").withColumn("alone", F.col("n") - F.size("known"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    posted = placed.filter(prefix > 0).select("node", "root", "outside", "n", "alone", F.posexplode(F.slice("known", F.lit(1), prefix.cast("int"))).alias("k", "x"))
    posted = settled(posted.select("node", "root", "outside", "n", F.col("x.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("k")).alias("left")))
    l, r = posted.filter("outside").alias("l"), posted.alias("r")
    may = F.expr(
        f"l.root <> r.root AND (NOT r.outside OR l.node < r.node) AND 100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) "
        f"AND (100 + {percent}) * least(l.left, r.left) >= {percent} * (l.n + r.n)"
    )
    return merged(l, r, (F.col("l.shingle") == F.col("r.shingle")) & may).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.root").alias("root_a"), F.col("r.root").alias("root_b")).distinct()
