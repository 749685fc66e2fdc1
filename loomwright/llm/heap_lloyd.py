"""Product codes from Lloyd rounds that rescan only what may have moved (operator 13).

Vectors lie in blocks; a block keeps, for each part position and codebook
entry, a heap of its parts keyed by their slack: the distance to the second
nearest entry minus that to their own, when they were last scanned. Entries
that move use slack up: their own drift plus the largest drift of any other
entry, added up over the rounds. A part is popped and scanned exactly once the
drift since its scan reaches its slack; all others keep their entry without a
look at them. As keys hold the drift at the time of the push, no key changes.

A round reads the blocks, writes them again to the shared folder and adds up
what popped parts have moved between entries; sums are of integers, so codes
don't depend on partitions. The driver holds the codebooks only, whose size
is set by the vectors' length.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shared_folder

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
BLOCK = 4096  #: vectors of a block, at most
WIDEST = 1 << 26  #: components beyond this, once scaled, could make errors that no long holds
SURE = 1e-9  #: share of the distances by which slack is taken as less and drift as more, above any rounding

KINDS = "vec_ids array<long>, labels array<long>, vectors binary, codes binary, keys binary, places binary, part int, entry int, n long, sums array<long>"
SCHEMA = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("codes", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of ``x`` by entries), in doubles only while these hold every intermediate integer."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 52 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, ties to the lower index, and its slack: the distance to the second nearest less that to the nearest, a little less than true."""
    entry, slack = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for at in range(0, len(x), 1024):
        d = squares(x[at : at + 1024], book)
        rows = np.arange(len(d))
        entry[at : at + 1024] = own = d.argmin(1)
        if len(book) > 1:
            u = np.sqrt(d[rows, own].astype(np.float64))
            d[rows, own] = d.max() + 1
            second = np.sqrt(d.min(1).astype(np.float64))
            slack[at : at + 1024] = second - u - SURE * (second + u + 1)
    return entry, slack


class Codebooks:
    """Entries of all parts, and the drift that each entry's parts have seen up to now."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries  # parts, entries, length of a part
        self.drift = np.zeros(entries.shape[:2])
        self.sums, self.counts = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)

    def move(self, moved: list) -> None:
        """Take in what has come to and gone from entries; each used entry becomes the floor of its parts' mean."""
        for part, entry, n, sums in moved:
            self.counts[part, entry] += n
            self.sums[part, entry] += np.array(sums, np.int64)
        used = self.counts > 0
        new = np.where(used[:, :, None], self.sums // np.maximum(self.counts, 1)[:, :, None], self.entries)
        step = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(2))
        for part, each in enumerate(step):
            most = int(each.argmax())
            other = np.full(len(each), each[most])
            other[most] = np.delete(each, most).max(initial=0.0)
            self.drift[part] += (each + other) * (1 + SURE) + SURE
        self.entries = new


def fixed(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors take part, their scaled integers): not null, of the given length, of finite components within range."""
    flat = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) * SCALE)
    fine = (sizes == length) & (length > 0) & np.asarray(column.is_valid())
    at = np.flatnonzero(fine)
    x = values[starts[at][:, None] + np.arange(length)] if len(at) else np.zeros((0, length))
    sound = (np.abs(x) <= WIDEST).all(1)  # false for NaN
    return at[sound], x[sound].astype(np.int64)


def parted(x: np.ndarray) -> np.ndarray:
    """Vectors cut into PARTS equal consecutive parts (part, row, place); a length that is no multiple is filled up with zeros."""
    width = -(-x.shape[1] // PARTS)
    full = np.zeros((len(x), width * PARTS), np.int64)
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), PARTS, width).swapaxes(0, 1)


class Sums:
    """What a task's parts bring to and take from entries."""

    def __init__(self, books: Codebooks) -> None:
        self.sums, self.counts = np.zeros_like(books.sums), np.zeros_like(books.counts)

    def add(self, part: int, entries: np.ndarray, x: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part], entries, sign * x)
        np.add.at(self.counts[part], entries, sign)

    def rows(self) -> Iterator[dict]:
        for part, entry in zip(*np.nonzero((self.counts != 0) | (self.sums != 0).any(2)), strict=True):
            yield {"part": int(part), "entry": int(entry), "n": int(self.counts[part, entry]), "sums": self.sums[part, entry].tolist()}


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def heaped(codes: np.ndarray, keys: np.ndarray, n: int) -> list[list[tuple[float, int]]]:
    """A heap of (key, row) for each entry."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for entry, key, row in zip(codes.tolist(), keys.tolist(), range(len(codes)), strict=True):
        heaps[entry].append((key, row))
    for h in heaps:
        heapq.heapify(h)
    return heaps


def stored(heaps: list) -> tuple[bytes, bytes]:
    """All heaps of a part in their own order, entry by entry: keys, and rows."""
    flat = [x for h in heaps for x in h]
    return np.array([k for k, _ in flat], np.float64).tobytes(), np.array([i for _, i in flat], np.int32).tobytes()


def loaded(codes: np.ndarray, keys: np.ndarray, places: np.ndarray, n: int) -> list[list[tuple[float, int]]]:
    """The heaps as they were stored; each one's length is the number of parts with its entry."""
    ends = np.cumsum(np.bincount(codes, minlength=n)).tolist()
    pairs = list(zip(keys.tolist(), places.tolist(), strict=True))
    return [pairs[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def rescan(x: np.ndarray, codes: np.ndarray, heaps: list, book: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Pop every part whose slack the drift has used up and scan it exactly; ``codes`` and ``heaps`` change in place. The rows scanned."""
    popped = []
    for heap, gone in zip(heaps, drift.tolist(), strict=True):
        while heap and heap[0][0] <= gone:
            popped.append(heapq.heappop(heap)[1])
    rows = np.array(popped, np.int64)
    if len(rows):
        codes[rows], slack = nearest(x[rows], book)
        for row, entry, key in zip(popped, codes[rows].tolist(), (slack + drift[codes[rows]]).tolist(), strict=True):
            heapq.heappush(heaps[entry], (key, row))
    return rows


def _first(books: Codebooks, length: int):
    """The first scan: rows to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(books)
        for whole in batches:
            for start in range(0, len(whole), BLOCK):
                batch = whole.slice(start, BLOCK)
                at, x = fixed(batch.column("embedding"), length)
                if not len(at):
                    continue
                codes, keys, places = [], [], []
                for part, own in enumerate(parted(x)):
                    entry, slack = nearest(own, books.entries[part])
                    sums.add(part, entry, own, 1)
                    k, p = stored(heaped(entry, slack, books.entries.shape[1]))
                    codes.append(entry.astype(np.uint8).tobytes())
                    keys.append(k)
                    places.append(p)
                ids = [batch.column(c).take(pa.array(at)).to_pylist() for c in ("vec_id", "label")]
                yield batch_of([{"vec_ids": ids[0], "labels": ids[1], "vectors": x.astype(np.int32).tobytes(), "codes": b"".join(codes), "keys": b"".join(keys), "places": b"".join(places)}])
        yield batch_of(list(sums.rows()))
        release()

    return run


def _block(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(row["vec_ids"])
    x = parted(np.frombuffer(row["vectors"], np.int32).reshape(n, length).astype(np.int64))
    return x, np.frombuffer(row["codes"], np.uint8).reshape(PARTS, n).astype(np.int64)


def _again(books: Codebooks, length: int):
    """A later scan of blocks: pop, rescan, push."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(books)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                x, codes = _block(row, length)
                n = codes.shape[1]
                keys, places = np.frombuffer(row["keys"], np.float64).reshape(PARTS, n), np.frombuffer(row["places"], np.int32).reshape(PARTS, n)
                ks, ps = [], []
                for part in range(PARTS):
                    heaps = loaded(codes[part], keys[part], places[part], books.entries.shape[1])
                    before = codes[part].copy()
                    rows = rescan(x[part], codes[part], heaps, books.entries[part], books.drift[part])
                    rows = rows[before[rows] != codes[part][rows]]
                    sums.add(part, before[rows], x[part][rows], -1)
                    sums.add(part, codes[part][rows], x[part][rows], 1)
                    k, p = stored(heaps)
                    ks.append(k)
                    ps.append(p)
                yield batch_of([row | {"codes": codes.astype(np.uint8).tobytes(), "keys": b"".join(ks), "places": b"".join(ps)}])
        yield batch_of(list(sums.rows()))
        release()

    return run


CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def _coded(books: Codebooks, length: int):
    """Blocks to rows: each vector's code and exact error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                x, codes = _block(row, length)
                error = sum(((x[p] - books.entries[p][codes[p]]) ** 2).sum(1) for p in range(PARTS))
                text = [codes[:, k].astype(np.uint8).tobytes().hex() for k in range(codes.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(text, pa.string()), pa.array(error, pa.int64())], schema=CODED)

    return run


def common_length(vectors: DataFrame) -> int:
    """The commonest length of vectors whose components are all finite, the smaller of equally common ones; 0 without any."""
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    top = vectors.filter(sound).groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return top[0]["n"] if top else 0


def first_entries(vectors: DataFrame, length: int, n: int = ENTRIES) -> np.ndarray:
    """Scaled vectors of the ``n`` smallest vec_ids that take part (of several rows with one id, the least vector); n rows at most."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = fixed(batch.column("embedding"), length)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(list(x), pa.list_(pa.int64()))], ["vec_id", "x"])

    kept = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL")
    scaled = kept.mapInArrow(keep, "vec_id long, x array<long>")
    last = scaled.select("vec_id").distinct().orderBy("vec_id").limit(n).agg(F.max("vec_id")).collect()[0][0]
    if last is None:
        return np.zeros((0, length), np.int64)
    rows = kept.filter(F.col("vec_id") <= last).mapInArrow(keep, "vec_id long, x array<long>").groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    return np.array([r["x"] for r in rows], np.int64)


def product_codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks by part, entry and place) after ``rounds`` rounds and a last assignment.

    ``vectors`` has vec_id, embedding (numbers) and label; other columns are
    ignored. Rows take no part whose vector is null, holds null or non-finite
    components or one beyond WIDEST / SCALE = 65,536, or is not of the
    commonest length. Each other row has a code, repeated rows and null ids
    too, but null ids seed no entry. With fewer ids than ENTRIES codebooks have
    fewer entries; without any row both results are empty. Lengths that are no
    multiple of PARTS are filled up with zeros.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    length = common_length(rows)
    first = first_entries(rows, length)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, label long, code string, error long"), np.zeros((PARTS, 0, 0), np.int64)
    books = Codebooks(parted(first))
    folder = f"{shared_folder(spark)}/heap-lloyd-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    width = books.entries.shape[2]
    scanned = rows.mapInArrow(_first(books, length), KINDS)
    for k in range(rounds + 1):
        at = f"{folder}/{k}"
        scanned.withColumn("kind", F.when(F.col("part").isNull(), "block").otherwise("sums")).write.partitionBy("kind").parquet(at)
        if k:
            files.delete(path(f"{folder}/{k - 1}"), True)
        blocks = spark.read.schema(KINDS).parquet(f"{at}/kind=block")
        if k < rounds:
            # In a round without moves no sums are written.
            there = files.exists(path(f"{at}/kind=sums"))
            moved = spark.read.schema(KINDS).parquet(f"{at}/kind=sums").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect() if there else []
            books.move([(r[0], r[1], r[2], r[3:]) for r in moved])
            scanned = blocks.mapInArrow(_again(books, length), KINDS)
    blocks.mapInArrow(_coded(books, length), "vec_id long, label long, code string, error long").write.parquet(f"{folder}/codes")
    files.delete(path(f"{folder}/{rounds}"), True)
    return spark.read.parquet(f"{folder}/codes"), books.entries


def codebook_digest(entries: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Per vector that takes part: vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    codes, entries = product_codes(vectors)
    labels = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = codes.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(entries)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL: a table of parts, and for each round one of codes and one of entries."""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS (SELECT vec_id, label, p, list_slice(v, CAST(p * len(v) / {PARTS} + 1 AS BIGINT), CAST((p + 1) * len(v) / {PARTS} AS BIGINT)) AS x FROM kept, range({PARTS}) t(p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    square = "list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        steps.append(f"near{k} AS (SELECT vec_id, p, min({{'d': {square}, 'e': e}}) AS best FROM parts a JOIN book{k} b USING (p) GROUP BY vec_id, p)")
        if k < rounds:
            steps.append(f"moved{k} AS (SELECT p, n.best.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k} n JOIN parts USING (vec_id, p))")
            steps.append(f"mean{k} AS (SELECT p, e, list(y ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM moved{k} GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)")
    steps.append(f"coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})")
    return f"WITH {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"
