"""Clicks credited with sales in a stateful stream (operator 11).

Clicks and sales arrive in batches, each a start of one streaming query on one
checkpoint. Its state is an interval join of clicks and sales by client and
time, held until the watermark closes a sale; what it emits then are partial
results (number of clicks, latest click), never pairs, which the sink puts
together for each sale. Time is cut into cells of ``WIDTH``. A sale reaches
back ``REACH``, a whole number of cells, so it sees the end of one cell, the
start of another, and all cells between:

* Clicks of the two outer cells are found by binary search. Rows are dealt to
  buckets by client and the cell's place within ``REACH``, which is the same for
  both, so a click is sent and held once, and a client with any share of all
  rows is spread over as many buckets as there are cells in ``REACH``.
* For the cells between, clicks are added up by cell before they are dealt out
  by client, and sales ask once for each cell: a client has no more of these
  rows than there are cells in the batch's time.

Buckets hold thousands of rows and keep their state as one value of packed
arrays, as a call to the state store for each sale would cost more than all
else. The store is the one in the executor's heap: a RocksDB store leaves
half a MB of native statistics behind each time that it is opened, and a start
opens one for each partition. The watermark is made from the batches
themselves, in microseconds: Spark's own is in milliseconds and forgets on a
restart how far each side had come. A clock row in every batch wakes all
buckets, also if nothing else comes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import shared_folder, splitmix, tasks

BATCHES = 12
HOUR = 3_600_000_000
DELAY, REACH = 6 * HOUR, 7 * 24 * HOUR
WIDTH = HOUR // 6  #: microseconds of a cell
CELLS = REACH // WIDTH
LATE_HOURS = 240  #: a quarter of the rows arrives so much later
BUCKET_ROWS = 8000  #: rows of a batch in one bucket, about
PART_BUCKETS = 8  #: buckets in a partition of the state, about
NEVER, ALWAYS = -(1 << 62), 1 << 62
MISSING = -(1 << 63)  #: stands for a null id inside the stream

CLOCK, CLICK, SALE = 0, 1, 2
ROW = "kind int, client long, t long, id long, n long, born int"
BEGIN, END = 1, 2  # what a click is for a sale: in its own cell, or CELLS cells before it
SOLD, CELL, ASK, LATE = 2, 3, 4, 5  # kinds of rows in buckets, besides CLOCK and CLICK
ROUTED = "bucket int, kind int, client long, t long, id long, n long"
STATE = "clicks binary, sales binary, cells binary, asks binary"
PARTIAL = "kind long, client long, cell long, id long, copies long, n long, t long, best long"
CLOSED = "sale_id long, late boolean, click_id long, n_clicks long"


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(F.col(column).cast("timestamp"))


def _hours(arrived: Column, key: Column) -> Column:
    """Whole hours of arrival; a quarter of the keys comes LATE_HOURS later."""
    late = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 0, F.lit(False))
    return F.floor(arrived / HOUR).cast("long") + F.when(late, LATE_HOURS).otherwise(0)


def staged(clicks: DataFrame, sales: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows of both tables that count, with their hours of arrival, and the extremes of the clicks' hours."""
    c = clicks.select(F.col("click_id").cast("long").alias("id"), micros(clicks, "ts").alias("t"), micros(clicks, "arrived_at").alias("arrived"), F.col("client_id").cast("long").alias("client"))
    c = c.filter("t IS NOT NULL AND arrived IS NOT NULL AND client IS NOT NULL").withColumn("h", _hours(F.col("arrived"), F.col("id"))).drop("arrived")
    s = sales.select(F.col("sale_id").cast("long").alias("id"), micros(sales, "sold_at").alias("t"), micros(sales, "arrived_at").alias("arrived"), F.col("client_id").cast("long").alias("client"))
    s = s.filter("t IS NOT NULL AND arrived IS NOT NULL AND client IS NOT NULL").withColumn("h", _hours(F.col("arrived"), F.col("id"))).drop("arrived")
    low, high = c.agg(F.min("h"), F.max("h")).collect()[0]
    once = c.groupBy("id").agg(F.min(F.struct("h", "t", "client")).alias("x")).select("id", "x.*")
    return once, s, low or 0, high or 0


def in_batches(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """Rows of the stream with ``part``, their batch; equal sales of a batch are one row and their number."""
    c, s, low, high = staged(clicks, sales)
    part = F.floor(F.lit(BATCHES) * (F.col("h") - low) / (high - low + 1)).cast("int")
    number = F.coalesce(F.col("id"), F.lit(MISSING)).alias("id")
    c = c.select(F.lit(CLICK).alias("kind"), "client", "t", number, F.lit(1).cast("long").alias("n"), part.alias("born"))
    s = s.select("client", "t", number, F.least(F.lit(BATCHES - 1), F.greatest(F.lit(0), part)).alias("born"))
    s = s.groupBy("client", "t", "id", "born").agg(F.count("*").alias("n")).select(F.lit(SALE).alias("kind"), "client", "t", "id", "n", "born")
    return c.unionByName(s).withColumn("part", F.col("born"))


def watermarks(furthest: list) -> list[int]:
    """Of (batch, kind, latest time) rows: for each batch the watermark that earlier batches have brought, and at last one that closes all."""
    out, seen = [], {}
    by = {(b, k): t for b, k, t in furthest}
    for b in range(BATCHES):
        out.append(min(seen.values()) - DELAY if len(seen) == 2 else NEVER)
        for k in (CLICK, SALE):
            if (b, k) in by:
                seen[k] = max(seen.get(k, NEVER), by[b, k])
    return [*out, ALWAYS]


# Packed arrays: rows of whole numbers.


def packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


def unpacked(data: bytes | None, width: int) -> np.ndarray:
    return np.frombuffer(data or b"", np.int64).reshape(-1, width)


def numbered(*tables: np.ndarray) -> list[np.ndarray]:
    """A number for each row of each table, the same for equal rows, in their order."""
    rows = np.concatenate(tables)
    order = np.lexsort(rows.T[::-1])
    new = np.zeros(len(rows), np.int64)
    new[1:] = (np.diff(rows[order], axis=0) != 0).any(1)
    codes = np.empty(len(rows), np.int64)
    codes[order] = np.cumsum(new)
    return np.split(codes, np.cumsum([len(t) for t in tables])[:-1])


def best_by(codes: np.ndarray, n: np.ndarray, t: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code, ascending: the code, the sum of ``n``, and the latest ``t`` with its smallest id."""
    if not len(codes):
        return codes, n, t, ids
    order = np.lexsort((~ids, t, codes))
    codes = codes[order]
    last = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
    total = np.cumsum(n[order])[last]
    return codes[last], np.diff(total, prepend=0), t[order][last], ids[order][last]


def edges(clicks: np.ndarray, sales: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sale, of the clicks of its client and cell that it sees: their number, the latest one's time and its id.

    ``clicks`` are (client, cell, kind, t, id): of kind BEGIN in the sale's own
    cell, which count up to the sale; of kind END ``CELLS`` cells before it,
    which count from ``REACH`` before the sale on. ``sales`` begin with
    (client, cell, t).
    """
    n, t, ids = np.zeros(len(sales), np.int64), np.full(len(sales), NEVER), np.zeros(len(sales), np.int64)
    if not len(clicks) or not len(sales):
        return n, t, ids
    of_click, of_sale = numbered(clicks[:, :2], sales[:, :2])
    inside = sales[:, 2] - sales[:, 1] * WIDTH
    at = of_sale * WIDTH + inside
    for kind in (END, BEGIN):  # what BEGIN finds is later, so it comes last
        some = clicks[:, 2] == kind
        c = clicks[some]
        shifted = c[:, 3] + (REACH if kind == END else 0) - c[:, 1] * WIDTH
        key = of_click[some] * WIDTH + shifted
        order = np.lexsort((~c[:, 4], key))
        key, c = key[order], c[order]
        if kind == BEGIN:
            first, end = np.searchsorted(key, of_sale * WIDTH), np.searchsorted(key, at, "right")
        else:
            first, end = np.searchsorted(key, at), np.searchsorted(key, (of_sale + 1) * WIDTH)
        hit = end > first
        n += end - first
        t[hit], ids[hit] = c[end[hit] - 1, 3], c[end[hit] - 1, 4]
    return n, t, ids


def between(cells: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ask (client, cell): number of clicks in the CELLS - 1 cells before its own, the latest one's time and its id.

    ``cells`` are (client, home, cell, n, t, id), where home is the run of
    CELLS cells of the asks that they are for.
    """
    n, t, ids = np.zeros(len(asks), np.int64), np.full(len(asks), NEVER), np.zeros(len(asks), np.int64)
    if not len(cells) or not len(asks):
        return n, t, ids
    homes = np.stack((asks[:, 0], asks[:, 1] // CELLS), 1)
    of_cell, of_ask = numbered(cells[:, :2], homes)
    span = 2 * CELLS
    key = of_cell * span + cells[:, 2] - cells[:, 1] * CELLS + CELLS
    order = np.lexsort((~cells[:, 5], cells[:, 4], key))
    key, c = key[order], cells[order]
    total = np.concatenate(([0], np.cumsum(c[:, 3])))
    own = of_ask * span + asks[:, 1] - homes[:, 1] * CELLS + CELLS
    first, end = np.searchsorted(key, own - CELLS + 1), np.searchsorted(key, own)
    hit = end > first
    n[:] = total[end] - total[first]
    t[hit], ids[hit] = c[end[hit] - 1, 4], c[end[hit] - 1, 5]
    return n, t, ids


def route(watermark: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the stream to rows of buckets; clicks are added up by cell, sales ask once for a cell, clicks before the watermark are left out."""
    names = [x.split()[0] for x in ROUTED.split(", ")]

    def rows(kind: int, bucket, client, t, ids, n) -> pa.RecordBatch:
        columns = [np.broadcast_to(np.asarray(x, np.int32 if i < 2 else np.int64), len(t)) for i, x in enumerate((bucket, kind, client, t, ids, n))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    def bucket(client: np.ndarray, cell: np.ndarray | None = None) -> np.ndarray:
        h = splitmix(client.astype(np.uint64))
        if cell is not None:
            h = splitmix(h ^ (cell % CELLS + 1).astype(np.uint64))
        return h % np.uint64(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, client, t, ids, n = (np.asarray(b.column(c)) for c in ("kind", "client", "t", "id", "n"))
            cell = t // WIDTH
            if (kind == CLOCK).any():
                yield rows(CLOCK, np.arange(buckets), 0, np.zeros(buckets, np.int64), 0, 0)
            c = np.flatnonzero((kind == CLICK) & (t >= watermark))
            if len(c):
                yield rows(CLICK, bucket(client[c], cell[c]), client[c], t[c], ids[c], 1)
                (codes,) = numbered(np.stack((client[c], cell[c]), 1))
                _, total, best_t, best_id = best_by(codes, np.ones(len(c), np.int64), t[c], ids[c])
                who = client[c][np.unique(codes, return_index=True)[1]]
                yield rows(CELL, bucket(who), who, best_t, best_id, total)
            for which, late in ((SOLD, False), (LATE, True)):
                s = np.flatnonzero((kind == SALE) & ((t < watermark) == late))
                if len(s):
                    yield rows(which, bucket(client[s], cell[s]), client[s], t[s], ids[s], n[s])
            s = np.flatnonzero((kind == SALE) & (t >= watermark))
            if len(s):
                asks = np.unique(np.stack((client[s], cell[s]), 1), axis=0)
                yield rows(ASK, bucket(asks[:, 0]), asks[:, 0], asks[:, 1] * WIDTH, 0, 0)

    return run


def interval(watermark: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The join of a bucket: holds clicks and sales, and emits what the sales that the watermark has passed get from it."""
    alive = watermark // WIDTH  # the first cell that a sale to come, or one still open, may be in
    closing = (watermark - 1) // WIDTH  # the last cell with sales that close

    def partial(kind: int, client, cell, ids, copies, n, t, best) -> pd.DataFrame:
        names = [x.split()[0] for x in PARTIAL.split(", ")]
        return pd.DataFrame({k: np.broadcast_to(np.asarray(x, np.int64), len(client)) for k, x in zip(names, (kind, client, cell, ids, copies, n, t, best), strict=True)})

    def closed(sales: np.ndarray, clicks: np.ndarray) -> pd.DataFrame:
        cell = sales[:, 1] // WIDTH
        low, high = cell.min(), cell.max()
        views = []
        for kind, shift in ((BEGIN, 0), (END, CELLS)):
            seen = clicks[:, 1] // WIDTH + shift
            some = (seen >= low) & (seen <= high)
            c, seen = clicks[some], seen[some]
            views.append(np.stack((c[:, 0], seen, np.full(len(c), kind), c[:, 1], c[:, 2]), 1))
        n, t, best = edges(np.concatenate(views), np.stack((sales[:, 0], cell, sales[:, 1]), 1))
        return partial(SOLD, sales[:, 0], cell, sales[:, 2], sales[:, 3], n, t, best)

    def answered(asks: np.ndarray, cells: np.ndarray) -> pd.DataFrame:
        cell = cells[:, 2] // WIDTH
        some = (cell > asks[:, 1].min() - CELLS) & (cell < asks[:, 1].max())
        c, cell = cells[some], cell[some]
        near, far = cell // CELLS, (cell + CELLS - 1) // CELLS
        sums = np.concatenate([np.stack((c[:, 0], home, cell, c[:, 1], c[:, 2], c[:, 3]), 1)[pick] for home, pick in ((near, near == near), (far, far != near))])
        n, t, best = between(sums, asks)
        hit = n > 0
        return partial(ASK, asks[hit, 0], asks[hit, 1], 0, 0, n[hit], t[hit], best[hit])

    def run(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = np.concatenate([x[["kind", "client", "t", "id", "n"]].to_numpy(np.int64) for x in tables])
        pick = lambda kind, *columns: new[new[:, 0] == kind][:, columns]
        old = state.get if state.exists else (b"", b"", b"", b"")
        clicks, sales, cells, asks = (unpacked(x, width) for x, width in zip(old, (3, 4, 4, 2), strict=True))
        clicks = np.concatenate((clicks, pick(CLICK, 1, 2, 3)))  # client, t, id
        sales = np.concatenate((sales, pick(SOLD, 1, 2, 3, 4)))  # client, t, id, copies
        cells = np.concatenate((cells, pick(CELL, 1, 4, 2, 3)))  # client, n, latest t, id
        asks = np.concatenate((asks, pick(ASK, 1, 2) // (1, WIDTH)))  # client, cell
        late = pick(LATE, 1, 2, 3, 4)
        if len(late):
            yield partial(LATE, late[:, 0], late[:, 1] // WIDTH, late[:, 2], late[:, 3], 0, NEVER, MISSING)
        done = sales[:, 1] < watermark
        if done.any():
            yield closed(sales[done], clicks)
        due = asks[:, 1] <= closing
        if due.any():
            yield answered(np.unique(asks[due], axis=0), cells)
        keep = (clicks[clicks[:, 1] // WIDTH + CELLS >= alive], sales[~done], cells[cells[:, 2] // WIDTH + CELLS > alive], np.unique(asks[asks[:, 1] >= alive], axis=0))
        if watermark != ALWAYS and any(map(len, keep)):
            state.update(tuple(map(packed, keep)))
        elif state.exists:
            state.remove()

    return run


def attribution_stream(rows: DataFrame, watermark: int, buckets: int) -> DataFrame:
    """The streaming query of one start: rows of ROW to partial results (PARTIAL) of the sales that it emits."""
    return rows.mapInArrow(route(watermark, buckets), ROUTED).groupBy("bucket").applyInPandasWithState(interval(watermark), PARTIAL, STATE, "Append", GroupStateTimeout.NoTimeout)


def whole(partials: DataFrame) -> DataFrame:
    """Partial results of one batch to its closed and late sales (CLOSED): each sale gets what its own cells and the cells between have."""
    own = Window.partitionBy("client", "cell")
    df = partials.withColumn("mid", F.max(F.when(F.col("kind") == ASK, F.struct("t", "n", "best"))).over(own)).filter(F.col("kind") != ASK)
    late = F.col("kind") == LATE
    n = F.when(late, 0).otherwise(F.col("n") + F.coalesce("mid.n", F.lit(0)))
    click = F.when(F.col("mid.t") > F.col("t"), F.col("mid.best")).otherwise(F.col("best"))
    df = df.select(F.col("id").alias("sale_id"), late.alias("late"), F.when(n > 0, click).otherwise(MISSING).alias("click_id"), n.cast("long").alias("n_clicks"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return df.drop("copy")


SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    # A start has one micro-batch: a store that stayed open after it would only take memory.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _feed(spark: SparkSession, folder: str, marks: list[int], buckets: int) -> None:
    """Start the query for each batch in turn, with all batches up to it in sight, on one checkpoint."""
    for k, watermark in enumerate(marks):
        seen = ",".join(str(b) for b in range(k + 1))
        rows = spark.readStream.schema(ROW).parquet(f"{folder}/in/part={{{seen}}}")

        def write(batch: DataFrame, number: int, k: int = k) -> None:
            whole(batch).withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/out/{k}/{number}")

        query = attribution_stream(rows, watermark, buckets).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()


def attributed_sales(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """(sale_id, batch, late, click_id, n_clicks): each sale with its client's latest click in the seven days before.

    One row for each click_id is used (the first to arrive). Rows of either
    table without client, time or time of arrival take no part; null ids are
    ids like others. Repeated sales are a row each. Without clicks all sales
    close at the end. Other columns are ignored. All files are in a new folder
    of the shared one; only the result stays.
    """
    spark = clicks.sparkSession
    folder = f"{shared_folder(spark)}/attribution-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    spread = F.pmod(F.xxhash64("client", F.floor(F.col("t") / WIDTH)), F.lit(max(1, spark.sparkContext.defaultParallelism // 2, tasks(spark) // BATCHES)))
    # Clicks of a cell come together, so that they are added up in one place.
    in_batches(clicks, sales).repartition("part", spread).sortWithinPartitions("part", "kind", "client", "t").write.partitionBy("part").parquet(f"{folder}/in")
    clock = spark.createDataFrame([(CLOCK, 0, 0, 0, 0, b, b) for b in range(BATCHES + 1)], f"{ROW}, part int")
    clock.coalesce(1).write.mode("append").partitionBy("part").parquet(f"{folder}/in")
    furthest = spark.read.schema(f"{ROW}, part int").parquet(f"{folder}/in").filter(F.col("kind") != CLOCK).groupBy("part", "kind").agg(F.max("t").alias("t"), F.count("*").alias("rows")).collect()
    buckets = max(1, -(-sum(r["rows"] for r in furthest) // (BATCHES * BUCKET_ROWS)))
    parts = min(tasks(spark), max(spark.sparkContext.defaultParallelism, -(-buckets // PART_BUCKETS)))
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        _feed(spark, folder, watermarks([(r["part"], r["kind"], r["t"]) for r in furthest]), buckets)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name in ("in", "state"):
        files.delete(path(f"{folder}/{name}"), True)
    known = lambda c: F.when(F.col(c) != MISSING, F.col(c)).alias(c)
    return spark.read.schema(f"{CLOSED}, batch int").parquet(f"{folder}/out/*/*").select(known("sale_id"), "batch", "late", known("click_id"), "n_clicks")


_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))),
lambda r, b: list_reduce(list_prepend(xor(r, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""
_H = "CAST(floor(epoch_us(arrived_at) / 3600000000) AS BIGINT) + CASE WHEN " + _CRC + " % 4 = 0 THEN 240 ELSE 0 END AS h"
ORACLE = f"""
WITH c AS (SELECT DISTINCT ON (click_id) click_id, client_id, epoch_us(ts) AS t, {_H.format("CAST(click_id AS VARCHAR)")} FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS t, {_H.format("CAST(sale_id AS VARCHAR)")} FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
e AS (SELECT min(h) AS lo, max(h) AS hi FROM c),
cb AS (SELECT c.*, (12 * (h - lo)) // (hi - lo + 1) AS b FROM c, e),
sb AS (SELECT s.*, least(11, greatest(0, (12 * (h - lo)) // (hi - lo + 1))) AS b FROM s, e),
w AS (SELECT k AS b, CASE WHEN x.t IS NOT NULL AND y.t IS NOT NULL THEN least(x.t, y.t) - {DELAY} END AS mark FROM range(12) r(k),
LATERAL (SELECT max(t) AS t FROM cb WHERE b < k) x, LATERAL (SELECT max(t) AS t FROM sb WHERE b < k) y),
ok AS (SELECT cb.* FROM cb JOIN w USING (b) WHERE mark IS NULL OR t >= mark),
sm AS (SELECT sb.*, row_number() OVER () AS r, coalesce(t < mark, false) AS late FROM sb JOIN w USING (b)),
ends AS (SELECT sm.*, CASE WHEN late THEN b ELSE (SELECT coalesce(min(w.b), 12) FROM w WHERE w.b > sm.b AND sm.t < w.mark) END AS batch FROM sm),
found AS (SELECT r, count(*) AS n_clicks, max({{'t': k.t, 'i': -k.click_id}}) AS best FROM ends JOIN ok k ON NOT late AND k.client_id = ends.client_id AND k.t BETWEEN ends.t - {REACH} AND ends.t GROUP BY r)
SELECT sale_id, CAST(batch AS INTEGER) AS batch, late, -best.i AS click_id, coalesce(n_clicks, 0) AS n_clicks FROM ends LEFT JOIN found USING (r)
"""
