"""Click attribution, common lines and vector codes against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import oracle_rows, rows_of
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loomwright.llm import attribution, heap_lloyd, line_dedup, queries

BEGIN = datetime(2024, 1, 1)


# Operator 11


def plain_attribution(clicks, sales):
    """The contract, batch by batch, with lists."""
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    hour = lambda arrived, i: us(arrived) // 3_600_000_000 + (240 if i is not None and zlib.crc32(str(i).encode()) % 4 == 0 else 0)
    once = {}
    for i, ts, arrived, client in clicks:
        if None not in (ts, arrived, client) and (i not in once or (hour(arrived, i), us(ts), client) < once[i]):
            once[i] = (hour(arrived, i), us(ts), client)
    hours = [h for h, _, _ in once.values()] or [0]
    low, high = min(hours), max(hours)
    batch = lambda h: min(11, max(0, 12 * (h - low) // (high - low + 1)))
    arriving = defaultdict(lambda: ([], []))
    for i, (h, t, c) in once.items():
        arriving[batch(h)][0].append((t, i, c))
    for i, client, sold, arrived in sales:
        if None not in (sold, arrived, client):
            arriving[batch(hour(arrived, i))][1].append((us(sold), i, client))
    out, held, open_sales, latest = [], [], [], {}
    six, week = 6 * 3_600_000_000, 7 * 24 * 3_600_000_000
    for k in range(13):
        mark = min(latest.values()) - six if len(latest) == 2 else None
        mark = 1 << 62 if k == 12 else mark
        cs, ss = arriving[k] if k < 12 else ([], [])
        held += [c for c in cs if mark is None or c[0] >= mark]
        for s in ss:
            if mark is not None and s[0] < mark:
                out.append((s[1], k, True, None, 0))
            else:
                open_sales.append(s)
        if mark is not None:
            for t, i, client in [s for s in open_sales if s[0] < mark]:
                mine = [(c[0], -c[1] if c[1] is not None else 1 << 63, c[1]) for c in held if c[2] == client and t - week <= c[0] <= t]
                out.append((i, k, False, max(mine)[2] if mine else None, len(mine)))
            open_sales = [s for s in open_sales if s[0] >= mark]
            held = [c for c in held if c[0] >= mark - week]
        for name, rows in (("c", cs), ("s", ss)):
            if rows:
                latest[name] = max(latest.get(name, rows[0][0]), max(r[0] for r in rows))
    return sorted(out, key=repr)


def attributed(spark, clicks, sales, extra=False):
    c = spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long")
    s = spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz")
    if extra:
        c, s = c.withColumns({"h": F.lit(1), "kind": F.lit("x"), "part": F.lit(2)}), s.withColumns({"n": F.lit(1), "bucket": F.lit("x")})
    return sorted((tuple(r) for r in attribution.attributed_sales(c, s).collect()), key=repr)


def test_attribution_of_odd_rows(spark):
    """One hot client, ties, repeated sales, null ids, late rows, cells of several sizes' worth of clicks and sales on cell borders."""
    rng = random.Random(8)
    cell = timedelta(minutes=10)
    clicks, sales = [], []
    for i in range(900):
        ts = BEGIN + rng.randrange(60 * 144) * cell + timedelta(microseconds=rng.choice((0, 1, 599_999_999, rng.randrange(600_000_000))))
        clicks.append((i, ts, ts + timedelta(hours=rng.choice((0, 0, 0, 30, 400))), rng.choice((1, 1, 1, 2, 3))))
    clicks += [clicks[5], clicks[6], (2000, None, BEGIN, 1), (2001, BEGIN, BEGIN, None), (2002, BEGIN, None, 1), (None, BEGIN + 100 * cell, BEGIN + 100 * cell, 1)]
    clicks += [(3000 + i, clicks[0][1], clicks[0][2], clicks[0][3]) for i in range(3)]
    for i in range(300):
        base = rng.choice(clicks[:900])[1] if rng.random() < 0.4 else BEGIN + rng.randrange(60 * 144) * cell
        sold = base + timedelta(days=rng.choice((0, 7, rng.random() * 9)))
        sales.append((i, rng.choice((1, 1, 2, 3, 4)), sold, sold + timedelta(hours=rng.choice((0, 0, 0, 50, 500)))))
    sales += [sales[3], sales[3], (None, 1, BEGIN + 200 * cell, BEGIN + 200 * cell), (9000, None, BEGIN, BEGIN), (9001, 1, None, BEGIN), (9002, 1, BEGIN, None)]
    got = attributed(spark, clicks, sales, extra=True)
    assert got == plain_attribution(clicks, sales)
    assert any(r[2] for r in got) and max(r[4] for r in got) > 30


def test_attribution_without_clicks(spark):
    sales = [(1, 1, BEGIN, BEGIN), (2, 2, BEGIN, BEGIN)]
    assert attributed(spark, [], sales) == [(1, 12, False, None, 0), (2, 12, False, None, 0)]


def test_partial_matches_equal_pairs():
    """Ends, starts and whole cells between add up to the interval."""
    rng = np.random.default_rng(1)
    week, width, cells = attribution.REACH, attribution.WIDTH, attribution.CELLS
    t = rng.integers(0, 3 * week, 3000)
    ids, client = rng.permutation(3000), rng.integers(0, 3, 3000)
    sold = np.concatenate((rng.integers(0, 3 * week, 200), t[:50], t[50:100] + week, t[100:110] + week + 1, t[110:120] - 1))
    who = rng.integers(0, 3, len(sold))
    cell = t // width
    clicks = np.concatenate([np.stack((client, cell + (cells if k == attribution.END else 0), np.full(3000, k), t, ids), 1) for k in (attribution.BEGIN, attribution.END)])
    sales = np.stack((who, sold // width, sold), 1)
    n, best_t, best_id = attribution.edges(clicks, sales)
    entries = np.concatenate([np.stack((client, home, cell, np.ones(3000, np.int64), t, ids), 1) for home in (cell // cells, (cell + cells - 1) // cells)])
    entries = np.unique(entries, axis=0)
    m, mid_t, mid_id = attribution.between(entries, sales[:, :2])
    for i in range(len(sold)):
        mine = [(a, -b) for a, b, c in zip(t, ids, client, strict=True) if c == who[i] and sold[i] - week <= a <= sold[i]]
        assert n[i] + m[i] == len(mine)
        if mine:
            assert max((best_t[i], -best_id[i]), (mid_t[i], -mid_id[i])) == max(mine)


def test_a_start_opens_one_store_a_partition_and_none_of_rocksdb(spark):
    """Spark leaves half a MB of native memory behind each time that a RocksDB store is opened, so executors grew with starts, partitions and stateful steps."""
    seen = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            seen.append([(s.operatorName, s.numShufflePartitions, [k for k in s.customMetrics if "rocksdb" in k.lower()]) for s in event.progress.stateOperators])

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    clicks = [(i, BEGIN + timedelta(hours=i), BEGIN + timedelta(hours=i), i % 3) for i in range(50)]
    sales = [(i, i % 3, BEGIN + timedelta(hours=i), BEGIN + timedelta(hours=i)) for i in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.streams.addListener(listener)
    try:
        assert attributed(spark, clicks, sales) == plain_attribution(clicks, sales)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    states = [x for x in seen if x]
    assert len(states) == attribution.BATCHES + 1
    assert all(len(x) == 1 and x[0][1] == 8 and not x[0][2] for x in states)


def test_clicks_are_dealt_once_and_one_client_to_many_buckets():
    """A click is one row and adds to one sum of its cell; late rows and the clock go where they belong."""
    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(-attribution.REACH, 3 * attribution.REACH, 4000))
    names = [x.split()[0] for x in attribution.ROW.split(", ")]
    kind = np.where(np.arange(4000) % 4 == 3, attribution.SALE, attribution.CLICK)
    kind[0] = attribution.CLOCK
    columns = (kind.astype(np.int32), np.full(4000, 7), t, np.arange(4000), np.ones(4000, np.int64), np.zeros(4000, np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)
    out = pa.Table.from_batches(list(attribution.route(0, 50)(iter([batch])))).to_pandas()
    of = {k: out[out["kind"] == k] for k in range(6)}
    on_time, clicks, sales = t >= 0, kind == attribution.CLICK, kind == attribution.SALE
    assert sorted(of[attribution.CLICK]["id"]) == np.flatnonzero(on_time & clicks).tolist() and of[attribution.CLICK]["bucket"].nunique() == 50
    assert of[attribution.CELL]["n"].sum() == len(of[attribution.CLICK]) and len(of[attribution.CELL]) == len(np.unique(t[on_time & clicks] // attribution.WIDTH))
    assert sorted(of[attribution.SOLD]["id"]) == np.flatnonzero(on_time & sales).tolist() and sorted(of[attribution.LATE]["id"]) == np.flatnonzero(~on_time & sales).tolist()
    assert sorted(of[attribution.CLOCK]["bucket"]) == list(range(50))
    again = out[out["kind"].isin((attribution.CLICK, attribution.SOLD))]
    assert (again.groupby(again["t"] // attribution.WIDTH % attribution.CELLS)["bucket"].nunique() == 1).all()


# Operator 12


def plain_lines(docs):
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower()))
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(strip(line)) >= 20 and i is not None:
                holders[strip(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[strip(x)]) < 3 or (i is not None and i == max(holders[strip(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_of_odd_documents(spark):
    """Nulls, empty texts, repeated rows and ids, blanks and case at the threshold, lines of other alphabets, one line in most documents, all lines lost."""
    rng = random.Random(3)
    common = ["A line that is in many DOCUMENTS", "  a line that is in many documents\t\r", "ÉÀ a line with other letters İ", "ÉÀ A line with other letters İ", "x" * 20, "x" * 19, "twenty letters here..", " twenty letters here.. ", ""]
    docs = [(i, "\n".join(rng.choices([*common, f"own line of document {i}", f"pair {i // 2} of equal lines"], k=rng.randint(0, 9)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n"), (503, common[0]), (503, common[0]), (503, "other text under this id\n" + common[4]), (None, common[0]), (504, "\n".join(common[:1] * 5000)), (505, common[0] + "\n" + common[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"k1": F.lit(1), "line": F.lit("x"), "t1": F.lit(2), "drops": F.lit(3)})
    assert sorted((tuple(r) for r in line_dedup.line_digests(df).collect()), key=repr) == plain_lines(docs)
    assert line_dedup.line_digests(df.limit(0)).count() == 0


# Operator 13


def plain_codes(rows, rounds=4):
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([v for _, v, _ in rows], np.float64) * 1024).astype(np.int64)
    parts = x.reshape(len(x), 4, -1)
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])[:256]
    book = parts[order].swapaxes(0, 1).copy()
    for k in range(rounds + 1):
        d = np.stack([((parts[:, p, None] - book[p]) ** 2).sum(2) for p in range(4)], 1)
        code = d.argmin(2)
        if k < rounds:
            for p in range(4):
                for e in np.unique(code[:, p]):
                    own = parts[code[:, p] == e, p]
                    book[p, e] = own.sum(0) // len(own)
    error = d.min(2).sum(1)
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted((rows[i][0], bytes(code[i].tolist()).hex(), int(error[i]), by[rows[i][2]], digest) for i in range(len(rows)))


@pytest.mark.parametrize("block", [7, 4096])
def test_codes_equal_plain_lloyd(spark, monkeypatch, block):
    """Ties between equal entries, groups of equal vectors, clusters that move, nulls, and blocks of few rows."""
    monkeypatch.setattr(heap_lloyd, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).round(3)
    x[:40] = x[0]
    x[300:500] = np.round(x[300:500] * 0.01, 3)
    x[600:] += 3
    rows = [(int(i), v, int(i % 3) if i % 5 else None) for i, v in zip(rng.permutation(900), x.tolist(), strict=True)]
    odd = [(1000, None, 1), (1001, [0.0] * 7 + [None], 1), (1002, [0.0] * 7 + [float("nan")], 1), (1003, [0.0] * 7 + [float("inf")], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({"codes": F.lit(1), "error": F.lit(2), "of": F.lit(3)}).repartition(3)
    assert sorted(tuple(r) for r in heap_lloyd.vector_codes(df).collect()) == plain_codes(rows)


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(5, [1.0, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, 3.0, 4.0], 1), (None, [1.5, 2.0, 3.0, 4.0], 1), (7, [1.0, 2.0], 1), (8, [1e30, 0.0, 0.0, 0.0], 1), (9, [], 1)], schema)
    got = [(r["vec_id"], r["code"], r["error"]) for r in heap_lloyd.vector_codes(few).collect()]
    assert sorted(got, key=repr)[0][0] == 5 and len(got) == 3 and all(r[1] == "00000000" for r in got)
    assert heap_lloyd.vector_codes(few.limit(0)).count() == 0


def test_only_parts_whose_slack_is_used_up_are_scanned():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-20, 20, (100, 4)) + 1000 * c for c in range(4)]).astype(np.int64)
    book = np.array([[1000 * c] * 4 for c in range(4)], np.int64)
    codes, slack = heap_lloyd.nearest(x, book)
    heaps = heap_lloyd.heaped(codes, slack, 4)
    assert len(heap_lloyd.rescan(x, codes, heaps, book, np.full(4, 1.0))) == 0
    moved = book + np.array([[0], [0], [0], [-985]])  # the last entry comes close to the third
    near, far = 0, np.sqrt(4 * 985.0**2)
    scanned = heap_lloyd.rescan(x, codes, heaps, moved, np.array([far, far, far, far + near]))
    assert len(scanned) and (codes == heap_lloyd.nearest(x, moved)[0]).all()
    assert sorted(i for h in heaps for _, i in h) == list(range(400))


@pytest.mark.parametrize("name", ["op11_click_attribution", "op12_line_dedup", "op13_heap_lloyd"])
def test_against_sql(spark, sf_dir, name):
    names, want = oracle_rows(queries.oracle_sql()[name], sf_dir)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == names and rows_of(df) == want


def test_crc_in_sql():
    texts = ["0", "7", "12345", "-9"]
    got = duckdb.sql("SELECT " + ", ".join(attribution._CRC.format(f"'{t}'") for t in texts)).fetchall()[0]
    assert list(got) == [zlib.crc32(t.encode()) for t in texts]
