"""Nearest neighbours, perspectives, components and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import components, permutation_index, perspectives


def exact(ids, x, k=10, every=100):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            out[i] = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD", 1000)
    monkeypatch.setattr(permutation_index, "LEAST", 50)
    base = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{base}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    want = exact([r[0] for r in rows], np.array([r[1] for r in rows], np.float64))
    got = permutation_index.search(vectors).collect()
    hits = sum((r["vec_id"] in {i for _, i in want[r["query_id"]]}) for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all([r["rank"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == list(range(1, 11)) for q in want)


def test_footrule():
    orders = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5]])
    files = permutation_index.InvertedFiles(orders, 6)
    for q in ([0, 1, 2], [1, 5, 0]):
        want = [sum(abs((list(o).index(p) if p in o else 3) - (q.index(p) if p in q else 3)) for p in set(o) | set(q)) for o in orders.tolist()]
        assert files.footrule(np.array(q)).tolist() == want


def skewed_recall(spark, monkeypatch):
    """Recall of queries in and outside a group of identical vectors that holds a third of 6,000 rows."""
    monkeypatch.setattr(permutation_index, "SHARD", 3000)
    monkeypatch.setattr(permutation_index, "LEAST", 50)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64)).round(3)
    hot = rng.permutation(6000)[:2000]
    x[hot] = x[hot[0]]
    got = {}
    for r in permutation_index.search(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(range(6000), x)
    inside = set(hot.tolist())
    recall = lambda some: np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in some])
    return recall([q for q in want if q in inside]), recall([q for q in want if q not in inside])


def test_identical_vectors_give_the_smallest_ids(spark, monkeypatch):
    hot, _ = skewed_recall(spark, monkeypatch)
    assert hot == 1


def test_pivots_are_distinct(spark, monkeypatch):
    _, outside = skewed_recall(spark, monkeypatch)
    assert outside >= 0.9


def test_recall_with_a_third_of_near_copies(spark):
    """At the shipped constants, in and outside a dense group."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    hot = rng.permutation(6000)[:2000]
    x[hot] = x[hot[0]] + 0.1 * rng.normal(size=(2000, 64))
    got = {}
    for r in permutation_index.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want, inside = exact(range(6000), x), set(hot.tolist())
    for some in ([q for q in want if q in inside], [q for q in want if q not in inside]):
        assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in some]) >= 0.9


def test_cells_meet_in_every_partition(spark, monkeypatch):
    """Many shards and blocks over many partitions: with everything reranked the result is exact."""
    monkeypatch.setattr(permutation_index, "SHARD", 150)
    monkeypatch.setattr(permutation_index, "BLOCK", 2)
    monkeypatch.setattr(permutation_index, "SHARE", 1.0)
    x = np.random.default_rng(5).normal(size=(1200, 8)).round(3)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = permutation_index.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = exact(range(1200), x)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, k, i) for q, near in want.items() for k, (_, i) in enumerate(near, 1)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (200, [0.0, 0.0]), (9, [])]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, shard int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in permutation_index.search(docs).collect())
    far = round(2**0.5, 6)
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, far), (0, 3, 2, far), (0, 4, 2, far), (100, 1, 0, 0.0), (100, 2, 1, far), (100, 3, 2, far), (100, 4, 2, far)]
    assert permutation_index.search(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 70)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    group = {}

    def root(i):
        while group.setdefault(i, i) != i:
            i = group[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges for i in e if e[0] != e[1] or i in {x for f in edges for x in f if f[0] != f[1]}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é 😀"), (1, 3, "cy", ""), (1, None, None, None), (1, 1, "ann", "hi"), (2, 0, "system", "x"), (None, 0, "ann", "x"), (3, 70, "ann", "late"), (3, 1, "ann", "early"), (3, 1, "bob", "tie")]
    docs = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, perspective string, block int")
    got = {(r["conv_id"], r["perspective"], r["block"]): r for r in perspectives.rotate(docs).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (1, "unknown"), (3, "ann"), (3, "bob")}
    bob = got[(1, "bob", 0)]
    assert bob["rendered"] == "<|system|>\nbe kind<|end|>\n<|user|>ann\nhi<|end|>\n<|assistant|>\né 😀<|end|>\n<|user|>cy\n<|end|>\n<|user|>unknown\n<|end|>\n"
    begin, end = map(int, bob["masks"].split("-"))
    assert bob["rendered"][begin:end] == "é 😀<|end|>\n"
    assert got[(3, "bob", 0)]["rendered"] == "<|user|>ann\nearly<|end|>\n<|assistant|>\ntie<|end|>\n<|user|>ann\nlate<|end|>\n"
    assert perspectives.rotate(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("run", "long"), [(1, 0), (2, 200), (4096, 100), (4096, 4096)])
def test_perspectives_equal_sql(spark, monkeypatch, tmp_path, run, long):
    """Null, negative, equal and very large turn numbers, and a dialogue that holds most turns and lies in many ranges."""
    monkeypatch.setattr(perspectives, "RUN", run)
    monkeypatch.setattr(perspectives, "LONG", long)
    rng = random.Random(run)
    turns = [(1, rng.choice([None, -1, -5, 0, 3, 70, 2**62, -(2**63), 2**63 - 1]), rng.choice(["ann", "bob", "system", "", None]), f"t{k % 130}") for k in range(150)]
    turns += [(2, k // 2, rng.choice(["ann", "bob", "cy é"]), "x" * (k % 7)) for k in range(900)] + [(None, 1, "ann", "x"), (3, None, None, None), (4, 1, "system", "x")]
    docs = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    docs.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = con.sql(perspectives.ORACLE)
    df = perspectives.rotate(docs.repartition(7))
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall()) and df.filter("conv_id = 2").count() >= 3 * 14


def test_repeated_query_rows(spark):
    """Each query row has ranks of its own; rows of one id are candidates for each other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4)).round(2)
    rows = [(k, v) for k, v in enumerate(x.tolist(), 1)] + [(100, x[0].tolist()), (100, x[0].tolist()), (100, x[5].tolist()), (200, x[0].tolist())]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = []
    for at, (i, q) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((round(float(np.sqrt(((np.array(v) - q) ** 2).sum())), 9), j) for k, (j, v) in enumerate(rows) if k != at)[:10]
            want += [(i, rank, j, d) for rank, (d, j) in enumerate(near, 1)]
    assert got == sorted(want) and len(got) == 40


def documents(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    odd = [(90_001, None, "en", "s", 0), (90_002, "", "en", "s", None), (None, "Erinst resh the of and to in is, by as was.", None, None, 10), (90_004, "Mail me: x@y.zz the of and to in is by as.", "en", "s", 44), (90_004, "Mail me: x@y.zz the of and to in is by as.", "en", "s", 44)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"spans": F.lit(1), "score": F.lit("x"), "kept": F.lit(True)} | {c: F.lit(2) for c in ("n", "id", "stays", "its_id", "its_key", "text_key", "component", "key")})


def test_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = documents(spark)
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "pii", "packing"]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names
    deduped = p.dedup_stage(spark, docs, sf_dir)
    rows = deduped.select("doc_id", "text").collect()
    assert sum(r["doc_id"] == 90_004 for r in rows) == 1 and sum(r["doc_id"] is None for r in rows) == 1
    cleaned = {r["doc_id"]: r for r in p.pii_stage(spark, docs, sf_dir).collect()}
    assert cleaned[90_004]["text"] == "Mail me: [EMAIL] the of and to in is by as." and cleaned[90_004]["n_chars"] == len(cleaned[90_004]["text"])
    assert cleaned[90_001]["text"] is None and cleaned[90_002]["n_chars"] is None
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_copies_between_80_and_85_go(spark, sf_dir):
    """Pairs with 100 shingles each, of which so many are common that the similarity is 0.80 to 0.85; one below stays."""
    import corpus_pipeline as p

    rows, gone = [], set()
    for k, changed in enumerate([9, 10, 11] * 40 + [12] * 5):
        words = [f"w{k}x{i}" for i in range(104)]
        other = words[: 104 - changed] + [f"v{k}x{i}" for i in range(changed)]  # 100 - changed common of 100 + changed
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if 100 * (100 - changed) >= 80 * (100 + changed):
            gone.add(2 * k + 1)
    kept = {r["doc_id"] for r in p.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()}
    assert kept == {i for i, _ in rows} - gone and len(gone) == 120


def test_rows_that_share_a_doc_id(spark, sf_dir):
    """Unlike texts under one doc_id all stay; of copies the one with the smallest doc_id stays, once."""
    import corpus_pipeline as p

    a, b, c = ("one two three four five six " + x for x in ("alpha beta gamma", "delta", "epsilon zeta eta theta iota kappa"))
    rows = [(5, a), (5, b), (5, c), (5, a), (5, a.upper()), (4, c), (6, b), (7, None), (7, None), (8, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, text_key int, component string")
    got = sorted(((r["doc_id"], r["text"]) for r in p.dedup_stage(spark, docs, sf_dir).collect()), key=repr)
    one = min((a, a.upper()), key=lambda t: hashlib.md5(t.encode()).digest())
    assert got == sorted([(5, one), (5, b), (4, c), (7, None), (7, None), (8, ""), (None, a), (None, a)], key=repr)


def test_no_table_goes_through_the_driver(spark, sf_dir):
    """No step of the near-duplicate stage collects a side of a join to broadcast it, however small the side is."""
    import corpus_pipeline as p

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    p.dedup_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    after = store.executionsCount()
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(before, after)]
    assert any("Join" in x for x in plans) and not any("BroadcastExchange" in x for x in plans)


def test_broken_run_goes_on(spark, sf_dir, tmp_path, monkeypatch):
    import corpus_pipeline as p

    stages = p.STAGES

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(p, "STAGES", [*stages[:2], ("pii", broken), stages[3]])
    with pytest.raises(RuntimeError):
        p.run(spark, sf_dir, str(tmp_path))
    monkeypatch.setattr(p, "STAGES", [("quality", broken), ("near_dedup", broken), *stages[2:]])
    digest = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    got = digest(p.run(spark, sf_dir, str(tmp_path)))
    monkeypatch.setattr(p, "STAGES", stages)
    assert got == digest(p.run(spark, sf_dir)) and [x.name for x in tmp_path.iterdir()] == ["2-pii"]


def test_run(spark, sf_dir):
    import corpus_pipeline as p

    got = p.run(spark, sf_dir).collect()
    total, used = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
    assert got and used <= 1.05 * total / 1024 + 2


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(n):
    from loomwright.llm import queries

    assert sum(q.startswith(f"op{n}_") for q in queries.queries()) == 1
