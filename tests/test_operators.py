"""Operators that SQL can't express, and invariants, against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import calls as C
from loomwright.functions.text import iso_date_evidenced, nfkc
from loomwright.operators import corpus, generate, scoring, tokenizer, training
from loomwright.sources import adapters, arrays, jsonl
from loomwright.streaming import ingest


def naive_merge(word, vocabulary):
    """Rescanning merge loop: the least rank, leftmost first."""
    symbols = list(word)
    while True:
        ranked = [(vocabulary.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in vocabulary.rank]
        if not ranked:
            return symbols
        _, i = min(ranked)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcde1") for _ in range(rng.randint(1, 9))): rng.randint(1, 20) for _ in range(400)}
    return tokenizer.grow(words, 300)


def test_merges_follow_ranks(vocabulary):
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 14)))
        if word not in vocabulary.ids:
            assert [vocabulary.tokens[i] for i in vocabulary.word(word)] == naive_merge(word, vocabulary)


def test_digits_never_merge(vocabulary):
    assert not [t for t in vocabulary.ids if len(t) > 1 and any(c.isdigit() for c in t) and t not in tokenizer.SPECIALS]
    for text in ("2021", "38.0", "2022-12-31", "T1001"):
        assert all(len(vocabulary.tokens[i]) == 1 for i in vocabulary.encode(text) if any(c.isdigit() for c in vocabulary.tokens[i]))


def test_structure_and_round_trip(vocabulary):
    for c in tokenizer.STRUCTURAL:
        assert len(vocabulary.encode(c)) == 1
    for text in ('{"a":"hello world","n":3}', "<call>\n[]\n</call>", "tab\tand  spaces", ""):
        assert vocabulary.decode(vocabulary.encode(text)) == text
    assert vocabulary.encode("<call>") == [8]
    assert vocabulary.encode("中") == [tokenizer.UNK]


def test_merge_counts_are_greedy():
    v = tokenizer.grow({"ab": 5, "abc": 3, "bc": 4}, 10_000)
    assert v.merges[:2] == [("a", "b"), ("b", "c")]
    assert ("ab", "c") in v.merges


def test_tags():
    t = tokenizer.tags_of
    text = '[{"name":"f","arguments":{"a":"on my way, call me","n":-1.5}},{"name":"g","arguments":{"l":["x"],"o":{"k":true}}}]'
    tags = t(text)
    spelled = lambda tag: "".join(c for c, x in zip(text, tags, strict=True) if x == tag)
    assert spelled(tokenizer.NAME) == "fg"
    assert spelled(tokenizer.KEY) == "nameargumentsannameargumentslok"
    assert spelled(tokenizer.VALUE) == "on my way, call me-1.5true"
    assert [i for i, x in enumerate(tags) if x == tokenizer.STOP] == [text.index("},{") + 1, len(text) - 1]
    assert t("[]") == [1, 5] and t("") == []


def test_batches_match_a_plain_loop(spark):
    rng = random.Random(3)
    real = [rng.randint(1, 700) for _ in range(3000)]
    limits, held, widest = [0], 0, 0
    for i, r in enumerate(sorted(real)):
        size = min(512, (r + 63) // 64 * 64)
        if held and ((held + 1) * max(widest, size) > 16384 or held >= 128):
            limits.append(i)
            held, widest = 0, 0
        held, widest = held + 1, max(widest, size)
    counts = {r: real.count(r) for r in set(real)}
    runs = training.batch_runs(counts, 512, 16384).tolist()
    batch_at = [b + (i - at) // size for (at, b, size), end in zip(runs, [r[0] for r in runs[1:]] + [len(real)], strict=True) for i in range(at, end)]
    assert [i for i, b in enumerate(batch_at) if i == 0 or b != batch_at[i - 1]] == limits
    assert len(training.batch_runs({600: 10**10, 90: 10**9}, 512, 16384)) <= 4
    rows = training.token_budget_batches(spark.createDataFrame(list(enumerate(real)), "k long, r long"), "k", "r", 512, 16384).collect()
    order = [i for i, _ in sorted(enumerate(real), key=lambda x: (x[1], x[0]))]
    assert [r["k"] for r in sorted(rows, key=lambda r: r["place"])] == order
    assert all(limits[r["batch"]] <= r["place"] and (r["batch"] + 1 == len(limits) or r["place"] < limits[r["batch"] + 1]) for r in rows)


def test_numbering_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(training, "CHUNK", 50)
    rows = spark.createDataFrame([(i % 2, i) for i in range(600)], "g int, k long")
    got = {(r["g"], r["k"]): r["rank__"] for r in training.numbered(rows, "g", "k").collect()}
    assert got == {(i % 2, i): i // 2 for i in range(600)}


def test_running_values_over_ranges(spark, monkeypatch):
    """Sums, minima and averages of long series are the same from many ranges of keys."""
    rng = random.Random(5)
    data = [(k % 3, k, rng.random(), rng.randrange(500)) for k in range(900)]
    rows = spark.createDataFrame(data, "s int, k long, x double, p int").withColumn("c", F.lit(0))
    monkeypatch.setattr(training, "CHUNK", 40)
    best = {r["k"]: r["new_best"] for r in training.best_so_far(rows, "s", "k", "x").collect()}
    spent = {r["k"]: (r["cost"], r["over"]) for r in training.spending(rows, "s", "k", "p", "c", 0.005).collect()}
    average = {r["s"]: r["ema"] for r in training.moving_average(rows, "s", "k", "x", 0.9).collect()}
    least, cost, ema = {}, dict.fromkeys(range(3), 0.0), {}
    for s, k, x, p in data:
        assert best[k] == (x < least.get(s, 9))
        least[s] = min(x, least.get(s, 9))
        cost[s] += p * training.PROMPT_PRICE
        assert spent[k][0] == pytest.approx(cost[s]) and spent[k][1] == (cost[s] > 0.005)
        ema[s] = 0.9 * ema[s] + 0.1 * x if s in ema else x
    assert average == pytest.approx(ema)


def test_loads_rules(spark):
    cases = {"[]": [], '{"name":"x","arguments":{}}': [("x", "{}")], "not json": None, '[{"no_name": 1}]': None, '[{"name":"x","arguments":"{\\"a\\":1}"}]': [("x", '{"a":1}')], '[{"name":"x"}]': [("x", "{}")], '[{"name":"x","arguments":null}]': None, "3": None, "": None, '[{"name":"x","arguments":[1]}]': None, '[{"name":7}]': [("7", "{}")]}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", C.loads(F.col("t")).alias("c")).collect()
    for r in rows:
        assert (None if r["c"] is None else [tuple(x) for x in r["c"]]) == cases.get(r["t"])


def test_dumps_is_python_json(spark):
    rng = random.Random(4)
    values = [1, 1.5, -3, True, None, "x", 'q"uo\\te', "é", [1, 2.0, "a"], {"z": 1, "a": [True]}, ""]
    samples = [[{"name": rng.choice("fg"), "arguments": {rng.choice(["a", "B", "_", "é", "k"]): rng.choice(values) for _ in range(3)}} for _ in range(rng.randint(0, 3))] for _ in range(60)]
    rows = spark.createDataFrame([(json.dumps(s),) for s in samples], "t string").select("t", C.dumps(C.loads(F.col("t"))).alias("d")).collect()
    for r in rows:
        canonical = [{"name": c["name"], "arguments": {k: c["arguments"][k] for k in sorted(c["arguments"])}} for c in json.loads(r["t"])]
        assert r["d"] == json.dumps(canonical, ensure_ascii=False, separators=(",", ":"))


def test_score_table_of_nothing(spark):
    empty = spark.createDataFrame([], f"pred {C.CALLS}, gold {C.CALLS}")
    assert scoring.score_table(empty).collect() == []


def test_score_table_counts(spark):
    rows = spark.createDataFrame([([], []), ([("a", "{}"), ("b", "{}")], [("b", "{}"), ("a", "{}")]), ([("a", "{}")], None)], f"gold {C.CALLS}, pred {C.CALLS}")
    r = scoring.score_table(rows).collect()[0]
    assert (r["n"], r["refuse"], r["two_plus"], r["n_one"]) == (3, 1.0, 0.0, 1)
    assert r["well_formed"] == pytest.approx(2 / 3)


def test_rewards(spark):
    one, two = ("a", "{}"), ("b", "{}")
    cases = [([one], [one], 1.0), ([one, two], [one], 0.5), ([one], [one, two], 0.9), ([], [], 1.0), ([], [one], 0.0), ([one], None, 0.0), ([one, two], [two, one], 0.0)]
    rows = spark.createDataFrame([(g, p, w) for g, p, w in cases], f"gold {C.CALLS}, pred {C.CALLS}, want double")
    for r in rows.select("want", scoring.reward(F.col("pred"), F.col("gold")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_nfkc(spark):
    rows = spark.createDataFrame([("ﬁne “x”… –",), ("plain",), (None,), ("",)], "t string").select(nfkc(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == ['fine "x"... -', "plain", None, ""]


def test_iso_dates_with_nulls(spark):
    rows = spark.createDataFrame([(None, "q"), ("2024-01-02", None)], "v string, q string")
    assert [r[0] for r in rows.select(iso_date_evidenced(F.col("v"), F.col("q"))).collect()] == [False, False]


def test_order_does_not_matter(spark):
    rows = [(i, f"src{i % 3}", f"text {i % 7}") for i in range(60)]
    key = lambda rs: sorted(tuple(r) for r in corpus.first_wins(spark.createDataFrame(rs, "id long, s string, t string").repartition(5), F.col("t"), F.col("s"), F.col("id")).collect())
    assert key(rows) == key(rows[::-1])


def test_tolerant_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n{"a":')
    rows, skipped = jsonl.read_rows(spark, str(tmp_path / "a.jsonl"), "a long")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and skipped.collect()[0]["skipped"] == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s1", "é"), (2, "s2", None)], "id long, source string, t string")
    jsonl.write_by_status(rows, spark.createDataFrame([("s2", True)], "source string, quarantined boolean"), "source", str(tmp_path / "q"))
    back = spark.read.json(str(tmp_path / "q"))
    assert {r["id"]: r["status"] for r in back.collect()} == {1: "kept", 2: "quarantined"}
    jsonl.write_metrics(rows.groupBy().count(), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).collect()[0]["count"] == 2


def test_refusal_cap_is_in_order(spark, monkeypatch):
    monkeypatch.setattr(adapters, "MOST_REFUSALS", 2)
    row = json.dumps({"conversations": [{"from": "system", "value": '{"name":"f"}'}, {"from": "human", "value": "q"}, {"from": "gpt", "value": "no"}]})
    got = adapters.convert(spark.createDataFrame([(row, i) for i in (5, 3, 9)], "value string, row_idx long"), "glaive")
    assert sorted(r["row_idx"] for r in got.collect()) == [3, 5]


def test_python_calls():
    assert adapters.code_calls("f(a=1)\nf(a=[1, {'k': None}])", {"f"}) == [{"name": "f", "arguments": {"a": 1}}, {"name": "f", "arguments": {"a": [1, {"k": None}]}}]
    for bad in ("f(1)", "f(**x)", "g(a=1)", "f(a=b)", "f(a={1, 2})", "f(a=", "1"):
        with pytest.raises(adapters.Drop):
            adapters.code_calls(bad, {"f"})
    assert adapters.line_calls("a.b(q='x')\n\n", {"a.b"}) == [{"name": "a.b", "arguments": {"q": "x"}}]
    assert adapters.json_objects('x {bad {"a":1} {"b":{"c":2}} [') == [{"a": 1}, {"b": {"c": 2}}]
    assert adapters.greedy_object('say {"a":{"b":1}} ok') == {"a": {"b": 1}} and adapters.greedy_object("no") is None


def test_described_tools():
    source = "def f(a: int, b: List[str], c=1):\n    \'\'\'Says: this.\n\n    And more.\n    :param a: first: one\n    :param c: third\n    :returns: x\n    \'\'\'\nclass C:\n    def g(self): pass\ndef h(): pass"
    f, h = adapters.defined_tools(source)
    assert f["description"] == "Says: this.\n\nAnd more." and f["parameters"]["required"] == ["a", "b"] and h["description"] == "" and h["name"] == "h"
    assert f["parameters"]["properties"] == {"a": {"type": "integer", "description": "first: one"}, "b": {"type": "array", "description": ""}, "c": {"type": "string", "description": "third"}}
    assert adapters.defined_tools("def f(:") == []


def test_seal_prompt():
    assert adapters.seal_prompt('Hi api_list = [{\'a\': 1}, 2]\n\ntask_instruction = "say \\"x\\" = 1\nnow"\n  Output : ') == ("[{'a': 1}, 2]", 'say \\"x\\" = 1\nnow')
    for bad in ("", "api_list = []", 'api_list = []\ntask_instruction = "q"', 'api_list = x\ntask_instruction = "q"\nOutput:', "api_list = []\ntask_instruction = q\nOutput:"):
        with pytest.raises(adapters.Drop):
            adapters.seal_prompt(bad)


def test_streams(spark, tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    (lines / "a.txt").write_text('{"a":1}\n\n{"a":')
    marked = ingest.drain(ingest.stream_lines(spark, str(lines)), "t_lines")
    assert sorted(r["ok"] for r in marked.collect()) == [False, True]
    texts = tmp_path / "texts"
    spark.createDataFrame([("A  b",), ("a B",), ("c",)], "text string").write.parquet(str(texts))
    stream = spark.readStream.schema("text string").parquet(str(texts))
    assert ingest.drain(ingest.stream_new(stream), "t_new").count() == 2
    (tmp_path / "none").mkdir()
    assert ingest.drain(ingest.stream_new(spark.readStream.schema("text string").parquet(str(tmp_path / "none"))), "t_none").collect() == []
    ingest.append_to(ingest.stream_new(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_normalized_example(spark):
    from loomwright.functions.text import normalized_example

    rows = [("say “hi”…", '[{"name":"f…","arguments":{"a":"ﬁ","n":{"x":"…"},"k":1}}]'), ("x", "torn …"), ("x", None)]
    got = [tuple(r) for r in normalized_example(spark.createDataFrame(rows, "query string, answers string")).collect()]
    assert got == [('say "hi"...', '[{"name":"f…","arguments":{"a":"fi","n":{"x":"…"},"k":1}}]'), ("x", "torn …"), ("x", None)]


def test_unseen_keeps_one_of_equal_new_rows(spark):
    from loomwright.functions.text import collapse
    from loomwright.operators.corpus import unseen

    rows = spark.createDataFrame([(1, "a  b"), (3, "A b"), (5, "old"), (7, "a b"), (9, "c")], "doc_id long, text string")
    history = spark.createDataFrame([("old",)], "text string")
    got = sorted(r["doc_id"] for r in unseen(rows, history, "text", F.col("doc_id")).collect())
    keys = {}
    for r in rows.select("doc_id", collapse(F.col("text")).alias("k")).collect():
        keys.setdefault(r["k"], r["doc_id"])
    assert got == sorted(i for k, i in keys.items() if i != 5) and len(got) < 4


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_runs_of_words_have_one_mark_each(spark, n):
    """Equal runs of ``n`` words, and only these, have equal marks, whatever ``n`` is; a shorter text has one, a null text none."""
    rng = random.Random(n)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(60)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", corpus._marks(F.col("text"), n).alias("marks")).collect()
    of_run, of_mark = {}, {}
    for text, marks in rows:
        if text is None:
            assert marks is None
            continue
        w = text.split()
        runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or [("short", *w)]
        assert len(marks) == len(runs)
        for run, mark in zip(runs, marks, strict=True):
            assert of_run.setdefault(run, mark) == mark and of_mark.setdefault(mark, run) == run


def test_texts_are_not_shuffled_to_find_overlaps(spark):
    """Only rows that share a mark are read again, by keys that are broadcast; before, all texts went through a shuffle."""
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(i, f"{i} " + (item if i % 50 == 0 else "other words")) for i in range(200)] + [(200, "two"), (201, None)], "doc_id long, text string")
    items = spark.createDataFrame([(item,), ("TWO!",), (None,)], "text string")
    found = corpus.overlapping(docs, items)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 50, 100, 150, 200]


def test_characters_of_uncommon_words_get_ids(spark):
    texts = spark.createDataFrame([("common common common ж😀",)], "text string")
    v = tokenizer.train(texts, 400, most_words=2)
    assert v.decode(v.encode("ж 😀")) == "ж 😀"


@pytest.mark.parametrize(("letters", "known"), [("ab", 5), ("abcdeé1", 40)])
def test_merges_grown_in_spark(spark, monkeypatch, letters, known):
    """Equal to growth on the driver, also where few pairs are known at once, many are equally common and tokens come about in two ways."""
    monkeypatch.setattr(tokenizer, "KNOWN_PAIRS", known)
    rng = random.Random(3)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 4) for _ in range(120)}
    counts = spark.createDataFrame(list(words.items()), "piece string, n long").repartition(3)
    size = len(tokenizer._first_ids(letters)) + 40
    want, got = tokenizer.grow(words, size), tokenizer.grow_spread(counts, size)
    assert len(want.merges) > 30 and got.merges == want.merges and got.ids == want.ids
    nothing = tokenizer.grow_spread(counts.limit(0), size)
    assert nothing.merges == [] and nothing.ids == tokenizer.grow({}, size).ids


def grow_plainly(words, size):
    """Merges one after another, all pairs counted anew for each."""
    ids, merges = tokenizer._first_ids({c for w in words for c in w}), []
    words = [(list(w), n) for w, n in words.items()]
    while len(ids) < size:
        total = {}
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                if not any(c.isdigit() for c in p[0] + p[1]):
                    total[p] = total.get(p, 0) + n
        pair, n = min(total.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
        if n < 2:
            break
        merges.append(pair)
        ids.setdefault(pair[0] + pair[1], len(ids))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == pair:
                    w[i : i + 2] = [w[i] + w[i + 1]]
                i += 1
    return ids, merges


@pytest.mark.parametrize("known", [3, 40, 100_000])
def test_merges_of_blocks(monkeypatch, known):
    """Blocks of symbols grow the merges of plain counting: with runs of one letter, digits, specials, tokens made in two ways and few known pairs."""
    monkeypatch.setattr(tokenizer, "KNOWN_PAIRS", known)
    monkeypatch.setattr(tokenizer, "BLOCK_WORDS", 16)
    rng = random.Random(known)
    for letters in ("a", "ab", "abc", "abcdeé1²", "<pad>ab", "ж😀a") * 5:
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): rng.randint(1, 9) for _ in range(rng.randint(0, 40))}
        got = tokenizer.grow(words, 100_000)
        assert (got.ids, got.merges) == grow_plainly(words, 100_000)


def test_blocks_written_in_between(spark, monkeypatch):
    """Rounds go on from written blocks, of which none is left at the end; words that are given as counts are not counted again."""
    monkeypatch.setattr(tokenizer, "ROUNDS_KEPT", 3)
    rng = random.Random(8)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))): rng.randint(1, 4) for _ in range(120)}
    counts = spark.createDataFrame(list(words.items()), "piece string, n long").repartition(3)
    blocks = []
    monkeypatch.setattr(tokenizer, "SparkBlocks", type("Kept", (tokenizer.SparkBlocks,), {"__init__": lambda self, w: (super(type(self), self).__init__(w), blocks.append(self))[0]}))
    got = tokenizer.train_counts(counts, 10_000, most_words=5)
    assert (got.ids, got.merges) == grow_plainly(words, 10_000)
    assert blocks[0].rounds > 6 and blocks[0].written and not os.path.exists(blocks[0].written.removeprefix("file:"))


def test_merges_settled_together():
    """Every list of merges taken in one round is the start of what one by one gives."""
    rng = random.Random(5)
    together = 0
    for _ in range(200):
        words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))): rng.randint(1, 9) for _ in range(rng.randint(2, 40))}
        total = {}
        for w, n in words.items():
            for p in zip(w, w[1:], strict=False):
                total[p] = total.get(p, 0) + n
        ids = tokenizer._first_ids("")
        chosen = tokenizer._next_merges(total, None, ids, 64)
        assert tokenizer.grow(words, 10_000).merges[: len(chosen)] == chosen
        together += len(chosen) > 1
    assert together > 20


def test_run_to_cap(spark, tmp_path):
    """The query ends in the middle of a micro-batch; what comes later, and after a restart, is not processed."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "at long, cost long"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        return ingest.run_to_cap(spark.readStream.schema(schema).parquet(source), "at", F.col("cost"), 100, out)

    def kept():
        rows = ingest.capped_rows(spark, out, spark.createDataFrame([], schema).schema).collect()
        return sorted((tuple(r) for r in rows), key=repr)

    assert not deliver([])
    assert not deliver([(5, 30), (2, None), (None, 10)])
    first = kept()
    assert len(first) == 3
    assert deliver([(9, 1), (8, 30), (8, 1), (7, 25), (6, 35)])  # 75, 100, then two rows of one place
    assert kept() == sorted([*first, (6, 35), (7, 25)], key=repr)
    assert deliver([(1, 0), (20, 1)])
    assert len(kept()) == 5
    empty = str(tmp_path / "none")
    (tmp_path / "nothing").mkdir()
    assert not ingest.run_to_cap(spark.readStream.schema(schema).parquet(str(tmp_path / "nothing")), "at", F.col("cost"), 1, empty)
    assert ingest.capped_rows(spark, empty, spark.createDataFrame([], schema).schema).collect() == []


def test_pointers_to_argument_values(spark, sf_dir, vocabulary):
    """Every document's copied values against a plain search; odd calls."""
    from loomwright.plans import tokens as plans
    from loomwright.registry import queries

    v = plans._vocabulary(spark, sf_dir)
    want = set()
    for r in plans.quotes(spark, sf_dir).collect():
        p = v.encode(r["prompt"])
        for key, value in json.loads(r["call"])[0]["arguments"].items():
            if not isinstance(value, str) or len(value) < 2 or f'"{key}":"{value}"' not in r["call"]:
                continue
            needle, before = v.encode(value), v.encode(r["call"][: r["call"].index(f'"{key}":"{value}"') + len(key) + 4])
            start = next((i for i in range(len(p)) if p[i : i + len(needle)] == needle), None)
            if start is not None:
                want.add((r["doc_id"], key, len(p) + len(before), start, start + len(needle) - 1))
    got = [tuple(r) for r in queries()["pointer_values"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for _, k, *_ in want} >= {"lang", "quote"}
    call = '[{"name":"f","arguments":{"b":"cab","a":"cab"}},{"name":"f","arguments":{"a":"cab","n":1,"s":"x"}}]'
    rows = spark.createDataFrame([(1, "abba cab cab", call), (2, "abba", call), (3, "cab", None), (4, None, call), (5, "cab", call[:9])], "id long, p string, c string")
    found = {r["id"]: r["x"] for r in rows.select("id", tokenizer.pointers(vocabulary, rows, "p", "c").alias("x")).collect()}
    assert [x["key"] for x in found[1]] == ["a", "a"] and found[1][0]["start"] == found[1][1]["start"] and not any(found[i] for i in (2, 3, 4, 5))
    assert found[1][0]["pos"] > 0 and found[1][0]["pos"] < found[1][1]["pos"]


def test_progress(spark, tmp_path):
    rows = [(k % 3 > 0, 0.5) for k in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "ok boolean, cost double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    said = []
    progress = ingest.Progress(10, say=said.append)
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema("ok boolean, cost double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = ingest.drain(ingest.counted(stream, F.col("ok"), F.col("cost")), "t_progress")
        assert got.count() == 30
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(progress)
    assert (progress.ok, progress.rejected, progress.spent) == (20, 10, 15.0)
    assert said[-1] == "final: 20 ok / 10 rejected, ~$15.00 spent" and 2 <= len(said) <= 4


def test_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "eval"), (2, "train"), (3, None)], "id long, part string")
    rows.write.parquet(str(tmp_path / "a.parquet"))
    rows.write.json(str(tmp_path / "a.jsonl"))
    for name in ("a.parquet", "a.jsonl"):
        held, rest = jsonl.scan_split(spark, str(tmp_path / name), "part", "eval")
        assert [r["id"] for r in held.collect()] == [1] and sorted(r["id"] for r in rest.collect()) == [2, 3]
    some = jsonl.scan(spark, str(tmp_path / "a.parquet"), "id > 1", ["id"])
    assert sorted(map(tuple, some.collect())) == [(2,), (3,)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan and "ReadSchema: struct<id:bigint>" in plan
    with pytest.raises(ValueError):
        jsonl.scan(spark, str(tmp_path / "a.csv"))


def test_parse_and_score(spark):
    rows = spark.createDataFrame([([("f", '{"a":1}')], '[{"name":"f","arguments":{"a":1}}]'), ([("f", "{}")], "torn"), ([], None)], f"gold {C.CALLS}, pred_text string")
    r = scoring.parse_and_score(rows).collect()[0]
    assert (r["n"], r["accuracy"], r["well_formed"]) == (3, pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_composition_verdict(spark):
    rows = spark.createDataFrame([(120, 47, 40), (100, 42, 40), (0, 0, 0)], "n_rows long, assembled_rows long, pool long")
    assert [r["rerank_pays"] for r in scoring.composes(rows, "pool").collect()] == [True, False, False]


def test_documents_encode_as_plain_merges(spark, sf_dir):
    """bpe_encode, fragmentation, pointer_spans and nfkc_normalize on the smallest tables, against plain Python."""
    import unicodedata

    from loomwright.functions.text import PUNCTUATION
    from loomwright.plans import tokens as plans
    from loomwright.registry import queries

    v = plans._vocabulary(spark, sf_dir)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}

    def plain(text):
        return [v.ids.get(s, tokenizer.UNK) for w in v.pattern.findall(text) for s in ([w] if w in v.ids else naive_merge(w, v))]

    got = {r["doc_id"]: r["ids"] for r in queries()["bpe_encode"](spark, sf_dir).collect()}
    some = sorted(docs, key=lambda i: len(docs[i]["text"]))[:60]
    assert got.keys() == docs.keys() and all(got[i] == plain(docs[i]["text"]) for i in some)
    shares = {}
    for i, r in docs.items():
        shares.setdefault(r["lang"], []).append(len(got[i]) / max(1, len(r["text"].split())))
    assert {r["lang"]: r["tokens_per_word"] for r in queries()["fragmentation"](spark, sf_dir).collect()} == pytest.approx({k: sum(x) / len(x) for k, x in shares.items()}, abs=1e-3)
    for r in queries()["nfkc_normalize"](spark, sf_dir).collect():
        assert r["text"] == unicodedata.normalize("NFKC", docs[r["doc_id"]]["text"]).translate(str.maketrans(PUNCTUATION))
    gold = {(r["row_id"], k): c["name"] for r in plans.pool_and_gold(spark, sf_dir)[1].collect() for k, c in enumerate(r["gold"])}
    spans = {(r["row_id"], r["pos"]): (r["start"], r["n"]) for r in queries()["pointer_spans"](spark, sf_dir).collect()}
    want = {}
    for k, name in gold.items():
        hay, needle = plain(f"please {name} now"), plain(name)
        want[k] = (next((i for i in range(len(hay)) if hay[i : i + len(needle)] == needle), -1), len(needle))
    assert spans == want


def test_pack_drops_what_it_cannot_hold(spark, vocabulary):
    """Texts with unknown characters and long ones are left out whole; the others hold their texts, tags and padding."""
    call = '[{"name":"f","arguments":{"a":1}}]'
    rows = [(1, "ab - f (a=int) do", call, ["f"]), (2, "ab 中", call, ["f"]), (3, "ab", call.replace("f", "é"), ["f"]), (4, "ab " * 60, call, ["f"])]
    got = tokenizer.pack(spark.createDataFrame(rows, "id long, prompt string, call string, names array<string>"), vocabulary, 128).collect()
    assert [r["id"] for r in got] == [1]
    r = got[0]
    real = r["ids"][: r["real_len"]]
    assert len(r["ids"]) == len(r["tags"]) == 128 and set(r["ids"][r["real_len"] :]) == {tokenizer.PAD} and real[0] == tokenizer.BOS and real[-1] == tokenizer.EOS
    assert vocabulary.decode(real) == rows[0][1] + call
    parts, at = [vocabulary.tokens[i] for i in vocabulary.encode(call)], 0
    for part, tag in zip(parts, r["tags"][r["real_len"] - 1 - len(parts) :], strict=False):
        assert tag == tokenizer.tags_of(call)[at]
        at += len(part)
    assert [d["name"] for d in r["decisions"]] == ["f"] and r["decisions"][0]["gold"] == 0


def test_pack_statistics(spark, sf_dir):
    from loomwright.plans import tokens as plans

    rows = plans._packed(spark, sf_dir).collect()
    r = plans.pack_statistics(spark, sf_dir).collect()[0]
    assert (r["kept"], r["mean_len"]) == (len(rows), pytest.approx(sum(x["real_len"] for x in rows) / len(rows)))
    assert r["weight"] == pytest.approx(sum(tokenizer.WEIGHTS[t] for x in rows for t in x["tags"]))


def test_spans_of_benchmark_texts(spark, sf_dir):
    """Candidate spans against a plain version, for every benchmark text and hints from its own words."""
    import re

    from loomwright.operators.retrieve import spans

    def tokens(t):
        t = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", t))
        return set(re.findall("[a-z0-9]+", t.lower()))

    def plain(q, hint):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", q) if x]
        if not w or len(w) > 120:
            return None
        runs = [" ".join(w[i : i + n]).strip(".,;:!?\"\'()[]") for i in range(len(w)) for n in range(1, min(8, len(w) - i) + 1)]
        distinct = list(dict.fromkeys(r for r in runs if r))
        ranked = sorted(distinct, key=lambda s: -(2.0 * len(tokens(s) & tokens(hint)) - 0.15 * len(s.split(" "))))
        return ranked[:24] if len(distinct) > 24 else distinct

    rows = [(r["text"], " ".join(r["text"].split()[k::7])) for k, r in enumerate(spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())]
    rows += [("", "x"), ("one", ""), ("play 'Hey Jude' now!", "songTitle jude"), ("a " * 121, "a")]
    got = spark.createDataFrame(rows, "q string, h string").select("q", "h", spans(F.col("q"), F.col("h")).alias("s")).collect()
    assert len(got) == len(rows) and all(r["s"] == plain(r["q"], r["h"]) for r in got)


def test_numbers_as_python_prints_them(spark):
    """Large and small floats, long ones, infinities, minus zero and large integers; repeated keys give their last value."""
    rng = random.Random(11)
    written = ["12345678.5", "0.0005", "1e22", "1e16", "1e15", "1E5", "0.00001", "-0.0", "-0", "1.50", "1e400", "-1e400", "1e-400", "9007199254740993", "12345678901234567890", "0.1", "2.5e-7", "NaN", "-Infinity", "1.7976931348623157e308"]
    written += [repr(rng.uniform(-1e9, 1e9)) for _ in range(20)] + [f"{rng.randint(1, 10**9)}e{rng.randint(-30, 30)}" for _ in range(40)]
    rows = spark.createDataFrame([(x,) for x in written], "x string")
    call = F.concat(F.lit('[{"name": "f", "arguments": {"a": 0, "n": [{"v": '), "x", F.lit('}], "a": '), "x", F.lit("}}]"))
    for r in rows.select("x", C.dumps(C.loads(call)).alias("d")).collect():
        assert r["d"] == '[{"name":"f","arguments":{"a":%s,"n":[{"v":%s}]}}]' % (json.dumps(json.loads(r["x"])), json.dumps(json.loads(r["x"])))


def test_loads_like_python(spark):
    def plain(text):
        try:
            raw = json.loads(text)
        except json.JSONDecodeError:
            return None
        raw = [raw] if isinstance(raw, dict) and "name" in raw else raw
        if not isinstance(raw, list):
            return None
        out = []
        for item in raw:
            if not isinstance(item, dict) or "name" not in item:
                return None
            a = item.get("arguments", {})
            try:
                a = json.loads(a) if isinstance(a, str) else a
            except json.JSONDecodeError:
                return None
            if not isinstance(a, dict):
                return None
            out.append({"name": str(item["name"]), "arguments": {k: a[k] for k in sorted(a)}})
        return json.dumps(out, separators=(",", ":"), ensure_ascii=False)

    call = '[{"name":"f","arguments":%s}]'
    texts = ["[]", "{}", "[{}]", "[1]", "nul", "", "[null]", '"s"', "12", '[{"name":"f"}] , [2]', '[{"name":"f"}]]', '[{"name":"f"},]', '[[{"name":"f"}]]', '{"name":"f","name":"g","arguments":{}}', '[{"name":null}]', '[{"name":true}]', '[{"name":1.0}]', call % "null", call % '"x"', call % r'"{\"x\": 1.50}"']
    texts += [call % a for a in ('{"x":01}', '{"x":1.}', '{"k":"a\\u0001"}', '{"s":"[1]","t":"true","u":"1.0","v":"","w":" a\\"b\\\\ "}', '{"q":{"q":"{","w":"\\u0001x"}}', '{"a":true,"b":false,"c":null,"d":[],"e":{},"f":[null,true]}', '{"x":"\t"}', '{} } ]', '{"é":"ü\\n"}')]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", C.dumps(C.loads(F.col("x"))).alias("d")).collect()
    # Control characters inside nested text keep the case of the reader's escapes.
    assert [(r["x"], r["d"]) for r in rows] == [(x, plain(x)) for x in texts]


@pytest.mark.parametrize("chunk", [2, 1_000_000])
def test_null_groups_and_keys_stay(spark, monkeypatch, chunk):
    """Rows without group or key are rows of their own group and come first, below and above CHUNK."""
    monkeypatch.setattr(training, "CHUNK", chunk)
    data = [(g, k, float(10 - k)) for g in ("a", None) for k in range(1, 7)] + [("a", None, 50.0), (None, None, 60.0)]
    rows = spark.createDataFrame(data, "g string, k int, x double").withColumns({"p": F.lit(100), "c": F.lit(0)})
    ranks = {(r["g"], r["k"]): r["rank__"] for r in training.numbered(rows, "g", "k").collect()}
    assert ranks == {(g, k): k or 0 for g in ("a", None) for k in (None, 1, 2, 3, 4, 5, 6)}
    assert [r["new_best"] for r in training.best_so_far(rows, "g", "k", "x").collect()] == [True] * 14
    assert training.spending(rows, "g", "k", "p", "c", 1.0).count() == 14
    assert training.moving_average(rows, "g", "k", "x", 0.5).count() == 2
    lengths = spark.createDataFrame([(1, None), (2, 70), (3, 10)], "k long, r long")
    assert {r["k"]: r["place"] for r in training.token_budget_batches(lengths, "k", "r", 512, 16384).collect()} == {1: 0, 3: 1, 2: 2}


def test_a_large_group_is_cut_by_its_own_keys(spark, monkeypatch):
    monkeypatch.setattr(training, "CHUNK", 100)
    rows = spark.createDataFrame([(g, g * 10_000 + k) for g in range(3) for k in range(500)], "g int, k long")
    most = training._ranged(rows, "g", "k").groupBy("g", "part__").count().agg(F.max("count")).collect()[0][0]
    assert most < 250


def test_clashing_columns_stay(spark):
    rows = spark.createDataFrame([("x y", "s", 7, 8, 9, 10)], "text string, source string, line int, copy int, stratum int, part int")
    assert corpus.exact_firewall(rows, rows.limit(0)).columns == rows.columns
    out = corpus.mixed(rows, {"s": 2}).select("copy", "copy_").collect()
    assert sorted((r["copy"], r["copy_"]) for r in out) == [(8, 1), (8, 2)]
    assert corpus.stratified(rows, F.lit("u"), {"u": 1}, "line", 1).select("stratum", "stratum_").first() == (9, "u")
    assert corpus.holdout(rows, 1, "line").select("part", "part_").first() == (10, "dev")
    assert corpus.split_by_share(rows, "line", 1, 1.0).select("part", "part_").first() == (10, "dev")


def test_a_wrong_name_is_no_argument_error(spark):
    call = lambda name, args: '[{"name":"%s","arguments":%s}]' % (name, args)
    data = [(call("f", '{"a":1}'), p) for p in (call("g", '{"a":1}'), call("g", '{"a":2}'), call("f", '{"b":1,"c":1}'), "[]", None)]
    rows = spark.createDataFrame(data, "g string, p string").select(C.loads(F.col("g")).alias("gold"), C.loads(F.col("p")).alias("pred"))
    assert {r["kind"]: r["n"] for r in scoring.argument_errors(rows).collect()} == {"values_only": 1, "bad_value": 1, "key_set": 1, "missing=1 extra=2": 1}


def test_growing_files(spark, tmp_path):
    """Appended lines arrive once, a torn line waits for its end, and a restart goes on from the checkpoint."""
    from loomwright.sources import growing

    folder = tmp_path / "in"
    folder.mkdir()
    got = []

    def start():
        seen = []
        q = growing.stream_growing(spark, str(folder)).writeStream.foreachBatch(lambda b, n: seen.extend((r["file"][-1], r["position"], r["value"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(sorted(seen))

    (folder / "a").write_bytes(b"one\r\n\ntw")
    start()
    with open(folder / "a", "ab") as f:
        f.write(b"o\nthr")
    (folder / "b").write_bytes("é\n".encode())
    start()
    start()
    with open(folder / "a", "ab") as f:
        f.write(b"ee\n")
    start()
    assert got == [[("a", 0, "one"), ("a", 5, "")], [("a", 6, "two"), ("b", 0, "é")], [], [("a", 10, "three")]]


def test_stretches_share_lines_out(tmp_path):
    from loomwright.sources import growing

    rng = random.Random(2)
    data = b"".join(b"x" * rng.choice((0, 1, 5, 30)) + b"\n" for _ in range(200))
    (tmp_path / "f").write_bytes(data)
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    for first in (0, want[7][0]):
        for size in (1, 7, 64, 10_000):
            got = []
            for begin in range(first, len(data), size):
                with open(tmp_path / "f", "rb") as f:
                    got += growing.whole_lines(f, growing.Stretch("f", first, begin, min(begin + size, len(data)), len(data)))
            assert got == [w for w in want if w[0] >= first]


def test_alias_table():
    names, keep, alias = corpus.alias_table({"a": 5, "b": 3, "c": 1.5, "d": 0.5, "e": 0})
    share = dict.fromkeys(names, 0.0)
    for n, k, a in zip(names, keep, alias, strict=True):
        share[n] += k / 4
        share[a] += (1 - k) / 4
    assert share == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05})


@pytest.mark.parametrize("read", [0, 3, 2000])
def test_global_retrieval_equals_scoring_all(spark, monkeypatch, read):
    """Few, some and all postings read at first; repeated tools, ties, hot tokens, nulls and texts without tokens."""
    from loomwright.operators import catalog

    monkeypatch.setattr(catalog, "READ", read)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["hot"] * 6
    tools = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(60)] + [(70, None), (71, "--"), (5, "hot w1")]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(30)] + [(40, None), (41, "unknown"), (42, "Hot")]
    got = sorted(tuple(r) for r in catalog.retrieve_global(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(tools, "tool_id long, text string"), 3).collect())
    want = []
    for q, text in queries:
        own = set((text or "").lower().split())
        scored = sorted((-len(own & set((t or "").split())), i) for i, t in tools)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate([x for x in scored if x[0] < 0][:3])]
    assert got == sorted(want)


def test_publication(spark, tmp_path):
    """A broken-off write is never seen, of two writers one is refused, and a reader keeps its version."""
    from loomwright.sources import publish

    top = str(tmp_path / "set")
    rows = lambda *xs: spark.createDataFrame([(x, "a" if x % 2 else "b") for x in xs], "x long, split string")
    ids = lambda df: sorted(r["x"] for r in df.collect())
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, top)
    assert jsonl.publish_packed(rows(1, 2), top) == 1
    reader = publish.read_published(spark, top)
    broken = rows(3, 4).withColumn("x", F.when(F.col("x") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, top)
    assert publish.versions(spark, top) == [1]
    assert publish.publish(rows(5, 6, 7), top, base=1, by=("split",)) == 2
    with pytest.raises(publish.Conflict):
        publish.publish(rows(8), top, base=1)
    assert ids(reader) == [1, 2] and ids(publish.read_published(spark, top)) == [5, 6, 7]
    assert ids(jsonl.read_packed(spark, top, "a")) == [5, 7] and ids(jsonl.read_packed(spark, top, "b", 1)) == [2]
    assert "split" not in jsonl.read_packed(spark, top, "a").columns


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_averages_after_every_step(spark, monkeypatch, chunk):
    """Runs of one series and of many, null groups, steps and values, repeated steps, against a plain loop."""
    monkeypatch.setattr(training, "CHUNK", chunk)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, *map(float, range(9))]), k) for k in range(90)]
    rows += [("c", 1, None, 90), ("c", 2, 4.0, 91), ("d", 1, None, 92)]
    got = {r["id"]: r for r in training.moving_averages(spark.createDataFrame(rows, "s string, step long, ema_of double, id long"), "s", "step", "ema_of", 0.7).collect()}
    assert len(got) == len(rows) and {(r["s"], r["step"], r["ema_of"], i) for i, r in got.items()} == set(rows)
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0))
        average, want = None, []
        for _, step, x, _ in own:
            average = average if x is None else x if average is None else 0.7 * average + 0.3 * x
            want.append((step, x, None if average is None else round(average, 9)))
        found = [(got[r[3]]["step"], got[r[3]]["ema_of"], None if got[r[3]]["ema"] is None else round(got[r[3]]["ema"], 9)) for r in own]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    assert training.moving_averages(spark.createDataFrame([], "s string, step long, v double"), "s", "step", "v").collect() == []


def test_annotations_and_json_values():
    import ast

    kinds = {"int": "integer", "List[int]": "array", "List": "string", "list[int]": "string", "Optional[Optional[Dict[str, int]]]": "object", "Optional": "string", "t.List[int]": "string", "List[int] | None": "string", "Any": "string", "None": "string", "list": "array"}
    assert {k: adapters.annotation(ast.parse(k, mode="eval").body) for k in kinds} == kinds and adapters.annotation(None) == "string"
    assert all(map(adapters.expressible, [None, [1, {"a": [True, 1.5, "é"]}], {}, ""]))
    assert not any(map(adapters.expressible, [(1,), {1: 2}, {1}, [b"x"], 1j, ..., {"a": (1,)}, {None: 1}]))


def _json_value(rng, depth=0):
    k = rng.random()
    if depth > 3 or k < 0.45:
        return "".join(rng.choice('a,"\\[]{}\n:é😀 ') for _ in range(rng.randrange(25)))
    if k < 0.6:
        return rng.choice([1, -2.5, None, True])
    if k < 0.8:
        return [_json_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {_json_value(rng, 9) + str(i): _json_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("block", [200, 4096])
def test_arrays_read_by_blocks(spark, tmp_path, block):
    """Arrays in one file each equal a whole parse wherever blocks cut them: in strings, behind escapes, between elements."""
    rng, want = random.Random(block), {}
    for i, (n, how) in enumerate([(0, {}), (1, {}), (40, {"indent": 1}), (60, {"ensure_ascii": False, "separators": (",", ":")})]):
        want[f"f{i}.json"] = [_json_value(rng) for _ in range(n)]
        (tmp_path / f"f{i}.json").write_text(json.dumps(want[f"f{i}.json"], **how))
    want["long.json"] = ["x,[" * 300, {"k": ['",' * 200]}, 1]
    (tmp_path / "long.json").write_text(json.dumps(want["long.json"]))
    (tmp_path / "object.json").write_text('{"a": [1, 2]}')
    (tmp_path / "empty.json").write_text("")
    for name, value in (("maxPartitionBytes", block), ("openCostInBytes", 8)):
        spark.conf.set(f"spark.sql.files.{name}", value)
    try:
        found = {}
        for r in arrays.read_array(spark, str(tmp_path)).collect():
            found.setdefault(r["file"].rpartition("/")[2], {})[r["row_idx"]] = json.loads(r["value"])
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")
    assert {f: [rows[i] for i in range(len(rows))] for f, rows in found.items()} == {f: x for f, x in want.items() if x}


def test_torn_arrays_and_nulls(spark, tmp_path):
    """A torn array gives its last element as it stands; nulls are written as null and files without rows not at all."""
    (tmp_path / "torn.json").write_text('[{"a": 1}, {"b": "x, ')
    assert [r["value"] for r in arrays.read_array(spark, str(tmp_path)).orderBy("row_idx").collect()] == ['{"a": 1}', '{"b": "x,']
    arrays.write_arrays(spark.createDataFrame([("1",), (None,)], "value string").coalesce(1), str(tmp_path / "out"))
    assert [r["value"] for r in arrays.read_array(spark, str(tmp_path / "out")).orderBy("row_idx").collect()] == ["1", "null"]
    arrays.write_arrays(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert arrays.read_array(spark, str(tmp_path / "none")).count() == 0


def test_examples_for_rows(spark):
    """Given texts stay whole in JSON, whatever they hold; null texts are drawn, equal and null keys have defined examples."""
    texts = ['a "quoted" \\ name', "{degrees} {level}", None, "é\n"]
    rows = spark.createDataFrame([(k, texts[k % 4], "kind") for k in range(400)] + [(None, "x", "y"), (7, texts[3], "kind")], "id long, who string, query string")
    out = generate.generate_for(rows, "id", 5, True, {"handle": "who"}).collect()
    assert len(out) == 402
    told = set()
    for r in out:
        for c in json.loads(r["answers"]):
            if "to" in c["arguments"] and "body" in c["arguments"]:
                told.add(c["arguments"]["to"])
                assert c["arguments"]["to"] in r["query"]
            assert c["name"] in {t["name"] for t in json.loads(r["tools"])}
    assert {t for t in texts if t} < told and told - set(texts) - {"x"} <= set(generate.SLOTS["handle"])
    assert len({(r["query"], r["answers"], r["tools"]) for r in out if r["row"] == 7}) == 1
    plain = generate.generate(spark, 50, 5, True).collect()
    assert plain == generate.generate_for(spark.range(50), "id", 5, True).collect()
    with pytest.raises(ValueError, match="level"):
        generate.generate_for(rows, "id", given={"level": "who"})
    assert generate.generate_for(rows.limit(0), "id").count() == 0


def test_growing_files_keep_their_order(spark, tmp_path):
    """Events from several files in any order: the second delivery only appends to the first, so each event arrives once."""
    from loomwright.registry import queries

    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.concat(F.lit("kind"), F.col("id") % 3).alias("event_type"))
    rows.repartition(4, F.md5(F.col("event_id").cast("string"))).sortWithinPartitions(F.md5(F.col("event_id").cast("string"))).write.parquet(str(tmp_path / "events.parquet"))
    out = {r["event_id"]: (r["n"], r["kind"]) for r in queries()["stream_growing"](spark, str(tmp_path)).collect()}
    assert out == {i: (1, f"kind{i % 3}") for i in range(4000)}


@pytest.mark.parametrize("name, most", [("rejections_over_events", 8), ("validate_over_events", 12), ("accepted_over_events", 14), ("calls_equal_over_events", 6), ("sample_rewards", 6)])
def test_json_is_read_once(spark, sf_dir, name, most):
    """Each text is read in one place of the plan, however many results name it."""
    from loomwright.registry import queries

    settings = {"spark.sql.maxToStringFields": "100000", "spark.sql.maxPlanStringLength": str(1 << 30)}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert 0 < plan.count("from_json(") <= most


def test_dealt_by_size(spark, tmp_path, monkeypatch):
    """A table in one file is dealt to as many tasks as its size asks for, not to the cores alone."""
    from loomwright import session

    monkeypatch.setattr(session, "SPREAD", 1 << 10)
    monkeypatch.setattr(session, "DEALT", 1 << 12)
    rows = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("x"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    out = session.dealt(spark.read.parquet(str(tmp_path / "t")))
    assert out.rdd.getNumPartitions() > 100 and out.distinct().count() == 40_000


def test_pieces_of_batches():
    """A batch is worked on in pieces, nulls stay, an empty batch is one."""
    import pyarrow as pa
    from loomwright.session import in_pieces

    run = in_pieces(str.upper, pa.string(), 3)
    assert run(pa.array(["a", None, "b", "c", "", "d", "e"])).to_pylist() == ["A", None, "B", "C", "", "D", "E"]
    assert run(pa.array([], pa.string())).to_pylist() == []


def test_only_the_best_sets_list_their_tools(spark):
    """Many tools with equal tokens: the best are found by sets of tokens, so that no candidate set is multiplied by its tools before they are ranked."""
    from loomwright.operators import catalog

    rng = random.Random(4)
    text = lambda: " ".join(rng.choices("abcdef", k=3))
    tools = [(rng.randint(1, 400), text()) for _ in range(400)]
    queries = [(i, text()) for i in range(30)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = sorted(tuple(r) for r in catalog.retrieve_global(frame(queries, "query_id"), frame(tools, "tool_id"), 4).select("query_id", "rank", "tool_id", "score").collect())
    want = []
    for q, a in queries:
        scores = sorted((-len(set(a.split()) & set(b.split())), key) for key, b in tools if set(a.split()) & set(b.split()))
        want += [(q, rank, key, -score) for rank, (score, key) in enumerate(scores[:4], 1)]
    assert got == sorted(want)
    pairs = spark.createDataFrame([("q", str(i)) for i in range(20)], "set string, tools string")
    asked = spark.createDataFrame([("q", ["a"])], "set string, tokens array<string>")
    kept = spark.createDataFrame([(str(i), ["a"], [i, i + 100, i + 200]) for i in range(20)], "set string, tokens array<string>, firsts array<long>")
    scored = catalog._scored(pairs, asked, kept, 3)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2 and plan.index("explode(firsts") < plan.rindex("Window [row_number()")
    assert sorted(r["tool"] for r in scored.collect()) == [0, 1, 2]


def test_events_are_dealt_by_size(spark, tmp_path):
    """A table of one row group is read by one task; the rows are then dealt by the size of the table, so that no task of dumps_over_events grows with it."""
    from loomwright.plans import tables

    parts = {}
    for name, n in (("small", 150_000), ("large", 600_000)):
        rows = spark.range(n).select(F.col("id").alias("event_id"), F.md5(F.col("id").cast("string")).alias("event_type"), F.lit('{"k": 7}').alias("props"))
        rows.coalesce(1).write.parquet(str(tmp_path / name / "events.parquet"))
        parts[name] = tables.dumps_over_events(spark, str(tmp_path / name)).rdd.getNumPartitions()
    assert parts["small"] > 8 and parts["large"] > 3 * parts["small"]


def test_prices_are_read_once_by_partitions_that_grow(spark, sf_dir, tmp_path):
    """The text of prices_canonical is parsed once for all that is printed and stated of it: as a call, as arguments that are text, and as arguments. Its rows are dealt by the size of the table."""
    from loomwright.plans import tables

    plan = tables.prices_canonical(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3
    parts = {}
    for name, n in (("small", 150_000), ("large", 600_000)):
        rows = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") / 100).alias("o_totalprice"), F.md5(F.col("id").cast("string")).alias("o_comment"))
        rows.coalesce(1).write.parquet(str(tmp_path / name / "orders.parquet"))
        parts[name] = tables.prices_canonical(spark, str(tmp_path / name)).rdd.getNumPartitions()
    assert parts["small"] > 8 and parts["large"] > 3 * parts["small"]


def test_opened_calls_give_the_same(spark):
    """Printing and grounding of opened calls equal those of their text, where arguments are no object, too."""
    from loomwright.operators import validate as V

    given = ['{"b":1.50,"a":"x y z","b":2e3}', "{}", "[1]", '{"a":', None, '{"q\\"":"\\u00e9\\n","n":null}']
    df = spark.createDataFrame([(g,) for g in given], "x string").withColumn("c", F.array(F.struct(F.lit('f"').alias("name"), F.col("x").alias("arguments"))))
    df = df.withColumn("o", C.opened(F.col("c")))
    q = F.lit("x y z 2000.0")
    rows = df.select(C.dumps(F.col("c")).alias("a"), C.dumped(C.ordered(F.col("o"))).alias("b"), V.grounded(q, F.col("c")).alias("g"), V.told(q, F.col("o")).alias("t")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and [r["g"] for r in rows] == [r["t"] for r in rows] == [True, True, False, False, False, True]
    assert rows[0]["a"] == '[{"name":"f\\"","arguments":{"a":"x y z","b":2000.0}}]' and rows[5]["a"] == '[{"name":"f\\"","arguments":{"n":null,"q\\"":"é\\n"}}]'
