"""Automaton, encoding, decoding, counts under edits, packing."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import packing, tokens
from loomwright.llm.automaton import BatchEncoder, MergeAutomaton, explicit_table
from loomwright.llm.edit_counts import EDITS, TokenTree, edit_trees, edited_counts, token_trees

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "the ", "'s", "'", "'ll", "'re", " ", "  ", "\n", "\t", "1", "22", "é", "ñ", "!", "#", "re", "<|endoftext|>", "<|endo", "ftext|>", " word", "😀", "漢", "٣", "½", "\x85", "\x1c", "\0", "'S", "՘", "꟎", "\r\n", "é"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return BatchEncoder(tokens.vocabulary(PATH))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def naive(word, rank):
    symbols = list(word)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def random_merges(rng, n):
    labels, merges = [bytes([97 + i]) for i in range(4)], []
    while len(merges) < n:
        a, b = rng.choice(labels), rng.choice(labels)
        if a + b not in labels:
            merges.append((a, b))
            labels.append(a + b)
    return labels, merges


def test_arcs_equal_the_explicit_gadgets():
    rng = random.Random(1)
    for _ in range(20):
        labels, merges = random_merges(rng, rng.randint(1, 25))
        vocab = {x: i for i, x in enumerate(labels)}
        automaton = MergeAutomaton(vocab, merges)
        table = explicit_table(4, [(vocab[a], vocab[b]) for a, b in merges])
        got = np.array([[automaton.arc(t, x) for x in range(len(labels))] for t in range(len(labels))])
        assert (got == table).all()


def test_words_equal_the_merge_loop():
    rng = random.Random(2)
    for _ in range(20):
        labels, merges = random_merges(rng, rng.randint(0, 25))
        automaton = MergeAutomaton({x: i for i, x in enumerate(labels)}, merges)
        rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        for _ in range(100):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12)))
            assert [labels[i] for i in automaton.encode_word(word)] == naive([bytes([c]) for c in word], rank)


def test_texts_equal_the_library(encoder, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "\n\n", "a" * 3000, " " * 500, "x 's", "''s"]
    at = 0
    for n, ids, counts in encoder.encode(texts):
        to = np.concatenate(([0], np.cumsum(counts)))
        for k in range(n):
            assert ids[to[k] : to[k + 1]].tolist() == ids_of(library, texts[at + k]), texts[at + k]
        at += n
    assert at == len(texts)


def test_memory_is_bounded_and_long_texts_are_split(encoder, library, monkeypatch):
    monkeypatch.setattr(BatchEncoder, "WORDS", 50)
    monkeypatch.setattr(BatchEncoder, "CHUNK", 200)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(600)) for _ in range(4)]
    got = [ids for _, ids, _ in encoder.encode(texts)]
    assert np.concatenate(got).tolist() == [i for t in texts for i in ids_of(library, t)]


ROWS = [(1, "It's 2024, isn't it?\n\n  ok"), (2, ""), (3, None), (None, "no id"), (5, "word " * 4000), (5, "word " * 4000), (6, "<|endoftext|> é漢😀"), (7, "a" * 5000)]
SCHEMA = "doc_id long, text string, n_tokens long, length string, at string, bucket int"


def clashing(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "x", "y", 3) for r in rows], SCHEMA)


def test_digests(spark, library):
    got = tokens.token_digests(clashing(spark, ROWS), PATH).collect()
    want = []
    for k, text in ROWS:
        ids = ids_of(library, text)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokens.token_digests(clashing(spark, []), PATH).collect() == []


def test_round_trip(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0]], "doc_id long, text string")
    back = tokens.decode_documents(tokens.encode_documents(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == sorted((k, t or "") for k, t in ROWS if k)


def check_packing(library, rows, got, capacity):
    pieces = collections.Counter()
    for k, text in rows:
        ids = ids_of(library, text) + [2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        at, piece = 0, 0
        while at < len(ids):
            size = first if piece == 0 else capacity
            pieces[(k, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()))] += 1
            at, piece = at + size, piece + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), math.ceil(sum(k[3] * n for k, n in pieces.items()) / capacity)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing(spark, library, capacity):
    got = packing.pack_documents(clashing(spark, ROWS), PATH, capacity).collect()
    n, least = check_packing(library, ROWS, got, capacity)
    assert least <= n <= least + 2
    assert packing.pack_documents(clashing(spark, []), PATH).collect() == []


def test_packing_table(spark, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n, least = check_packing(library, rows, packing.pack_documents(docs, PATH).collect(), 1024)
    assert n <= 1.05 * least + 1


def test_packing_in_buckets(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    rows = [(i, "same text") for i in range(100)]
    n, least = check_packing(library, rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 32).collect(), 32)
    assert n <= least + 4


def test_plans_use_every_piece():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([7, 16, 64])
        counts = {k: rng.randint(0, 40) for k in range(1, capacity + 1) if rng.random() < 0.6}
        used = collections.Counter()
        for lengths, n in packing.pack_counts(counts, capacity):
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                used[x] += n
        assert used == collections.Counter({k: n for k, n in counts.items() if n})


def test_complements_fill_exactly():
    plan = packing.pack_counts({10: 5, 6: 5, 9: 3, 4: 3, 3: 3, 8: 2, 5: 2, 2: 2, 1: 2}, 16)
    assert sum(n for lengths, n in plan if sum(lengths) == 16) == sum(n for _, n in plan) == 10


def test_edits_equal_a_new_count(encoder, library):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice(BITS) for _ in range(n))
    for _ in range(60):
        text = make(rng.choice([0, 1, 3, 20, 200, 500]))
        tree = TokenTree(encoder, text)
        assert tree.count == len(ids_of(library, text))
        for _ in range(8):
            a = rng.randint(-2, len(text) + 3)
            b, new = a + rng.choice([0, 0, 1, 3, 30, 300]), make(rng.choice([0, 1, 2, 5, 60]))
            start = min(max(a, 0), len(text))
            text = text[:start] + new + text[min(max(b, start), len(text)) :]
            tree.edit(a, b, new)
            assert tree.text == text and tree.count == len(ids_of(library, text))


def test_edits_touch_few_words(encoder):
    tree = TokenTree(encoder, "some words in a row " * 5000)
    tree.edit(50_000, 50_003, "another")
    assert tree.reencoded < 300 < tree.words


def test_edited_counts(spark, library):
    rows = [(*r, [(0, 2, "So"), (10**6, 0, " end")]) for r in ROWS] + [(8, "abc", None), (9, "abc", [None, (None, None, None), (1, 2, None)])]
    docs = spark.createDataFrame([(a, b, [c and c for c in e] if e else e, 1) for a, b, e in rows], f"doc_id long, text string, edits {EDITS}, reencoded int")
    got = {(r["doc_id"], r["n_tokens"], r["n_tokens_after"]) for r in edited_counts(docs, F.col("edits"), PATH).collect()}
    count = lambda t: len(ids_of(library, t))
    want = {(k, count(t), count("So" + (t or "")[2:] + " end")) for k, t in ROWS} | {(8, count("abc"), count("abc")), (9, count("abc"), count("ac"))}
    assert got == want
    assert edited_counts(docs.limit(0), F.col("edits"), PATH).collect() == []


def test_kept_trees_take_later_edits(spark, library, tmp_path):
    """Trees are written, edited, written and edited again; each batch splits few words again and gives the count of the new text."""
    rng = random.Random(12)
    texts = [None, "", "abc", *("".join(rng.choice(BITS) for _ in range(900)) for _ in range(6)), "some words in a row " * 3000]
    trees = token_trees(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    now = {k: t or "" for k, t in enumerate(texts)}
    for batch in range(3):
        trees.write.parquet(str(tmp_path / str(batch)))
        changes = {k: [(rng.randrange(len(t) + 1), 0, " new"), (5, 9, None)] for k, t in now.items() if k % 2 == batch % 2}
        for k, edits in changes.items():
            for start, end, new in edits:
                start = min(start, len(now[k]))
                now[k] = now[k][:start] + (new or "") + now[k][max(start, end) :]
        kept = spark.read.parquet(str(tmp_path / str(batch)))
        edits = spark.createDataFrame([(k, [(a, max(a, b), c) for a, b, c in e]) for k, e in changes.items()], f"doc_id long, edits {EDITS}")
        trees = edit_trees(kept.join(edits, "doc_id", "left"), F.col("edits"), PATH)
        for r in trees.collect():
            assert r["text"] == now[r["doc_id"]] and r["n_tokens"] == len(ids_of(library, r["text"])) == sum(r["counts"])
            assert (r["reencoded"] > 0) <= (r["doc_id"] in changes) and r["reencoded"] < 600
    assert trees.limit(0).collect() == []
