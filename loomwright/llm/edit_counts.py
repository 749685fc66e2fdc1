"""Token counts that follow edits (operator 2).

A document's words (the pieces that a BPE pattern splits off) are the leaves
of a segment tree that sums characters and tokens. An edit finds its place
from the character sums, splits and encodes again only the words that it can
change - two words before it, and words after it until a new word boundary
falls on an old one - and updates the sums on the paths to the root.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import BatchEncoder, encoder_for
from .common import in_pieces, text_or_empty
from .tokens import vocabulary

LEAF = 32  #: words in a leaf
#: The public byte-level BPE pattern (a fixed value), for short windows of characters below ``SURE``, which all Unicode versions class alike.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
SURE, SHORT, MEMO = "\u0220", 4096, 1 << 18
#: What a kept tree consists of: characters and tokens of each word, words of each leaf, and the sums of both by node.
STATE = ("lengths", "counts", "leaves", "chars", "tokens")
EDITS = "array<struct<start:int,end:int,text:string>>"


def split_words(encoder: BatchEncoder, text: str) -> tuple[list[int], list[int]]:
    """Length and number of tokens of each word of ``text``; special tokens are words."""
    lengths, counts, memo = [], [], encoder.memo
    parts: list[str | int] = [text]
    for token, i in encoder.automaton.special.items():
        if token in text:
            parts = [y for x in parts for y in (encoder._between(x, token, i) if isinstance(x, str) else [x])]
    for part in parts:
        if isinstance(part, int):
            lengths.append(len(encoder.automaton.labels[part].decode()))
            counts.append(1)
        elif part and len(part) < SHORT and max(part) < SURE:
            words = WORDS.findall(part)
            lengths += map(len, words)
            try:
                counts += [memo[w] for w in words]
            except KeyError:
                if len(memo) > MEMO:
                    memo.clear()
                for w in words:
                    if w not in memo:
                        memo[w] = len(encoder.automaton.encode_word(w.encode()))
                counts += [memo[w] for w in words]
        elif part:
            got = encoder.words([part])
            if got is None:
                words = encoder.library_words(part)
                lengths += [n for n, _ in words]
                counts += [len(ids) for _, ids in words]
            else:
                lengths += got[0][:-1].tolist()
                counts += encoder.count[got[1][:-1]].tolist()
    return lengths, counts


def margin_of(encoder: BatchEncoder) -> int:
    return max(map(len, encoder.automaton.special), default=0)


class TokenTree:
    """Token count of a text under edits. Positions are code points; out-of-range ones are moved into the text.

    Each leaf holds a piece of the text, and characters and tokens of each of
    its words, so that an edit copies a few leaves and not the text.
    """

    def __init__(self, encoder: BatchEncoder, text: str, words: tuple[list[int], list[int]] | None = None) -> None:
        self.encoder, self.reencoded, self.margin = encoder, 0, margin_of(encoder)
        self._build(text, *(words or split_words(encoder, text)))

    def _build(self, text: str, lengths: list[int], counts: list[int]) -> None:
        self.leaves, at = [], 0
        for i in range(0, len(lengths) or 1, LEAF):
            sizes = lengths[i : i + LEAF]
            to = at + sum(sizes)
            self.leaves.append((text[at:to], sizes, counts[i : i + LEAF]))
            at = to
        self.size = size = 1 << (len(self.leaves) - 1).bit_length()
        none = [0] * (size - len(self.leaves))
        self.chars = [0] * size + [len(x[0]) for x in self.leaves] + none
        self.tokens = [0] * size + [sum(x[2]) for x in self.leaves] + none
        for tree in (self.chars, self.tokens):
            for node in range(size - 1, 0, -1):
                tree[node] = tree[2 * node] + tree[2 * node + 1]

    def state(self) -> dict[str, list[int]]:
        """All that the tree holds besides the text."""
        words = [[n for x in self.leaves for n in x[k]] for k in (1, 2)]
        return dict(zip(STATE, (*words, [len(x[1]) for x in self.leaves], self.chars, self.tokens), strict=True))

    @classmethod
    def restored(cls, encoder: BatchEncoder, text: str, state: dict[str, list[int]]) -> TokenTree:
        """The tree of ``state()``; nothing is split, encoded or summed again."""
        tree = cls.__new__(cls)
        tree.encoder, tree.reencoded, tree.margin = encoder, 0, margin_of(encoder)
        tree.chars, tree.tokens = list(state["chars"]), list(state["tokens"])
        tree.size, tree.leaves, word, at = len(tree.chars) // 2, [], 0, 0
        for k, n in enumerate(state["leaves"]):
            to = at + tree.chars[tree.size + k]
            tree.leaves.append((text[at:to], state["lengths"][word : word + n], state["counts"][word : word + n]))
            word, at = word + n, to
        return tree

    @property
    def text(self) -> str:
        return "".join(x[0] for x in self.leaves)

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def words(self) -> int:
        return sum(len(x[1]) for x in self.leaves)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, before, chars = 1, 0, self.chars
        while node < self.size:
            node *= 2
            if char >= before + chars[node] and chars[node + 1]:
                before += chars[node]
                node += 1
        return node - self.size, before

    def _put(self, leaf: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Replace a leaf, and the sums on its path to the root."""
        self.leaves[leaf] = (text, lengths, counts)
        node = self.size + leaf
        more, cost = len(text) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += cost
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``end``."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        shift = len(new) - (end - start)
        if not n:
            self._build(new, *split_words(self.encoder, new))
            self.reencoded += self.words
            return
        # Left: back from the word before the edit by two words more, and over the characters of a special token.
        near = max(0, start - 1 - self.margin)
        first, at = self._leaf_at(near)
        keep = bisect_right(list(accumulate(self.leaves[first][1], initial=at)), near) - 3
        while keep < 0 and first > 0:
            first -= 1
            at -= self.chars[self.size + first]
            keep += len(self.leaves[first][1])
        keep = max(0, keep)
        begin = at + sum(self.leaves[first][1][:keep])
        # Right: widen the window until a new boundary after the edit falls on an old one, clear of the window's own end.
        last, reach, wide = first, at + self.chars[self.size + first], 1
        while True:
            while last + 1 < len(self.leaves) and (reach <= end + self.margin or wide > 0):
                last += 1
                reach += self.chars[self.size + last]
                wide -= reach > end + self.margin
            held = "".join([x[0] for x in self.leaves[first : last + 1]])
            text = held[: start - at] + new + held[end - at :]
            lengths, counts = split_words(self.encoder, text[begin - at :])
            self.reencoded += len(lengths)
            if last + 1 >= len(self.leaves):
                stop, to = len(lengths), reach
                break
            old = {x for x in accumulate((n for x in self.leaves[first : last + 1] for n in x[1]), initial=at) if x >= end}
            news = list(accumulate(lengths, initial=begin))
            safe = range(max(1, bisect_left(news, start + len(new) + self.margin)), min(len(news) - 3, bisect_right(news, reach + shift - self.margin)))
            stop = next((k for k in safe if news[k] - shift in old), 0)
            if stop:
                to = news[stop] - shift
                break
            wide = max(2, 2 * (last - first))
        # Back to the leaf in which the old words go on.
        while last > first and reach - self.chars[self.size + last] >= to:
            reach -= self.chars[self.size + last]
            last -= 1
        where, sizes, of = self.leaves[last][0], self.leaves[last][1], self.leaves[last][2]
        tail = len(sizes) if to == reach else bisect_left(list(accumulate(sizes, initial=reach - len(where))), to)
        lengths = self.leaves[first][1][:keep] + lengths[:stop] + sizes[tail:]
        counts = self.leaves[first][2][:keep] + counts[:stop] + of[tail:]
        text, leaves = text[: reach + shift - at], last + 1 - first
        if len(lengths) > 4 * LEAF * leaves:
            before, after = self.leaves[:first], self.leaves[last + 1 :]
            whole = ["".join([x[0] for x in before]) + text + "".join([x[0] for x in after])]
            for k, some in ((1, lengths), (2, counts)):
                whole.append([n for x in before for n in x[k]] + some + [n for x in after for n in x[k]])
            self._build(*whole)
            return
        begin = word = 0
        for k in range(leaves):
            cut = len(lengths) * (k + 1) // leaves
            stop = begin + sum(lengths[word:cut])
            self._put(first + k, text[begin:stop], lengths[word:cut], counts[word:cut])
            begin, word = stop, cut


def standard_edits(text: Column) -> Column:
    """Four edits that the registered query applies to every document: a replacement, an insertion, a deletion and an addition at the end."""
    n = F.length(text)
    at = lambda part: F.floor(n * part / 4).cast("int")
    edit = lambda start, size, new: F.struct(start.alias("start"), (start + size).alias("end"), F.lit(new).alias("text"))
    return F.array(edit(at(1), 5, "edited"), edit(at(2), 0, " It's 2024, isn't it? "), edit(at(3), 7, ""), edit(n + (1 << 20), 0, "\n\nThe end.")).cast(EDITS)


TREES = "doc_id long, text string, n_tokens long, reencoded long, " + ", ".join(f"{x} array<long>" for x in STATE)


def _rows_of(trees: list[TokenTree], ids: pa.Array) -> pa.RecordBatch:
    states = [t.state() for t in trees]
    columns = [ids, pa.array([t.text for t in trees], pa.string()), pa.array([t.count for t in trees], pa.int64()), pa.array([t.reencoded for t in trees], pa.int64())]
    columns += [pa.array([s[x] for s in states], pa.list_(pa.int64())) for x in STATE]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TREES.split(", ")])


def _edit(tree: TokenTree, changes: list | None) -> None:
    for c in changes or []:
        if c is not None:
            tree.edit(c["start"] or 0, c["end"] or 0, c["text"] or "")


def token_trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, n_tokens, reencoded (0) and the token tree of each row: a table to keep.

    A null text counts as empty. Repeated rows give repeated results. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        encoder = encoder_for(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield _rows_of([TokenTree(encoder, t, w) for t, w in zip(texts, _words_of(encoder, texts), strict=True)], batch.column(0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(in_pieces(run), TREES)


def edit_trees(trees: DataFrame, edits: Column, path: str) -> DataFrame:
    """The rows of ``token_trees`` after ``edits`` (see ``edited_counts``): a table to keep, to which later edits can be applied.

    Only the words that the edits can change are split and encoded again
    (``reencoded``); a row without edits is handed on as it is.
    """
    shared = trees.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        encoder = encoder_for(shared.value)
        for batch in batches:
            out = []
            columns = [batch.column(x) for x in STATE]
            for k, (text, changes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True)):
                tree = TokenTree.restored(encoder, text, {x: c[k].as_py() for x, c in zip(STATE, columns, strict=True)})
                _edit(tree, changes)
                out.append(tree)
            yield _rows_of(out, batch.column("doc_id"))

    return trees.select("doc_id", "text", *STATE, edits.cast(EDITS).alias("edits")).mapInArrow(in_pieces(run), TREES)


def edited_counts(docs: DataFrame, edits: Column, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens before, n_edits, n_tokens_after and reencoded (words split again) of each row.

    ``edits`` are applied one after another; positions count code points of
    the text as it then is. Null edits, and null fields, count as none, 0 and
    empty. A null text counts as empty. Repeated rows give repeated results.
    Trees are built and edited in one pass; ``token_trees`` and ``edit_trees``
    keep them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = "doc_id long, n_words long, n_tokens long, n_edits long, n_tokens_after long, reencoded long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encoder = encoder_for(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for text, changes, words in zip(texts, batch.column(2).to_pylist(), _words_of(encoder, texts), strict=True):
                tree = TokenTree(encoder, text, words)
                n_words, n_tokens = tree.words, tree.count
                _edit(tree, changes)
                rows.append((n_words, n_tokens, len(changes or []), tree.count, tree.reencoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), edits.cast(EDITS).alias("edits")).mapInArrow(in_pieces(run), schema)


def _words_of(encoder: BatchEncoder, texts: list[str]):
    """split_words of each text, many texts at once."""
    at = 0
    special = encoder.automaton.special
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size < 1 << 17 and not any(s in texts[to] for s in special):
            size += len(texts[to]) + 1
            to += 1
        got = encoder.words(texts[at:to]) if to > at else None
        if got is None:
            to = max(to, at + 1)
            for text in texts[at:to]:
                yield split_words(encoder, text)
        else:
            lengths, word, is_end = got
            ends, a = np.flatnonzero(is_end).tolist(), 0
            lengths, counts = lengths.tolist(), encoder.count[word].tolist()
            for b in ends:
                yield lengths[a:b], counts[a:b]
                a = b + 1
        at = to
