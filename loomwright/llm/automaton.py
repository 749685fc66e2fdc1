"""BPE as a deterministic automaton over tokens, and table-driven encoding.

The automaton reads tokens. Its state is the token read last; an arc
``t -> x`` labelled ``x`` exists when ``x`` may follow ``t`` in a tokenization
that the merges produce. It is built by one gadget per merge, in rank order.
The gadget of merge ``k``, (a, b) -> x, on the automaton built so far

* adds the state ``x`` with a copy of the arcs that leave ``b``,
* removes the arc ``b`` from state ``a`` (a gadget without that arc does nothing),
* adds an arc ``x`` to every state that still has an arc ``a``.

``explicit_table`` does exactly that on a dense table. With 50,000 merges the
dense table would have 2.5e9 arcs, so ``MergeAutomaton`` keeps each gadget as
one row of four tables (copied-from states, birth, removed arc) and fills in
single arcs on first use, by following the copies back to the byte arcs; it
remembers each arc. Both give the same arcs (tests compare them).

A word is encoded by running the automaton over every split of the word into
labels at once: because exactly one path of valid arcs spells each prefix, one
state per position is enough, and no merge loop runs. Decoding concatenates
the labels of the arcs.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .common import RollingHash, splitmix

# The public GPT-2 pre-splitting pattern's contractions and its special token.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def explicit_table(n_symbols: int, merges: list[tuple[int, int]]) -> np.ndarray:
    """allowed[t, x] after applying the merge gadgets one after another; merge k makes symbol n_symbols + k."""
    n = n_symbols + len(merges)
    allowed = np.zeros((n, n), bool)
    allowed[:n_symbols, :n_symbols] = True
    for k, (a, b) in enumerate(merges):
        x = n_symbols + k
        if not allowed[a, b]:  # no path for the gadget: the merge never applies
            continue
        leaving = allowed[b].copy()
        allowed[a, b] = False
        allowed[:x, x] = allowed[:x, a]
        leaving[x] = leaving[a]
        allowed[x] = leaving
    return allowed


ARCS = 1 << 20  #: arcs that are kept, at most
_NONE: dict[int, bool] = {}
FOLLOWED = 1 << 18  #: transitions along shorter suffixes that are kept, at most


class MergeAutomaton:
    """Compiled from a byte-level ``tokenizers`` JSON file's vocabulary and merges."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None) -> None:
        self.vocab = vocab
        self.special = special or {}
        size = max([*vocab.values(), *self.special.values(), -1]) + 1
        self.labels: list[bytes] = [b""] * size
        for label, i in vocab.items():
            self.labels[i] = label
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.born = [0] * size
        self.left = list(range(size))
        self.right = list(range(size))
        self.removed: dict[int, int] = {}
        alive = {i for label, i in vocab.items() if len(label) == 1}
        for k, (a, b) in enumerate(merges, 1):  # gadget k
            x, i, j = vocab[a + b], vocab[a], vocab[b]
            if x in alive or i not in alive or j not in alive or not self._build(i, j):
                continue  # no path for the gadget: the merge never applies
            self.removed[i << 32 | j] = k
            self.born[x], self.left[x], self.right[x] = k, i, j
            alive.add(x)
        #: Labels that the merges can spell; others are never emitted.
        self.emitted = {label: i for label, i in vocab.items() if i in alive}
        self._alive = alive
        self._arcs: list[dict[int, bool]] = [_NONE] * size  # by label: state -> whether it has the arc
        self._known = 0
        self._compile_labels()

    def _compile_labels(self) -> None:
        """Byte transitions of a matcher for all labels, and for each of its states the labels that end there, longest first."""
        step: dict[int, int] = {}
        own: list[tuple] = [()]
        edges: list[list[tuple[int, int]]] = [[]]
        for label, x in self.emitted.items():
            s = 0
            for byte in label:
                to = step.get(s << 8 | byte)
                if to is None:
                    to = step[s << 8 | byte] = len(own)
                    own.append(())
                    edges.append([])
                    edges[s].append((byte, to))
                s = to
            own[s] = ((len(label), x),)
        back = [0] * len(own)
        queue = [to for _, to in edges[0]]
        for s in queue:  # by depth: a shorter suffix comes before a longer one
            own[s] += own[back[s]]
            for byte, to in edges[s]:
                f = back[s]
                while f and f << 8 | byte not in step:
                    f = back[f]
                back[to] = step.get(f << 8 | byte, 0)
                queue.append(to)
        self._step, self._back, self._ends = step, back, own
        self.most_steps = len(step) + FOLLOWED

    @classmethod
    def from_json(cls, data: bytes | str) -> MergeAutomaton:
        spec = json.loads(data)
        to_byte = byte_characters()
        as_bytes = lambda s: bytes(map(to_byte.__getitem__, s))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        return cls(vocab, [(as_bytes(a), as_bytes(b)) for a, b in merges], special)

    def arc(self, t: int, x: int) -> bool:
        """Whether state ``t`` has an arc ``x``; filled in on first use."""
        known = self._arcs[x].get(t)
        if known is None:
            if self._known >= ARCS:
                self._arcs, self._known = [_NONE] * len(self._arcs), 0
            if self._arcs[x] is _NONE:
                self._arcs[x] = {}
            known = self._arcs[x][t] = t in self._alive and x in self._alive and self._build(t, x)
            self._known += 1
        return known

    def _build(self, t: int, x: int) -> bool:
        born, removed, before = self.born, self.removed, 1 << 62
        while True:
            if removed.get(t << 32 | x, 1 << 62) < before:
                return False
            bt, bx = born[t], born[x]
            if not bt and not bx:
                return True
            if bt == bx:  # the gadget's own state and arc: copied before the removal
                t, x, before = self.right[t], self.left[x], bt
            elif bx > bt:  # an arc added beside the arc of its left part, after the removal
                x, before = self.left[x], bx + 1
            else:  # a state copied from its right part, before the removal
                t, before = self.right[t], bt

    def _follow(self, key: int) -> int:
        """The state after a byte that does not go on with the label at hand: along the shorter suffixes. Kept with the transitions, while there is room."""
        step, back, s, byte = self._step, self._back, key >> 8, key & 255
        while s:
            s = back[s]
            to = step.get(s << 8 | byte)
            if to is not None:
                break
        else:
            to = 0
        if len(step) < self.most_steps:
            step[key] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        emitted = self.emitted
        whole = emitted.get(word)
        if whole is not None:
            return [whole]
        n, arcs, step, ends = len(word), self._arcs, self._step, self._ends
        state: list[int] = [-1] * (n + 1)
        begin = [0] * (n + 1)
        s = 0
        for i, byte in enumerate(word, 1):
            key = s << 8 | byte
            to = step.get(key)
            if to is None:
                to = self._follow(key)
            s = to
            for length, x in ends[s]:
                j = i - length
                if j:
                    t = state[j]
                    if t < 0:
                        continue
                    ok = arcs[x].get(t)
                    if ok is None:
                        ok = self.arc(t, x)
                        arcs = self._arcs
                    if not ok:
                        continue
                state[i], begin[i] = x, j
                break
        if n and state[n] < 0:
            raise ValueError("the vocabulary has no label for a byte of the word")
        out, i = [], n
        while i:
            out.append(state[i])
            i = begin[i]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


LETTER, NUMBER, SPACE, OTHER, END, UNSURE = range(6)


def character_classes() -> np.ndarray:
    """Class of each code point; END beyond the last one.

    A letter or number counts as such if Unicode 3.2 and the present version
    agree. Later letters and unassigned code points are UNSURE: libraries with
    different Unicode versions split them differently.
    """
    old = unicodedata.ucd_3_2_0
    table = np.full(0x110001, OTHER, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] in "LN":
            table[cp] = (LETTER if kind[0] == "L" else NUMBER) if old.category(c)[0] == kind[0] else UNSURE
        elif kind == "Cn" and not (cp & 0xFFFE == 0xFFFE or 0xFDD0 <= cp <= 0xFDEF):
            table[cp] = UNSURE
        elif kind[0] == "Z" or cp in (9, 10, 11, 12, 13, 0x85):
            table[cp] = SPACE
        elif old.category(c)[0] in "LNZ":
            table[cp] = UNSURE
    table[0x110000] = END
    return table


class BatchEncoder:
    """Encodes whole texts: pre-splits in numpy, looks words up in a hash table, sends new words through the automaton."""

    CHUNK = 1 << 17  # code points handled at once
    WORDS = 1 << 20  # words remembered, at most
    LONG = 48  # code points; longer words are not remembered
    SURE_PART = 256  # code points of a part, about, where some part of a text must be split by the library

    def __init__(self, data: bytes) -> None:
        self.automaton = MergeAutomaton.from_json(data)
        self.data = data
        self.classes = character_classes()
        self.values = splitmix(np.arange(0x110001, dtype=np.uint64))
        self.rolling = RollingHash()
        self._library = None
        self.memo: dict[str, int] = {}  # token counts of single words
        self._forget()

    def _forget(self) -> None:
        self.bits = 21
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.count = np.zeros(1 << 12, np.int32)
        self.offset = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.n_words, self.n_flat = 1, 0  # word 0 has no tokens

    def _add(self, words: list[list[int]]) -> int:
        """Append words; the index of the first."""
        counts = np.fromiter(map(len, words), np.int32, len(words))
        ids = np.fromiter((i for w in words for i in w), np.uint32, int(counts.sum()))
        n, m = self.n_words + len(words), self.n_flat + len(ids)
        for name, size in (("count", n), ("offset", n), ("flat", m)):
            old = getattr(self, name)
            if len(old) < size:
                new = np.zeros(max(size, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        first = self.n_words
        self.count[first:n] = counts
        self.offset[first:n] = self.n_flat + np.cumsum(counts) - counts
        self.flat[self.n_flat : m] = ids
        self.n_words, self.n_flat = n, m
        return first

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Word index of each hash, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        out = np.full(len(h), -1, np.int64)
        slot = (h & mask).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.slots[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.slots[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def _put(self, h: np.ndarray, index: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[left[free]]
            mine = self.keys[s] == h[left]
            self.slots[s[mine]] = index[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & mask

    @staticmethod
    def _splits(text: str, size: int) -> list[str]:
        """Parts of at most about ``size`` code points, cut where a word surely begins: at a space between two letters."""
        parts, at = [], 0
        while len(text) - at > size:
            to = at + size
            while True:
                to = text.find(" ", to)
                if to < 0 or to + 1 >= len(text):
                    to = len(text)
                    break
                if text[to - 1].isascii() and text[to - 1].isalpha() and text[to + 1].isascii() and text[to + 1].isalpha():
                    break
                to += 1
            parts.append(text[at:to])
            at = to
        return [*parts, text[at:]] if at < len(text) or not parts else parts

    def encode(self, texts: list[str]):
        """Yields (number of texts, ids, token counts) for runs of the texts, in order."""
        special = self.automaton.special
        run: list[str | int] = []  # parts of text, and ids of special tokens
        owner: list[int] = []
        size = done = 0
        for k, text in enumerate(texts):
            parts: list[str | int] = [text]
            for token, i in special.items():
                if token in text:
                    parts = [y for x in parts for y in (self._between(x, token, i) if isinstance(x, str) else [x])]
            for part in parts:
                for piece in self._splits(part, 4 * self.CHUNK) if isinstance(part, str) and len(part) > 4 * self.CHUNK else [part]:
                    run.append(piece)
                    owner.append(k - done)
                    size += len(piece) + 1 if isinstance(piece, str) else 1
            if size >= self.CHUNK:
                yield self._run(run, owner, k + 1 - done)
                run, owner, size, done = [], [], 0, k + 1
        if done < len(texts):
            yield self._run(run, owner, len(texts) - done)

    @staticmethod
    def _between(text: str, token: str, i: int) -> list[str | int]:
        out: list[str | int] = []
        for k, part in enumerate(text.split(token)):
            out += [i] * bool(k) + [part]
        return out

    def _run(self, run: list[str | int], owner: list[int], n: int):
        size = 0
        pieces, held = [], []  # a part's ids are gathered chunk by chunk
        ids_out, counts = [], np.zeros(n, np.int64)

        def flush():
            nonlocal pieces, held, size
            if pieces:
                ids, per = self._texts(pieces)
                ids_out.append(ids)
                np.add.at(counts, held, per)
            pieces, held, size = [], [], 0

        for part, who in zip(run, owner, strict=True):
            if isinstance(part, int):
                flush()
                ids_out.append(np.array([part], np.uint32))
                counts[who] += 1
                continue
            pieces.append(part)
            held.append(who)
            size += len(part)
            if size >= 2 * self.CHUNK:
                flush()
        flush()
        return n, (np.concatenate(ids_out) if ids_out else np.zeros(0, np.uint32)), counts

    def words(self, texts: list[str]):
        """Words of several texts, each text followed by an empty word that marks its end.

        Returns (lengths in code points, word indices, marks of the ends), or
        None if some code points are UNSURE.
        """
        if self.n_words > self.WORDS:
            self._forget()
        joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cp[ends] = 0x110000
        starts, kind = self.starts(cp)
        if kind is None:
            return None
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(cp))
        h = self.rolling.slices(self.values[cp], first, last)
        h[h == 0] = 1
        is_end = kind[first] == END
        long = ((last - first) > self.LONG) & ~is_end
        h[is_end | long] = 0
        word = np.zeros(len(first), np.int64)
        plain = np.flatnonzero(h)
        found = self._find(h[plain])
        new = plain[found < 0]
        if len(new):
            unique, where = np.unique(h[new], return_index=True)
            at = new[where]
            encode = self.automaton.encode_word
            begin = self._add([encode(joined[a:b].encode()) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)])
            self._put(unique, np.arange(begin, begin + len(unique)))
            found[found < 0] = begin + np.searchsorted(unique, h[new])
        word[plain] = found
        at = np.flatnonzero(long)
        if len(at):
            begin = self._add([self.automaton.encode_word(joined[a:b].encode()) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)])
            word[at] = np.arange(begin, begin + len(at))
        return last - first, word, is_end

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, one after another, and each one's number of ids."""
        got = self.words(texts)
        if got is None:
            if len(texts) == 1:
                parts = self._splits(texts[0], self.SURE_PART)
                if len(parts) > 1:  # only parts with such characters go to the library
                    ids = np.concatenate([self._texts([p])[0] for p in parts])
                    return ids, np.array([len(ids)])
                words = self.library_words(texts[0])
                ids = np.fromiter((i for _, w in words for i in w), np.uint32)
                return ids, np.array([len(ids)])
            parts = [self._texts([t]) for t in texts]
            return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        _, word, is_end = got
        c = self.count[word].astype(np.int64)
        to = np.cumsum(c)
        ids = self.flat[np.repeat(self.offset[word] - (to - c), c) + np.arange(int(to[-1]))]
        return ids, np.diff(to[np.flatnonzero(is_end)], prepend=0)

    def starts(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Where words begin, and each code point's class (None if some are UNSURE)."""
        kind = self.classes[cp]
        if kind.max() == UNSURE:
            return kind, None
        space, blank = kind == SPACE, cp == 32
        change = np.ones(len(cp), bool)
        change[1:] = kind[1:] != kind[:-1]
        after_blank = np.zeros(len(cp), bool)
        after_blank[1:] = blank[:-1]
        starts = change & (space | ~after_blank) | (kind == END)
        # The last of several spaces goes with the word that follows, if one does.
        tail = np.zeros(len(cp), bool)
        tail[:-1] = space[:-1] & ~space[1:] & (kind[1:] != END)
        starts |= tail
        marks = np.flatnonzero((cp == 39) & starts & ~after_blank)
        marks = marks[marks + 1 < len(cp)]
        if len(marks):
            padded = np.append(cp, [0, 0, 0])
            one, two = padded[marks + 1], padded[marks + 2]
            for c in CONTRACTIONS:
                ok = one == ord(c[1])
                if len(c) == 3:
                    ok &= two == ord(c[2])
                at = marks[ok]
                starts[at + 1] = False
                starts[at + len(c)] |= kind[at + len(c)] == LETTER
        return starts, kind

    def library_words(self, text: str) -> list[tuple[int, list[int]]]:
        """Length and ids of each word, split by the library: for texts whose characters Unicode versions class differently."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.data.decode()).pre_tokenizer
        to_byte = byte_characters()
        return [(b - a, self.automaton.encode_word(bytes(map(to_byte.__getitem__, w)))) for w, (a, b) in self._library.pre_tokenize_str(text)]

    def labels_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All labels' bytes in one array, and where each begins (one more at the end)."""
        lengths = np.fromiter(map(len, self.automaton.labels), np.int64, len(self.automaton.labels))
        return np.frombuffer(b"".join(self.automaton.labels), np.uint8), np.concatenate(([0], np.cumsum(lengths)))


_ENCODERS: dict[int, BatchEncoder] = {}


def encoder_for(data: bytes) -> BatchEncoder:
    """One encoder per worker process and vocabulary; it outlives the task."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BatchEncoder(data)
    return _ENCODERS[key]
