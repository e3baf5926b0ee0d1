"""LM scoring by online logistic context mixing.

A text is its tokens: lower-cased (A-Z) words and one end. A token is coded in
bits, and the bits' probabilities give the text's:

* The most frequent training tokens (``words`` at most) and an escape are the
  leaves of an alphabetic tree; a bit's node there is its symbol context. Every bit is
  mixed from four predictors: the node alone (exact counts), and the node
  hashed with the end of the word before, with that whole word, and with the
  last two frequent words before, which tell what kind of text it is.
* What is escaped is a mixture of two codes: its share of the counts of all
  training tokens outside the tree (by a join to the table of all counts,
  which grows with the corpus and is never collected), and its spelling, by
  the bits of its bytes and a closing space. The spelling's predictors are the
  bits so far hashed with the last frequent word and two bytes before, with
  three and four bytes before, and with the whole word so far. How much goes to spelling is the share of training tokens that
  occur once (Good and Turing's estimate of what is new).

A hashed context's slot holds how often either bit followed in the training
texts (spelled bits: in tokens that are escaped or occur once there, which are
like what is new).
A predictor draws its counts towards what a shorter context says, so one
seldom seen says little; it enters the mixture as what it adds in log odds.
The mixture is a weighted sum: the weights are chosen by a gate (how often the
contexts were seen), start from fixed values and are refined online, after
each block of words, by the gradient of that block's coding cost. They start
anew in every document, so a score depends on the training texts and the
document alone. ``score`` is the log10 probability; ``bits_per_byte`` is the
same in bits over the lower-cased text's bytes.

``base_score`` is that of single token counts.

Everything that is gathered covers all training texts. The number of slots
follows the number of training tokens up to ``1 << slots`` for each of six
tables; those and ``words`` tokens are what is broadcast, 48 MB and a few.

Defined results: a null text counts as empty (one end token); repeated rows
get equal scores; a null id counts as the empty text where rows are dealt into
training and held-out; without training tokens every count is 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.llm.common import crc_mod, quoted, text_or_empty
from mnemolith.session import bounded_batches, cut

#: The end token and the escape as table keys; words are never empty and hold no blank.
END, ESCAPE = b"", b" "
#: Words between refinements of the weights, words and bytes that are worked on at once, bytes whose equal words and pairs are counted together.
BLOCK, AT_ONCE, BYTES, TOGETHER = 64, 20_480, 8_000_000, 4_000_000
#: Levels of a tree whose nodes have their slots side by side, so that they come from memory together.
LEVELS = 4
#: Predictors of a bit, gates of coded and of spelled bits, tables of slots (three of coded bits, one of spelled).
INPUTS, GATES, TABLES = 4, 32, 6
#: The tables of coded and of spelled bits' contexts.
OF_CODED, OF_SPELLED = (0, 1, 2), (3, 3, 4, 5)
#: Tokens whose last two before a token tell what kind of text it is in.
FREQUENT = 64
#: Bounds of how often a context was seen, for the gates.
SEEN = (2, 16, 256)
#: Pieces that the tables of counts are merged in.
PIECES = 512
#: How much a predictor is drawn to what the shorter context says, in observations.
DRAWN = ((4.0, 16.0, 4.0), (4.0, 4.0, 4.0, 4.0))
#: First weights of the predictors, for coded and for spelled bits.
FIRST = np.repeat(np.array([[1.0, 0.8, 0.8, 0.8], [1.0, 1.0, 0.7, 0.3]], np.float32).T, GATES // 2, axis=1)
RATE = 0.02
EDGE = np.isin(np.arange(256), np.frombuffer(b".,;:!?()\"'", np.uint8))


Code = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def alphabetic(keys: list, counts: list[int]) -> Code:
    """(first, number, nodes, bits, odds): each symbol's code as a run of nodes and bits, and the odds of a 1 at each of those by the counts.

    The tree halves the symbols, sorted by their keys, where their counts are halved. So a node's
    symbols begin alike, and what a context says of one of them is learnt from all.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    upto = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[order])])
    paths: list[tuple] = [()] * len(keys)
    todo, node, ones = [(0, len(keys), ())], 0, []
    while todo:
        a, z, path = todo.pop()
        if z - a == 1:
            paths[order[a]] = path
            continue
        half = (upto[a] + upto[z]) / 2
        k = int(np.searchsorted(upto[a + 1 : z], half)) + a + 1
        if k == z or k > a + 1 and half - upto[k - 1] < upto[k] - half:
            k -= 1
        ones.append((upto[z] - upto[k]) / (upto[k] - upto[a]))
        todo += [(a, k, (*path, (node, 0))), (k, z, (*path, (node, 1)))]
        node += 1
    number = np.fromiter(map(len, paths), np.int64, len(paths))
    flat = np.array([x for p in paths for x in p], np.int64).reshape(-1, 2)
    return np.cumsum(number) - number, number, flat[:, 0].copy(), flat[:, 1].astype(np.int8), np.array(ones, np.float32)[flat[:, 0]] if len(flat) else np.empty(0, np.float32)


def split(texts: pa.Array) -> pa.Array:
    """A list of words for each text, and empty ones beside leading and closing blanks."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))


class Tokens:
    """Tokens of some texts: kinds (the distinct tokens), of each token its kind, its text, and its place there."""

    def __init__(self, texts: pa.Array):
        lists = split(texts)
        coded = lists.flatten().dictionary_encode()
        self.kinds: list[bytes] = coded.dictionary.cast(pa.large_binary()).to_pylist()
        kind = coded.indices.to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        if b"" in self.kinds:  # beside leading and closing blanks
            full = kind != self.kinds.index(b"")
            kind, of = kind[full], of[full]
        self.count = np.bincount(of, minlength=len(texts)) + 1
        self.of = np.repeat(np.arange(len(texts)), self.count)
        self.kind = np.full(len(self.of), len(self.kinds))
        self.kind[np.arange(len(kind)) + of] = kind
        self.kinds.append(END)
        self.place = np.arange(len(self.of)) - np.repeat(np.cumsum(self.count) - self.count, self.count)


def runs(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first, texts) in runs of BYTES bytes at most, or one text; copies, since the kernels used later misread slices."""
    size = pc.binary_length(texts).to_numpy()
    a, n = 0, 0
    for k, x in enumerate(size.tolist()):
        if k > a and n + x > BYTES:
            yield a, texts.take(pa.array(range(a, k)))
            a, n = k, 0
        n += x
    if len(size) > a:
        yield a, texts.take(pa.array(range(a, len(size))))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first column of batches that hold TOGETHER bytes, so that what they share is worked out once."""
    some, n = [], 0
    for b in batches:
        some.append(b.column(0))
        n += some[-1].nbytes
        if n >= TOGETHER:
            yield pa.concat_arrays(some)
            some, n = [], 0
    if some:
        yield pa.concat_arrays(some)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def side_by_side(code: Code, factor: int) -> np.ndarray:
    """At each place of a code: the hash of the node LEVELS or fewer levels up where a run of slots begins, and in its low bits which slot of it is the place's."""
    first, number, nodes, bits, _ = code
    at = np.arange(len(nodes))
    depth = (at - np.repeat(first, number)) % LEVELS
    which = np.ones(len(nodes), np.int64)
    for d in range(1, LEVELS):
        deep = at[depth == d]
        which[deep] = 2 * which[deep - 1] + bits[deep - 1]
    low = np.uint64((1 << LEVELS) - 1)
    return (nodes[at - depth].astype(np.uint64) + np.uint64(1)) * np.uint64(factor) & ~low | which.astype(np.uint64)


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word a hash of its last three bytes, closing punctuation left out, and one of the whole."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    b = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    starts, here = np.cumsum(size) - size, np.arange(len(b))
    whole = np.add.reduceat(_mix64((b + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (here - np.repeat(starts, size)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts)
    inner = ~EDGE[b]
    inner[starts + size - 1] = False
    last = np.maximum.accumulate(np.where(inner, here, -1))[starts + size - 1]
    ends = np.ones(len(words), np.uint64)
    for k in range(3):
        ends = ends * np.uint64(257) + np.where(last - k >= starts, b[np.maximum(last - k, 0)] + np.uint64(1), np.uint64(0))
    return _mix64(ends * np.uint64(0x9E3779B97F4A7C15)), _mix64(whole)


class Coder:
    """Turns tokens into bit events: place in the code, bit, and slots of the predictors."""

    def __init__(self, vocabulary: list[bytes], code: tuple, spelling: tuple, slots: int):
        self.index = {w: k for k, w in enumerate(vocabulary)}
        self.code, self.spelling, self.slots = code, spelling, slots
        self.escape = self.index[ESCAPE]
        self.keys = [side_by_side(c, k) for c, k in ((code, 0x9E3779B97F4A7C15), (spelling, 0xD1342543DE82EF95))]
        self.prior, self.logit = ([f(c[4]) for c in (code, spelling)] for f in (lambda odds: odds / (1 + odds), np.log))
        self.signs = [2 * c[3].astype(np.float32) - 1 for c in (code, spelling)]
        #: Bits that a context leaves free for a symbol.
        self.symbols = np.uint64((1 << len(vocabulary).bit_length()) - 1)

    def look(self, t: Tokens) -> tuple[np.ndarray, ...]:
        """Symbol of each token; hashes of the end of the token before it, of that whole token, and of the last two frequent ones before; the last of those."""
        get, escape = self.index.get, self.escape
        symbol = np.fromiter(map(get, t.kinds, repeat(escape)), np.int64, len(t.kinds))[t.kind]
        ends, whole = np.zeros(len(symbol), np.uint64), np.zeros(len(symbol), np.uint64)
        later = t.place[1:] > 0
        for context, own in zip((ends, whole), hashes(t.kinds)):
            np.copyto(context[1:], (own & ~self.symbols)[t.kind[:-1]], where=later)
        here = np.arange(len(symbol))
        start = here - t.place
        frequent = np.concatenate([[-1], np.maximum.accumulate(np.where(symbol < FREQUENT, here, -1))])
        last = frequent[:-1]  # before the token; -1 or before its text if there is none
        last2 = np.where(last >= start, frequent[np.maximum(last, 0)], -1)
        one, two = (np.where(x >= start, symbol[x], FREQUENT).astype(np.uint64) for x in (last, last2))
        return symbol, ends, whole, _mix64((one * np.uint64(FREQUENT + 1) + two + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & ~self.symbols, one

    def _events(self, code: tuple, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each symbol, which symbol each bit is of, and its place in the code."""
        n = code[1][symbol]
        of = np.repeat(np.arange(len(symbol)), n)
        at = np.arange(len(of))
        at += (code[0][symbol] - (np.cumsum(n) - n))[of]
        return n, of, at

    def coded(self, symbol: np.ndarray, *contexts: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits of each token, places in the code, slots of its contexts); ``first`` is the table of the first of these."""
        n, word, at = self._events(self.code, symbol)
        key, slot = self.keys[0][at], np.empty((len(contexts), len(at)), np.int64)
        low = key & np.uint64((1 << LEVELS) - 1)
        key ^= low
        for k, c in enumerate(contexts):
            h = c[word]
            h ^= key
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h >>= np.uint64(64 - self.slots)
            h ^= low
            slot[k] = h
            slot[k] += OF_CODED[first + k] << self.slots
        return n, at, slot

    def pairs(self, symbol: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of a symbol and its context, and how often each is there."""
        pair, n = np.unique(context | symbol.astype(np.uint64), return_counts=True)
        own = pair & self.symbols
        return own.astype(np.int64), pair ^ own, n

    def spelled(self, words: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits of each word, places in the code, slots) of the bits that spell words, each with a closing space; ``kind`` tells the text's."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        raw = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        b = raw.astype(np.uint64)
        starts = np.cumsum(size) - size
        place = np.arange(len(b)) - np.repeat(starts, size)
        past, pasts = np.zeros(len(b), np.uint64), []
        for k in range(1, 5):
            prior = np.zeros(len(b), np.uint64)
            prior[k:] = b[:-k]
            past = past * np.uint64(257) + np.where(place >= k, prior + np.uint64(1), np.uint64(0))
            if k > 1:
                pasts.append(past * np.uint64(256) + (np.repeat(kind, size) if k == 2 else np.uint64(k - 1)))
        # the whole word so far: a running sum of mixed bytes less what it was where the word began
        mixed = np.cumsum(_mix64((b + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        sofar = np.concatenate([np.zeros(1, np.uint64), mixed[:-1]])
        pasts.append(sofar - np.repeat(sofar[starts], size))
        n, char, at = self._events(self.spelling, raw.astype(np.int64))
        key, slot = self.keys[1][at], np.empty((len(pasts), len(at)), np.int64)
        low = key & np.uint64((1 << LEVELS) - 1)
        key ^= low
        for k, p in enumerate(pasts):
            h = _mix64(p * np.uint64(0x9E3779B97F4A7C15))[char]
            h ^= key
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h >>= np.uint64(64 - self.slots)
            h ^= low
            slot[k] = h
            slot[k] += OF_SPELLED[k] << self.slots
        return np.add.reduceat(n, starts), at, slot


class Wide:
    """A table that is copied when a worker reads it: numpy asks for large memory pages, a pickle doesn't, and looking up places anywhere in a table on small pages takes longer."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __reduce__(self):
        return np.copy, (self.table,)


class Scorer:
    """``table`` has a slot's counts of ones and of zeros in the upper and the lower 16 bits."""

    def __init__(self, coder: Coder, table: np.ndarray):
        self.coder, self.table = coder, table

    def _counts(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a 1 and a 0 followed."""
        c = self.table[slot].astype("<u4", copy=False).view("<u2")
        return c[1::2].astype(np.float32), c[::2].astype(np.float32)

    def inputs(self, kind: int, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each predictor adds in log odds, gate) of coded (0) or spelled (1) bits."""
        one = self.coder.prior[kind][at]
        zero = 1 - one
        x = np.empty((INPUTS, len(at)), np.float32)
        gate = np.full(len(at), kind, np.uint8)  # the upper half is of spelled bits
        before = np.float32(0)
        if kind == 0:
            before = x[0] = self.coder.logit[0][at]
            k = DRAWN[0][2]
            a, b = self._counts(slot[2])
            a += k * one
            b += k * zero
            a /= b
            np.log(a, out=x[3])
            x[3] -= before
        # each predictor is drawn to the one before
        steps, gates = (((1, 0), (2, 1)), (0, 1)) if kind == 0 else (tuple((i, i) for i in range(INPUTS)), (1, 3))
        for i, c in steps:
            k = DRAWN[kind][c]
            a, b = self._counts(slot[c])
            if c in gates:
                n = a + b
                gate *= 4
                for least in SEEN:
                    gate += (n >= least).view(np.uint8)
            a += k * one
            b += k * zero
            odds = a / b
            if (i, c) != steps[-1]:  # probabilities for the next one
                zero = 1 / (1 + odds)
                one = odds * zero
            np.log(odds, out=odds)
            np.subtract(odds, before, out=x[i])
            before = odds
        return x, gate.astype(np.int64)

    def score(self, t: Tokens, looked: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text's coded bits, and of each token's spelling (0 for those in the tree); ``looked`` is what the coder says of the tokens."""
        looked = looked or self.coder.look(t)
        symbol = looked[0]
        total, spelt = np.zeros(len(t.count)), np.zeros(len(symbol))
        ends, w, begin = np.cumsum(t.count), None, 0
        while begin < len(symbol):
            # whole texts, or a part of one
            whole = int(np.searchsorted(ends, begin + AT_ONCE, side="right"))
            if t.place[begin] == 0 and whole and ends[whole - 1] > begin:
                stop = int(ends[whole - 1])
            else:
                stop = min(begin + AT_ONCE, int(ends[t.of[begin]]))
            of, place = t.of[begin:stop], t.place[begin:stop]
            docs = np.arange(of[0], of[-1] + 1)
            block = (place - place[0] if len(docs) == 1 else place) // BLOCK
            # the longest text first, so that the weights of those that go on are the first ones
            docs = docs[np.argsort(-t.count[docs], kind="stable")]
            rank = np.empty(len(docs), np.int64)
            rank[docs - of[0]] = np.arange(len(docs))
            whose = rank[of - of[0]]
            if w is None or place[0] == 0:
                w = np.tile(FIRST.T, (len(docs), 1))
            # blocks of all texts come side by side, so that each step works on many
            order = np.argsort(block, kind="stable")
            whose, block = whose[order], block[order]
            own = symbol[begin:stop][order]
            edges = np.searchsorted(block, np.arange(block[-1] + 2))
            live = (np.maximum.reduceat(whose, edges[:-1]) + 1) * GATES
            streams = []
            for kind in (0, 1):
                if kind == 0:
                    n, at, slot = self.coder.coded(own, *(c[begin:stop][order] for c in looked[1:4]))
                    its, word = edges, np.repeat(whose * GATES, n)
                else:
                    strange = np.flatnonzero(own == self.coder.escape)
                    if not len(strange):
                        continue
                    n, at, slot = self.coder.spelled([t.kinds[k] for k in t.kind[begin:stop][order[strange]].tolist()], looked[4][begin:stop][order[strange]])
                    its, word = np.searchsorted(strange, edges), np.repeat(whose[strange] * GATES, n)
                x, gate = self.inputs(kind, at, slot)
                gate += word
                x *= self.coder.signs[kind][at]  # for the bit that came, not for a 1
                streams.append((np.concatenate([[0], np.cumsum(n)])[its].tolist(), x, gate, np.empty(len(at), np.float32), n))
            for k, cells in enumerate(live.tolist()):
                for at, x, cell, inverse, _ in streams:
                    a, z = at[k], at[k + 1]
                    if a < z:
                        self._step(w[:cells], x[:, a:z], cell[a:z], inverse[a:z])
            for kind, (_, _, _, inverse, n) in enumerate(streams):
                np.log(inverse, out=inverse)
                each = np.add.reduceat(inverse, np.cumsum(n) - n, dtype=np.float64)
                if kind == 0:
                    total[docs] -= np.bincount(whose, each, len(docs))
                else:
                    spelt[begin + order[strange]] = -each
            begin = stop
        return total, spelt

    def _step(self, w: np.ndarray, x: np.ndarray, cell: np.ndarray, inverse: np.ndarray) -> None:
        """Sets the inverse probabilities of a block's bits; takes one step along the gradient of their costs."""
        own = w.take(cell, axis=0)
        s = own[:, 0] * x[0]
        for i in range(1, len(x)):
            s += own[:, i] * x[i]
        np.minimum(s, 16, out=s)
        np.maximum(s, -16, out=s)
        np.negative(s, out=s)
        np.exp(s, out=inverse)
        inverse += 1
        np.divide(-1, inverse, out=s)
        s += 1
        moved = np.empty((len(x), len(w)))
        for i in range(len(x)):
            moved[i] = np.bincount(cell, s * x[i], len(w))
        np.minimum(moved, 20, out=moved)
        np.maximum(moved, -20, out=moved)
        moved *= RATE
        w += moved.T


def token_counts(training: DataFrame) -> DataFrame:
    """(token, n) over all texts; the end token is the empty binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])

        found: Counter[bytes] = Counter()
        for column in gathered(batches):
            for _, texts in runs(column):
                words, n = split(texts).flatten().value_counts().flatten()
                found[END] += len(texts)
                for w, k in zip(words.cast(pa.large_binary()).to_pylist(), n.to_pylist()):
                    if w:  # blanks that lead and close give empty ones
                        found[w] += k
                if len(found) > 500_000:
                    yield out(found)
                    found = Counter()
        yield out(found)

    return training.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def context_counts(training: DataFrame, shared, slots: int) -> np.ndarray:
    """The tables of slots over all training texts: coded bits of every token, spelled bits of those that are escaped or occur once.

    A task sends its pieces as slots and counts where few are set, else as counts alone.
    """
    size = TABLES << slots
    width = size // PIECES

    def pieces(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.reshape(PIECES, width, 2)
        for p in range(PIECES):
            x = table[p]
            some = np.flatnonzero(x.any(axis=1))
            if len(some):
                sparse = 2 * len(some) < width
                kept = x[some] if sparse else x
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([some.astype("<u4").tobytes() if sparse else b""], pa.binary()), pa.array([kept.astype("<u2" if kept.max() < 1 << 16 else "<u4").tobytes()], pa.binary())], names=["piece", "slots", "counts"])

    def add(table: np.ndarray, bit: np.ndarray, slot: np.ndarray, n: np.ndarray) -> None:
        slot *= 2
        slot += bit
        np.add.at(table, slot, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *given, once = shared.value
        coder, table = Coder(*given), np.zeros(2 * size, np.uint32)
        for column in gathered(batches):
            for _, texts in runs(column):
                t = Tokens(texts)
                *every, kind = coder.look(t)
                for i, context in enumerate(every[1:]):
                    own, its, often = coder.pairs(every[0], context)
                    often = often.astype(np.uint32)
                    for k in range(0, len(own), AT_ONCE):
                        n, at, (slot,) = coder.coded(own[k : k + AT_ONCE], its[k : k + AT_ONCE], first=i)
                        add(table, coder.code[3][at], slot, np.repeat(often[k : k + AT_ONCE], n))
                for k in range(0, len(t.kind), AT_ONCE):
                    rare = np.flatnonzero(once[every[0][k : k + AT_ONCE]]) + k
                    if len(rare):
                        _, at, slot = coder.spelled([t.kinds[i] for i in t.kind[rare].tolist()], kind[rare])
                        bit, one = coder.spelling[3][at], np.ones(len(at), np.uint32)
                        for s in slot:
                            add(table, bit, s, one)
        yield from pieces(table)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, at, raw in zip(*(c.to_pylist() for c in b.columns)):
                its = np.frombuffer(at, "<u4") if at else slice(None)
                n = len(at) // 4 if at else width
                total.setdefault(p, np.zeros((width, 2), np.int64))[its] += np.frombuffer(raw, "<u2" if len(raw) == 4 * n else "<u4").reshape(n, 2)
        for p, x in total.items():
            while (large := x.max(axis=1) >= 1 << 16).any():  # counts that don't fit are halved together
                x[large] = (x[large] + 1) // 2
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([(x[:, 1] << 16 | x[:, 0]).astype("<u4").tobytes()], pa.binary())], names=["piece", "counts"])

    table = np.zeros((PIECES, width), np.uint32)
    schema = "piece int, slots binary, counts binary"
    every = few(training.select("text")).mapInArrow(count, schema)
    for r in every.repartition("piece").mapInArrow(merge, "piece int, counts binary").toLocalIterator():
        table[r.piece] = np.frombuffer(r.counts, "<u4")  # PIECES rows
    return table.reshape(-1)


def frequent_tokens(counts: DataFrame, words: int) -> dict[bytes, int]:
    """The most frequent tokens, ``words`` at most, most frequent first: those whose count is above a bound that a histogram of counts gives."""
    bucket = F.floor(F.log2("n") * 256).cast("int")
    sizes = sorted(((r.b, r.k) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)  # 64 * 256 rows at most
    least, n = None, 0
    for b, k in sizes:
        if n + k > words:
            break
        least, n = b, n + k
    chosen = counts.where(bucket >= least).collect() if least is not None else []  # ``words`` rows at most
    return dict(sorted(((bytes(r.token), r.n) for r in chosen), key=lambda x: (-x[1], x[0])))


def few(df: DataFrame) -> DataFrame:
    """A quarter of the tasks, or one for each core: each of them sends a table."""
    n = df.rdd.getNumPartitions()
    return df.coalesce(max(1, min(n, max(df.sparkSession.sparkContext.defaultParallelism, -(-n // 4)))))


def lm_scores(docs: DataFrame, parts: int = 5, held: int = 1, words: int = 1 << 17, slots: int = 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text"), (crc_mod(id_col, parts) == held).alias("held_out"))
    training = rows.where("not held_out")
    counts = cut(token_counts(training))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.sum(F.when(F.length("token") == 0, F.col("n"))).alias("ends")).first()
    known = frequent_tokens(counts, words)
    if total.ends:
        known.setdefault(END, total.ends)  # in the tree, however rare
    rest = total.n - sum(known.values())
    # of what is escaped, the share that is new
    escaped = rest + total.once + 1
    new = (total.once + 1) / escaped
    symbols = [*known, *([] if END in known else [END]), ESCAPE]
    code = alphabetic(symbols, [*(known.get(s, 1) for s in symbols[:-1]), escaped])
    # bytes of the frequent tokens shape the code that spells words
    of_byte = Counter(b for w in symbols for b in w)
    spelling = alphabetic(list(range(256)), [16 * of_byte[b] + 1 for b in range(32)] + [len(symbols)] + [16 * of_byte[b] + 1 for b in range(33, 256)])
    slots = min(slots, max(12, (total.n + 1).bit_length()))
    once = np.array([known.get(s, 0) == 1 and s != END for s in symbols[:-1]] + [True])
    shared = spark.sparkContext.broadcast((symbols, code, spelling, slots, once))
    model = spark.sparkContext.broadcast((Wide(context_counts(training, shared, slots)), np.array([*(known.get(s, 0) for s in symbols[:-1]), 0])))
    n_all, norm = total.n, math.log10(total.n + 0.5 * (total.v + 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = model.value
        scorer = Scorer(Coder(*shared.value[:4]), table)
        logs = np.log10(known + 0.5)
        for b in batches:
            for first, texts in runs(b.column(1)):
                t, size = Tokens(texts), len(texts)
                symbol, *_ = looked = scorer.coder.look(t)
                score, spelt = scorer.score(t, looked)
                log, top = logs[symbol], known[symbol] > 0
                # the tokens outside the tree, with the cost of their spelling
                other = np.flatnonzero(spelt)
                offsets = pa.array(np.searchsorted(t.of[other], np.arange(size + 1)).astype(np.int32))
                names, kinds = ["id", "held_out", "coded", "n_tokens", "n_top", "top_sum", "n_bytes", "rare", "spelt"], pa.array([t.kinds[k] for k in t.kind[other].tolist()], pa.binary())
                columns = [score, t.count, np.bincount(t.of[top], minlength=size), np.bincount(t.of[top], log[top], size), pc.binary_length(texts).to_numpy().astype(np.int64)]
                yield pa.record_batch([b.column(0)[first : first + size], b.column(2)[first : first + size], *map(pa.array, columns), pa.ListArray.from_arrays(offsets, kinds), pa.ListArray.from_arrays(offsets, pa.array(spelt[other].astype(np.float32)))], names=names)

    scored = rows.mapInArrow(each, "id long, held_out boolean, coded double, n_tokens long, n_top long, top_sum double, n_bytes long, rare array<binary>, spelt array<float>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    for b in (shared, model):
        b.unpersist()
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "spelt")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.spelt").cast("double").alias("spelt"))
    # both sides are written, so Spark can split a token that many texts have
    spell, share = F.col("spelt") + math.log(new), F.log(F.col("n") * ((1 - new) / max(1, rest)))
    either = F.greatest(spell, share) + F.log1p(F.exp(-F.abs(spell - share)))
    found = rare.join(counts, "token").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 0.5)).alias("rare_sum"), F.sum(either - spell).alias("gain"))
    joined = scored.withColumns({"n_other": F.size("spelt"), "all_spelt": F.aggregate("spelt", F.lit(0.0), lambda s, v: s + v.cast("double"))}).drop("rare", "spelt").join(found, "row", "left")
    joined = joined.withColumns({"n_rare": F.coalesce("n_rare", F.lit(0).cast("long")), "rare_sum": F.coalesce("rare_sum", F.lit(0.0)), "gain": F.coalesce("gain", F.lit(0.0))})
    n_known = F.col("n_top") + F.col("n_rare")
    base = F.col("top_sum") + F.col("rare_sum") + (F.col("n_tokens") - n_known) * math.log10(0.5) - F.col("n_tokens") * norm
    score = (F.col("coded") + F.col("all_spelt") + F.col("n_other") * math.log(new) + F.col("gain")) / math.log(10)
    joined = joined.withColumns({"n_known": n_known, "base_score": base, "score": score})
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return joined.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
