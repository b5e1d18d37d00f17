"""Language-model scores by a weighted automaton over smoothed n-grams.

Contexts of up to ``order - 1`` tokens that training texts have are states. A state has an arc for
each token that followed it in training, with the token's log-probability, and a failure arc to its
own longest shorter context, with what is left for tokens it hasn't met. The root has an arc for every
token. A text is read from left to right: the state is carried on, failure arcs are taken until an arc
for the token is found, and all weights on the way add up.

Probabilities are interpolated by Witten and Bell: p(w|h) = (c(hw) + T(h) p(w|h')) / (c(h) + T(h)),
where T(h) counts the distinct tokens after h, and end on the add-one unigram. An arc carries the whole
p, a failure arc T(h) / (c(h) + T(h)), so the automaton is exact.

Counts are those of the whole table and are held nowhere together. Blocks of documents ask for the
n-grams that they have (``blocks``): once for counts, where for each n-gram of the training texts one
block is told that it stands for it; once for T, to which each block adds the n-grams it stands for. A
block's automaton has the states and arcs that its own texts can meet.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm import blocks as B
from rasterloom.llm.common import binary_parts, mix64, size_of, table
from rasterloom.llm.grams import gram_hashes, lower_ascii, runs_of_texts, word_hashes, words

U = np.uint64
ORDER = 2
KEY_BITS = 54
#: Token values beside words, and the keys under which the tokens of training are counted, all and distinct.
START, END, TOKENS, DISTINCT = (U(x) for x in mix64(np.arange(4, dtype=U), 4242).tolist())
# n-grams are told apart by KEY_BITS bits: of a thousand million, some thirty pairs share a key.
#: Most bytes of a block, and tokens of a text that are read in one go.
BLOCK_BYTES, SEGMENT = 16 << 20, 512


class Totals(B.Records):
    """Sums over the table. An answer is twice the sum, and one more for a single sender among those that add to it."""

    dtype = answer = np.dtype(np.uint64)

    def pack(self, values: np.ndarray) -> bytes:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(k).max)
        return bytes([np.dtype(kind).itemsize]) + zlib.compress(values.astype(kind).tobytes(), 1)

    def unpack(self, blob: bytes, n: int) -> np.ndarray:
        return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(U)

    def merge(self, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        new = B.firsts(keys[order])
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return keys[order][first], np.add.reduceat(own[order], first) if len(first) else own, of

    def decide(self, keys: np.ndarray, merged: np.ndarray) -> np.ndarray:
        return merged << U(1) | (merged > 0).astype(U)

    def spread(self, said: np.ndarray, of: np.ndarray, own: np.ndarray, merged: np.ndarray) -> np.ndarray:
        stands = np.full(len(merged), -1, np.int64)
        adds = np.flatnonzero(own)[::-1]
        stands[of[adds]] = adds  # the first of those that add something
        chosen = (stands[of] == np.arange(len(of))) & (said[of] & U(1) == 1)
        return said[of] & ~U(1) | chosen.astype(U)


TOTALS = Totals()


class Texts:
    """The tokens of a block's texts, each text led by START and ended by END, and its n-grams of every order."""

    def __init__(self, t: pa.Table, order: int):
        raw, offsets = binary_parts(t.column("t"))
        self.train = np.array([not r["held"] for r in t.column("rest").to_pylist()], bool)
        hashes, counts = [], []
        for i, j in runs_of_texts(offsets):
            part, at = lower_ascii(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
            s, e, c = words(part, at)
            hashes.append(word_hashes(part, s, e, 0))
            counts.append(c)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.n_tokens, size = n + 1, n + 2
        self.begin = np.cumsum(size) - size
        token = np.full(int(size.sum()), END, U)
        token[self.begin] = START
        inner = np.ones(len(token), bool)
        inner[self.begin] = inner[self.begin + size - 1] = False
        token[inner] = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.text = np.repeat(np.arange(len(n)), size)
        self.place = np.arange(len(token)) - self.begin[self.text]
        #: Of each order the places where an n-gram ends, the distinct keys, and each place's n-gram among them (-1: none).
        self.ends, self.keys, self.of, self.own = [], [], [], []
        for o in range(1, order + 1):
            ends = np.flatnonzero(self.place >= o - 1)
            key = gram_hashes(token, ends - (o - 1), o, 31 * o) >> U(64 - KEY_BITS)
            keys, inverse = np.unique(key, return_inverse=True)
            of = np.full(len(token), -1, np.int64)
            of[ends] = inverse
            self.ends.append(ends)
            self.keys.append(keys)
            self.of.append(of)
            self.own.append(np.bincount(inverse[self.train[self.text[ends]]], minlength=len(keys)).astype(U))
        self.start = int(self.of[0][self.begin[0]]) if len(self.begin) else -1

    def example(self, o: int) -> np.ndarray:
        """A place where each n-gram of this order ends."""
        out = np.zeros(len(self.keys[o - 1]), np.int64)
        out[self.of[o - 1][self.ends[o - 1]]] = self.ends[o - 1]
        return out

    def before(self, o: int) -> np.ndarray:
        """For each n-gram of order o > 1 its context, an n-gram of the order below."""
        return self.of[o - 2][self.example(o) - 1]

    def shorter(self, o: int) -> np.ndarray:
        """For each n-gram of order o > 1 what is left without its first token."""
        return self.of[o - 2][self.example(o)]


def sent_sorted(ways: B.Ways, block: int, keys: list[np.ndarray], own: list[np.ndarray]) -> pa.Table:
    k, v = np.concatenate(keys), np.concatenate(own)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.flatnonzero(B.firsts(k))
    k, v = k[first], np.add.reduceat(v, first)
    return ways.send(0, block, k, lambda i, j: TOTALS.pack(v[i:j]))


def answers(said: pa.Table, ways: B.Ways, keys: np.ndarray) -> np.ndarray:
    """Answers to keys in any order, of what this block asked."""
    some, inverse = np.unique(keys, return_inverse=True)
    return B.read_answers(said, some, ways, 0, 0, TOTALS)[inverse]


def _count(docs: pa.Table, order: int, ways: B.Ways) -> pa.Table:
    t = Texts(docs, order)
    return sent_sorted(ways, docs.column("block")[0].as_py(), t.keys, t.own)


def _types(docs: pa.Table, said: pa.Table, order: int, ways: B.Ways, second: B.Ways) -> pa.Table:
    """Contexts that training has, each with the n-grams after it that this block stands for; tokens all and distinct."""
    if not len(docs):
        return B.PIECE.empty_table()
    t = Texts(docs, order)
    told = split_answers(said, ways, t.keys)
    keys, own = [], []
    for o in range(2, order + 1):
        context = t.before(o)
        many = np.bincount(context[(told[o - 1] & U(1)) == 1], minlength=len(t.keys[o - 2])).astype(U)
        known = told[o - 2] > 1
        keys.append(t.keys[o - 2][known])
        own.append(many[known])
    stands = (told[0] & U(1)) == 1
    stands[t.start] = False
    keys.append(np.array([TOKENS, DISTINCT], U) >> U(64 - KEY_BITS))
    own.append(np.array([int(t.n_tokens[t.train].sum()), int(stands.sum())], U))
    return sent_sorted(second, docs.column("block")[0].as_py(), keys, own)


def split_answers(said: pa.Table, ways: B.Ways, keys: list[np.ndarray]) -> list[np.ndarray]:
    """The answers to each order's keys, which were asked together."""
    told = answers(said, ways, np.concatenate(keys))
    return np.split(told, np.cumsum([len(k) for k in keys])[:-1])


class Automaton:
    """States, arcs and failure arcs that a block's texts can meet."""

    def __init__(self, t: Texts, counts: list[np.ndarray], after: list[np.ndarray], tokens: int, distinct: int):
        order = len(counts)
        p = (counts[0] + 1.0) / (tokens + distinct + 1.0)
        self.unigram = np.log10(p)
        state, n_states = [], 1
        fail, weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        arc_keys, arc_weights, arc_to = [], [], []
        next_ = np.zeros(len(p), np.int64)
        last = np.arange(len(p))
        for o in range(1, order + 1):
            n = len(t.keys[o - 1])
            c = counts[o - 1].astype(float)
            if o > 1:
                context, shorter = t.before(o), t.shorter(o)
                last = t.of[0][t.example(o)]
                h, kinds = counts[o - 2][context].astype(float), after[o - 2][context].astype(float)
                p = np.where(c > 0, (c + kinds * p[shorter]) / np.maximum(h + kinds, 1), p[shorter])
            own, lower = np.full(n, -1, np.int64), next_[t.shorter(o)] if o > 1 else np.zeros(n, np.int64)
            if o < order:
                some = np.flatnonzero((c > 0) & (after[o - 1] > 0))
                own[some] = n_states + np.arange(len(some))
                n_states += len(some)
                kinds = after[o - 1][some].astype(float)
                fail.append(lower[some])
                weight.append(np.log10(kinds / (c[some] + kinds)))
            to = np.where(own >= 0, own, lower)
            arcs = np.arange(n) if o == 1 else np.flatnonzero((c > 0) & (state[-1][context] >= 0))
            source = np.zeros(n, np.int64) if o == 1 else state[-1][context]
            arc_keys.append(source[arcs].astype(U) << U(32) | last[arcs].astype(U))
            arc_weights.append(np.log10(p[arcs]))
            arc_to.append(to[arcs])
            state.append(own)
            next_ = to
        keys = np.concatenate(arc_keys)
        by = np.argsort(keys)
        self.arcs, self.weights, self.to = keys[by], np.concatenate(arc_weights)[by], np.concatenate(arc_to)[by]
        self.fail, self.lost = np.concatenate(fail), np.concatenate(weight)
        self.first = max(int(state[0][t.start]), 0) if order > 1 else 0

    def read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one token each, and the log-probabilities collected."""
        state, gained, todo = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            at = B.look_up(self.arcs, state[todo].astype(U) << U(32) | token[todo].astype(U))
            found, done = at >= 0, todo[at >= 0]
            gained[done] += self.weights[at[found]]
            state[done] = self.to[at[found]]
            todo = todo[~found]
            gained[todo] += self.lost[state[todo]]
            state[todo] = self.fail[state[todo]]
        return state, gained


def traversed(a: Automaton, token: np.ndarray, begin: np.ndarray, size: np.ndarray, order: int, segment: int = SEGMENT) -> np.ndarray:
    """The sum of log-probabilities of each text, many texts abreast.

    After ``order - 1`` tokens the state no longer depends on where the reading began, so a long text
    is cut: each further segment starts that many tokens early, from the root, and counts from its own
    first token on.
    """
    warm = order - 1
    pieces = np.maximum(-(-size // segment), 1)
    text = np.repeat(np.arange(len(size)), pieces)
    i = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    early = np.where(i > 0, np.minimum(warm, i * segment), 0)
    start = begin[text] + i * segment - early
    length = np.minimum(segment, size[text] - i * segment) + early
    by = np.argsort(-length, kind="stable")
    start, length, early, text = start[by], length[by], early[by], text[by]
    state = np.where(i[by] * segment > warm, 0, a.first)  # those that begin where their text does
    total = np.zeros(len(text))
    for step in range(int(length[0]) if len(length) else 0):
        many = int(np.searchsorted(-length, -step, "left"))
        state[:many], gained = a.read(state[:many], token[start[:many] + step])
        total[:many] += np.where(step >= early[:many], gained, 0)
    return np.bincount(text, total, minlength=len(size))


OUT = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _score(docs: pa.Table, said: pa.Table, order: int, ways: B.Ways, second: B.Ways) -> pa.Table:
    if not len(docs):
        return pa.table({"rest": docs.column("rest"), **{c: pa.array([], k) for c, k in OUT}})
    t = Texts(docs, order)
    types = pc.equal(said.column("n"), pa.scalar(b"types"))
    counts = [x >> U(1) for x in split_answers(said.filter(pc.invert(types)), ways, t.keys)]
    known = [k[c > 0] for k, c in zip(t.keys[:-1], counts, strict=False)]
    whole = np.array([TOKENS, DISTINCT], U) >> U(64 - KEY_BITS)
    *told, totals = split_answers(said.filter(types), second, [*known, whole])
    after = []
    for k, c, x in zip(t.keys[:-1], counts, told, strict=False):
        own = np.zeros(len(k), U)
        own[c > 0] = x >> U(1)
        after.append(own)
    tokens, distinct = (int(x) >> 1 for x in totals)
    a = Automaton(t, counts, after, tokens, distinct)
    token, n = t.of[0], len(t.n_tokens)
    real = t.place > 0
    text, own = t.text[real], token[real]
    columns = [t.n_tokens, np.bincount(text, counts[0][own] > 0, minlength=n).astype(np.int64), np.full(n, tokens), np.bincount(text, a.unigram[own], minlength=n), traversed(a, token, t.begin + 1, t.n_tokens, order)]
    return pa.table({"rest": docs.column("rest"), **{c: pa.array(x, k) for (c, k), x in zip(OUT, columns, strict=True)}})


def language_model_scores(docs: DataFrame, held_out: Column, order: int = ORDER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z in lower case, and one end a text; null texts are empty. The model is learnt
    from the rows that aren't held out (null: learnt from). score is its log10 probability of the text,
    base_score that of the add-one unigram. Rows that repeat are texts of their own. Keys keep their
    type. Without training rows all tokens have probability 1; an empty table gives no rows; other
    columns are ignored.
    """
    _, n_bytes = size_of(docs, f"`{text}`")
    blocks = max(B.block_count(n_bytes), math.ceil(n_bytes / BLOCK_BYTES))
    rest = F.struct(F.col(f"`{key}`").alias("k"), F.coalesce(held_out, F.lit(False)).alias("held"))
    rows = docs.select(rest.alias("rest"), F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b"")).alias("t"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rest", "t"), F.lit(blocks)).cast("int"))
    ways, second = B.Ways.of(blocks, KEY_BITS, n_bytes // 3), B.Ways.of(blocks, KEY_BITS, n_bytes // 8)
    by = rows.groupBy("block")
    said = B.exchanged(by.applyInArrow(lambda t: _count(t, order, ways), B.PIECE_SQL), ways, TOTALS)
    asked = by.cogroup(said.groupBy("block")).applyInArrow(lambda a, b: _types(a, b, order, ways, second), B.PIECE_SQL)
    told = B.exchanged(asked, second, TOTALS).withColumn("n", F.lit(b"types"))
    schema = StructType([rows.schema["rest"]])
    for name, kind in OUT:
        schema = schema.add(name, "long" if kind == pa.int64() else "double")
    out = by.cogroup(said.unionByName(told).groupBy("block")).applyInArrow(lambda a, b: _score(a, b, order, ways, second), schema)
    return out.select(F.col("rest.k").alias(key), F.col("rest.held").alias("held_out"), *[n for n, _ in OUT])


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
