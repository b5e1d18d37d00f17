"""Removal of repeated byte strings with a sparse enhanced suffix array and its common-prefix intervals.

A string of ``LENGTH`` bytes has one anchor: of its ``GRAM``-byte substrings the one of least hash.
Equal strings have equal anchors at equal places, so only strings around equal anchors need be
compared. An anchor stands for the strings around it that have it (its context).

1. Blocks of documents tell how many contexts each of their anchors has; the sum over the table comes
   back. Anchors with one context in all are done with: nothing else in the table is like them.
2. Every other context is sent once by each block, with its bytes, to the range that its anchor is in.
   Equal contexts of one block are combined before, by their bytes.
3. A range sorts the suffixes that begin at its anchors (a suffix array of the anchors), takes the
   common prefixes of neighbours, and scans them with a stack: every interval is a group of suffixes
   with one longest common prefix. In each interval the strings before the anchors are sorted from
   the anchor leftwards and scanned the same way, which finds where left extensions begin to differ.
   An interval that differs on both sides is a maximal repeat, with all its occurrences.

Anchors with many contexts (a common line in many surroundings) would crowd one range. They are split:
the distances from a string's start to its anchor are cut into parts, the finer the more contexts
there are, and the contexts are dealt for each part by all the bytes that the strings of that part
have in common: a longer prefix of the suffix from the anchor, and some of the bytes before it. Each
part goes through the same suffix array and intervals, over the bytes that its strings have.

All occurrences of a repeat but the first, by document and place, are removed (``suffix_dedup``), or
the repeats are given out with all occurrences (``repeat_groups``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import blocks as B
from rasterloom.llm.common import binary_parts, mix64, size_of, stored, table
from rasterloom.llm.grams import base, prefix_hash, runs_of_texts, span_hash

U = np.uint64
LENGTH, GRAM = 100, 40
SPREAD = LENGTH - GRAM  # an anchor begins 0 to SPREAD bytes after its string
H_BITS = 48
#: Contexts of one anchor (as the blocks count them) from which on its distances are cut into parts.
CROWD = 4096
RUN = 1 << 18
#: Bytes kept for what follows and what precedes an anchor: whole 8-byte words.
RIGHT, LEFT = 104, 64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """Anchors of a block of texts in order: place, first and last string start, hash, context hash, and string keys."""

    def __init__(self, t: pa.Table):
        doc, th = B.ordered_keys(t.column("k")), t.column("th").to_numpy().view(U)
        order = np.lexsort((th, doc))
        t, self.doc, self.th = t.take(pa.array(order)), doc[order], th[order]
        self.keys = t.column("k")
        self.raw, self.offsets = binary_parts(t.column("t"))
        got = [self._run(i, j) for i, j in runs_of_texts(self.offsets, RUN)]
        cat = lambda n, kind: np.concatenate([g[n] for g in got]) if got else np.zeros(0, kind)
        self.at, self.first, self.last = cat(0, np.int64), cat(1, np.int64), cat(2, np.int64)
        self.h, self.f = cat(3, U), cat(4, U)

    def _hash(self, i: int, j: int, seed: int) -> np.ndarray:
        _, _, values = base(seed)
        return prefix_hash(values[self.raw[self.offsets[i] : self.offsets[j]]], seed)

    def _run(self, i: int, j: int) -> tuple[np.ndarray, ...]:
        lo, n = int(self.offsets[i]), int(self.offsets[j] - self.offsets[i])
        none = np.zeros(0, np.int64)
        if n < LENGTH:
            return none, none, none, none.astype(U), none.astype(U)
        prefix = self._hash(i, j, 0)
        start = np.arange(n - GRAM + 1)
        grams = mix64(span_hash(prefix, start, start + GRAM, 0), 21)
        bits = U(max(18, int(n).bit_length()))
        least = sliding_min(grams >> bits << bits | start.astype(U), SPREAD + 1)
        place = (least & ((U(1) << bits) - U(1))).astype(np.int64)
        ends = np.full(n, 0, np.int64)  # a string may begin at each place that its text goes on from far enough
        sizes = np.diff(self.offsets[i : j + 1])
        whole = np.repeat(self.offsets[i + 1 : j + 1] - lo, sizes)
        ends[:] = whole
        valid = np.arange(len(place)) + LENGTH <= ends[: len(place)]
        cut = np.ones(len(place), bool)
        cut[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(place)) - 1
        keep = valid[first]
        first, last = first[keep], last[keep]
        at = place[first]
        second = self._hash(i, j, 1)
        f = mix64(span_hash(second, first, last + LENGTH, 1) ^ mix64(((at - first) << 8 | (last - first)).astype(U), 23), 24)
        f = np.where(f == 0, U(1), f)
        # Anchors have small hashes, being the least of many: mixed again, they spread over all ranges.
        return at + lo, first + lo, last + lo, mix64(grams[at], 22) >> U(64 - H_BITS), f

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors that are first of their context, in order of anchor hash, and which of all anchors repeat a context before them."""
        order = np.lexsort((self.f, self.h))  # stable: the first of equal ones comes first in the text
        again = ~B.firsts(self.h[order], self.f[order])
        at = np.flatnonzero(again)
        again[at] = self._equal(self.first, self.last + LENGTH, order[at], order[at - 1])
        whole = np.zeros(len(order), bool)
        whole[order] = again
        return order[~again], whole

    def _equal(self, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a have the same bytes as spans b."""
        out = end[a] - start[a] == end[b] - start[b]
        for i in range(0, len(a), 1 << 13):
            x, y = a[i : i + (1 << 13)], b[i : i + (1 << 13)]
            size = np.minimum(end[x] - start[x], end[y] - start[y])
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = self.raw[np.repeat(start[x], size) + step] == self.raw[np.repeat(start[y], size) + step]
            out[i : i + len(x)] &= np.logical_and.reduceat(same, np.cumsum(size) - size)
        return out

    def parts(self, which: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each part of each of these anchors' contexts: the anchor, the part's least and greatest distance here, and its key."""
        many = np.where(total > CROWD, np.minimum(2 ** np.ceil(np.log2(np.maximum(total, 1) / CROWD)), SPREAD + 1), 1).astype(np.int64)
        own = np.repeat(which, many)
        parts = np.repeat(many, many)
        part = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        lo, hi = part * (SPREAD + 1) // parts, (part + 1) * (SPREAD + 1) // parts - 1
        a, b = np.maximum(lo, self.at[own] - self.last[own]), np.minimum(hi, self.at[own] - self.first[own])
        key = self.h[own].copy()
        cut = np.flatnonzero((parts > 1) & (a <= b))
        if len(cut):
            start, end = self.at[own[cut]] - lo[cut], self.at[own[cut]] + LENGTH - hi[cut]
            for i, j in runs_of_texts(self.offsets, RUN):
                at = np.flatnonzero((start >= self.offsets[i]) & (start < self.offsets[j]))
                h = span_hash(self._hash(i, j, 0), start[at] - self.offsets[i], end[at] - self.offsets[i], 0)
                key[cut[at]] = mix64(h ^ (parts[cut[at]] * 64 + part[cut[at]]).astype(U), 31) >> U(64 - H_BITS)
        some = a <= b
        return own[some], a[some], b[some], key[some]

    def records(self, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Records of parts: document, place, and the bytes after and before the anchor that strings at these distances have."""
        out = np.zeros(len(own), Contexts.dtype)
        text = np.searchsorted(self.offsets, self.at[own], "right") - 1
        out["doc"], out["th"], out["at"] = self.doc[text], self.th[text], self.at[own] - self.offsets[text]
        out["nr"], out["nl"] = LENGTH - lo, hi
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.raw, np.zeros(RIGHT, np.uint8)])
        for i in range(0, len(own), 1 << 13):
            r, at = out[i : i + (1 << 13)], self.at[own[i : i + (1 << 13)], None]
            # Bytes are raised by one (modulo 256, 255 does not occur in UTF-8), so that 0 is none.
            r["right"] = np.where(np.arange(RIGHT) < r["nr"][:, None], padded[LEFT + at + np.arange(RIGHT)] + np.uint8(1), 0)
            r["left"] = np.where(np.arange(LEFT) < r["nl"][:, None], padded[LEFT - 1 + at - np.arange(LEFT)] + np.uint8(1), 0)
        return out


def _tell(t: pa.Table, ways: B.Ways) -> pa.Table:
    a = Anchors(t)
    h, many = B.counted(a.h[a.contexts()[0]])
    return ways.send(0, t.column("block")[0].as_py(), h, lambda i, j: TOTALS.pack(many[i:j]))


class Sent:
    """What a block knows after the first exchange: anchors that repeat a context before them, and the parts it sends, in order of keys."""

    def __init__(self, a: Anchors, said: pa.Table, ways: B.Ways):
        lead, self.whole = a.contexts()
        h, _ = B.counted(a.h[lead])
        total = B.read_answers(said, h, ways, 0, 0, TOTALS)[np.searchsorted(h, a.h[lead])] if len(lead) else np.zeros(0, np.uint32)
        own, lo, hi, key = a.parts(lead[total > 1], total[total > 1].astype(np.int64))
        # Parts of several contexts can have the same bytes: the first is sent, the others repeat it.
        start, end = a.at[own] - hi, a.at[own] + LENGTH - lo
        order = np.lexsort((start, lo, hi, key))
        again = ~B.firsts(key[order], lo[order], hi[order])
        at = np.flatnonzero(again)
        again[at] = a._equal(start, end, order[at], order[at - 1])
        self.again = start[order[again]], end[order[again]]
        self.own, self.lo, self.hi, self.key = (x[order[~again]] for x in (own, lo, hi, key))


def _contexts(docs: pa.Table, said: pa.Table, ways: B.Ways, to: B.Ways) -> pa.Table:
    if not len(docs):
        return B.PIECE.empty_table()
    a = Anchors(docs)
    s = Sent(a, said, ways)
    return to.send(0, docs.column("block")[0].as_py(), s.key, lambda i, j: a.records(s.own[i:j], s.lo[i:j], s.hi[i:j]).tobytes())


def words_of(rows: np.ndarray) -> list[np.ndarray]:
    """Byte rows (their length a multiple of 8) as numbers that sort like them, the last column first."""
    words = np.ascontiguousarray(rows).view(">u8").astype(U)
    return [words[:, c] for c in reversed(range(words.shape[1]))]


def neighbours_common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row with the next, no longer than either."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(common, np.minimum(size[1:], size[:-1]))


def common_prefix_intervals(common: np.ndarray, least: int) -> tuple[list[int], list[int], list[int]]:
    """Intervals (first, last, length) of the tree over neighbours' common prefixes, of length ``least`` or more; children before parents."""
    first, last, length = [], [], []
    stack: list[tuple[int, int]] = []  # (length, first)
    for i, c in enumerate([*common.tolist(), -1]):
        begin = i
        while stack and stack[-1][0] > c:
            own, begin = stack.pop()
            first.append(begin)
            last.append(i)
            length.append(own)
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, begin))
    return first, last, length


def range_mask(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits lo to hi of uint64 (none if lo > hi)."""
    width = np.clip(hi - lo + 1, 0, 63).astype(U)
    return np.where(hi >= lo, ((U(1) << width) - U(1)) << np.clip(lo, 0, 63).astype(U), U(0))


def maximal_repeats(keys: np.ndarray, c: np.ndarray):
    """Maximal repeats among contexts that are sorted by key and suffix: (members, bytes before the anchor, bytes from it on)."""
    right, nr, left, nl = c["right"], c["nr"].astype(np.int64), c["left"], c["nl"].astype(np.int64)
    common = np.where(keys[1:] == keys[:-1], neighbours_common(right, nr), -1)
    first, last, length = (np.array(x, np.int64) for x in common_prefix_intervals(common, GRAM))
    # Pairs, the most frequent intervals, all at once.
    beside = neighbours_common(left, nl)
    two = np.flatnonzero(last - first == 1)
    ok = two[beside[first[two]] >= LENGTH - length[two]]
    pairs = np.stack([first[ok], first[ok] + 1], axis=1)
    wide = np.flatnonzero(last - first > 1)
    groups = []
    if len(wide):
        by_left = np.empty(len(c), np.int64)
        by_left[np.lexsort(words_of(left))] = np.arange(len(c))
    for w in wide.tolist():
        i, j, size = int(first[w]), int(last[w]) + 1, int(length[w])
        own = i + np.argsort(by_left[i:j])
        agree = neighbours_common(left[own], nl[own])
        if not (agree >= LENGTH - size).any():
            continue
        # The child of the interval that each suffix is in: with all in one, the repeat goes on to the right.
        child = np.concatenate([[0], np.cumsum(common[i : j - 1] == size)])[own - i]
        for p, q, m in zip(*common_prefix_intervals(agree, max(0, LENGTH - size)), strict=True):
            if (child[p : q + 1] != child[p]).any():
                groups.append((own[p : q + 1], m, size))
    return pairs, beside[first[ok]], length[ok], groups


class Contexts(B.Records):
    """Contexts by the range of their keys; the answer has a bit for each distance of a string that the table has earlier."""

    answer = np.dtype(np.uint64)
    dtype = np.dtype([("doc", "u8"), ("th", "u8"), ("at", "u8"), ("right", "u1", RIGHT), ("left", "u1", LEFT), ("nr", "u1"), ("nl", "u1")])

    def merge(self, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        right, left = words_of(own["right"]), words_of(own["left"])
        order = np.lexsort((own["at"], own["th"], own["doc"], *left, *right, keys))
        new = B.firsts(keys[order], *(x[order] for x in (*right, *left)))
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        return keys[order][new], own[order][new], of

    def decide(self, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        rank = np.empty(len(c), np.int64)
        rank[np.lexsort((c["at"], c["th"], c["doc"]))] = np.arange(len(c))
        gone = np.zeros(len(c), U)
        pairs, before, after, groups = maximal_repeats(keys, c)
        if len(pairs):
            later = pairs[np.arange(len(pairs)), np.argmax(rank[pairs], axis=1)]
            np.bitwise_or.at(gone, later, range_mask(LENGTH - after, before))
        for some, m, size in groups:
            gone[some[rank[some] != rank[some].min()]] |= range_mask(np.array(LENGTH - size), np.array(m))
        return gone

    def spread(self, said: np.ndarray, of: np.ndarray, own: np.ndarray, merged: np.ndarray) -> np.ndarray:
        m = merged[of]
        first = (own["doc"] == m["doc"]) & (own["th"] == m["th"]) & (own["at"] == m["at"])
        return np.where(first, said[of], range_mask(LENGTH - own["nr"].astype(np.int64), own["nl"].astype(np.int64)))


TOTALS, CONTEXTS = B.Counts(1 << 31), Contexts()


OUT = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _remove(docs: pa.Table, said: pa.Table, ways: B.Ways, to: B.Ways) -> pa.Table:
    if not len(docs):
        return OUT.empty_table()
    a = Anchors(docs)
    second = pc.equal(said.column("n"), pa.scalar(b"contexts"))
    s = Sent(a, said.filter(pc.invert(second)), ways)
    bits = B.read_answers(said.filter(second), s.key, to, 0, 0, CONTEXTS)
    cover = np.zeros(len(a.raw) + 1, np.int32)

    def mark(starts: np.ndarray, ends: np.ndarray) -> None:
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends, -1)

    mark(a.first[s.whole], a.last[s.whole] + LENGTH)
    mark(*s.again)
    some = np.flatnonzero(bits)
    row, distance = np.nonzero(np.unpackbits(bits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    start = a.at[s.own[some[row]]] - distance
    mark(start, start + LENGTH)
    gone = np.cumsum(cover[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(gone)])[a.offsets]
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), a.offsets)
    spans = np.concatenate([[0], np.cumsum(begins)])[a.offsets]
    n = np.diff(a.offsets)
    kept_at = (a.offsets - removed).astype(np.int64)
    kept = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(kept_at.tobytes()), pa.py_buffer(a.raw[~gone].tobytes())])
    return pa.table({"k": a.keys, "n_bytes": n, "n_removed": np.diff(removed), "n_spans": np.diff(spans), "kept": kept.cast(pa.binary())}, schema=OUT)


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept (the bytes that stay, as binary).

    Keys are integers. A byte goes if a string of 100 bytes covers it, within its document, that also starts earlier: in
    a document with a smaller key, or further left in the same one. Strings are judged on the input
    and may overlap; they never cross documents. kept may end inside a character, so it is binary.
    Null and empty texts, and texts under 100 bytes, lose nothing. Documents without a key come after
    all others, by hash and text; rows with one key are ordered by text, equal ones arbitrarily. An
    empty table gives no rows; other columns are ignored.
    """
    _, n_bytes = size_of(docs, text)
    blocks = B.block_count(n_bytes)
    ways = B.Ways.of(blocks, H_BITS, n_bytes // 31)
    to = B.Ways.of(blocks, H_BITS, n_bytes // 60, range_items=1 << 16)
    by = B.blocked(docs, n_bytes, text, key).withColumn("th", F.xxhash64("t")).groupBy("block")
    said = B.exchanged(by.applyInArrow(lambda t: _tell(t, ways), B.PIECE_SQL), ways, TOTALS)
    sent = by.cogroup(said.groupBy("block")).applyInArrow(lambda a, b: _contexts(a, b, ways, to), B.PIECE_SQL)
    told = B.exchanged(sent, to, CONTEXTS).withColumn("n", F.lit(b"contexts"))
    out = by.cogroup(said.unionByName(told).groupBy("block")).applyInArrow(
        lambda a, b: _remove(a, b, ways, to), "k long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.withColumnRenamed("k", key)


def identities(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the key and the bytes around the anchor of each record."""
    out = []
    for seed in (41, 42):
        h = mix64(mix64(keys, seed) ^ (c["nr"].astype(U) << U(8) | c["nl"].astype(U)), seed)
        for w in [*words_of(c["right"]), *words_of(c["left"])]:
            h = mix64(h ^ w, seed)
        out.append(h.view(np.int64))
    return out[0], out[1]


MEMBERS = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("before", pa.int32()), ("length", pa.int32())])
PLACES = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("nl", pa.int32()), ("nr", pa.int32())])


def _members(t: pa.Table, ways: B.Ways, level: int) -> pa.Table:
    """The maximal repeats of a range, a row for each context that has one. A repeat's number is that of a context cut down to it."""
    _, _, keys, payload = B.opened(t, ways, level, CONTEXTS)
    keys, c, _ = CONTEXTS.merge(keys, payload)
    pairs, before, after, groups = maximal_repeats(keys, c)
    own = np.concatenate([pairs.ravel(), *[g[0] for g in groups]]).astype(np.int64)
    count = np.array([2] * len(pairs) + [len(g[0]) for g in groups], np.int64)
    left = np.concatenate([before, [g[1] for g in groups]]).astype(np.int64)
    right = np.concatenate([after, [g[2] for g in groups]]).astype(np.int64)
    lead = own[np.cumsum(count) - count]
    numbers = np.zeros((2, len(lead)), np.int64)
    for i in range(0, len(lead), 1 << 14):
        at = slice(i, i + (1 << 14))
        part = c[lead[at]]
        part["nl"], part["nr"] = left[at], right[at]
        part["left"][np.arange(LEFT) >= left[at, None]] = 0
        part["right"][np.arange(RIGHT) >= right[at, None]] = 0
        numbers[:, at] = identities(keys[lead[at]], part)
    c1, c2 = identities(keys, c)
    each = lambda x: np.repeat(x, count)
    columns = [each(numbers[0]), each(numbers[1]), c1[own], c2[own], each(left).astype(np.int32), each(left + right).astype(np.int32)]
    return pa.Table.from_arrays([pa.array(x) for x in columns], schema=MEMBERS)


def _places(docs: pa.Table, said: pa.Table, ways: B.Ways) -> pa.Table:
    """All anchors that may be in a repeat, with their context's number and how far it goes before and after them."""
    if not len(docs):
        return PLACES.empty_table()
    a = Anchors(docs)
    h, _ = B.counted(a.h)
    n = B.counted(a.h)[1]
    at = np.searchsorted(h, a.h)
    total = B.read_answers(said, h, ways, 0, 0, TOTALS)[at].astype(np.int64)
    own, lo, hi, key = a.parts(np.flatnonzero((total > 1) | (n[at] > 1)), total[(total > 1) | (n[at] > 1)])
    text = np.searchsorted(a.offsets, a.at[own], "right") - 1
    numbers = np.zeros((2, len(own)), np.int64)
    for i in range(0, len(own), 1 << 14):
        at = slice(i, i + (1 << 14))
        numbers[:, at] = identities(key[at], a.records(own[at], lo[at], hi[at]))
    columns = [numbers[0], numbers[1], a.keys.take(pa.array(text)).cast(pa.int64()), a.at[own] - a.offsets[text], hi.astype(np.int32), (LENGTH - lo).astype(np.int32)]
    return pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], schema=PLACES)


def repeat_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The maximal repeats of 100 bytes or more, with all occurrences: group, length, key, start (a byte of the UTF-8 text).

    A repeat is seen around each anchor that it has, in up to 160 bytes: a longer one is several groups,
    which overlap. Every group has all places at which its bytes stand, in any row; what
    ``suffix_dedup`` removes is all of them but the first. Ranges give the repeats as rows of (group,
    context); blocks give the places of each context; a join on the contexts' numbers (128 bits) brings
    them together, so that no task has all occurrences of anything. Null, empty and short texts have
    no groups, an empty table neither. Repeated rows occur once each; other columns are ignored.
    """
    _, n_bytes = size_of(docs, text)
    blocks = B.block_count(n_bytes)
    ways = B.Ways.of(blocks, H_BITS, n_bytes // 31)
    to = B.Ways.of(blocks, H_BITS, n_bytes // 60, range_items=1 << 16)
    by = B.blocked(docs, n_bytes, text, key).withColumn("th", F.xxhash64("t")).groupBy("block")
    said = stored(B.exchanged(by.applyInArrow(lambda t: _tell(t, ways), B.PIECE_SQL), ways, TOTALS), "totals").groupBy("block")
    places = stored(by.cogroup(said).applyInArrow(lambda a, b: _places(a, b, ways), "c1 long, c2 long, k long, at long, nl int, nr int"), "places")
    sent = B.raised(by.cogroup(said).applyInArrow(lambda a, b: _contexts(a, b, ways, to), B.PIECE_SQL), to, CONTEXTS)
    top = len(sent) - 1
    members = sent[top].groupBy("node").applyInArrow(lambda t: _members(t, to, top), "g1 long, g2 long, c1 long, c2 long, before int, length int")
    # A context that occurs twice is a repeat itself.
    whole = places.groupBy("c1", "c2", "nl", "nr").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = whole.select(F.col("c1").alias("g1"), F.col("c2").alias("g2"), "c1", "c2", F.col("nl").alias("before"), (F.col("nl") + F.col("nr")).alias("length"))
    found = places.join(members.unionByName(whole).distinct(), ["c1", "c2"])
    number = F.format_string("%016x%016x", "g1", "g2")
    return found.select(number.alias("group"), "length", F.col("k").alias(key), (F.col("at") - F.col("before")).alias("start"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every 100-byte string by its MD5: for small tables.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, n, h, unnest(range((n - 100) // 1000 + 1)) AS part FROM d WHERE n >= 100),
q AS (SELECT doc_id, part, substr(h, 2000 * part + 1, 2198) AS h, least(1000, n - 99 - 1000 * part) AS many FROM g),
p AS (SELECT doc_id, part, h, unnest(range(many)) AS step FROM q),
k AS (SELECT doc_id, 1000 * part + step AS pos, md5_number(substr(h, 2 * step + 1, 200)) AS s FROM p),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1 AS again FROM k),
a AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS since FROM o WHERE again),
b AS (SELECT doc_id, pos, sum(CASE WHEN since <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM a),
c AS (SELECT doc_id, span, min(pos) AS x, max(pos) + 100 AS y FROM b GROUP BY 1, 2),
e AS (SELECT doc_id, x, y, lag(y, 1, 0) OVER (PARTITION BY doc_id ORDER BY x) AS past FROM c),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * past + 1, 2 * (x - past)), '' ORDER BY x) || substr(any_value(h), 2 * max(y) + 1) AS h, CAST(sum(y - x) AS BIGINT) AS gone, count(*) AS spans FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
