"""Asking the whole table about hashed items without a row for each of them.

Documents are dealt into blocks by a hash of key and text. A block sends its distinct items (sorted
keys and what belongs to each), packed, to the ranges of the key space; whoever holds a range sees
all blocks' items in it, merges them and answers each. What is shuffled is a few bytes an item, and a
block names an item once, however often it has it, so no hot key weighs more than others.

The exchange goes in levels, so that its packed pieces stay in proportion to the table: a sender
addresses at most ``FAN`` ranges, and at most ``FAN`` senders meet in one node, which merges their
items and sends them on to finer ranges. Answers come back down the same way. Tables of up to ``FAN``
blocks need a single level.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MB = 1 << 20
U = np.uint64
#: Senders that meet in one node, and ranges a sender addresses on all levels but the last.
FAN = 256
#: Items that a range of the last level has about.
RANGE_ITEMS = 2 << 20


def block_count(n_bytes: int) -> int:
    size = min(64 * MB, max(4 * MB, int(4 * MB * math.sqrt(n_bytes / (1 << 30)))))
    return max(math.ceil(n_bytes / size), min(32, math.ceil(n_bytes / MB)), 1)


def blocked(docs: DataFrame, n_bytes: int, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``k`` (key), ``t`` (UTF-8 bytes, empty for null) and ``block`` of every row; columns to ``carry`` as a struct, ``rest``.

    Rows spread by key and text: many rows with one key, or with none, do not meet in one block
    unless they have one text too.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b"")).alias("t"), *rest)
    return rows.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(block_count(n_bytes))).cast("int"))


def pack(sorted_values: np.ndarray) -> bytes:
    """Rising uint64 values as gaps of one, two or four bytes, where the top value adds to the next gap, else of as many bytes as the largest has."""
    if not len(sorted_values):
        return b""
    gaps = np.diff(sorted_values, prepend=U(0))
    for code, kind in ((1, np.uint8), (2, np.uint16), (4, np.uint32)):
        top = U(np.iinfo(kind).max)
        if float((gaps // top).sum(dtype=np.float64)) <= 0.6 * len(gaps) + 8:
            over = (gaps // top).astype(np.int64)
            out = np.full(len(gaps) + int(over.sum()), top, kind)
            out[np.cumsum(over) + np.arange(len(gaps))] = (gaps % top).astype(kind)
            return bytes([code]) + out.tobytes()
    wide = max(1, -(-int(gaps.max()).bit_length() // 8))
    return bytes([16 + wide]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    if blob[0] > 16:
        wide = blob[0] - 16
        parts = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, wide)
        gaps = np.zeros((len(parts), 8), np.uint8)
        gaps[:, :wide] = parts
        return np.cumsum(gaps.view("<u8").ravel())
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[blob[0]]
    gaps = np.frombuffer(blob, kind, offset=1)
    return np.cumsum(gaps.astype(U))[gaps != np.iinfo(kind).max]


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of rows differs from the row before, in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(firsts(values))
    return values[first], np.diff(np.append(first, len(values)))


def look_up(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ones, -1 where it is missing."""
    if not len(sorted_values):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    at[sorted_values[at] != values] = -1
    return at


def width_bits(n_items: int) -> int:
    """Width of a sketch row: at least four cells for each item."""
    return min(60, max(16, math.ceil(math.log2(max(n_items, 1))) + 2))


@dataclass(frozen=True)
class Ways:
    """How ``blocks`` blocks' items, keys of ``bits`` bits, are led to ranges: into how many parts each level cuts a range."""

    blocks: int
    bits: int
    fans: tuple[int, ...]

    @staticmethod
    def of(blocks: int, bits: int, n_items: int, fan: int = 0, range_items: int = RANGE_ITEMS) -> Ways:
        fan, fans, left = fan or FAN, [], blocks
        while left > fan:
            fans.append(fan)
            left = math.ceil(left / fan)
        ranges = max(1, math.ceil(n_items / range_items), min(32, math.ceil(n_items / 65536)))
        return Ways(blocks, bits, (*fans, max(1, math.ceil(ranges / math.prod(fans)))))

    @property
    def fan(self) -> int:
        return self.fans[0] if len(self.fans) > 1 else self.blocks

    def ranges(self, level: int) -> int:
        return math.prod(self.fans[: level + 1])

    def width(self, level: int) -> int:
        least = -(-(1 << self.bits) // math.prod(self.fans))
        return least * math.prod(self.fans[level + 1 :])

    def nodes(self, level: int) -> int:
        """Nodes that the pieces of a level go to."""
        return math.ceil(self.blocks / self.fan ** (level + 1)) * self.ranges(level)

    def pieces(self) -> int:
        """Most pieces that all levels send."""
        senders = [self.blocks, *[self.nodes(level) for level in range(len(self.fans) - 1)]]
        return sum(n * f for n, f in zip(senders, self.fans, strict=True))

    def send(self, level: int, sender: int, keys: np.ndarray, payload: Callable[[int, int], bytes]) -> pa.Table:
        """The pieces of a sender: a block at level 0, above it a node of the level below."""
        group, inside = (sender, 0) if level == 0 else divmod(sender, self.ranges(level - 1))
        low, width = inside * (self.width(level - 1) if level else 0), self.width(level)
        edges = np.array([min(low + i * width, 1 << 63) for i in range(self.fans[level] + 1)], U)
        cut = np.searchsorted(keys, edges)
        out = []
        for s in np.flatnonzero(np.diff(cut)).tolist():
            i, j = int(cut[s]), int(cut[s + 1])
            node = group // self.fan * self.ranges(level) + inside * self.fans[level] + s
            out.append({"node": node, "sender": sender, "cells": pack(keys[i:j] - edges[s]), "n": payload(i, j)})
        return pa.Table.from_pylist(out, PIECE)

    def low(self, level: int, node: int) -> np.uint64:
        return U(node % self.ranges(level) * self.width(level))


PIECE = pa.schema([("node", pa.int64()), ("sender", pa.int64()), ("cells", pa.binary()), ("n", pa.binary())])
PIECE_SQL = "node long, sender long, cells binary, n binary"


class Counts:
    """Items with a number; the answer is the sum over the table, 0 where that is 1. Numbers stop at ``most``."""

    answer = np.dtype(np.uint32)

    def __init__(self, most: int = 2):
        self.most = most
        self.kind = np.uint8 if most < 256 else np.uint32

    def pack(self, n: np.ndarray) -> bytes:
        if (n == 1).all():
            return b""
        return np.packbits(n > 1).tobytes() if self.most == 2 else zlib.compress(np.minimum(n, self.most).astype(self.kind).tobytes(), 1)

    def unpack(self, blob: bytes, n: int) -> np.ndarray:
        if not blob:
            return np.ones(n, np.int64)
        if self.most == 2:
            return 1 + np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(np.int64)
        return np.frombuffer(zlib.decompress(blob), self.kind).astype(np.int64)

    def merge(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = firsts(s)
        first = np.flatnonzero(new)
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(new) - 1
        return s[first], np.minimum(np.add.reduceat(n[order], first), self.most), of

    def decide(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(n > 1, n, 0).astype(np.uint32)

    def spread(self, said: np.ndarray, of: np.ndarray, own: np.ndarray, merged: np.ndarray) -> np.ndarray:
        return said[of]


class Records:
    """Items with a record each, a numpy structure; what merging, deciding and telling back means is the subclass's."""

    answer = np.dtype(np.uint8)
    dtype: np.dtype

    def pack(self, records: np.ndarray) -> bytes:
        return records.tobytes()

    def unpack(self, blob: bytes, n: int) -> np.ndarray:
        return np.frombuffer(blob, self.dtype)


def opened(t: pa.Table, ways: Ways, level: int, kind: Counts | Records):
    """The pieces of one node, in order of their senders, with keys and payloads of all joined."""
    rows = sorted(t.to_pylist(), key=lambda r: r["sender"])
    low = ways.low(level, rows[0]["node"])
    keys = [unpack(r["cells"]) for r in rows]
    sizes = [len(k) for k in keys]
    payload = np.concatenate([kind.unpack(r["n"], n) for r, n in zip(rows, sizes, strict=True)])
    return rows, sizes, np.concatenate(keys) + low, payload


def _merged(t: pa.Table, ways: Ways, level: int, kind: Counts | Records) -> pa.Table:
    rows, _, keys, payload = opened(t, ways, level, kind)
    keys, payload, _ = kind.merge(keys, payload)
    return ways.send(level + 1, rows[0]["node"], keys, lambda i, j: kind.pack(payload[i:j]))


def _answered(t: pa.Table, said: pa.Table | None, ways: Ways, level: int, kind: Counts | Records) -> pa.Table:
    if not len(t):
        return PIECE.empty_table()
    rows, sizes, keys, payload = opened(t, ways, level, kind)
    mkeys, merged, of = kind.merge(keys, payload)
    told = kind.decide(mkeys, merged) if said is None else read_answers(said, mkeys, ways, level + 1, rows[0]["node"], kind)
    own = kind.spread(told, of, payload, merged)
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        part = own[at : at + n]
        at += n
        if part.any():
            bits = kind.answer == np.uint32 and kind.most == 2
            blob = np.packbits(part > 0).tobytes() if bits else part.tobytes()
            out.append({"node": r["node"], "sender": r["sender"], "cells": zlib.compress(blob, 1), "n": b""})
    return pa.Table.from_pylist(out, PIECE)


def raised(pieces: DataFrame, ways: Ways, kind: Counts | Records) -> list[DataFrame]:
    """The pieces that are sent to each level, those of the blocks first."""
    def merged(level: int) -> Callable[[pa.Table], pa.Table]:
        return lambda t: _merged(t, ways, level, kind)

    sent = [pieces]
    for level in range(len(ways.fans) - 1):
        sent.append(sent[-1].groupBy("node").applyInArrow(merged(level), PIECE_SQL))
    return sent


def exchanged(pieces: DataFrame, ways: Ways, kind: Counts | Records) -> DataFrame:
    """From the pieces of all blocks the answers to them: node, block (an int, as blocks have it), cells, n."""
    def answered(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda t, said: _answered(t, said.rename_columns(["sender", "node", "cells", "n"]), ways, level, kind)

    sent = raised(pieces, ways, kind)
    top = len(sent) - 1
    said = sent[top].groupBy("node").applyInArrow(lambda t: _answered(t, None, ways, top, kind), PIECE_SQL)
    for level in reversed(range(top)):
        # Who sent a piece to the level above is, here, the node that its answer goes to.
        back = said.select(F.col("sender").alias("node"), F.col("node").alias("sender"), "cells", "n")
        said = sent[level].groupBy("node").cogroup(back.groupBy("node")).applyInArrow(answered(level), PIECE_SQL)
    return said.select("node", F.col("sender").cast("int").alias("block"), "cells", "n")


def read_answers(said: pa.Table, keys: np.ndarray, ways: Ways, level: int, sender: int, kind: Counts | Records) -> np.ndarray:
    """The answer to each key that this sender sent at this level."""
    out = np.zeros(len(keys), kind.answer)
    for r in said.to_pylist():
        low, width = int(ways.low(level, r["node"])), ways.width(level)
        i, j = np.searchsorted(keys, np.array([low, min(low + width, 1 << 63)], U)).tolist()
        blob = zlib.decompress(r["cells"])
        if kind.answer == np.uint32 and kind.most == 2:
            out[i:j] = np.unpackbits(np.frombuffer(blob, np.uint8), count=j - i) * np.uint32(2)
        else:
            out[i:j] = np.frombuffer(blob, kind.answer)
    return out


NO_KEY = U(0xFFFFFFFFFFFFFFFF)


def ordered_keys(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integer keys as uint64 in the same order; those without a key come last."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    none = keys.is_null().to_numpy(zero_copy_only=False)
    values = keys.fill_null(0).to_numpy().astype(np.int64).view(U) ^ U(1 << 63)
    return np.where(none, NO_KEY, values)
