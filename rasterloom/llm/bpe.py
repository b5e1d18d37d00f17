"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's leaves hold, for every symbol, the rank of the pair it begins, with its place as the tie
breaker. The root is then the leftmost pair of lowest rank; merging it changes three leaves and
their ancestors, so a word of n symbols takes O(n log n) steps. Words of up to ``WIDE`` symbols are
merged many at a time, one tree a row; longer ones have a tree of their own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm.common import table

WIDE = 64
#: Entries of the memory of words a process keeps; it is emptied when full.
MEMORY = 700_000


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    other = {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [other.get(b, chr(b)) for b in range(256)]


class Merges:
    """Merge rules as arrays: pairs sorted for look-up, their ranks, and the symbol each rank makes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.by_pair = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it can't be merged or a side is missing (-1)."""
        pair = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == pair) & (right >= 0) & (left >= 0), self.ranks[at], -1)

    def merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merges each row of symbols (padded with -1 to a power of two); symbols that went are -1 afterwards."""
        n, size = symbols.shape
        none = np.int64(1) << 60
        symbols = symbols.copy()
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (n, 1))
        wide = np.concatenate([symbols, np.full((n, 1), -1, symbols.dtype)], axis=1)  # column ``size``: the end
        tree = np.full((n, 2 * size), none, np.int64)
        first = self.rank(wide[:, :-1].ravel(), wide[:, 1:].ravel()).reshape(n, size)
        tree[:, size:] = np.where(first >= 0, first * size + np.arange(size), none)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            root = tree[rows, 1]
            at = root % size
            gone = after[rows, at]
            then = after[rows, gone]
            prev = before[rows, at]
            made = self.made[root // size]
            wide[rows, at] = made
            wide[rows, gone] = -1
            after[rows, at] = then
            inner = then < size
            before[rows[inner], then[inner]] = at[inner]
            right = self.rank(made, wide[rows, then])
            left = self.rank(np.where(prev >= 0, wide[rows, prev], -1), made)
            tree[rows, size + gone] = none
            tree[rows, size + at] = np.where(right >= 0, right * size + at, none)
            safe = np.maximum(prev, 0)
            tree[rows, size + safe] = np.where(prev >= 0, np.where(left >= 0, left * size + safe, none), tree[rows, size + safe])
            for node in (size + gone, size + at, size + safe):
                up = node >> 1
                while up[0]:
                    tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                    up = up >> 1
            rows = rows[tree[rows, 1] < none]
        return wide[:, :-1]

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The same for one long word, over plain lists."""
        n = len(symbols)
        size = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62
        rank = lambda a, b, i: none if (r := self.by_pair.get(a << 32 | b)) is None else r * size + i
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank(symbols[i], symbols[i + 1], i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, symbols = [*range(1, n + 1)], [*range(-1, n - 1)], list(symbols)

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while (root := tree[1]) < none:
            r, at = divmod(root, size)
            gone, prev = after[at], before[at]
            then = after[gone]
            symbols[at], symbols[gone], after[at] = int(self.made[r]), -1, then
            put(gone, none)
            if then < n:
                before[then] = at
            put(at, rank(symbols[at], symbols[then], at) if then < n else none)
            if prev >= 0:
                put(prev, rank(symbols[prev], symbols[at], prev))
        return [s for s in symbols if s >= 0]


WHITE = r"\p{White_Space}"
#: A word of the word-end vocabulary, as its tokenizer file states it (fixed value).
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
SPLIT = regex.compile(rf"{WHITE}+")
ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't


class WordBpe:
    """Encoder and decoder of a BPE file with word ends: NFC, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        end = model["end_of_word_suffix"]
        self.merges = Merges(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.parts: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            names, own = by_size.setdefault((len(b) - 1).bit_length(), ([], []))
            names.append(w)
            own.append(b)
        for power, (names, own) in by_size.items():
            size = max(2, 1 << power)
            if size > WIDE:
                for w, b in zip(names, own, strict=True):
                    symbols = self.inner[np.frombuffer(b, np.uint8)].tolist()
                    symbols[-1] = int(self.last[b[-1]])
                    out[w] = np.array(self.merges.merge_one(symbols), "<u4").tobytes()
                continue
            for i in range(0, len(own), 8192):
                some = own[i : i + 8192]
                lengths = np.fromiter(map(len, some), np.int64, len(some))
                flat = np.array(some, f"S{size}").view(np.uint8).reshape(len(some), size)
                symbols = self.inner[flat]
                rows = np.arange(len(some))
                symbols[rows, lengths - 1] = self.last[flat[rows, lengths - 1]]
                symbols[np.arange(size) >= lengths[:, None]] = -1
                done = self.merges.merge_rows(symbols)
                keep = done >= 0
                ids = done[keep].astype("<u4").tobytes()
                ends = (np.cumsum(keep.sum(axis=1)) * 4).tolist()
                out.update(zip(names[i : i + 8192], [ids[a:b] for a, b in zip([0, *ends], ends)], strict=True))  # noqa: B905
        return out

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts (runs without white space) that are new."""
        single, several = {}, {}
        for p in parts:
            low = p.lower() if p.isascii() else unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()
            if low.isalpha():
                single[p] = low
            elif low[-1] in ",.!?;:)" and low[:-1].isalpha():  # letters and one mark: the pattern's two words
                several[p] = (low[:-1], low[-1])
            else:
                several[p] = WORD.findall(low)
        get = self._encode_words(list({*single.values(), *(w for ws in several.values() for w in ws)})).__getitem__
        self.parts.update(zip(single, map(get, single.values()), strict=True))
        self.parts.update((p, b"".join(map(get, ws))) for p, ws in several.items())

    def _split(self, text: str) -> list[str]:
        return text.split() if not ODD_SPACE.search(text) else [p for p in SPLIT.split(text) if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            if self.cut and "<|" in t and self.cut.search(t):
                cut.append([p if i % 2 else self._split(p) for i, p in enumerate(self.cut.split(t))])
            else:
                cut.append([self._split(t)])
        for i in range(0, len(cut), 256):
            some = cut[i : i + 256]
            need = set().union(*(x for c in some for x in c if isinstance(x, list)))
            known = self.parts
            if len(known) + len(need) > MEMORY:
                known.clear()
            self._learn([p for p in need if p not in known])
            get = self.parts.__getitem__
            for c in some:
                c[:] = [b"".join(map(get, x)) if isinstance(x, list) else self.special[x].to_bytes(4, "little") for x in c]
        return [b"".join(c) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings joined by one space, in UTF-8: this vocabulary names no other way back."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)




def bpe_encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, ids (little-endian unsigned 32-bit, as one binary), decoded (or null).

    ``path`` is the tokenizer file, there on every node. Null and empty texts give no ids. Strings of
    special tokens in a text become those tokens. An empty table gives no rows; other columns are
    ignored; rows that repeat are encoded each for itself. Keys keep their type.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = bpe.encode(part.column(1).to_pylist())
                back = [bpe.decode(x).decode("utf-8", "replace") for x in ids] if decode else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["k", "ids", "decoded"])

    return rows.mapInArrow(run, StructType([rows.schema["k"]]).add("ids", "binary").add("decoded", "string")).withColumnRenamed("k", key)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
