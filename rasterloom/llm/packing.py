"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has room for so many tokens, so many pieces, and so much attention cost (the sum of
squared piece lengths). Pieces are placed from the longest on, each into the open sequence where it
fits in every respect and that its rule prefers: the least weighted norm of what would be left
(``norm``), or the greatest weighted dot-product of demand and room (``dot``).

Pieces are dealt into groups of a fixed expected size by a hash, and each group is packed by itself:
the groups are alike, so next to nothing is lost against one packing of all, at most about one
sequence that is not full for each group.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rasterloom.llm.common import stored, table

TOKENS, END = 1024, 2
GROUP = 8192
#: The pre-tokenizer of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A run of one kind that is longer than the fast encoder takes well: its pattern backtracks, and its merges grow with the square of a run.
LONG_RUN = re.compile(r"\s{1000}|\S{1000}")


@lru_cache(maxsize=2)
def whole_bpe(path: str):
    """The same vocabulary in the tokenizers library, for texts with long runs."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    return lib


@lru_cache(maxsize=2)
def byte_bpe(path: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    """The byte-level encoder of a file of ranks; strings of special tokens in a text become those tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def token_ids(text: str, path: str, special: tuple[tuple[str, int], ...]) -> np.ndarray:
    """The ids of a text, by the file of ranks, or by the library's file (``.json`` beside it) where it has a long run."""
    if LONG_RUN.search(text):
        return np.array(whole_bpe(path.removesuffix(".tiktoken") + ".json").encode(text, add_special_tokens=False).ids, "<u4")
    return byte_bpe(path, special).encode_to_numpy(text, allowed_special="all").astype("<u4")


def token_pieces(
    docs: DataFrame, path: str, special: dict[str, int], limit: int = TOKENS, end: int | None = END, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The pieces of every row of ``docs``: k, piece, start, length, ids_crc32.

    A document's ids are its text's (null: empty) and then ``end``. Up to ``limit`` ids are one
    piece; more are cut from the end into pieces of ``limit``, so the first may be shorter.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kind, arrow = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    tokens = tuple(special.items())
    tail = b"" if end is None else end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, piece, start, length, crc = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(token_ids(t.as_py(), path, tokens).tobytes() + tail)
                n = len(ids) // 4
                first = n % limit or min(n, limit)
                edges = [0, *range(first, n + 1, limit)] if n else [0, 0]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905
                    keys.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, arrow), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["k", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, tokens: int, pieces: int, cost: float, weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of one group."""
    room = np.array([tokens, pieces, cost], float)
    w = np.array(weights) / room  # capacities count as one each, times their weight
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((64, 3))
    used = np.zeros(64, np.int64)
    names = np.zeros(64, np.int64)
    open_, made, most = 0, 0, 0.0
    for i in order.tolist():
        n = int(lengths[i])
        need = np.array([n, 1, float(n) * n])
        at = -1
        if open_ and most >= n:
            some = left[:open_]
            fits = np.flatnonzero((some >= need).all(axis=1))
            if len(fits):
                rest = some[fits]
                score = -(((rest - need) * w) ** 2).sum(axis=1) if rule == "norm" else ((rest * w) * (need * w)).sum(axis=1)
                at = int(fits[np.argmax(score)])
        if at < 0:
            if open_ == len(left):
                left, used, names = np.concatenate([left, left * 0]), np.concatenate([used, used * 0]), np.concatenate([names, names * 0])
            at, open_ = open_, open_ + 1
            left[at], used[at], names[at] = room, 0, made
            made += 1
        where[i], offset[i] = names[at], used[at]
        used[at] += n
        left[at] -= need
        if left[at, 0] <= 0 or left[at, 1] <= 0:  # full: the last open one takes its place
            open_ -= 1
            left[at], used[at], names[at] = left[open_], used[open_], names[open_]
        most = max(most, float(room[0] - n)) if open_ < 256 else float(left[:open_, 0].max())
    return where, offset


def best_fit_packing(
    docs: DataFrame,
    path: str,
    special: dict[str, int],
    limit: int = TOKENS,
    end: int | None = END,
    pieces_limit: int | None = None,
    cost_limit: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    text: str = "text",
    key: str = "doc_id",
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    The capacities of a sequence are ``limit`` tokens, ``pieces_limit`` pieces and ``cost_limit``
    attention cost; the last two bind nothing by default (every piece has a token). Offsets run from
    0 without gaps. Null and empty texts are one piece of the end id alone; rows that repeat are
    packed each for itself; keys keep their type; an empty table gives no rows; other columns are ignored.
    """
    pieces = stored(token_pieces(docs, path, special, limit, end, text, key), "pieces")
    groups = max(1, round(pieces.count() / group))
    caps = (limit, pieces_limit or limit, float(limit) ** 2 if cost_limit is None else cost_limit)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("k", "ascending"), ("piece", "ascending")])
        where, offset = best_fit(t.column("length").to_numpy(), *caps, weights, rule)
        g = t.column("g").to_numpy().astype(np.int64)
        return t.drop_columns(["g"]).append_column("sequence_id", pa.array(g << 32 | where)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("k", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    out = dealt.groupBy("g").applyInArrow(pack, pieces.schema.add("sequence_id", "long").add("offset", "long"))
    return out.withColumnRenamed("k", key)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
