"""Elements of JSON documents, however large one document is.

The text reader deals a file out by byte ranges, at closing braces instead of line ends, so a document
is many tasks' work and no task holds it. What a range means depends on what is before it: whether it
begins inside a string, and how deep. A first scan finds for each range how both change over it, for a
range that begins outside a string and for one that begins inside; running sums over the ranges of a
file, a row each, tell every range where it begins. A second scan cuts the ranges at the commas and
brackets of the wanted depth. An element that ends in another range than it begins in leaves its
parts, which are put together afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions.storage import checkpointed

#: Ranges whose beginnings are broadcast at most (some ten megabytes); beyond, ranges and beginnings are joined by a shuffle.
BROADCAST_RANGES = 100_000
QUOTE, ESCAPE, COMMA = (ord(c) for c in '"\\,')
OPEN, CLOSE = [ord(c) for c in "{["], [ord(c) for c in "}]"]


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, block (where the range begins), seq (order within it), value: the text up to each closing brace, which is left out."""
    d = spark.read.option("lineSep", "}").text(path)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.encode("value", "UTF-8").alias("value"))


def ranges_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, bytes]]:
    """The ranges in a batch, in its order: path and block, the first row, and the text with its braces."""
    paths, blocks = batch.column("path"), batch.column("block").to_numpy()
    values, n, at = batch.column("value").to_pylist(), batch.num_rows, 0
    names = paths.dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(names) != 0)) + 1
    for end in [*cut.tolist(), n]:
        if end > at:
            yield (paths[at].as_py(), int(blocks[at])), at, b"}".join(values[at:end]) + b"}"
            at = end


def unescaped_quotes(b: np.ndarray) -> np.ndarray:
    """Where quotes stand that have an even number of backslashes before them."""
    quote = b == QUOTE
    slash = b == ESCAPE
    if not slash.any():
        return quote
    place = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(slash, -1, place))  # the last byte up to here that is no backslash
    run = np.zeros(len(b), np.int64)
    run[1:] = place[:-1] - plain[:-1]
    return quote & (run % 2 == 0)


def structure(b: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside strings, how each changes the depth, and whether the end is inside a string."""
    quotes = np.cumsum(unescaped_quotes(b))
    kind = np.zeros(256, np.int8)
    kind[OPEN], kind[CLOSE] = 1, -1
    of = kind[b]
    at = np.flatnonzero(((of != 0) | (b == COMMA)) & ((quotes + inside) % 2 == 0))
    return at, of[at].astype(np.int64), (inside + (int(quotes[-1]) if len(b) else 0)) % 2


SUMMARY = "path string, block long, flips int, delta0 long, delta1 long, lists0 array<long>, lists1 array<long>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, {}

    def row() -> pa.RecordBatch:
        (path, block), one = now, state
        values = [path, block, one["flips"], one[0][1], one[1][1], sorted(one[0][2]), sorted(one[1][2])]
        return pa.RecordBatch.from_pylist([dict(zip(("path", "block", "flips", "delta0", "delta1", "lists0", "lists1"), values, strict=True))], schema=_SUMMARY)

    for batch in batches:
        for key, _, text in ranges_of(batch):
            if key != now:
                if now is not None:
                    yield row()
                now, state = key, {"flips": 0, 0: [0, 0, set()], 1: [1, 0, set()]}
            b = np.frombuffer(text, np.uint8)
            for start in (0, 1):
                own = state[start]
                at, step, own[0] = structure(b, own[0])
                before = own[1] + np.cumsum(step) - step
                own[2] |= set(before[b[at] == OPEN[1]].tolist())
                own[1] += int(step.sum())
            state["flips"] = state[0][0]
    if now is not None:
        yield row()


_SUMMARY = pa.schema([("path", pa.string()), ("block", pa.int64()), ("flips", pa.int32()), ("delta0", pa.int64()), ("delta1", pa.int64()), ("lists0", pa.list_(pa.int64())), ("lists1", pa.list_(pa.int64()))])


def starts(spark: SparkSession, path: str | list[str], level: int | None) -> DataFrame:
    """Where each range begins: path, block, inside (a string), depth, level. Without a level it is 2 where a member of the document is a list, else 1."""
    found = checkpointed(pieces(spark, path).mapInArrow(_summaries, SUMMARY))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    d = found.withColumn("inside", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    own = lambda n: F.when(F.col("inside") == 0, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
    d = d.select("path", "block", "inside", own("delta").alias("delta"), own("lists").alias("lists")).withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    lists = F.max(F.exists("lists", lambda x: x + F.col("depth") == 1)).over(Window.partitionBy("path"))
    return d.select("path", "block", "inside", "depth", (F.when(lists, 2).otherwise(1) if level is None else F.lit(level)).alias("level"))


PART = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("kind", pa.string()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("outer", pa.string()), ("text", pa.binary())])
PART_SQL = "path string, block long, n long, level int, kind string, begins boolean, ends boolean, outer string, text binary"


class Cutter:
    """One range, cut at its elements as its text comes."""

    def __init__(self, key: tuple[str, int], inside: int, depth: int, level: int):
        self.key, self.inside, self.depth, self.level = key, inside, depth, level
        self.rows: list[tuple] = []
        self.n = 0
        self.text: list[bytes] = []  # of the element at hand
        self.begins, self.on = False, depth >= level
        self.head: list[bytes] | None = None  # of the member at hand, where its beginning is here
        self.outer: str | None = None

    def _out(self, kind: str, begins: bool, ends: bool, text: bytes) -> None:
        if text.strip() or not (begins and ends):
            self.rows.append((*self.key, self.n, self.level, kind, begins, ends, self.outer, text))
            self.n += 1

    def _element(self, ends: bool) -> None:
        self._out("element", self.begins, ends, b"".join(self.text))
        self.text = []

    def take(self, text: bytes) -> None:
        b = np.frombuffer(text, np.uint8)
        at, step, self.inside = structure(b, self.inside)
        depth = np.maximum(self.depth + np.cumsum(step), 0)
        before = np.append(self.depth, depth[:-1]) if len(at) else depth
        wanted = np.where(step > 0, before, np.where(step < 0, before - 1, before - 1)) < self.level
        last = 0
        for i in np.flatnonzero(wanted).tolist():
            p, d, s = int(at[i]), int(before[i]), int(step[i])
            if d == 0 and s < 0:
                continue  # a brace that the reader's splitting added at the end
            part, last = text[last:p], p + 1
            inner = d == self.level
            if inner:  # a comma or the end of a container of elements
                self.text.append(part)
                self._element(True)
                self.begins, self.on = True, s == 0
            elif d == 1 and self.level == 2:
                if self.head is not None:
                    self.head.append(part)
                if s > 0:  # a member that is a container
                    self.outer = None if self.head is None else member_name(b"".join(self.head))
                    self._out("head", True, True, b"%d" % int(self.outer is not None))
                    self.head, self.begins, self.on = None, True, True
                else:  # a comma or the document's end: the member before was plain, or has been cut
                    if self.head is not None:
                        self._out("member", True, True, b"".join(self.head))
                    self.head = [] if s == 0 else None
            if s > 0 and d + 1 == self.level:
                self.begins, self.on, self.text = True, True, []
            elif s > 0 and d == 0 and self.level == 2:
                self.head = []
        if len(at):
            self.depth = int(depth[-1])
        if self.on:
            self.text.append(text[last:])
        elif self.head is not None:
            self.head.append(text[last:])

    def end(self) -> None:
        if self.on and (self.text or self.begins):
            self._element(False)


def member_name(head: bytes) -> str | None:
    """The name in ``"name":``."""
    text = head.strip().removesuffix(b":").strip()
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Cutter | None = None

    def rows(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), PART, strict=True)], schema=PART)

    for batch in batches:
        for key, at, text in ranges_of(batch):
            if now is None or key != now.key:
                if now is not None:
                    now.end()
                    if now.rows:
                        yield rows(now.rows)
                first = {c: batch.column(c)[at].as_py() for c in ("inside", "depth", "level")}
                if first["depth"] is None:
                    raise ValueError(f"the ranges of {key[0]} were dealt anew between two scans: read it again")
                now = Cutter(key, first["inside"], first["depth"], first["level"])
            now.take(text)
        if now is not None and now.rows:
            yield rows(now.rows)
            now.rows = []
    if now is not None:
        now.end()
        if now.rows:
            yield rows(now.rows)


def json_elements(spark: SparkSession, path: str | list[str], level: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The elements of JSON documents: path, outer, element (text), and block and n, which order them; the plain members of documents of lists: path, member; and all paths.

    At level 1 they are what the document itself has, at level 2 what its members have, whose name is
    ``outer``; without a level 2 where a member is a list, else 1. An element of an object is
    ``"name": value``. White space around elements is kept, empty containers have none. Documents must
    be valid; at level 2 the names of members must not have a closing brace.
    """
    begin = checkpointed(starts(spark, path, level))
    few = begin.count() <= BROADCAST_RANGES
    rows = pieces(spark, path).join(F.broadcast(begin) if few else begin, ["path", "block"], "left")
    rows = (rows if few else rows.repartition("path", "block")).sortWithinPartitions("path", "block", "seq")
    cut = checkpointed(rows.select("path", "block", "value", "inside", "depth", "level").mapInArrow(_parts, PART_SQL))
    text = F.decode("text", "UTF-8")
    whole = cut.where("kind = 'element' AND begins AND ends")
    # Parts of elements, two a range at most: each goes with the last beginning before it.
    order = Window.partitionBy("path").orderBy("block", "n")
    some = cut.where("kind = 'element' AND NOT (begins AND ends)").withColumn("g", F.sum(F.col("begins").cast("int")).over(order))
    joined = some.groupBy("path", "g").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("p"), F.min_by("outer", F.struct("block", "n")).alias("outer"), F.first("level").alias("level"))
    joined = joined.select("path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"), "level", "outer", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"])).alias("text")).where(F.trim(text) != "")
    both = whole.select("path", "block", "n", "level", "outer", "text").unionByName(joined)
    # Elements before a range's first container of its own belong to the last one before the range.
    heads = cut.where("kind = 'head'").groupBy("path", "block").agg(F.max_by("outer", "n").alias("opened"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = begin.select("path", "block").join(heads, ["path", "block"], "left").withColumn("open", F.last("opened", True).over(before)).select("path", "block", "open")
    out = both.join(last, ["path", "block"], "left").select("path", F.when(F.col("level") == 2, F.coalesce("outer", "open")).alias("outer"), text.alias("element"), "block", "n", "level")
    members = cut.where("kind = 'member'").select("path", text.alias("member"))
    return out, members, begin.select("path").distinct()
