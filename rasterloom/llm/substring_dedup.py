"""Repeated word windows, found by a count-min prefilter and an exact second pass.

1. Every block of documents sketches its windows: two rows of cells, packed by range of the cells.
2. The ranges add the partition sketches up. Their counts can only be too high, so a window with a
   cell that counts one in any row occurs once in the table and is left out; no repeat is lost.
3. The windows that are left go to the exact pass: blocks send each distinct window once, as 128 bits
   and the least document that has it; the ranges tell each block where the table has a lesser one.
4. Words under windows that a lesser document of the table or of the block has go.

No step has a row for a window, and no window, however frequent, is sent more than once by a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.llm import blocks as B
from rasterloom.llm.common import binary_parts, mix64, size_of, table
from rasterloom.llm.grams import gram_hashes, gram_starts, runs_of_texts, word_hashes, words

U = np.uint64
WINDOW = 13
KEY_BITS = 48


class Windows:
    """The windows of a block: text, first word in its text, and two hashes, beside each text's word spans."""

    def __init__(self, t: pa.Table, n: int):
        raw, offsets = binary_parts(t.column("t"))
        self.raw, self.offsets, self.n = raw, offsets, n
        self.keys = B.ordered_keys(t.column("k"))
        starts, ends, counts, a, b, first = [], [], [], [], [], []
        seen = 0
        for i, j in runs_of_texts(offsets):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            s, e, c = words(part, at)
            g, _ = gram_starts(c, n)
            a.append(gram_hashes(word_hashes(part, s, e, 0), g, n, 0))
            b.append(gram_hashes(word_hashes(part, s, e, 100), g, n, 100))
            first.append(g + seen)
            starts.append(s + offsets[i])
            ends.append(e + offsets[i])
            counts.append(c)
            seen += len(s)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, self.counts = cat(starts, np.int64), cat(ends, np.int64), cat(counts, np.int64)
        self.a, self.b, self.first = cat(a, U), cat(b, U), cat(first, np.int64)
        self.text_of_word = np.repeat(np.arange(len(self.counts)), self.counts)

    def cells(self, bits: int) -> list[np.ndarray]:
        """Cells of both rows of the sketch, the second row's after the first's."""
        return [self.a >> U(64 - bits), (mix64(self.a, 5) >> U(64 - bits)) | U(1 << bits)]

    def repeated(self, said: pa.Table, ways: B.Ways) -> np.ndarray:
        """Indices of the windows whose every cell counts two or more."""
        cells = self.cells(ways.bits - 1)
        v = B.counted(np.concatenate(cells))[0]
        v = v[B.read_answers(said, v, ways, 0, 0, SKETCH) > 1]
        keep = np.ones(len(self.a), bool)
        for own in cells:
            keep[keep] = B.look_up(v, own[keep]) >= 0
        return np.flatnonzero(keep)

    def exact(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of these in order: key, record (rest of the 128 bits, least document), and each window's place among them."""
        key, lo, b = self.a[at] >> U(64 - KEY_BITS), self.a[at].astype(np.uint16), self.b[at]
        docs = self.keys[self.text_of_word[self.first[at]]] if len(at) else np.zeros(0, U)
        order = np.lexsort((docs, b, lo, key))
        key, lo, b = key[order], lo[order], b[order]
        new = B.firsts(key, lo, b)
        of = np.empty(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        out = np.zeros(int(new.sum()), Earliest.dtype)
        out["lo"], out["b"], out["doc"] = lo[new], b[new], docs[order][new]
        return key[new], out, of


class Earliest(B.Records):
    """Windows with the least document that has them; the answer is 1 where the table has a lesser one."""

    dtype = np.dtype([("lo", np.uint16), ("b", np.uint64), ("doc", np.uint64)])

    def merge(self, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((own["doc"], own["b"], own["lo"], keys))
        k, r = keys[order], own[order]
        new = B.firsts(k, r["lo"], r["b"])
        of = np.empty(len(k), np.int64)
        of[order] = np.cumsum(new) - 1
        return k[new], r[new], of

    def decide(self, keys: np.ndarray, merged: np.ndarray) -> np.ndarray:
        return np.zeros(len(keys), np.uint8)

    def spread(self, said: np.ndarray, of: np.ndarray, own: np.ndarray, merged: np.ndarray) -> np.ndarray:
        return said[of] | (own["doc"] > merged["doc"][of])


SKETCH, EARLIEST = B.Counts(2), Earliest()


OUT = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def kept_words(w: Windows, gone: np.ndarray, keys: pa.Array) -> pa.Table:
    """The result rows of a block: the words that are not gone, joined by one space."""
    n = len(w.raw)
    keep = np.zeros(n + 1, np.int32)
    s, e = w.start[~gone], w.end[~gone]
    keep[s] += 1
    last = np.zeros(n + 1, bool)
    last[w.offsets] = True
    more = ~last[e]  # a separator of the same text follows: it becomes the one space
    keep[e + more] -= 1
    mask = np.cumsum(keep[:-1]) > 0
    body = np.where(w_space(w.raw), np.uint8(32), w.raw)
    texts = len(w.counts)
    left = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
    tail = np.flatnonzero(mask)[left[1:][np.diff(left) > 0] - 1]  # each text's last byte: no space at the end
    mask[tail[body[tail] == 32]] = False
    left = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
    kept = pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(body[mask].tobytes())])
    removed = np.bincount(w.text_of_word[gone], minlength=texts)
    return pa.table({"k": keys, "n_words": w.counts.astype(np.int64), "n_removed": removed.astype(np.int64), "kept": kept.cast(pa.string())}, schema=OUT)


def w_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _sketch(t: pa.Table, n: int, ways: B.Ways) -> pa.Table:
    cells, many = B.counted(np.concatenate(Windows(t, n).cells(ways.bits - 1)))
    return ways.send(0, t.column("block")[0].as_py(), cells, lambda i, j: SKETCH.pack(many[i:j]))


def _keys(docs: pa.Table, said: pa.Table, n: int, ways: B.Ways, exact: B.Ways) -> pa.Table:
    if not len(docs):
        return B.PIECE.empty_table()
    w = Windows(docs, n)
    keys, records, _ = w.exact(w.repeated(said, ways))
    return exact.send(0, docs.column("block")[0].as_py(), keys, lambda i, j: EARLIEST.pack(records[i:j]))


def _remove(docs: pa.Table, said: pa.Table, n: int, ways: B.Ways, exact: B.Ways, carry: bool) -> pa.Table:
    if not len(docs):
        return OUT.empty_table() if not carry else pa.table({"rest": docs.column("rest"), **{c: OUT.empty_table().column(c) for c in ("n_words", "n_removed", "kept")}})
    w = Windows(docs, n)
    second = pc.equal(said.column("n"), pa.scalar(b"exact"))
    at = w.repeated(said.filter(pc.invert(second)), ways)
    keys, records, of = w.exact(at)
    dup = np.zeros(0, bool)
    if len(at):
        earlier = B.read_answers(said.filter(second), keys, exact, 0, 0, EARLIEST) > 0
        dup = earlier[of] | (w.keys[w.text_of_word[w.first[at]]] > records["doc"][of])
    begin, many = w.first[at[dup]], len(w.start) + 1
    cover = np.bincount(begin, minlength=many) - np.bincount(begin + n, minlength=many)
    out = kept_words(w, np.cumsum(cover)[: len(w.start)] > 0, docs.column("k"))
    if not carry:
        return out
    whole = pc.if_else(pc.equal(out.column("n_removed"), 0), docs.column("t").cast(pa.string()), out.column("kept"))
    return pa.table({"rest": docs.column("rest"), "n_words": out.column("n_words"), "n_removed": out.column("n_removed"), "kept": whole})


def substring_dedup(docs: DataFrame, n: int = WINDOW, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of ``n`` words of its document covers it whose words also stand, in the
    same order, in a document with a smaller key. Windows are judged on the input. Null and empty
    texts, and texts of fewer than ``n`` words, lose nothing. Keys are integers. A document with a null key is not
    smaller than any; it loses what stands in documents with keys. Rows with one key do not make
    each other lose anything. An empty table gives no rows; other columns are ignored.

    With ``carry`` the rows are rest (a struct of those columns), n_words, n_removed and kept, where
    kept is the text as it was, white space too, if nothing was removed.
    """
    _, n_bytes = size_of(docs, text)
    blocks = B.block_count(n_bytes)
    ways = B.Ways.of(blocks, B.width_bits(n_bytes // 5) + 1, n_bytes // 2)
    exact = B.Ways.of(blocks, KEY_BITS, n_bytes // 12)
    rows = B.blocked(docs, n_bytes, text, key, carry)
    by = rows.groupBy("block")
    said = B.exchanged(by.applyInArrow(lambda t: _sketch(t, n, ways), B.PIECE_SQL), ways, SKETCH)
    keys = by.cogroup(said.groupBy("block")).applyInArrow(lambda a, b: _keys(a, b, n, ways, exact), B.PIECE_SQL)
    told = B.exchanged(keys, exact, EARLIEST).withColumn("n", F.lit(b"exact"))
    head = StructType([rows.schema["rest"]]) if carry else StructType([rows.schema["k"]])
    schema = head.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    out = by.cogroup(said.unionByName(told).groupBy("block")).applyInArrow(lambda a, b: _remove(a, b, n, ways, exact, bool(carry)), schema)
    return out if carry else out.withColumnRenamed("k", key)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = (
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
k AS (SELECT doc_id, i, word, CASE WHEN lead(word, 12) OVER o IS NOT NULL THEN """
    + " || ".join(["word", *[f"' ' || lead(word, {j}) OVER o" for j in range(1, 13)]])
    + r""" END AS s FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, word, CASE WHEN s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END AS bad FROM k),
c AS (SELECT doc_id, i, word, max(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
)
