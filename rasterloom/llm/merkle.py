"""Merkle manifest of a dataset, with the states of the hash kept at every parent.

A node's digest enters its parent as hex text of 64 bytes, which is one block of SHA-256. So the
state before each child slot is eight words, which a parent retains for all its slots. A replaced
child is folded in from that state on: its own block, its right siblings' and the closing block;
nothing left of it is hashed again.

A tree is built in chunks of ``fan ** levels`` neighbours, one task each, whose roots are the next
stage's leaves; a group's size only adds stages. Each chunk is one row of the manifest: digests and
states of all its nodes. Going down again, a chunk gives each of its leaves the siblings and states
on its way up, so a leaf's task needs the rows on that way and no more.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import join_hot, sql_crc32, stored, table
from rasterloom.operators.captions import numbered

FAN, LEVELS = 3, 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
W = np.uint32


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, list[int]]:
    """First state and round constants of SHA-256: fractions of the square and cube roots of the first primes."""
    primes = [p for p in range(2, 320) if all(p % q for q in range(2, p))][:64]

    def cube_root(x: int) -> int:
        low, high = 0, 1 << 40
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
        return low

    first = np.array([[math.isqrt(p << 64) & 0xFFFFFFFF] for p in primes[:8]], W)
    return first, [cube_root(p << 96) & 0xFFFFFFFF for p in primes]


def compressed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 x n words) after one block each (16 x n words)."""
    turned = lambda x, n: (x >> W(n)) | (x << W(32 - n))
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i, k in enumerate(constants()[1]):
        if i >= 16:
            s0 = turned(w[1], 7) ^ turned(w[1], 18) ^ (w[1] >> W(3))
            s1 = turned(w[14], 17) ^ turned(w[14], 19) ^ (w[14] >> W(10))
            w.append(w[0] + s0 + w[9] + s1)
            w.pop(0)
        word = w[i] if i < 16 else w[15]
        t = h + (turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) + ((e & f) ^ (~e & g)) + W(k) + word
        u = (turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


@lru_cache(maxsize=1)
def _pairs() -> np.ndarray:
    return np.array([int.from_bytes(b"%02x" % i, "big") for i in range(256)], W)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block that each digest's hex text is."""
    t, out = _pairs(), np.empty((16, digests.shape[1]), W)
    for i, x in enumerate(digests):
        out[2 * i] = t[x >> W(24)] << W(16) | t[x >> W(16) & W(255)]
        out[2 * i + 1] = t[x >> W(8) & W(255)] << W(16) | t[x & W(255)]
    return out


def closing(children: np.ndarray) -> np.ndarray:
    """The block that ends a message of so many hex digests."""
    out = np.zeros((16, len(children)), W)
    out[0], out[15] = W(1 << 31), children.astype(W) * W(512)
    return out


def to_words(blob: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(blob, ">u4").reshape(-1, 8).T.astype(W)


def to_bytes(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def depth(total: int, fan: int, levels: int) -> int:
    """Levels that a chunk of a tree with ``total`` nodes has at this stage."""
    return next(d for d in range(levels + 1) if d == levels or fan**d >= total)


@dataclass
class Chunk:
    """Neighbouring nodes and the levels above them: digests of each level, and of each level's parents the states before every slot."""

    rows: list[np.ndarray]
    states: list[list[np.ndarray]]
    fan: int

    @staticmethod
    def of(digests: np.ndarray, levels: int, fan: int) -> Chunk:
        rows, states = [digests], []
        for _ in range(levels):
            row = rows[-1]
            many = -(-row.shape[1] // fan)
            state, before = np.repeat(constants()[0], many, axis=1), []
            for slot in range(fan):
                before.append(state)
                some = row[:, slot::fan]
                state = state.copy()
                state[:, : some.shape[1]] = compressed(state[:, : some.shape[1]], hex_block(some))
            states.append(before)
            rows.append(compressed(state, closing(Chunk.children(row.shape[1], fan))))
        return Chunk(rows, states, fan)

    @staticmethod
    def children(n: int, fan: int) -> np.ndarray:
        out = np.full(-(-n // fan), fan)
        out[-1] -= len(out) * fan - n
        return out

    def packed(self) -> tuple[bytes, bytes]:
        """All digests, and the states before every slot but the first, which is always the same."""
        return b"".join(map(to_bytes, self.rows)), b"".join(to_bytes(s) for level in self.states for s in level[1:])

    @staticmethod
    def read(digests: bytes, states: bytes, n: int, levels: int, fan: int) -> Chunk:
        rows, kept, at, mid = [], [], 0, 0
        all_, more = to_words(digests), to_words(states)
        for level in range(levels + 1):
            rows.append(all_[:, at : at + n])
            at += n
            if level < levels:
                n = -(-n // fan)
                own = [np.repeat(constants()[0], n, axis=1)]
                for _ in range(1, fan):
                    own.append(more[:, mid : mid + n])
                    mid += n
                kept.append(own)
        return Chunk(rows, kept, fan)

    def siblings(self) -> list[bytes]:
        """For each leaf the hex digests of its siblings on all levels of the chunk, from below."""
        above = [b""]
        for row in reversed(self.rows[:-1]):
            text = to_bytes(row).hex().encode()
            n, f = row.shape[1], self.fan
            own = []
            for i in range(n):
                begin, end = i // f * f * 64, min(n, i // f * f + f) * 64
                own.append(text[begin : i * 64] + text[i * 64 + 64 : end] + above[i // f])
            above = own
        return above

    def ways(self) -> list[bytes]:
        """For each leaf the steps by which a digest in its place is folded to the chunk's root: see ``Step``."""
        above = [b""]
        for level in reversed(range(len(self.states))):
            row = to_bytes(self.rows[level])
            mids = [to_bytes(s) for s in self.states[level]]
            n, f = self.rows[level].shape[1], self.fan
            children, own = Chunk.children(n, f), []
            for i in range(n):
                p, slot = divmod(i, f)
                right = row[(i + 1) * 32 : (p * f + int(children[p])) * 32]
                own.append(struct.pack("BB", len(right) // 32, int(children[p])) + mids[slot][p * 32 : p * 32 + 32] + right + above[p])
            above = own
        return above

    def folded(self, at: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """The chunk's roots after the leaf ``at[i]`` alone is replaced by ``digests[:, i]``."""
        for row, before in zip(self.rows, self.states, strict=False):
            p, slot = np.divmod(at, self.fan)
            children = Chunk.children(row.shape[1], self.fan)[p]
            state = np.empty_like(digests)
            for s in range(self.fan):
                some = np.flatnonzero(slot == s)
                state[:, some] = before[s][:, p[some]]
            state = compressed(state, hex_block(digests))
            for j in range(1, self.fan):
                some = np.flatnonzero(slot + j < children)
                if len(some):
                    state[:, some] = compressed(state[:, some], hex_block(row[:, at[some] + j]))
            digests, at = compressed(state, closing(children)), p
        return digests


def climbed(digests: np.ndarray, way: bytes) -> np.ndarray:
    """Digests of one node's place folded up a way: at each step a state is resumed with them and the right siblings."""
    at, n = 0, digests.shape[1]
    same = lambda words: np.repeat(words, n, axis=1)
    while at < len(way):
        right, children = way[at], way[at + 1]
        state = compressed(same(to_words(way[at + 2 : at + 34])), hex_block(digests))
        at += 34
        for _ in range(right):
            state = compressed(state, same(hex_block(to_words(way[at : at + 32]))))
            at += 32
        digests = compressed(state, closing(np.full(n, children)))
    return digests


CHUNK_SQL = "tree long, chunk long, total long, n int, root binary, digests binary, states binary"


def climb(nodes: DataFrame, fan: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The manifest's stages over ``nodes`` (tree, pos, total, digest), and the root of each tree (tree, digest)."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        total = t.column("total")[0].as_py()
        chunk = Chunk.of(to_words(b"".join(t.column("digest").to_pylist())), depth(total, fan, levels), fan)
        digests, states = chunk.packed()
        row = {"tree": t.column("tree")[0].as_py(), "chunk": t.column("chunk")[0].as_py(), "total": total, "n": len(t)}
        return pa.Table.from_pylist([{**row, "root": to_bytes(chunk.rows[-1]), "digests": digests, "states": states}], MANIFEST)

    width, stages = fan**levels, []
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        chunked = nodes.withColumn("chunk", F.floor(F.col("pos") / width).cast("long")).groupBy("tree", "chunk")
        stages.append(stored(chunked.applyInArrow(build, CHUNK_SQL), "merkle"))
        nodes = stages[-1].select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("total") / width).cast("long").alias("total"), F.col("root").alias("digest"))
        most = -(-most // width)
        if most <= 1:
            return stages, nodes.select("tree", "digest")


MANIFEST = pa.schema([("tree", pa.int64()), ("chunk", pa.int64()), ("total", pa.int64()), ("n", pa.int32()), ("root", pa.binary()), ("digests", pa.binary()), ("states", pa.binary())])


def descend(stages: list[DataFrame], ways: DataFrame, fan: int, levels: int, down_to: int) -> DataFrame:
    """From the ways of the trees' roots (tree, proof, way) those of the leaves of stage ``down_to`` (tree, pos, proof, way)."""
    ways = ways.withColumn("pos", F.lit(0).cast("long"))

    def opened(batches):
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk.read(r["digests"], r["states"], r["n"], depth(r["total"], fan, levels), fan)
                begin = r["chunk"] * fan**levels
                own = list(zip(chunk.siblings(), chunk.ways(), strict=True))
                for i in range(0, r["n"], 1024):
                    part = own[i : i + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["tree"]] * len(part), pa.int64()), pa.array(range(begin + i, begin + i + len(part)), pa.int64()), pa.array([p + r["proof"] for p, _ in part], pa.binary()), pa.array([w + r["way"] for _, w in part], pa.binary())],
                        names=["tree", "pos", "proof", "way"],
                    )

    for stage in reversed(stages[down_to:]):
        joined = stage.join(ways.withColumnRenamed("pos", "chunk"), ["tree", "chunk"]).select(*stage.columns, "proof", "way")
        ways = joined.mapInArrow(opened, "tree long, pos long, proof binary, way binary")
    return ways


def field(c: Column) -> Column:
    """A value as it is hashed: - for null, else its bytes counted, a colon, and itself."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


@dataclass
class Manifest:
    """Leaves (k, leaf, new, tree, pos), the stages of the groups' trees and of the tree over them, and the groups' roots."""

    leaves: DataFrame
    stages: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: bytes | None


def merkle_manifest(docs: DataFrame, leaf: Column, new: Column, group: str = "source", key: str = "doc_id", fan: int = FAN, levels: int = LEVELS) -> Manifest:
    """The manifest over the rows of ``docs``, whose digests (hex) are ``leaf``; ``new`` are those to fold in later.

    Per group (null first, then by UTF-8 bytes) leaves are in the order of ``key``, nulls first, ties by
    digest. Rows that repeat are leaves of their own. A group of one leaf has it as its root. Keys keep
    their type. An empty table has no root; columns that no argument names are ignored.
    """
    own = F.col(f"`{group}`")
    leaves = docs.select(F.col(f"`{key}`").alias("k"), own.isNotNull().alias("some"), F.coalesce(own.cast("string"), F.lit("")).alias("g"), leaf.alias("leaf"), new.alias("new"))
    at = numbered(leaves, ["some", "g", "k", "leaf"], "at")
    sizes = at.groupBy("some", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("total"))
    trees = stored(numbered(sizes, ["some", "g"], "tree").withColumn("tree", F.col("tree").cast("long")), "trees")
    placed = join_hot(at, trees, ["some", "g"], "total", "at")
    placed = stored(placed.select("k", "leaf", "new", "tree", (F.col("at") - F.col("first")).cast("long").alias("pos"), "total"), "leaves")
    stages, roots = climb(placed.select("tree", "pos", "total", F.unhex("leaf").alias("digest")), fan, levels)
    count = trees.count()
    top, root = climb(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("total"), "digest"), fan, levels)
    whole = root.first()
    return Manifest(placed.drop("total"), stages, top, roots, bytes(whole["digest"]) if whole else None)


def fold_leaves(m: Manifest, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """k, leaf, subroot, root, proof_sha256 (of all siblings, from below) and folded_root: the root after this leaf alone is ``new``."""
    spark = m.leaves.sparkSession
    if m.root is None:
        return m.leaves.selectExpr("k", "leaf", "'' AS subroot", "'' AS root", "'' AS proof_sha256", "'' AS folded_root")
    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(b"").alias("proof"), F.lit(b"").alias("way"))
    groups = descend(m.top, start, fan, levels, 0).select(F.col("pos").alias("tree"), "proof", "way")
    above = descend(m.stages, groups, fan, levels, 1)
    chunks = m.stages[0].join(above.withColumnRenamed("pos", "chunk"), ["tree", "chunk"])
    chunks = chunks.join(m.groups.withColumnRenamed("digest", "subroot"), "tree").select("tree", "chunk", "total", "n", "digests", "states", "proof", "way", "subroot")
    leaves = m.leaves.withColumn("chunk", F.floor(F.col("pos") / fan**levels).cast("long"))
    root = m.root.hex()

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        r = c.to_pylist()[0]
        chunk = Chunk.read(r["digests"], r["states"], r["n"], depth(r["total"], fan, levels), fan)
        new = to_words(bytes.fromhex("".join(t.column("new").to_pylist())))
        at = t.column("pos").to_numpy() - r["chunk"] * fan**levels
        folded = to_bytes(climbed(chunk.folded(at, new), r["way"])).hex()
        siblings, n = chunk.siblings(), len(t)
        more = {
            "subroot": [r["subroot"].hex()] * n,
            "root": [root] * n,
            "proof_sha256": [hashlib.sha256(siblings[i] + r["proof"]).hexdigest() for i in at.tolist()],
            "folded_root": [folded[64 * i : 64 * i + 64] for i in range(n)],
        }
        out = t.select(["k", "leaf"])
        for name, column in more.items():
            out = out.append_column(name, pa.array(column, pa.string()))
        return out

    schema = m.leaves.select("k", "leaf").schema
    for name in ("subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, "string")
    return leaves.groupBy("tree", "chunk").cogroup(chunks.groupBy("tree", "chunk")).applyInArrow(run, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256)
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    own = leaf(F.col("text"))
    out = fold_leaves(merkle_manifest(docs, own, F.when(hit, leaf(F.translate("text", "\n", ""))).otherwise(own)))
    return out.select(F.col("k").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _op12_sql(levels: int = 12, top: int = 5) -> str:
    """Level by level: 3**levels leaves a source and 3**top sources at most."""
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    hashed = lambda body: "sha256(" + " || ".join([*[text(c) for c in FIELDS[:-1]], text(body)]) + ")"
    ctes = [
        f"d AS MATERIALIZED (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN {sql_crc32('doc_id')} & 1 = 0 THEN {hashed("replace(text, chr(10), '')")} ELSE {hashed('text')} END AS new FROM documents)",
        "l0 AS MATERIALIZED (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS h, doc_id, new FROM d)",
        "f0 AS MATERIALIZED (SELECT doc_id, source, h AS leaf, pos, new AS h, '' AS proof FROM l0)",
    ]

    def up(i: int, side: str) -> None:
        whole = "CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h"
        folded = "CASE WHEN any_value(l.n) > 1 THEN sha256(string_agg(CASE WHEN l.pos = f.pos THEN f.h ELSE l.h END, '' ORDER BY l.pos)) ELSE any_value(f.h) END AS h"
        proof = "any_value(f.proof) || coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos <> f.pos), '') AS proof"
        ctes.append(f"l{i + 1} AS MATERIALIZED (SELECT source, pos // 3 AS pos, (n + 2) // 3 AS n, {whole} FROM l{i} GROUP BY source, pos // 3, n)")
        ctes.append(f"f{i + 1} AS MATERIALIZED (SELECT f.doc_id, f.{side} AS {side}, f.leaf, any_value(f.pos) // 3 AS pos, {folded}, {proof}{more} FROM f{i} f JOIN l{i} l ON l.source IS NOT DISTINCT FROM f.{side} AND l.pos // 3 = f.pos // 3 GROUP BY f.doc_id, f.{side}, f.leaf)")

    more = ""
    for i in range(levels):
        up(i, "source")
    ctes.append(f"l{levels + 1} AS MATERIALIZED (SELECT 0 AS source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, source AS name FROM l{levels})")
    ctes.append(f"f{levels + 1} AS MATERIALIZED (SELECT f.doc_id, 0 AS grp, f.leaf, l.pos, f.h, f.proof, l.h AS subroot FROM f{levels} f JOIN l{levels + 1} l ON l.name IS NOT DISTINCT FROM f.source)")
    more = ", any_value(f.subroot) AS subroot"
    for i in range(levels + 1, levels + 1 + top):
        up(i, "grp")
    end = levels + 1 + top
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, l.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = l.h AS verified FROM f{end} f CROSS JOIN l{end} l"


OP12_SQL = _op12_sql()
