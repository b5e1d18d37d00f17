"""Similarity join of word-shingle sets under Jaccard, size-aware: light sets by subsets, heavy ones by lists.

Equal sets are first folded into one. Of every other set the shingles are ordered from the rarest of
the table; of the first few, linked sets share at least one, and those that another set has too are
what the set is listed under. A light set (below the boundary) gives out, instead, the hash of each of
its subsets of the size that a link to a set of a given light size needs; two light sets are linked
exactly if such a subset is common. Light sets near the boundary are listed too, for the heavy ones.
The boundary is the size up to which subsets cost less than lists: the number of subsets against the
lengths of the lists that sets of that size are in, both counted over the table.

Lists are cut by size, since sets link with sets of about their size only. Sets that meet in a subset
or list are candidates. They go, with their neighbours' neighbours, to common groups, where overlaps
are counted by scanning the group's lists: no pairs are shuffled. Groups are bounded: a larger family
of candidates is cut into chunks of sets of about one size, and two chunks whose sizes can link are a
group. Components are taken over verified links alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import blocks as B
from rasterloom.llm.common import binary_parts, join_hot, mix64, size_of, stored, table
from rasterloom.llm.components import components
from rasterloom.llm.grams import prefix_hash, shingle_sets, span_hash

U = np.uint64
N, PERCENT = 4, 85
#: Subsets of one set that are held at once.
SUBSETS_AT_ONCE = 1 << 16
#: Shingles of a group that is verified at once.
CHUNK = 1 << 19
BYTES = 6  # of a shingle's hash in a verified set


def need(percent: int, s: int, t: int) -> int:
    """Least overlap of linked sets of s and t shingles."""
    return -(-percent * (s + t) // (100 + percent))


def partners(percent: int, s: int) -> range:
    """Sizes that a set linked with one of s shingles can have."""
    return range(max(1, -(-percent * s // 100)), 100 * s // percent + 1)


def prefix_size(percent: int, s: int) -> int:
    return s + percent * -s // 100 + 1 if s else 0


def subset_cost(percent: int, s: int, light: int) -> int:
    return sum(math.comb(s, need(percent, s, t)) for t in partners(percent, s) if t < light and need(percent, s, t) <= min(s, t))


def size_classes(percent: int, most: int) -> list[int]:
    """Least sizes of classes such that linked sets are in one class or in two that follow each other."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // percent + 1)
    return out


def light_boundary(sizes: dict[int, tuple[int, int]], percent: int) -> int:
    """The boundary of least cost, from the number of sets of each size and the sum of the lengths of all lists that they are in.

    What subsets cost grows with the boundary, so the search ends where they alone cost more than the best so far.
    """
    best, least = 1, sum(lists for _, lists in sizes.values())
    for light in range(2, max([*sizes, 0]) + 2):
        subsets_ = lists_ = 0
        for s, (n, lists) in sizes.items():
            subsets_ += n * subset_cost(percent, s, light) if s < light else 0
            lists_ += lists if 100 * s // percent >= light else 0
            if subsets_ > least:
                return best
        if subsets_ + lists_ < least:
            best, least = light, subsets_ + lists_
    return best


def set_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole sorted set."""
    out = []
    for seed in (3, 4):
        h = span_hash(prefix_hash(mix64(flat, seed), seed), offsets[:-1], offsets[1:], seed)
        out.append(mix64(h ^ np.diff(offsets).astype(U), seed).view(np.int64))
    return out[0], out[1]


def _signed(t: pa.RecordBatch, n: int) -> pa.RecordBatch:
    raw, offsets = binary_parts(t.column(1))
    flat, at = shingle_sets(raw, offsets, n)
    h1, h2 = set_keys(flat, at)
    return pa.RecordBatch.from_arrays([t.column(0), t.column(2), pa.array(np.diff(at)), pa.array(h1), pa.array(h2)], names=["k", "block", "n", "h1", "h2"])


def signatures(rows: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield _signed(batch.slice(at, 1024), n)

    return rows.select("k", "t", "block").mapInArrow(run, "k long, block int, n long, h1 long, h2 long")


def _own_sets(docs: pa.Table, copies: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, shingles and offsets of the block's rows that stand for a set: neither a copy, nor without key or words."""
    own = docs.filter(pc.is_valid(docs.column("k")))
    keys = own.column("k").to_numpy()
    flat, at = shingle_sets(*binary_parts(own.column("t")), n)
    name = lambda k, h: mix64(k.view(U), 12) ^ h.view(U)
    gone = np.isin(name(keys, set_keys(flat, at)[0]), name(copies.column("k").to_numpy(), copies.column("h1").to_numpy()))
    sizes = np.where(gone, 0, np.diff(at))
    flat = flat[np.repeat(~gone, np.diff(at))]
    return keys, flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _sketch(docs: pa.Table, copies: pa.Table, n: int, ways: B.Ways) -> pa.Table:
    if not len(docs):
        return B.PIECE.empty_table()
    _, flat, _ = _own_sets(docs, copies, n)
    cells, many = B.counted(flat >> U(64 - ways.bits))
    return ways.send(0, docs.column("block")[0].as_py(), cells, lambda i, j: COUNTS.pack(many[i:j]))


COUNTS = B.Counts((1 << 32) - 1)
FOUND = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("lists", pa.int64()), ("members", pa.binary())])
FOUND_SQL = "k long, n long, tokens array<long>, lists long, members binary"


def subset_hashes(members: np.ndarray, percent: int, light: int) -> Iterator[np.ndarray]:
    """Hashes of the subsets by which this light set links with one of a light size, some at a time; the sizes of both are in them."""
    s = len(members)
    mixed = mix64(members, 9)
    for t in partners(percent, s):
        c = need(percent, s, t)
        if t >= light or c > min(s, t):
            continue
        subsets_ = combinations(range(s), c)
        while len(pick := np.array(list(islice(subsets_, SUBSETS_AT_ONCE)), np.int64)):
            h = mix64(mixed[pick].sum(axis=1, dtype=U), 10) ^ mix64(np.array([min(s, t) << 32 | max(s, t)], U), 11)
            yield h.view(np.int64)


def _listed(docs: pa.Table, more: pa.Table, n: int, percent: int, ways: B.Ways) -> pa.Table:
    """Of each set that meets any other in a list: what it is listed under, how long these lists are together, and its members."""
    if not len(docs):
        return FOUND.empty_table()
    keys, flat, at = _own_sets(docs, more.filter(pc.is_valid(more.column("k"))), n)
    cells = flat >> U(64 - ways.bits)
    v, _ = B.counted(cells)
    total = np.maximum(B.read_answers(more.filter(pc.is_null(more.column("k"))), v, ways, 0, 0, COUNTS).astype(np.int64), 1)
    count = total[np.searchsorted(v, cells)] if len(cells) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(keys)), np.diff(at))
    order = np.lexsort((flat, count, text))  # in each text from the rarest shingle on
    rank = np.arange(len(flat)) - at[text]
    sizes = np.diff(at)
    most = sizes - -(-percent * sizes // 100) + 1
    chosen = order[(rank < most[text]) & (count[order] > 1)]
    many = np.bincount(text[chosen], minlength=len(keys))
    lists = np.bincount(text[chosen], count[chosen], minlength=len(keys)).astype(np.int64)
    some = np.flatnonzero(many)
    short = (flat >> U(64 - 8 * BYTES)).view(np.uint8).reshape(-1, 8)[:, :BYTES]
    cut = np.concatenate([[0], np.cumsum(many)])
    tokens = pa.ListArray.from_arrays(pa.array(np.append(cut[some], cut[-1]).astype(np.int32)), pa.array(flat[chosen].view(np.int64)))
    members = [short[at[i] : at[i + 1]].tobytes() for i in some]
    return pa.table({"k": keys[some], "n": sizes[some], "tokens": tokens, "lists": lists[some], "members": members}, schema=FOUND)


def subsets(found: DataFrame, percent: int, light: int) -> DataFrame:
    """Of the sets below the boundary, the hashes of their subsets."""

    def run(batches):
        for batch in batches:
            raw, at = binary_parts(batch.column(1))
            for i, k in enumerate(batch.column(0).to_pylist()):
                wide = np.zeros(((at[i + 1] - at[i]) // BYTES, 8), np.uint8)
                wide[:, :BYTES] = raw[at[i] : at[i + 1]].reshape(-1, BYTES)
                for own in subset_hashes(wide.view(U).ravel(), percent, light):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int64()), pa.array(own, pa.int64())], names=["k", "token"])

    return found.where(F.col("n") < light).select("k", "members").mapInArrow(run, "k long, token long")


VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _verify(t: pa.Table, percent: int) -> pa.Table:
    """One group: links of its sets by scanning its lists; edges that connect them, and each set's weighted number of links."""
    left, right = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    family = t.column("family").to_numpy()
    keys, n, weight = t.column("k").to_numpy(), t.column("n").to_numpy(), t.column("copies").to_numpy()
    side = t.column("chunk").to_numpy()
    raw, offsets = binary_parts(t.column("members"))
    wide = np.zeros((len(raw) // BYTES, 8), np.uint8)
    wide[:, :BYTES] = raw.reshape(-1, BYTES)
    items = wide.view(U).ravel()
    at = offsets // BYTES
    m = len(keys)
    owner = np.repeat(np.arange(m), np.diff(at))
    names = np.unique(family, return_inverse=True)[1]
    order = np.lexsort((owner, items, names[owner]))
    si, sf, so = items[order], names[owner][order], owner[order]
    new = np.concatenate([[True], (si[1:] != si[:-1]) | (sf[1:] != sf[:-1])]) if len(si) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(si)))
    of = np.empty(len(items), np.int64)
    of[order] = np.cumsum(new) - 1
    parent, links = list(range(m)), np.zeros(m, np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # Families one after the other: a set is counted against its own family's sets and no others.
    by = np.argsort(names, kind="stable")
    place = np.empty(m, np.int64)
    place[by] = np.arange(m)
    edges = np.flatnonzero(np.concatenate([[True], np.diff(names[by]) > 0, [True]])) if m else np.zeros(1, np.int64)
    first = edges[np.searchsorted(edges, place, "right") - 1] if m else place
    sp = place[so]  # owners as places among the sets in order of family
    for x in range(m):
        lists = of[at[x] : at[x + 1]]
        lists = lists[many[lists] > 1]
        if not len(lists):
            continue
        size = many[lists]
        total = int(size.sum())
        where = np.repeat(begin[lists] - (np.cumsum(size) - size), size) + np.arange(total)
        lo = first[x]
        overlap = np.bincount(sp[where] - lo)
        own = by[lo : lo + len(overlap)]
        hit = 100 * overlap >= percent * (n[x] + n[own] - overlap)
        hit[own == x] = False
        if left != right:
            hit &= side[own] != side[x]
        y = own[hit]
        if not len(y):
            continue
        links[x] = weight[y].sum()
        for z in y.tolist():
            parent[root(z)] = root(x)
    label = np.array([root(x) for x in range(m)], np.int64)
    some = np.flatnonzero(links)
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, label, keys)
    star = some[least[label[some]] < keys[some]]  # each linked set and the least key that it reaches here
    return pa.table(
        {
            "a": np.concatenate([keys[star], keys[some]]).astype(np.int64),
            "b": pa.array([*least[label[star]].tolist(), *[None] * len(some)], pa.int64()),
            "links": np.concatenate([np.zeros(len(star), np.int64), links[some]]),
        },
        schema=VERIFIED,
    )


def jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, n_links.

    A document's set has its distinct shingles of ``n`` words, A-Z in lower case; with fewer words,
    all of them as one; null and empty texts have none and link with nothing. Sets link when
    100 * intersection >= percent * union. component_id is the least key reachable by links, itself
    included; n_links counts the other documents it links with, equal sets included. Rows with a null
    key have n_shingles only; keys are integers. Rows that repeat a key are one document. An empty table gives no rows;
    other columns are ignored.
    """
    _, n_bytes = size_of(docs, text)
    rows = B.blocked(docs, n_bytes, text, key)
    signed = stored(signatures(rows, n), "signatures")
    alike = signed.where("n > 0 AND k IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    alike = stored(alike, "alike")
    mapped = join_hot(signed, alike, ["h1", "h2", "n"], "copies", "k").select("block", "k", "h1", "n", F.when(F.col("k").isNotNull(), F.coalesce("rep", "k")).alias("rep"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    mapped = stored(mapped, "mapped")
    copies = mapped.where("rep <> k").select("block", "k", "h1")
    about = signed.agg(F.sum("n").alias("items"), F.max("n").alias("most")).first()
    items, starts = int(about["items"] or 0), size_classes(percent, int(about["most"] or 1))
    ways = B.Ways.of(B.block_count(n_bytes), min(60, B.width_bits(items) + 4), items)

    docs_by, copies_by = rows.groupBy("block"), copies.groupBy("block")
    said = B.exchanged(docs_by.cogroup(copies_by).applyInArrow(lambda a, b: _sketch(a, b, n, ways), B.PIECE_SQL), ways, COUNTS)
    more = said.unionByName(copies, allowMissingColumns=True)
    found = stored(docs_by.cogroup(more.groupBy("block")).applyInArrow(lambda a, b: _listed(a, b, n, percent, ways), FOUND_SQL), "listed")

    few = found.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum("lists").alias("lists"))  # a row a set size
    light = light_boundary({r["n"]: (r["c"], r["lists"]) for r in few.collect()}, percent)
    size_class = sum((F.when(F.col("n") >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0))
    # A set of class c is in the lists of c, for its own class and the one before, and of c + 1, for the next.
    listed = found.where(F.floor(100 * F.col("n") / percent) >= light).select("k", size_class.alias("c"), F.explode("tokens").alias("token"))
    listed = listed.select("k", F.explode(F.array("c", F.col("c") + 1)).alias("c"), "token").select("k", F.xxhash64("token", "c").alias("token"))
    if light > 1:
        listed = listed.unionByName(subsets(found, percent, light))
    # Each list is joined up through its least member: sets that meet are in one family.
    heads = listed.groupBy("token").agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = join_hot(listed, heads, ["token"], "c", "k").where("k <> head")
    families = components(met.select(F.col("k").alias("a"), F.col("head").alias("b")).distinct())
    families = families.select(F.col("node").alias("k"), F.col("component").alias("family"))
    weights = mapped.where("rep = k").select("k", "copies").distinct()
    members = stored(found.select("k", "n", size_class.alias("c"), "members").join(families, "k").join(weights, "k"), "members")
    parts = members.groupBy("family", "c").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("many"))
    whole = parts.groupBy("family").agg(F.sum("items").alias("all"), F.sum("many").alias("many_all"))
    chunks = lambda c: F.coalesce(F.ceil(c / chunk), F.lit(0)).cast("int")
    near = lambda by: parts.select("family", (F.col("c") + by).alias("c"), chunks(F.col("items")).alias("above" if by < 0 else "below"))
    geometry = parts.join(whole, "family").join(near(1), ["family", "c"], "left").join(near(-1), ["family", "c"], "left")
    geometry = geometry.withColumn("g", chunks(F.col("items"))).na.fill(0, ["above", "below"])
    members = join_hot(members, geometry.select("family", "c", "all", "g", "above", "below", "many"), ["family", "c"], "many", "k")
    packs = max(1, math.ceil(int(members.agg(F.sum("n")).first()[0] or 0) / chunk))
    # Small families share groups; a larger one has a group for each two chunks of one class or of two that follow.
    code = lambda c, i: F.shiftleft(c.cast("long"), 32) + i
    cut = F.col("all") > chunk
    own = F.when(cut, F.pmod(F.xxhash64("k", F.lit(7)), F.col("g"))).otherwise(F.lit(0)).cast("int")
    c, g = F.col("c"), lambda name: F.when(F.col(name) > 0, F.sequence(F.lit(0), F.col(name) - 1)).otherwise(F.array().cast("array<int>"))
    mine = code(c, own)
    pairs = F.concat(
        F.transform(g("g"), lambda o: F.struct(F.least(mine, code(c, o)).alias("i"), F.greatest(mine, code(c, o)).alias("j"))),
        F.transform(g("above"), lambda o: F.struct(mine.alias("i"), code(c + 1, o).alias("j"))),
        F.transform(g("below"), lambda o: F.struct(code(c - 1, o).alias("i"), mine.alias("j"))),
    )
    alone = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    dealt = members.select("*", mine.alias("chunk"), cut.alias("cut"), F.explode(F.when(cut, pairs).otherwise(alone)).alias("pair"))
    dealt = dealt.withColumn("at", F.when(F.col("cut"), F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(packs))))
    dealt = dealt.select("at", "cut", "pair.i", "pair.j", "chunk", "family", "k", "n", "copies", "members")
    checked = stored(dealt.groupBy("at", "cut", "i", "j").applyInArrow(lambda t: _verify(t, percent), "a long, b long, links long"), "links")

    labels = components(checked.where("b IS NOT NULL"))
    counts = checked.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    about = counts.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    about = about.join(mapped.groupBy("rep").agg(F.count(F.lit(1)).alias("many")), "rep")
    out = join_hot(mapped, about, ["rep"], "many", "k")
    return out.select(
        F.col("k").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep").alias("component_id"),
        F.when(F.col("k").isNotNull(), F.coalesce("links", F.lit(0)) + F.when(F.col("n") > 0, F.col("copies") - 1).otherwise(0)).cast("long").alias("n_links"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle: for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, len(words) AS many, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, many, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS s FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(many - 3, 1)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sized AS (SELECT sh.doc_id, s, n FROM sh JOIN n ON n.doc_id = sh.doc_id),
meet AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM sized a JOIN sized b ON a.s = b.s WHERE a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2),
link AS (SELECT i, j FROM meet WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT link.j, reach.root FROM reach JOIN link ON link.i = reach.doc_id WHERE reach.root < link.j),
root AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id),
links AS (SELECT i AS doc_id, count(*) AS n_links FROM link GROUP BY i)
SELECT root.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM root LEFT JOIN n ON n.doc_id = root.doc_id LEFT JOIN links ON links.doc_id = root.doc_id
"""
