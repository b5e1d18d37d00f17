"""Vector retrieval: normalisation, blocked top-k search, recall, rerank, negatives, memories and codebooks.

Rankings are by descending score, then ascending id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from rasterloom.functions.storage import checkpointed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalised(v: Column) -> Column:
    """v over its norm, in double; null for a zero norm."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


#: Cells a side of a grid over all pairs, and the vectors a cell has a side from which on there are more.
GRID, CELL_ROWS = 8, 65_536


def cells_of(n: int, block: int = 1) -> int:
    """Cells for a side of n rows: at most ``GRID`` with at least ``block`` rows, more where a cell would have over ``CELL_ROWS`` rows."""
    return max(1, min(GRID, -(-n // block)), -(-n // CELL_ROWS))


def block_pairs(images: DataFrame, texts: DataFrame, block: int, pairs: Callable[[pa.Table, pa.Table], pa.Table], schema: str, cells: bool = False) -> DataFrame:
    """``pairs`` of every block of one side with every block of the other; both (with id) are dealt by a hash into blocks of about ``block`` rows.

    With ``cells`` the blocks are the cells of a coarse grid, and ``pairs`` takes them in parts: a row
    then travels as often as the other side has cells, which does not grow with the table.
    Rows travel as structures, so that sides of one origin have no column in common.
    """
    n_i, n_t = (cells_of(n, block) if cells else max(1, -(-n // block)) for n in (d.count() for d in (images, texts)))

    def spread(d: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        rows = d.select(F.struct(*d.columns).alias(f"row_{own}"), F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def unpacked(t: pa.Table, own: str) -> pa.Table:
        rows = t.column(f"row_{own}").combine_chunks()
        return pa.Table.from_arrays(rows.flatten(), names=[f.name for f in rows.type])

    def each(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return arrow.empty_table()
        return pairs(unpacked(a, "bi"), unpacked(b, "bt")).cast(arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    a, b = spread(images, "bi", n_i, "bt", n_t), spread(texts, "bt", n_t, "bi", n_i)
    return a.groupBy("bi", "bt").cogroup(b.groupBy("bi", "bt")).applyInArrow(each, schema)


def all_scores(queries: DataFrame, rows: DataFrame, block: int = 4096, scale: float = 1.0) -> DataFrame:
    """The scaled dot product of every query with every row: query, found, score. The queries should be few, as all pairs come out."""

    def scores(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = a.column("id").to_numpy(), b.column("id").to_numpy()
        x, y = (np.stack(t.column("vec").to_numpy()).astype(np.float64) for t in (a, b))
        return pa.table({"query": np.repeat(i, len(j)), "found": np.tile(j, len(i)), "score": (x @ y.T * scale).ravel()})

    return block_pairs(queries, rows, block, scores, "query long, found long, score double")


def first_columns(m: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each row the columns of its k greatest scores, best first, ties by id. Only what reaches a row's k-th score is sorted."""
    n, wide = m.shape
    least = np.partition(m, wide - k, axis=1)[:, wide - k] if k < wide else np.full(n, -np.inf)
    r, c = np.nonzero(m >= least[:, None])
    order = np.lexsort((ids[c], -m[r, c], r))
    r, c = r[order], c[order]
    return c[np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r] < k].reshape(n, min(k, wide))


#: Pairs of blocks from which on bounds are worth their own jobs, vectors that blocks are formed around at most, and of how many those are chosen.
PRUNE_FROM, PIVOTS, CHOSEN_FROM = 256, 256, 4096


def far_apart(v: np.ndarray, n: int) -> np.ndarray:
    """n of these vectors: the first, then ever the one farthest from those taken. Equal ones are taken once."""
    taken, gap = [0], ((v - v[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(v)) and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((v - v[taken[-1]]) ** 2).sum(axis=1))
    return v[taken]


def vector_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (id, vec) with ``b``: blocks of about ``block`` vectors that lie near each other.

    At most ``PIVOTS`` vectors are the middles, far apart from each other among the ``CHOSEN_FROM`` with
    the least hash of their id; each vector goes to the nearest, and a middle with too many is cut by a
    hash of the id.
    """
    n = rows.count()
    held = rows.orderBy(F.xxhash64("id"), "id").limit(CHOSEN_FROM).select("vec").toArrow()
    pivots = far_apart(np.stack(held.column("vec").to_numpy()).astype(np.float64), max(1, min(PIVOTS, -(-n // block)))) if held.num_rows else np.zeros((1, 1))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
                at = ((pivots * pivots).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "p"])

    placed = checkpointed(rows.mapInArrow(near, StructType(list(rows.schema.fields)).add("p", "long")))
    parts = placed.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    return placed.join(F.broadcast(parts), "p").withColumn("b", F.col("p") * (1 << 31) + F.pmod(F.xxhash64("id"), F.col("parts"))).select(*rows.columns, "b")


def block_shapes(blocks: DataFrame) -> DataFrame:
    """Of each block its middle and the greatest distance from it: id (the block's), vec, radius."""

    def shape(t: pa.Table) -> pa.Table:
        x = np.stack(t.column("vec").to_numpy()).astype(np.float64)
        c = x.mean(axis=0)
        return pa.table({"id": t.column("b").slice(0, 1), "vec": pa.array([c.tolist()]), "radius": [float(np.sqrt(((x - c) ** 2).sum(axis=1)).max())]})

    return blocks.groupBy("b").applyInArrow(shape, "id long, vec array<double>, radius double")


def pair_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each block of one side and of the other the greatest dot product that their vectors can have: bi, bt, bound."""

    def bounds(x: pa.Table, y: pa.Table) -> pa.Table:
        (i, c, r), (j, d, q) = ((t.column("id").to_numpy(), np.stack(t.column("vec").to_numpy()), t.column("radius").to_numpy()) for t in (x, y))
        size = lambda v: np.sqrt((v * v).sum(axis=1))
        top = c @ d.T + r[:, None] * size(d) + size(c)[:, None] * q + r[:, None] * q
        return pa.table({"bi": np.repeat(i, len(j)), "bt": np.tile(j, len(i)), "bound": (top + 1e-9 * (1 + np.abs(top))).ravel()})

    return block_pairs(a, b, 1024, bounds, "bi long, bt long, bound double")


def summed(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of rows r of x with rows c of y, summed from the first value to the last.

    A matrix product sums in an order that depends on where a row stands, so that copies of a vector
    differ in their last bits and no longer tie.
    """
    parts = (slice(n, n + 16_384) for n in range(0, len(r), 16_384))
    return np.concatenate([np.zeros(0), *(np.add.accumulate(x[r[p]] * y[c[p]], axis=1)[:, -1] for p in parts)])


def slack(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """For each row of x how far a matrix product with rows of y may be from ``summed``, at most."""
    size = lambda v: np.sqrt((v * v).sum(axis=1))
    return (x.shape[1] + 2) * 2.0**-51 * scale * size(x) * size(y).max(initial=0.0)


def may_be_first(m: np.ndarray, off: np.ndarray, k: int, least: np.ndarray | float = -np.inf) -> np.ndarray:
    """Which scores, each off by ``off`` of its row at most, may be among the k greatest of their row and reach ``least``."""
    reach = m >= least - off[:, None]
    many = np.flatnonzero(reach.sum(axis=1) > k)
    if len(many):
        at = m.shape[1] - k
        reach[many] &= m[many] >= np.partition(m[many], at, axis=1)[:, at : at + 1] - 2 * off[many, None]
    return reach


def better_kept(score: np.ndarray, found: np.ndarray, at: slice, m: np.ndarray, ids: np.ndarray, off: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Merges the scores of rows ``at`` with columns ``ids`` into each row's best so far (score, then least id), kept in order in ``score`` and ``found``.

    ``m`` has the scores but for ``off``; ``exact`` gives those of rows and columns that may be kept.
    """
    k = score.shape[1]
    reach = may_be_first(m, off, k, score[at, -1:])
    if not reach.any():
        return
    r, c = np.nonzero(reach)
    u = np.flatnonzero(reach.any(axis=1))
    rows = np.concatenate([np.repeat(u, k), r])
    s, f = np.concatenate([score[at][u].ravel(), exact(r, c)]), np.concatenate([found[at][u].ravel(), ids[c]])
    order = np.lexsort((f, -s, rows))
    rows = rows[order]
    order = order[np.arange(len(rows)) - np.searchsorted(rows, u)[np.searchsorted(u, rows)] < k]
    score[at.start + u], found[at.start + u] = s[order].reshape(-1, k), f[order].reshape(-1, k)


def best_of_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame, k: int, scale: float) -> DataFrame:
    """The k best of each row and column of these pairs of blocks (bi, bt, for_text, for_image: which sides need it).

    Blocks are dealt into the cells of a coarse grid, and a cell's pairs are multiplied one after the
    other: a vector travels once for each cell on the other side, not for each block, and what leaves
    a cell is k rows a query.
    """
    n_a, n_b = (cells_of(d.count()) for d in (a, b))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    flat = [none("long", "other"), none("boolean", "for_text"), none("boolean", "for_image")]
    left = a.select(cell("b", n_a).alias("ca"), every(n_b).alias("cb"), F.lit(0).alias("kind"), "b", "id", "vec", *flat)
    right = b.select(every(n_a).alias("ca"), cell("b", n_b).alias("cb"), F.lit(1).alias("kind"), "b", "id", "vec", *flat)
    met = pairs.select(cell("bi", n_a).alias("ca"), cell("bt", n_b).alias("cb"), F.lit(2).alias("kind"), F.col("bi").alias("b"), none("long", "id"), none("array<double>", "vec"), F.col("bt").alias("other"), "for_text", "for_image")

    def side(t: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, dict[int, slice]]:
        own = t.filter(pc.equal(t.column("kind"), kind)).select(["b", "id", "vec"])
        own = own.take(pc.sort_indices(own, [("b", "ascending"), ("id", "ascending")]))
        at, first = np.unique(own.column("b").to_numpy(), return_index=True)
        ends = [*first[1:].tolist(), len(own)]
        vec = np.stack(own.column("vec").to_numpy()).astype(np.float64) if len(own) else np.zeros((0, 1))
        return own.column("id").to_numpy(), vec, {x: slice(p, q) for x, p, q in zip(at.tolist(), first.tolist(), ends, strict=True)}

    def best(t: pa.Table) -> pa.Table:
        todo = t.filter(pc.equal(t.column("kind"), 2)).select(["b", "other", "for_text", "for_image"]).sort_by([("b", "ascending"), ("other", "ascending")])
        if not len(todo):
            return TOP.empty_table()
        (i, x, rows), (j, y, columns) = side(t, 0), side(t, 1)
        tops = [(np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)) for q in (i, j)]
        off_i, off_j = slack(x, y, scale), slack(y, x, scale)
        for p, q, for_text, for_image in zip(*(c.to_pylist() for c in todo.columns), strict=True):
            p, q = rows[p], columns[q]
            own, other = x[p], y[q]
            s = own @ other.T * scale
            if for_text:
                better_kept(*tops[0], p, s, j[q], off_i[p], lambda r, c: summed(own, other, r, c) * scale)  # noqa: B023
            if for_image:
                better_kept(*tops[1], q, s.T, i[p], off_j[q], lambda r, c: summed(other, own, r, c) * scale)  # noqa: B023
        out = []
        for name, q, (score, found) in zip(("text", "image"), (i, j), tops, strict=True):
            n, c = np.nonzero(score > -np.inf)
            out.append(pa.table({"side": [name] * len(n), "query": q[n], "found": found[n, c], "score": score[n, c]}, schema=TOP))
        return pa.concat_tables(out)

    return left.unionByName(right).unionByName(met).groupBy("ca", "cb").applyInArrow(best, TOP_SQL)


TOP = pa.schema([("side", pa.string()), ("query", pa.int64()), ("found", pa.int64()), ("score", pa.float64())])
TOP_SQL = "side string, query long, found long, score double"


def best_of_both(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int, scale: float, for_text: bool = True, for_image: bool = True) -> pa.Table:
    x, y = x.astype(np.float64), y.astype(np.float64)
    s, out = x @ y.T * scale, [TOP.empty_table()]
    for side, m, v, w, q, f, need in (("text", s, x, y, i, j, for_text), ("image", s.T, y, x, j, i, for_image)):
        if need:
            r, c = np.nonzero(may_be_first(m, slack(v, w, scale), k))
            m = np.full(m.shape, -np.inf)
            m[r, c] = summed(v, w, r, c) * scale
            order = first_columns(m, f, k)
            out.append(pa.table({"side": [side] * order.size, "query": np.repeat(q, order.shape[1]), "found": f[order].ravel(), "score": np.take_along_axis(m, order, 1).ravel()}, schema=TOP))
    return pa.concat_tables(out)


def pruned_pairs(a: DataFrame, b: DataFrame, k: int, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The k best as far as each block's likeliest partner tells, the pairs of blocks looked at for that, and those that may still hold better ones."""
    bounds = checkpointed(pair_bounds(block_shapes(a), block_shapes(b)))
    likely = lambda own, other: bounds.groupBy(own).agg(F.max_by(other, F.struct("bound", -F.col(other))).alias(other)).select("bi", "bt")
    first = likely("bi", "bt").unionByName(likely("bt", "bi")).distinct()
    first = checkpointed(first.withColumns({"for_text": F.lit(True), "for_image": F.lit(True)}))
    got = checkpointed(best_of_pairs(a, b, first, k, scale))
    rank = F.row_number().over(Window.partitionBy("side", "query").orderBy(F.desc("score"), "found"))
    kth = got.withColumn("r", rank).where(F.col("r") == k).select("side", F.col("query").alias("id"), "score")

    def least(side: str, rows: DataFrame, own: str) -> DataFrame:
        """The least k-th score of a block's queries; none where a query hasn't k yet."""
        own_kth = rows.select("id", "b").join(kth.where(F.col("side") == side).select("id", "score"), "id", "left")
        return own_kth.groupBy(F.col("b").alias(own)).agg(F.min(F.coalesce("score", F.lit(float("-inf")))).alias(f"least_{own}"))

    left = bounds.join(first.select("bi", "bt"), ["bi", "bt"], "left_anti").join(least("text", a, "bi"), "bi").join(least("image", b, "bt"), "bt")
    left = left.select("bi", "bt", (F.col("bound") * scale >= F.col("least_bi")).alias("for_text"), (F.col("bound") * scale >= F.col("least_bt")).alias("for_image"))
    return got, first, checkpointed(left.where("for_text OR for_image"))


#: How a vector ranks among what is found: one with a NaN before all others, one that is null after them.
NAN, PLAIN, NONE = 0, 1, 2


def unscored(queries: DataFrame, rows: DataFrame, side: str, k: int) -> DataFrame:
    """What may be among the k best of a query without a product of two plain vectors: side, query, found, score.

    Both have id and kind. A score with a null vector is null, any other with a NaN vector NaN. Ties
    go by id, so the k least ids of each kind are enough, and only they are broadcast.
    """
    of = lambda kind: rows.where(F.col("kind") == kind).orderBy("id").limit(k).select(F.col("id").alias("found"), F.col("kind").alias("other"))
    pairs = queries.select(F.col("id").alias("query"), "kind").crossJoin(F.broadcast(of(NAN).unionByName(of(PLAIN)).unionByName(of(NONE))))
    score = F.when((F.col("kind") != NONE) & (F.col("other") != NONE), F.lit(float("nan")))
    return pairs.where((F.col("kind") != PLAIN) | (F.col("other") != PLAIN)).select(F.lit(side).alias("side"), "query", "found", score.alias("score"))


def top_k_both(images: DataFrame, texts: DataFrame, k: int, block: int = 4096, scale: float = 1.0) -> DataFrame:
    """The k best texts of every image and the k best images of every text: side, query, found, score, rank.

    Both sides (id, vec) are dealt into blocks; a pair of blocks is one task, a matrix product that
    keeps k of each row and column. So what is shuffled after it is k rows a query and block, never all
    pairs; the last ranking merges those. Of many blocks, which then hold vectors near each other, each
    is first multiplied with its likeliest partner; after that only pairs whose middles and radii allow
    a score as great as a query's k-th so far. ``scale`` is positive.

    Scores of copies are equal, so they tie and go by id. A null vector's score is null and ranks
    last, one with a NaN has NaN and ranks first, as in SQL.
    """
    rank = F.row_number().over(Window.partitionBy("side", "query").orderBy(F.desc("score"), "found"))
    kind = F.when(F.col("vec").isNull(), NONE).when(F.exists("vec", F.isnan), NAN).otherwise(PLAIN)
    both = [checkpointed(d.select("id", "vec", kind.alias("kind"))) for d in (images, texts)]
    images, texts = (d.where(F.col("kind") == PLAIN).select("id", "vec") for d in both)
    n, m = (d.count() for d in (images, texts))
    if -(-n // block) * -(-m // block) < PRUNE_FROM:
        column = lambda t, c: np.stack(t.column(c).to_numpy())
        best = lambda a, b: best_of_both(a.column("id").to_numpy(), column(a, "vec"), b.column("id").to_numpy(), column(b, "vec"), k, scale)
        got = block_pairs(images, texts, block, best, TOP_SQL)
    else:
        a, b = (checkpointed(vector_blocks(d, block)) for d in (images, texts))
        first, _, left = pruned_pairs(a, b, k, scale)
        got = first.unionByName(best_of_pairs(a, b, left, k, scale))
    if n + m < sum(d.count() for d in both):
        got = got.unionByName(unscored(*both, "text", k)).unionByName(unscored(*both[::-1], "image", k))
    return got.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(top: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Recall at each k by side: a hit where any of the first k found is relevant to the query. ``relevant`` has side, query, found."""
    hits = top.join(relevant.withColumn("_hit", F.lit(True)), ["side", "query", "found"], "left")
    one = hits.groupBy("side", "query").agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("first"))
    return one.groupBy("side").agg(*[F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias(f"r{k}") for k in ks], F.count(F.lit(1)).alias("queries"))


def mean_recall(recalls: DataFrame, ks: list[int]) -> DataFrame:
    """Mean recall in percent, of each side and of both, rounded to 2."""
    mean = sum((F.col(f"r{k}") for k in ks), F.lit(0.0)) / len(ks) * 100
    sides = recalls.select("side", mean.alias("m"))
    return sides.select("side", F.round("m", 2).alias("r_mean")).unionByName(sides.agg(F.round(F.avg("m"), 2).alias("r_mean")).withColumn("side", F.lit("all")))


def rerank(top: DataFrame, second: DataFrame) -> DataFrame:
    """The candidates with their second score in place of the first, ranked anew; what is not a candidate counts -100 and needs no row."""
    scored = second.withColumn("_there", F.lit(True))
    j = top.select("side", "query", "found").join(scored, ["query", "found"], "left")
    j = j.withColumn("score", F.when(F.col("_there"), F.col("score")).otherwise(-100.0)).drop("_there")
    rank = F.row_number().over(Window.partitionBy("side", "query").orderBy(F.desc("score"), "found"))
    return j.withColumn("rank", rank)


def best_positive_ranks(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """By side: percent of queries whose best positive ranks (from 0) below 1, 5, 10 and so on, and the mean of these."""
    r = recall(ranked, relevant, ks)
    cols = [(F.col(f"r{k}") * 100).alias(f"r{k}") for k in ks]
    return r.select("side", *cols).withColumn("mean", sum((F.col(f"r{k}") for k in ks), F.lit(0.0)) / len(ks))


def soft_targets(rows: DataFrame, batch: str, group: str, key: str) -> DataFrame:
    """Within a batch rows of one group are each other's positives; weights of a row sum to 1."""
    b = rows.select(F.col(batch), F.col(group), F.col(key).alias("other"))
    n = F.count(F.lit(1)).over(Window.partitionBy(batch, key))
    return rows.select(batch, group, key).join(b, [batch, group]).select(batch, key, "other", (F.lit(1.0) / n).alias("target"))


#: Multipliers of the 32-bit mixer and the first words of the two lanes of ``pair_uniform``.
MIX, LANES = (0x7FEB352D, 0x846CA68B), (0x243F6A88, 0x85A308D3)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 32-bit words: each bit of a word touches all of them."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[0])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def pair_uniform(query: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each pair, the same in every run.

    Two lanes of 32 bits take the words of query and found one after the other and mix after each,
    twice after the last; together they give 53 bits.
    """
    words = lambda v: [(v.astype(np.int64).view(np.uint64) >> np.uint64(s)).astype(np.uint32) for s in (32, 0)]
    lanes = []
    for first in LANES:
        lane = np.full((len(query), 1), first, np.uint32)
        for w in words(query):
            lane = _mixed(lane ^ w[:, None])
        for w in words(found):
            lane = _mixed(lane ^ (w[:1] if (w == w[:1]).all() else w)[None, :])  # most ids share their upper word
        lanes.append(_mixed(lane + np.uint32(first)))
    high, low = (np.broadcast_to(x, (len(query), len(found))).astype(np.uint64) for x in lanes)
    return ((high << np.uint64(21) | low >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


DRAWN = pa.schema([("side", pa.string()), ("query", pa.int64()), ("hard", pa.bool_()), ("found", pa.int64()), ("z", pa.float64())])


def negative_draws(images: DataFrame, texts: DataFrame, block: int = 4096) -> DataFrame:
    """For every image and every text one hard negative, from softmax(score) over the other side's rows of another group, and one typical one, from softmax(-score).

    Drawn by the Gumbel maximum: the greatest of score - ln(-ln u), with u a uniform of the pair. Both
    sides (id, vec, group) are dealt into the cells of a coarse grid; each pair of cells is drawn from
    in squares of ``block`` rows and columns and gives the greatest of each row and column, so what is
    shuffled is a row a query and cell. A query without negatives has no row.
    """
    def draw(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.stack(t.column("vec").to_numpy()).astype(np.float64) for t in (a, b))
        i, j = a.column("id").to_numpy(), b.column("id").to_numpy()
        g, h = a.column("group").to_numpy(), b.column("group").to_numpy()
        tops = {(side, hard): (np.full(n, -np.inf), np.zeros(n, np.int64)) for side, n in (("text", len(i)), ("image", len(j))) for hard in (True, False)}
        for p in (slice(n, n + block) for n in range(0, len(i), block)):
            for q in (slice(n, n + block) for n in range(0, len(j), block)):
                other, s = g[p][:, None] != h[q], x[p] @ y[q].T
                for side, m, ok, own, one, f in (("text", s, other, p, i[p], j[q]), ("image", s.T, other.T, q, j[q], i[p])):
                    noise = -np.log(-np.log(pair_uniform(one, f)))
                    for hard, z in ((True, m + noise), (False, noise - m)):
                        z = np.where(ok, z, -np.inf)
                        at = z.argmax(axis=1)
                        most = z[np.arange(len(one)), at]
                        top, found = (v[own] for v in tops[side, hard])
                        more = most > top
                        top[more], found[more] = most[more], f[at[more]]
        out = []
        for (side, hard), (top, found) in tops.items():
            own = np.isfinite(top)
            out.append(pa.table({"side": [side] * int(own.sum()), "query": (i if side == "text" else j)[own], "hard": pa.array([hard] * int(own.sum()), pa.bool_()), "found": found[own], "z": top[own]}).cast(DRAWN))
        return pa.concat_tables(out)

    got = block_pairs(images, texts, block, draw, "side string, query long, hard boolean, found long, z double", cells=True)
    best = lambda hard: F.max_by(F.when(F.col("hard") == hard, F.col("found")), F.when(F.col("hard") == hard, F.col("z")))
    return got.groupBy("side", "query").agg(best(True).alias("negative"), best(False).alias("typical"))


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def sampled(df: DataFrame, key: str, n: int, u: Column) -> DataFrame:
    """n rows without replacement, the same in every run."""
    return df.withColumn("_u", u).orderBy("_u", key).limit(n).drop("_u")


def priority_merge(memory: DataFrame, new: DataFrame, key: str, arrival: str, priority: str, n: int) -> DataFrame:
    """Newest row of each key, then the n of highest priority."""
    both = memory.unionByName(new)
    rest = [c for c in both.columns if c != key]
    one = both.groupBy(key).agg(F.max_by(F.struct(*rest), arrival).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return one.orderBy(F.desc(priority), key).limit(n)


def memory_weights(pairs: DataFrame, query: str, threshold: float, value: Column | None = None) -> DataFrame:
    """Adds to (query, memory, cos) pairs their share: below the threshold -1, then scaled from least to greatest, then to a sum of 1."""
    w = Window.partitionBy(query)
    sim = F.when(F.col("cos") < threshold, F.lit(-1.0)).otherwise(F.col("cos") if value is None else value)
    d = pairs.withColumn("sim", sim).withColumn("_lo", F.min("sim").over(w)).withColumn("_hi", F.max("sim").over(w))
    d = d.withColumn("_d", (F.col("sim") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8))
    return d.withColumn("share", F.col("_d") / (F.sum("_d").over(w) + 1e-8)).drop("_lo", "_hi", "_d")


def cosine_pairs(queries: DataFrame, memory: DataFrame, limit: int) -> DataFrame:
    """(query, memory, cos) of every query with every memory row, with their other columns. The memory has at most ``limit`` rows by contract, which is checked.

    Each batch of queries is one matrix product. A vector without length has no cosine (null).
    """
    held = memory.limit(limit + 1).toArrow()
    if held.num_rows > limit:
        raise ValueError(f"the memory has more than {limit} rows")
    rest = held.drop_columns(["mvec"])
    own = [c for c in queries.columns if c != "vec"]
    schema = StructType([*[queries.schema[c] for c in own], *[memory.schema[c] for c in rest.column_names]]).add("cos", "double")
    arrow = to_arrow_schema(schema)

    def unit(column: pa.Array) -> np.ndarray:
        v = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, n, out=np.full_like(v, np.nan), where=n > 0)

    m = unit(held.column("mvec").combine_chunks()) if held.num_rows else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if m is not None else 0, 1024):
                part = batch.slice(at, 1024)
                cos = (unit(part.column("vec")) @ m.T).ravel()
                i, j = np.repeat(np.arange(part.num_rows), len(m)), np.tile(np.arange(len(m)), part.num_rows)
                columns = [part.column(c).take(pa.array(i)) for c in own] + [rest.column(c).combine_chunks().take(pa.array(j)) for c in rest.column_names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cos, mask=np.isnan(cos))], schema=arrow)

    return queries.select(*own, "vec").mapInArrow(each, schema)


def memory_score(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per query the share-weighted sum of the memory's scores, and the mean similarity above the threshold (null without any)."""
    d = memory_weights(pairs, "query", threshold)
    return d.groupBy("query").agg(F.sum(F.col("share") * F.col("mscore")).alias("score"), F.avg(F.when(F.col("cos") >= threshold, F.col("cos"))).alias("similarity"))


def memory_confidence(scores: DataFrame, threshold: float) -> DataFrame:
    """(mean - threshold) / (1 - threshold) over the queries that have anything similar, 0 if none has."""
    return scores.agg(F.coalesce((F.avg("similarity") - threshold) / (1 - threshold), F.lit(0.0)).alias("confidence"))


def memory_target(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per query the target from labels (at least 0) and its weight; similarity is cos * (1 - (score difference)^2)."""
    close = F.col("cos") * (1 - (F.col("mscore") - F.col("qscore")) ** 2)
    d = memory_weights(pairs, "query", threshold, close)
    mean = F.avg(F.when(F.col("cos") >= threshold, close))
    out = d.groupBy("query").agg(F.greatest(F.sum(F.col("share") * F.col("mlabel")), F.lit(0.0)).alias("target"), mean.alias("_m"))
    return out.select("query", "target", (F.greatest(F.coalesce("_m", F.lit(0.0)) - threshold, F.lit(0.0)) / (1 - threshold)).alias("weight"))


def blended(memory: Column, score: Column, weight: Column, beta0: float, rate: float) -> Column:
    beta = F.lit(beta0) * F.pow(weight, F.exp(F.lit(rate)) + 1)
    return beta * memory + (1 - beta) * score


def nearest_code(vectors: DataFrame, codebook: DataFrame, limit: int) -> DataFrame:
    """The code of least squared distance (first on ties) of every vector. The codebook has at most ``limit`` rows, which is checked."""
    if codebook.limit(limit + 1).count() > limit:
        raise ValueError(f"the codebook has more than {limit} codes")
    book = codebook.select("code", "cvec").orderBy("code").toArrow()  # ``limit`` rows at most
    codes, c = book.column("code").to_numpy(), np.stack(book.column("cvec").to_numpy()).astype(np.float64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes[np.round(d, 9).argmin(axis=1)])], names=["id", "code"])

    kind = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *codebook.schema]}
    return vectors.select("id", "vec").mapInArrow(near, f"id {kind['id']}, code {kind['code']}")


def code_perplexity(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    n = assigned.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    p = codebook.select("code").join(n, "code", "left").join(F.broadcast(total)).withColumn("p", F.coalesce("n", F.lit(0)) / F.col("total"))
    return p.agg(F.exp(-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("perplexity"), F.count_if(F.col("p") > 0).alias("used"))


def codebook_update(vectors: DataFrame, assigned: DataFrame, state: DataFrame, decay: float, eps: float = 1e-5) -> DataFrame:
    """One step of a moving codebook: sizes and sums move towards this batch's; weights are sums over smoothed sizes."""
    long = vectors.join(assigned, "id").select("code", F.posexplode("vec").alias("pos", "v"))
    batch = long.groupBy("code", "pos").agg(F.sum(F.col("v").cast("double")).alias("batch_sum"), F.count(F.lit(1)).alias("batch_size"))
    s = state.select("code", "size", F.posexplode("sum").alias("pos", "s")).join(batch, ["code", "pos"], "left").fillna(0, ["batch_sum", "batch_size"])
    new = s.select("code", "pos", (decay * F.col("size") + (1 - decay) * F.col("batch_size")).alias("size"), (decay * F.col("s") + (1 - decay) * F.col("batch_sum")).alias("sum"))
    whole = new.where("pos = 0").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("codes"))
    smooth = (F.col("size") + eps) / (F.col("n") + F.col("codes") * eps) * F.col("n")
    return new.join(F.broadcast(whole)).select("code", "pos", "size", "sum", (F.col("sum") / smooth).alias("weight"))


def remapped(df: DataFrame, used: DataFrame, code: str, unknown: int) -> DataFrame:
    """Codes as compact numbers of the used codes (code, compact), others as ``unknown``."""
    return df.join(used.select(F.col("code").alias(code), "compact"), code, "left").withColumn("compact", F.coalesce("compact", F.lit(unknown)))
