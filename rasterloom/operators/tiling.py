"""Tile windows, blended stitching, and raster neighbourhoods over pixel tables.

Pixel tables have a scene column, ``y`` and ``x``. Neighbourhood operators deal rows by scene once;
the row-wise and column-wise windows that follow need no further exchange.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions.storage import before, in_ranges
from rasterloom.operators.captions import numbered


def tile_starts(length: Column, tile: int, stride: int) -> Column:
    """0, stride, ... with the last start moved to the border; one start where the tile isn't shorter."""
    if stride > tile:
        raise ValueError("stride is greater than the tile")
    last = F.greatest(length - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def scene_windows(scenes: DataFrame, tile: int, stride: int, height: str = "height", width: str = "width") -> DataFrame:
    """A row per tile of each scene: ty, tx and the tile's size, which is cut at small scenes."""
    t = scenes.withColumn("ty", F.explode(tile_starts(F.col(height).cast("int"), tile, stride)))
    t = t.withColumn("tx", F.explode(tile_starts(F.col(width).cast("int"), tile, stride)))
    return t.withColumns({"th": F.least(F.lit(tile), F.col(height)).cast("int"), "tw": F.least(F.lit(tile), F.col(width)).cast("int")})


def hann(i: Column, size: int) -> Column:
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * 3.141592653589793) * i / (size - 1)) if size > 1 else F.lit(1.0)


def blend_weight(dy: Column, dx: Column, size: int, floor: float = 0.2) -> Column:
    """floor + (1 - floor) * hann * hann / its maximum, which is that of the middle."""
    top = 0.5 - 0.5 * math.cos(2 * 3.141592653589793 * (size // 2) / (size - 1)) if size > 1 else 1.0
    return F.lit(floor) + F.lit(1 - floor) * hann(dy, size) * hann(dx, size) / F.lit(max(top * top, 1e-6))


def stitch(tiles: DataFrame, size: int, channels: list[str], scene: str = "scene_id") -> DataFrame:
    """Weighted mean of overlapping tiles for each channel, with the sum of weights and the coverage.

    ``tiles`` has ty, tx and, in the tile, dy and dx. The aggregation combines before its exchange,
    so that a pixel is shuffled once for each task that has it, not for each tile.
    """
    t = tiles.withColumns({"y": F.col("ty") + F.col("dy"), "x": F.col("tx") + F.col("dx"), "_w": blend_weight(F.col("dy"), F.col("dx"), size)})
    sums = [F.sum(F.col(c) * F.col("_w")).alias(f"_{c}") for c in channels]
    s = t.groupBy(scene, "y", "x").agg(*sums, F.sum("_w").alias("weight_sum"), F.count(F.lit(1)).alias("coverage"))
    return s.select(scene, "y", "x", *[(F.col(f"_{c}") / F.greatest("weight_sum", F.lit(1e-6))).alias(c) for c in channels], "weight_sum", "coverage")


def tile_audit(tiles: DataFrame, expected: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Tiles that are off the grid, missing or there twice, and tiles with values outside [0, 1], as rows of (scene, ty, tx, rule).

    ``tiles`` has a row per pixel with prob; ``expected`` a row per tile.
    """
    got = tiles.groupBy(scene, "ty", "tx").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("dy", "dx").alias("places"), F.count_if((F.col("prob") < 0) | (F.col("prob") > 1) | F.isnan("prob") | F.col("prob").isNull()).alias("bad")
    )
    want = expected.select(scene, "ty", "tx", (F.col("th") * F.col("tw")).alias("size"))
    both = got.join(want, [scene, "ty", "tx"], "full_outer")
    rules = F.array_compact(
        F.array(
            F.when(F.col("size").isNull(), "off_grid"), F.when(F.col("n").isNull(), "missing"), F.when(F.col("n") > F.col("places"), "repeated"), F.when(F.col("places") < F.col("size"), "incomplete"), F.when(F.col("bad") > 0, "bad_value")
        )
    )
    return both.select(scene, "ty", "tx", F.explode(rules).alias("rule"))


def tile_metadata(pixels: DataFrame, windows: DataFrame, label: Column, scene: str = "scene_id", cell: int = 64) -> DataFrame:
    """Per whole tile: id, box in pixels and share of positive pixels. Pixels meet their tiles by an equi-join on scene and cells of ``cell`` pixels."""
    cells = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size) - 1) / cell)))
    own = windows.select(scene, "ty", "tx", "th", "tw").withColumn("_cy", cells("ty", "th")).withColumn("_cx", cells("tx", "tw"))
    p = pixels.select(scene, "y", "x", label.cast("double").alias("_l"), F.floor(F.col("y") / cell).alias("_cy"), F.floor(F.col("x") / cell).alias("_cx"))
    p = p.join(own, [scene, "_cy", "_cx"]).where("y >= ty AND y < ty + th AND x >= tx AND x < tx + tw")
    t = p.groupBy(scene, "ty", "tx", "th", "tw").agg(F.avg("_l").alias("positive_ratio"), F.count(F.lit(1)).alias("n")).where("n = th * tw")
    name = F.concat(F.col(scene).cast("string"), F.lit("_y"), F.col("ty").cast("string"), F.lit("_x"), F.col("tx").cast("string"))
    return t.select(scene, name.alias("patch_id"), "ty", "tx", "positive_ratio")


def hardness(ratio: Column, score: Column, positive: float = 0.0, least: float = 0.05) -> Column:
    return F.when(ratio > positive, F.greatest(F.lit(1e-4), ratio + 0.01)).otherwise(F.greatest(F.lit(least), score + 0.02))


def by_scene(df: DataFrame, scene: str) -> DataFrame:
    return df.repartition(scene)


def row(scene: str):
    return Window.partitionBy(scene, "y").orderBy("x")


def column(scene: str):
    return Window.partitionBy(scene, "x").orderBy("y")


def central_gradient(df: DataFrame, value: str, out: str, scene: str = "scene_id") -> DataFrame:
    """sqrt(gx^2 + gy^2 + 1e-6) of differences of the neighbours on both sides, 0 where one is missing."""
    r, c = row(scene), column(scene)
    gx = F.coalesce(F.lead(value).over(r) - F.lag(value).over(r), F.lit(0.0))
    gy = F.coalesce(F.lead(value).over(c) - F.lag(value).over(c), F.lit(0.0))
    return df.withColumn("_gx", gx).withColumn("_gy", gy).withColumn(out, F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2 + F.lit(1e-6))).drop("_gx", "_gy")


def sobel(df: DataFrame, value: str, out: str, scene: str = "scene_id", border: str = "repeat") -> DataFrame:
    """3 by 3 Sobel magnitude, sqrt(gx^2 + gy^2 + 1e-6); beyond the border the edge pixel is repeated, or zero.

    The kernel is separable: smoothing along one axis, then the difference along the other.
    """
    edge = (lambda f, v: F.coalesce(f, v)) if border == "repeat" else (lambda f, v: F.coalesce(f, F.lit(0.0)))
    r, c, v = row(scene), column(scene), F.col(value)
    d = df.withColumn("_left", edge(F.lag(value).over(r), v)).withColumn("_right", edge(F.lead(value).over(r), v))
    d = d.withColumn("_dx", F.col("_right") - F.col("_left")).withColumn("_sx", F.col("_left") + 2 * v + F.col("_right"))
    up_down = lambda n: (edge(F.lag(n).over(c), F.col(n)), edge(F.lead(n).over(c), F.col(n)))
    (ux, dx), (us, ds) = up_down("_dx"), up_down("_sx")
    d = d.withColumn("_gx", ux + 2 * F.col("_dx") + dx).withColumn("_gy", ds - us)
    return d.withColumn(out, F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2 + F.lit(1e-6))).drop("_left", "_right", "_dx", "_sx", "_gx", "_gy")


def quantile_normalised(df: DataFrame, values: list[str], scene: str = "scene_id", low: float = 0.02, high: float = 0.98, eps: float = 1e-6) -> DataFrame:
    """Each value clipped to [0, 1] between its scene's quantiles; between its least and greatest where these meet; else 0."""
    w = Window.partitionBy(scene)
    out = df
    for v in values:
        q = lambda p: F.expr(f"percentile(`{v}`, {p}D)").over(w)  # noqa: B023, E731
        out = out.withColumns({"_lo": q(low), "_hi": q(high), "_mn": F.min(v).over(w), "_mx": F.max(v).over(w)})
        clip = lambda a, b: F.least(F.greatest((F.col(v) - a) / (b - a + F.lit(eps)), F.lit(0.0)), F.lit(1.0))  # noqa: B023, E731
        lo, hi, mn, mx = (F.col(c) for c in ("_lo", "_hi", "_mn", "_mx"))
        out = out.withColumn(v, F.when(hi - lo >= eps, clip(lo, hi)).when(mx - mn >= eps, clip(mn, mx)).otherwise(F.lit(0.0))).drop("_lo", "_hi", "_mn", "_mx")
    return out


def negative_hardness(pairs: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Score of each scene of before (t1) and after (t2) values: change, edge change, texture and deviation, each normalised, weighted and averaged."""
    d = central_gradient(central_gradient(by_scene(pairs, scene), "t1", "e1", scene), "t2", "e2", scene)
    mean2 = F.avg("t2").over(Window.partitionBy(scene))
    d = d.withColumns({"change": F.abs(F.col("t2") - F.col("t1")), "edge": F.abs(F.col("e2") - F.col("e1")), "texture": F.greatest("e1", "e2"), "deviation": F.sqrt(F.greatest((F.col("t2") - mean2) ** 2, F.lit(1e-8)))})
    d = quantile_normalised(d, ["change", "edge", "texture", "deviation"], scene)
    one = F.lit(0.44) * F.col("change") + F.lit(0.28) * F.col("edge") + F.lit(0.18) * F.col("texture") + F.lit(0.10) * F.col("deviation")
    return d.groupBy(scene).agg(F.least(F.greatest(F.avg(one), F.lit(0.0)), F.lit(1.0)).alias("score"))


def change_map(pairs: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Per pixel: normalised 0.68 times normalised change and 0.32 times normalised Sobel change."""
    d = sobel(sobel(by_scene(pairs, scene), "t1", "e1", scene), "t2", "e2", scene)
    d = d.withColumns({"change": F.abs(F.col("t2") - F.col("t1")), "edge": F.abs(F.col("e2") - F.col("e1"))})
    d = quantile_normalised(d, ["change", "edge"], scene)
    d = d.withColumn("delta", F.lit(0.68) * F.col("change") + F.lit(0.32) * F.col("edge"))
    return quantile_normalised(d, ["delta"], scene).select(scene, "y", "x", "delta")


def negative_weights(df: DataFrame, weight: str, gamma: float, least: float) -> DataFrame:
    """(w / max)^gamma, at least ``least``, as shares of their sum."""
    top = df.agg(F.greatest(F.max(weight), F.lit(1e-6)).alias("_top"))
    d = df.join(F.broadcast(top)).withColumn("_w", F.greatest(F.pow(F.col(weight) / F.col("_top"), F.lit(gamma)), F.lit(least)))
    total = d.agg(F.greatest(F.sum("_w"), F.lit(1e-12)).alias("_sum"))
    return d.join(F.broadcast(total)).withColumn("share", F.col("_w") / F.col("_sum")).drop("_top", "_w", "_sum")


def extreme_negatives(df: DataFrame, score: str, share: str, quantile: float, least: float) -> DataFrame:
    """Rows whose score is above 0 and at the quantile or more, with shares renormalised among them.

    The quantile is exact, between the two values beside its place in the order of all, which ranges number.
    """
    d = numbered(df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_v")), ["_v"], "_n")
    place = d.agg(((F.count(F.lit(1)) - 1) * F.lit(quantile)).alias("_at"))
    beside = d.join(F.broadcast(place)).where(F.col("_n").between(F.floor("_at"), F.ceil("_at")))
    q = beside.agg((F.min("_v") + (F.max("_v") - F.min("_v")) * (F.max("_at") - F.floor(F.max("_at")))).alias("_q"))
    own = df.join(F.broadcast(q)).where((F.col(score) >= F.col("_q")) & (F.col(score) > 0)).withColumn("_w", F.greatest(F.col(share), F.lit(least)))
    total = own.agg(F.greatest(F.sum("_w"), F.lit(1e-12)).alias("_sum"))
    return own.join(F.broadcast(total)).withColumn("extreme_share", F.col("_w") / F.col("_sum")).drop("_q", "_w", "_sum")


def uniform(*keys: Column | int) -> Column:
    """A number in [0, 1) by a seeded hash of the keys, the same in every run."""
    h = F.md5(F.concat_ws("|", *[F.lit(k) if isinstance(k, int) else k.cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def weighted_draws(draws: DataFrame, items: DataFrame, key: str, share: str, u: str, buckets: int = 1024) -> DataFrame:
    """For each draw (a number in [0, 1) in ``u``) the item whose cumulative share interval holds it.

    Both sides are cut into ``buckets`` of the unit interval, which makes the range join an equi-join.
    Running sums over all items come from sums per range of keys, so no task has all of them.
    """
    d = in_ranges(items.select(key, F.col(share).alias("_s")), [key])
    start = before(d, F.sum("_s"), "_b")
    own = Window.partitionBy("_p").orderBy(key)
    d = d.join(F.broadcast(start), "_p").withColumn("_hi", F.col("_b") + F.sum("_s").over(own)).withColumn("_lo", F.col("_hi") - F.col("_s"))
    cell = lambda c: F.least(F.floor(c * buckets), F.lit(buckets - 1)).cast("int")
    spread = d.withColumn("_c", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    at = draws.withColumn("_c", cell(F.col(u)))
    return at.join(spread, "_c").where((F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_hi"))).drop("_c", "_p", "_b", "_hi", "_lo", "_s")


def dilate(df: DataFrame, mask: Column, d: int, scene: str = "scene_id") -> DataFrame:
    """Whether any pixel of the (2d+1) square around is set: the maximum along rows, then along columns."""
    wx = Window.partitionBy(scene, "y").orderBy("x").rangeBetween(-d, d)
    wy = Window.partitionBy(scene, "x").orderBy("y").rangeBetween(-d, d)
    m = by_scene(df, scene).withColumn("_m", F.max(mask.cast("int")).over(wx))
    return m.withColumn("dilated", F.max("_m").over(wy) > 0).drop("_m")


def scaled_by_max(df: DataFrame, value: str, scene: str = "scene_id") -> DataFrame:
    top = F.greatest(F.max(value).over(Window.partitionBy(scene)), F.lit(1e-6))
    return df.withColumn(value, F.col(value) / top)


def edge_layer(df: DataFrame, mask: str, scene: str = "scene_id", above: float = 0.10) -> DataFrame:
    d = scaled_by_max(sobel(by_scene(df, scene), mask, "_g", scene, border="zero"), "_g", scene)
    return d.withColumn("edge", F.col("_g") > above).drop("_g")


def pair_signals(pairs: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Change, edge change and after-edge of each pixel, each divided by its scene's greatest."""
    d = sobel(sobel(by_scene(pairs, scene), "t1", "e1", scene, "zero"), "t2", "e2", scene, "zero")
    d = d.withColumns({"change": F.abs(F.col("t2") - F.col("t1")), "edge": F.abs(F.col("e2") - F.col("e1"))})
    return reduce(lambda x, v: scaled_by_max(x, v, scene), ["change", "edge", "e2"], d)


def colour_only(pairs: DataFrame, scene: str = "scene_id") -> DataFrame:
    return pair_signals(pairs, scene).withColumn("colour_only", (F.col("change") > 0.35) & (F.col("edge") < 0.15))


def background_weight(pairs: DataFrame, scene: str = "scene_id", low_change: float = 0.20, low_structure: float = 0.22) -> DataFrame:
    ramp = lambda t, v: F.least(F.greatest((F.lit(t) - v) / F.lit(t), F.lit(0.0)), F.lit(1.0))
    return pair_signals(pairs, scene).withColumn("weight", ramp(low_change, F.col("change")) * ramp(low_structure, F.greatest("e2", "edge")))


def top_k_mean(df: DataFrame, value: Column, k: int, scene: str = "scene_id", where: Column | None = None) -> DataFrame:
    """Mean of the k greatest values of each scene."""
    d = df.select(scene, "y", "x", value.alias("_v")) if where is None else df.where(where).select(scene, "y", "x", value.alias("_v"))
    rank = F.row_number().over(Window.partitionBy(scene).orderBy(F.desc("_v"), "y", "x"))
    return d.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(scene).agg(F.avg("_v").alias("top_mean"))
