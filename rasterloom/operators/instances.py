"""From masks to objects: connected components, peaks, offset voting, centres and training targets.

Joins go by shuffle (the merge hint): sides just small enough to be broadcast would be collected to
the driver by every join of every round, which adds up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions.storage import checkpointed, dropped


def label_components(mask: DataFrame, scene: str = "scene_id") -> DataFrame:
    """(scene, y, x) of set pixels with their 8-neighbour component: label 1..n in scan order of the first pixel.

    Pixels become row runs (islands of consecutive x), runs of neighbouring rows that touch become
    edges. In each round every tree of runs hooks onto the least tree beside it and jumps three times
    further, so the rounds grow with the logarithm of a component's extent; each is checkpointed.
    """
    w = Window.partitionBy(scene, "y").orderBy("x")
    px = mask.select(scene, "y", "x").withColumn("_g", F.col("x") - F.row_number().over(w))
    runs = px.groupBy(scene, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).withColumn("run", F.col("y").cast("long") * (1 << 31) + F.col("x0"))
    runs = checkpointed(runs)
    below = runs.select(scene, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("other"))
    near = runs.hint("merge").join(below, [scene, "y"]).where("b0 <= x1 + 1 AND b1 >= x0 - 1").select(scene, "run", "other")
    edges = checkpointed(near.unionByName(near.select(scene, F.col("other").alias("run"), F.col("run").alias("other"))))
    labels, held = runs.select(scene, "run", F.col("run").alias("root")), None
    while True:
        seen = edges.hint("merge").join(labels.select(scene, F.col("run").alias("other"), "root"), [scene, "other"]).groupBy(scene, "run").agg(F.min("root").alias("_m"))
        met = labels.hint("merge").join(seen, [scene, "run"], "left").select(scene, F.col("root").alias("_old"), F.least("root", F.coalesce("_m", "root")).alias("_m"))
        hooks = met.groupBy(scene, "_old").agg(F.min("_m").alias("_h"))  # where each tree goes: the least tree beside it
        first = hooks = checkpointed(hooks)
        for _ in range(3):  # a chain of trees that hook onto each other shortens by eight
            jump = hooks.select(scene, F.col("_old").alias("_h"), F.col("_h").alias("_j"))
            hooks = hooks.hint("merge").join(jump, [scene, "_h"]).select(scene, "_old", F.col("_j").alias("_h"))
        hooks = hooks.select(scene, F.col("_old").alias("root"), F.col("_h").alias("_j"))
        new = checkpointed(labels.hint("merge").join(hooks, [scene, "root"]).select(scene, "run", F.col("root").alias("_old"), F.col("_j").alias("root")))
        dropped(first, *([held] if held is not None else []))
        labels, held = new.drop("_old"), new
        if new.where("root <> _old").isEmpty():
            break
    dropped(edges)
    rank = F.dense_rank().over(Window.partitionBy(scene).orderBy("root"))
    named = runs.hint("merge").join(labels, [scene, "run"]).withColumn("label", rank)
    return named.select(scene, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def peak_candidates(px: DataFrame, score: str, threshold: float, d: int, scene: str = "scene_id") -> DataFrame:
    """Pixels at the threshold or above that reach, but for 1e-7, the greatest of their component in the (2d+1) square around.

    The greatest is taken along rows first, at each place that a component's pixel reaches, then along
    columns by a sliding window, so a pixel counts 2d+1 times and not for each place of its square.

    Such pixels that touch are one plateau and give one candidate, their best pixel, the first of
    equal ones; equal peaks apart from each other stay apart.
    """
    along = px.select(scene, "label", "y", "x", F.col(score).alias("_s"), F.explode(F.sequence(F.lit(-d), F.lit(d))).alias("_dx"))
    own = F.max(F.when(F.col("_dx") == 0, F.col("_s"))).alias("score")
    rows = along.groupBy(scene, "label", "y", (F.col("x") + F.col("_dx")).alias("x")).agg(F.max("_s").alias("_row"), own)
    column = Window.partitionBy(scene, "label", "x").orderBy("y").rangeBetween(-d, d)
    best = rows.withColumn("_top", F.max("_row").over(column)).where((F.col("score") >= threshold) & (F.col("score") >= F.col("_top") - 1e-7))
    best = checkpointed(best.select(scene, "label", "y", "x", "score"))
    plateaus = label_components(best, scene).withColumnRenamed("label", "_plateau")
    first = F.max_by(F.struct("score", "y", "x"), F.struct("score", -F.col("y"), -F.col("x"))).alias("_p")
    one = best.hint("merge").join(plateaus, [scene, "y", "x"]).groupBy(scene, "label", "_plateau").agg(first)
    return one.select(scene, "label", "_p.score", "_p.y", "_p.x")


def separated_peaks(peaks: DataFrame, d: int, scene: str = "scene_id") -> DataFrame:
    """Greedily by (-score, y, x): a peak stays if it is at least d from all that stayed in its component.

    What that leaves is the lexicographically first independent set of peaks too close to each other,
    which needs no sequence: in each round a peak goes if a better one too close to it has stayed, and
    stays if all better ones too close to it have gone. A peak meets those of its own and the eight
    cells of side d around. Each round decides at least the best undecided peak of every component; the
    rounds are as many as the longest run of ever better peaks, each too close to the next.
    """
    order = lambda p="": F.struct(-F.col(f"{p}score"), F.col(f"{p}y"), F.col(f"{p}x"))
    p = checkpointed(peaks.select(scene, "label", "score", "y", "x", F.floor(F.col("y") / d).alias("_cy"), F.floor(F.col("x") / d).alias("_cx")))
    near = F.array(*[F.struct((F.col("_cy") + i).alias("_cy"), (F.col("_cx") + j).alias("_cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = p.select(scene, "label", *[F.col(c).alias(f"o_{c}") for c in ("score", "y", "x")], F.inline(near))
    close = (F.col("y") - F.col("o_y")) ** 2 + (F.col("x") - F.col("o_x")) ** 2 < d * d
    better = checkpointed(p.hint("merge").join(other, [scene, "label", "_cy", "_cx"]).where(close & (order("o_") < order())).select(scene, "label", "y", "x", "o_y", "o_x"))
    state = p.select(scene, "label", "score", "y", "x").hint("merge").join(better.select(scene, "label", "y", "x").distinct().withColumn("_open", F.lit(True)), [scene, "label", "y", "x"], "left")
    state = checkpointed(state.select(scene, "label", "score", "y", "x", F.when(F.col("_open").isNull(), True).alias("stays")))
    while not state.where("stays IS NULL").isEmpty():
        of = state.select(scene, "label", F.col("y").alias("o_y"), F.col("x").alias("o_x"), F.col("stays").alias("_o"))
        met = better.hint("merge").join(state.where("stays IS NULL").select(scene, "label", "y", "x"), [scene, "label", "y", "x"]).hint("merge").join(of, [scene, "label", "o_y", "o_x"])
        told = met.groupBy(scene, "label", "y", "x").agg(F.coalesce(F.max("_o"), F.lit(False)).alias("_any"), F.count_if(F.col("_o").isNull()).alias("_left"))
        new = F.when(F.col("_any"), False).when(F.col("_left") == 0, True)
        before, state = state, checkpointed(state.hint("merge").join(told, [scene, "label", "y", "x"], "left").select(scene, "label", "score", "y", "x", F.coalesce("stays", new).alias("stays")))
        dropped(before)
    dropped(p, better)
    return state.where("stays").drop("stays")


def with_fallback(peaks: DataFrame, px: DataFrame, score: str, scene: str = "scene_id") -> DataFrame:
    """Components without a peak take their pixel of highest score, the first of equal ones."""
    none = px.hint("merge").join(peaks, [scene, "label"], "left_anti")
    top = none.groupBy(scene, "label").agg(F.max_by(F.struct(F.col(score).alias("score"), "y", "x"), F.struct(score, -F.col("y"), -F.col("x"))).alias("_p"))
    return peaks.unionByName(top.select(scene, "label", "_p.score", "_p.y", "_p.x"))


def _gaps(y0: str, y1: str, x0: str, x1: str) -> tuple[Column, Column]:
    """Squares of the least and greatest distance between a tile's box (t_y0 ...) and another box."""
    c = F.col
    near = lambda a0, a1, b0, b1: F.greatest(c(b0) - c(a1), c(a0) - c(b1), F.lit(0.0))
    far = lambda a0, a1, b0, b1: F.greatest(c(b1) - c(a0), c(a1) - c(b0))
    return near("t_y0", "t_y1", y0, y1) ** 2 + near("t_x0", "t_x1", x0, x1) ** 2, far("t_y0", "t_y1", y0, y1) ** 2 + far("t_x0", "t_x1", x0, x1) ** 2


def site_candidates(points: DataFrame, sites: DataFrame, scene: str = "scene_id", fan: int = 4) -> tuple[DataFrame, DataFrame]:
    """``points`` (scene, label, vy, vx) with their tile, and for each tile the sites (scene, label, site, sy, sx) that may be nearest to any of its points.

    Tiles are about as large as the area that a site has. Sites are grouped into cells of one tile, and
    ``fan`` times as wide at each level above. From the top down a tile keeps the cells that may be
    nearer than the farthest place of any other cell it has, so it meets the cells around it and no others.
    """
    by, tile = [scene, "label"], [scene, "label", "_ty", "_tx"]
    of = sites.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs("sy"), F.abs("sx"))).alias("far")).first()
    if not of["n"]:
        return points.withColumns({"_ty": F.lit(0).cast("long"), "_tx": F.lit(0).cast("long")}), sites.withColumns({"_ty": F.lit(0).cast("long"), "_tx": F.lit(0).cast("long")})
    side = 2.0 ** max(0, round(math.log2(max(1.0, points.count() / of["n"])) / 2))
    at = lambda c, wide: F.floor(F.col(c) / wide).cast("long")
    placed = points.withColumns({"_ty": at("vy", side), "_tx": at("vx", side)})
    tiles = placed.groupBy(*tile).agg(F.min("vy").alias("t_y0"), F.max("vy").alias("t_y1"), F.min("vx").alias("t_x0"), F.max("vx").alias("t_x1"))
    cells = [sites.groupBy(*by, at("sy", side).alias("_cy"), at("sx", side).alias("_cx")).agg(F.min("sy").alias("y0"), F.max("sy").alias("y1"), F.min("sx").alias("x0"), F.max("sx").alias("x1"))]
    wide = side
    while wide <= of["far"]:
        wide *= fan
        cells.append(cells[-1].groupBy(*by, at("_cy", fan).alias("_cy"), at("_cx", fan).alias("_cx")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")))
    least = Window.partitionBy(*tile)
    box = ["t_y0", "t_y1", "t_x0", "t_x1"]

    def kept(met: DataFrame, *b: str) -> DataFrame:
        near, far = _gaps(*b)
        return met.withColumns({"_near": near, "_most": F.min(far).over(least)}).where(F.col("_near") <= F.col("_most") + 1e-6).drop("_near", "_most")

    met = kept(tiles.hint("merge").join(cells[-1], by), "y0", "y1", "x0", "x1").select(*tile, *box, "_cy", "_cx")
    for level in reversed(cells[:-1]):
        inner = level.withColumns({"_in_y": F.col("_cy"), "_in_x": F.col("_cx"), "_cy": at("_cy", fan), "_cx": at("_cx", fan)})
        met = kept(met.hint("merge").join(inner, [*by, "_cy", "_cx"]), "y0", "y1", "x0", "x1").select(*tile, *box, F.col("_in_y").alias("_cy"), F.col("_in_x").alias("_cx"))
    own = sites.withColumns({"_cy": at("sy", side), "_cx": at("sx", side)})
    return placed, kept(met.hint("merge").join(own, [*by, "_cy", "_cx"]), "sy", "sy", "sx", "sx").select(*tile, "site", "sy", "sx")


def nearest_sites(points: DataFrame, sites: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Each point's nearest site of its component: scene, label, y, x, site; ties go to the least site. Points whose component has none are left out."""
    placed, near = site_candidates(points, sites, scene)
    d2 = (F.col("vy") - F.col("sy")) ** 2 + (F.col("vx") - F.col("sx")) ** 2
    met = placed.hint("merge").join(near, [scene, "label", "_ty", "_tx"])
    return met.groupBy(scene, "label", "y", "x").agg(F.min_by("site", F.struct(F.round(d2, 9), "site")).alias("site"))


def decode_instances(px: DataFrame, peaks: DataFrame, offset_y: Column, offset_x: Column, height: int, width: int, scene: str = "scene_id") -> DataFrame:
    """Each pixel votes for its place plus its offset, clipped to the grid; the nearest peak of its component wins, ties to the first.

    Ids run from 1 in each scene without gaps, by component and rank of the peak; a peak that no pixel votes for has none.
    """
    rank = F.row_number().over(Window.partitionBy(scene, "label").orderBy(F.desc("score"), "y", "x"))
    sites = checkpointed(peaks.select(scene, "label", rank.alias("site"), F.col("y").cast("double").alias("sy"), F.col("x").cast("double").alias("sx")))
    clip = lambda c, m: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(m - 1))).cast("double")
    votes = px.select(scene, "label", "y", "x", clip(F.col("y") + offset_y, height).alias("vy"), clip(F.col("x") + offset_x, width).alias("vx"))
    won = checkpointed(nearest_sites(votes, sites, scene))
    ids = won.select(scene, "label", "site").distinct().withColumn("instance", F.row_number().over(Window.partitionBy(scene).orderBy("label", "site")))
    return won.hint("merge").join(ids, [scene, "label", "site"]).select(scene, "y", "x", "instance")


def support_problems(instances: DataFrame, mask: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Pixels with an instance outside the mask, mask pixels without one, ids below 1, and gaps in a scene's ids."""
    a = instances.select(scene, "y", "x", "instance").hint("merge").join(mask.select(scene, "y", "x").withColumn("_in", F.lit(True)), [scene, "y", "x"], "full_outer")
    rule = F.when(F.col("_in").isNull(), "outside").when(F.col("instance").isNull(), "unassigned").when(F.col("instance") < 1, "bad_id")
    rows = a.select(scene, rule.alias("problem")).where("problem IS NOT NULL").groupBy(scene, "problem").agg(F.count(F.lit(1)).alias("n"))
    gaps = instances.where("instance >= 1").groupBy(scene).agg((F.max("instance") - F.countDistinct("instance")).cast("long").alias("n")).where("n > 0").select(scene, F.lit("gap").alias("problem"), "n")
    return rows.unionByName(gaps)


def instance_centres(instances: DataFrame, scene: str = "scene_id") -> DataFrame:
    """The pixel of each instance that is closest to its centroid, the first in scan order on ties, and its area."""
    c = instances.groupBy(scene, "instance").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("area"))
    d2 = F.round((F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2, 9)
    j = instances.hint("merge").join(c, [scene, "instance"])
    return j.groupBy(scene, "instance", "area").agg(F.min(F.struct(d2.alias("d"), "y", "x")).alias("_p")).select(scene, "instance", "area", F.col("_p.y").alias("y"), F.col("_p.x").alias("x"))


def centre_targets(centres: DataFrame, sigma: float, height: int, width: int, scene: str = "scene_id") -> DataFrame:
    """Gaussian heat around each centre, up to ceil(3 sigma) away, the greatest of overlapping ones."""
    r = math.ceil(3 * sigma)
    span = F.sequence(F.lit(-r), F.lit(r))
    s = centres.withColumn("_dy", F.explode(span)).withColumn("_dx", F.explode(span))
    s = s.select(scene, (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"), F.exp(-(F.col("_dy") ** 2 + F.col("_dx") ** 2) / F.lit(2 * sigma * sigma)).alias("_h"))
    return s.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).groupBy(scene, "y", "x").agg(F.max("_h").alias("heat"))


def offset_targets(instances: DataFrame, centres: DataFrame, scene: str = "scene_id") -> DataFrame:
    c = centres.select(scene, "instance", F.col("y").alias("cy"), F.col("x").alias("cx"))
    return instances.hint("merge").join(c, [scene, "instance"]).select(scene, "y", "x", (F.col("cy") - F.col("y")).alias("offset_y"), (F.col("cx") - F.col("x")).alias("offset_x"))


def nearest_markers(px: DataFrame, markers: DataFrame, least_area: int, scene: str = "scene_id") -> DataFrame:
    """Component pixels to their nearest marker (ties to the first); markers of too small an area go, and their pixels choose again, once.

    If all of a component's markers are too small, the largest stays.
    """
    sites = checkpointed(markers.select(scene, "label", F.col("marker").alias("site"), F.col("y").cast("double").alias("sy"), F.col("x").cast("double").alias("sx")))
    points = px.select(scene, "label", "y", "x", F.col("y").cast("double").alias("vy"), F.col("x").cast("double").alias("vx"))
    first = checkpointed(nearest_sites(points, sites, scene))
    area = first.groupBy(scene, "label", "site").agg(F.count(F.lit(1)).alias("area"))
    best = F.row_number().over(Window.partitionBy(scene, "label").orderBy(F.desc("area"), "site"))
    keep = checkpointed(area.withColumn("_r", best).where((F.col("area") >= least_area) | (F.col("_r") == 1)).select(scene, "label", "site"))
    # Who is nearest to a marker that stays has chosen already.
    done = first.hint("merge").join(keep, [scene, "label", "site"], "left_semi")
    again = points.hint("merge").join(first.hint("merge").join(keep, [scene, "label", "site"], "left_anti").select(scene, "label", "y", "x"), [scene, "label", "y", "x"])
    rest = nearest_sites(again, sites.hint("merge").join(keep, [scene, "label", "site"], "left_semi"), scene)
    return done.unionByName(rest).withColumnRenamed("site", "marker").select(scene, "label", "y", "x", "marker")


def instance_counts(instances: DataFrame, scene: str = "scene_id") -> DataFrame:
    return instances.rollup(scene).agg(F.countDistinct(F.struct(F.col(scene), F.col("instance"))).alias("instances"))
