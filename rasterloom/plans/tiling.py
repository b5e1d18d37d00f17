"""Queries of the tiling and raster-neighbourhood family and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import tiling as tl
from rasterloom.plans import fixtures as fx
from rasterloom.plans.evaluation import rounded


def scenes64(spark, d):
    return fx.px64(spark, d).groupBy("scene_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def g1(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1200 + 1).cast("int").alias("length"))
    return o.select("o_orderkey", "length", F.explode(tl.tile_starts(F.col("length"), 256, 128)).alias("start"))


def g2(spark, d):
    return tl.scene_windows(scenes64(spark, d), 16, 8).select("scene_id", "ty", "tx", "th", "tw")


def g3(spark, d):
    t = fx.tiles16(spark, d).select("dy", "dx").distinct()
    return t.select("dy", "dx", F.round(tl.blend_weight(F.col("dy"), F.col("dx"), 16), 6).alias("weight"))


def g4(spark, d):
    return rounded(tl.stitch(fx.tiles16(spark, d), 16, ["prob"]), "prob", "weight_sum")


def g5(spark, d):
    t = fx.tiles16(spark, d).withColumns({"center": F.lit(1.0) - F.col("prob"), "offset_y": F.col("prob") * 2 - 1, "offset_x": F.col("prob") * F.col("prob")})
    return rounded(tl.stitch(t, 16, ["prob", "center", "offset_y", "offset_x"]), "prob", "center", "offset_y", "offset_x", "weight_sum")


def g6(spark, d):
    t = fx.tiles16(spark, d)
    broken = t.where("NOT (ty = 8 AND tx = 16) AND NOT (ty = 0 AND tx = 0 AND dy = 3)").unionByName(t.where("ty = 24 AND tx = 24 AND dy = 0"))
    broken = broken.withColumn("tx", F.when((F.col("ty") == 48) & (F.col("tx") == 48), 47).otherwise(F.col("tx"))).withColumn("prob", F.when((F.col("ty") == 40) & (F.col("dy") == 1), F.lit(1.5)).otherwise(F.col("prob")))
    return tl.tile_audit(broken, tl.scene_windows(scenes64(spark, d), 16, 8))


def tiles(spark, d):
    return tl.tile_metadata(fx.px64(spark, d), tl.scene_windows(scenes64(spark, d), 16, 8), F.col("v") > 0.15, cell=16)


def g7(spark, d):
    return rounded(tiles(spark, d), "positive_ratio")


def g8(spark, d):
    t = tiles(spark, d).withColumn("score", (F.col("ty") + F.col("tx")) / F.lit(100.0))
    return t.select("patch_id", F.round(tl.hardness(F.col("positive_ratio"), F.col("score"), 0.1, 0.05), 6).alias("hardness"))


def g9(spark, d):
    p = tl.by_scene(fx.pairs8(spark, d), "scene_id")
    return rounded(tl.central_gradient(p, "t1", "g").select("scene_id", "y", "x", "g"), "g")


def g10(spark, d):
    p = tl.by_scene(fx.pairs8(spark, d), "scene_id")
    return rounded(tl.sobel(p, "t1", "g").select("scene_id", "y", "x", "g"), "g")


def g11(spark, d):
    return rounded(tl.quantile_normalised(fx.pairs8(spark, d), ["t1"]).select("scene_id", "y", "x", "t1"), "t1")


def g12(spark, d):
    return rounded(tl.negative_hardness(fx.pairs8(spark, d)), "score")


def g13(spark, d):
    return rounded(tl.change_map(fx.pairs8(spark, d)), "delta")


def weights(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", (F.col("p_size") / F.lit(50.0)).alias("score"))


def g14(spark, d):
    return tl.negative_weights(weights(spark, d), "score", 1.5, 0.05).select("p_partkey", F.round("share", 9).alias("share"))


def g15(spark, d):
    n = tl.negative_weights(weights(spark, d), "score", 1.5, 0.05)
    return tl.extreme_negatives(n, "score", "share", 0.9, 0.05).select("p_partkey", F.round("extreme_share", 9).alias("extreme_share"))


def g16(spark, d):
    """Draws, one an order: class by the first number, item by the second; shares are whole numbers over their sum, so borders are exact."""
    w = fx.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    total = w.agg(F.sum("w").alias("t"))
    items = w.join(F.broadcast(total)).select("p_partkey", (F.col("w") / F.col("t")).alias("share"))
    draws = fx.table(spark, d, "orders").select("o_orderkey", tl.uniform(F.col("o_orderkey"), 1).alias("r"), tl.uniform(F.col("o_orderkey"), 2).alias("u"))
    kind = F.when(F.col("r") < 0.5, "positive").when(F.col("r") < 0.8, "hard").otherwise("uniform")
    drawn = tl.weighted_draws(draws.withColumn("kind", kind), items, "p_partkey", "share", "u")
    return drawn.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


def g17(spark, d):
    return tl.dilate(fx.px64(spark, d), F.col("v") > 0.15, 2).groupBy("scene_id").agg(F.count_if("dilated").alias("n"), F.sum(F.when(F.col("dilated"), F.col("y") * 64 + F.col("x"))).alias("places"))


def g18(spark, d):
    m = fx.px64(spark, d).withColumn("m", (F.col("v") > 0.15).cast("double"))
    return tl.edge_layer(m, "m").groupBy("scene_id").agg(F.count_if("edge").alias("n"), F.sum(F.when(F.col("edge"), F.col("y") * 64 + F.col("x"))).alias("places"))


def g19(spark, d):
    return tl.colour_only(fx.pairs8(spark, d)).groupBy("scene_id").agg(F.count_if("colour_only").alias("n"))


def g20(spark, d):
    return rounded(tl.background_weight(fx.pairs8(spark, d)).select("scene_id", "y", "x", "weight"), "weight")


def g21(spark, d):
    return rounded(tl.top_k_mean(fx.px8(spark, d), F.col("prob").cast("double"), 10), "top_mean")


def g21_masked(spark, d):
    w = tl.background_weight(fx.pairs8(spark, d))
    return rounded(tl.top_k_mean(w, F.col("t2") * F.col("weight"), 5, where=F.col("weight") > 0), "top_mean")


QUERIES = {
    "g1_tile_starts": g1, "g2_scene_windows": g2, "g3_blend_weights": g3, "g4_stitching": g4, "g5_multi_channel_stitching": g5, "g6_tile_audit": g6, "g7_tile_metadata": g7, "g8_tile_hardness": g8,
    "g9_central_gradient": g9, "g10_sobel": g10, "g11_quantile_normalisation": g11, "g12_negative_hardness": g12, "g13_change_map": g13, "g14_negative_weights": g14, "g15_extreme_negatives": g15,
    "g16_mixture_sampling": g16, "g17_dilation": g17, "g18_edge_layer": g18, "g19_colour_only": g19, "g20_background_weight": g20, "g21_top_k_mean": g21, "g21_masked_top_k_mean": g21_masked,
}

_H = "(CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * {0} / 15))"
_TOP = "pow(CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * 8 / 15), 2)"
WEIGHT = f"(CAST(0.2 AS DOUBLE) + CAST(0.8 AS DOUBLE) * {_H.format('dy')} * {_H.format('dx')} / {_TOP})"
STARTS = "list_sort(list_distinct(list_append(range(0, greatest({0} - {1}, 0) + 1, {2}), greatest({0} - {1}, 0))))"
WIN = "w AS (SELECT DISTINCT scene_id, ty, tx FROM px64, (SELECT unnest([0,8,16,24,32,40,48]) AS ty), (SELECT unnest([0,8,16,24,32,40,48]) AS tx))"
TILES = f"{WIN}, t AS (SELECT w.scene_id, ty, tx, avg(CASE WHEN v > CAST(0.15 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS r FROM w JOIN px64 p ON p.scene_id = w.scene_id AND y >= ty AND y < ty + 16 AND x >= tx AND x < tx + 16 GROUP BY ALL)"
NAME = "scene_id || '_y' || ty || '_x' || tx AS patch_id"


def grad(v: str, out: str, src: str) -> str:
    r, c = "(PARTITION BY scene_id, y ORDER BY x)", "(PARTITION BY scene_id, x ORDER BY y)"
    return f"SELECT *, sqrt(pow(coalesce(lead({v}) OVER {r} - lag({v}) OVER {r}, 0), 2) + pow(coalesce(lead({v}) OVER {c} - lag({v}) OVER {c}, 0), 2) + 1e-6) AS {out} FROM ({src})"


def sobel_sql(v: str, out: str, src: str, border: str = "repeat") -> str:
    """All nine neighbours by two rounds of windows, then the two kernels written out."""
    r, c = "(PARTITION BY scene_id, y ORDER BY x)", "(PARTITION BY scene_id, x ORDER BY y)"
    e = (lambda f, v: f"coalesce({f}, {v})") if border == "repeat" else (lambda f, v: f"coalesce({f}, 0)")
    a = f"SELECT *, {e(f'lag({v}) OVER {r}', v)} AS l0, {v} AS m0, {e(f'lead({v}) OVER {r}', v)} AS r0 FROM ({src})"
    b = ", ".join(f"{e(f'lag({n}0) OVER {c}', n + '0')} AS {n}u, {e(f'lead({n}0) OVER {c}', n + '0')} AS {n}d" for n in "lmr")
    g = "sqrt(pow((ru + 2 * r0 + rd) - (lu + 2 * l0 + ld), 2) + pow((ld + 2 * md + rd) - (lu + 2 * mu + ru), 2) + 1e-6)"
    return f"SELECT * EXCLUDE (l0, m0, r0, lu, ld, mu, md, ru, rd), {g} AS {out} FROM (SELECT *, {b} FROM ({a}))"


def norm_sql(v: str, src: str) -> str:
    q = f"SELECT scene_id AS qs, quantile_cont({v}, 0.02) AS lo, quantile_cont({v}, 0.98) AS hi, min({v}) AS mn, max({v}) AS mx FROM ({src}) GROUP BY 1"
    clip = lambda a, b: f"least(greatest(({v} - {a}) / ({b} - {a} + 1e-6), 0), 1)"
    return f"SELECT * EXCLUDE (qs, lo, hi, mn, mx) REPLACE (CASE WHEN hi - lo >= 1e-6 THEN {clip('lo', 'hi')} WHEN mx - mn >= 1e-6 THEN {clip('mn', 'mx')} ELSE 0 END AS {v}) FROM ({src}) JOIN ({q}) ON qs = scene_id"


_E = grad("t2", "e2", grad("t1", "e1", "SELECT * FROM pairs8"))
_HARD = f"SELECT scene_id, abs(t2 - t1) AS change, abs(e2 - e1) AS edge, greatest(e1, e2) AS texture, sqrt(greatest(pow(t2 - avg(t2) OVER (PARTITION BY scene_id), 2), 1e-8)) AS deviation FROM ({_E})"
for _v in ("change", "edge", "texture", "deviation"):
    _HARD = norm_sql(_v, _HARD)
_S = sobel_sql("t2", "e2", sobel_sql("t1", "e1", "SELECT * FROM pairs8"))
_CM = norm_sql("edge", norm_sql("change", f"SELECT scene_id, y, x, abs(t2 - t1) AS change, abs(e2 - e1) AS edge FROM ({_S})"))
_CM = norm_sql("delta", f"SELECT scene_id, y, x, CAST(0.68 AS DOUBLE) * change + CAST(0.32 AS DOUBLE) * edge AS delta FROM ({_CM})")
_Z = sobel_sql("t2", "e2", sobel_sql("t1", "e1", "SELECT * FROM pairs8", "zero"), "zero")
_SIG = "SELECT scene_id, y, x, t2, change / greatest(max(change) OVER s, 1e-6) AS change, edge / greatest(max(edge) OVER s, 1e-6) AS edge, e2 / greatest(max(e2) OVER s, 1e-6) AS e2 FROM"
_SIG += f" (SELECT *, abs(t2 - t1) AS change, abs(e2 - e1) AS edge FROM ({_Z})) WINDOW s AS (PARTITION BY scene_id)"
_BG = f"SELECT *, least(greatest((0.2 - change) / CAST(0.2 AS DOUBLE), 0), 1) * least(greatest((0.22 - greatest(e2, edge)) / CAST(0.22 AS DOUBLE), 0), 1) AS weight FROM ({_SIG})"
_U = "CAST(('0x' || substr(md5(o_orderkey || '|{0}'), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE)"
_NEG = "n AS (SELECT p_partkey, p_size / CAST(50 AS DOUBLE) AS score FROM part), m AS (SELECT *, greatest(pow(score / greatest((SELECT max(score) FROM n), 1e-6), 1.5), 0.05) AS w FROM n), k AS (SELECT *, w / (SELECT sum(w) FROM m) AS share FROM m)"
ORACLES = {
    "g1_tile_starts": f"SELECT o_orderkey, length, CAST(unnest({STARTS.format('length', 256, 128)}) AS INT) AS start FROM (SELECT o_orderkey, CAST(o_orderkey % 1200 + 1 AS INT) AS length FROM orders)",
    "g2_scene_windows": fx.sql(f"WITH {WIN} SELECT *, 16 AS th, 16 AS tw FROM w", "px64"),
    "g3_blend_weights": f"SELECT dy, dx, round({WEIGHT}, 6) AS weight FROM (SELECT CAST(range AS INT) AS dy FROM range(16)), (SELECT CAST(range AS INT) AS dx FROM range(16))",
    "g4_stitching": fx.sql(f"SELECT scene_id, ty + dy AS y, tx + dx AS x, round(sum(prob * {WEIGHT}) / greatest(sum({WEIGHT}), 1e-6), 6) AS prob, round(sum({WEIGHT}), 6) AS weight_sum, count(*) AS coverage FROM tiles16 GROUP BY 1, 2, 3", "tiles16"),
    "g5_multi_channel_stitching": fx.sql(
        "SELECT scene_id, ty + dy AS y, tx + dx AS x, " + ", ".join(f"round(sum(({e}) * {WEIGHT}) / greatest(sum({WEIGHT}), 1e-6), 6) AS {n}" for e, n in (("prob", "prob"), ("1 - prob", "center"), ("prob * 2 - 1", "offset_y"), ("prob * prob", "offset_x")))
        + f", round(sum({WEIGHT}), 6) AS weight_sum, count(*) AS coverage FROM tiles16 GROUP BY 1, 2, 3",
        "tiles16",
    ),
    "g6_tile_audit": fx.sql(
        """WITH s AS (SELECT DISTINCT scene_id FROM px64) SELECT scene_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, rule FROM s,
        (VALUES (8, 16, 'missing'), (0, 0, 'incomplete'), (24, 24, 'repeated'), (48, 48, 'missing'), (48, 47, 'off_grid'), (40, 0, 'bad_value'), (40, 8, 'bad_value'), (40, 16, 'bad_value'), (40, 24, 'bad_value'), (40, 32, 'bad_value'), (40, 40, 'bad_value'), (40, 48, 'bad_value')) r(ty, tx, rule)""",
        "px64",
    ),
    "g7_tile_metadata": fx.sql(f"WITH {TILES} SELECT scene_id, {NAME}, ty, tx, round(CAST(r AS DOUBLE), 6) AS positive_ratio FROM t", "px64"),
    "g8_tile_hardness": fx.sql(f"WITH {TILES} SELECT {NAME}, round(CASE WHEN CAST(r AS DOUBLE) > CAST(0.1 AS DOUBLE) THEN greatest(1e-4, r + 0.01) ELSE greatest(CAST(0.05 AS DOUBLE), (ty + tx) / CAST(100 AS DOUBLE) + 0.02) END, 6) AS hardness FROM t", "px64"),
    "g9_central_gradient": fx.sql(f"SELECT scene_id, y, x, round(g, 6) AS g FROM ({grad('t1', 'g', 'SELECT * FROM pairs8')})", "pairs8"),
    "g10_sobel": fx.sql(f"SELECT scene_id, y, x, round(g, 6) AS g FROM ({sobel_sql('t1', 'g', 'SELECT * FROM pairs8')})", "pairs8"),
    "g11_quantile_normalisation": fx.sql(f"SELECT scene_id, y, x, round(t1, 6) AS t1 FROM ({norm_sql('t1', 'SELECT * FROM pairs8')})", "pairs8"),
    "g12_negative_hardness": fx.sql(f"SELECT scene_id, round(least(greatest(avg(CAST(0.44 AS DOUBLE) * change + CAST(0.28 AS DOUBLE) * edge + CAST(0.18 AS DOUBLE) * texture + CAST(0.1 AS DOUBLE) * deviation), 0), 1), 6) AS score FROM ({_HARD}) GROUP BY 1", "pairs8"),
    "g13_change_map": fx.sql(f"SELECT scene_id, y, x, round(delta, 6) AS delta FROM ({_CM})", "pairs8"),
    "g14_negative_weights": f"WITH {_NEG} SELECT p_partkey, round(share, 9) AS share FROM k",
    "g15_extreme_negatives": f"WITH {_NEG}, e AS (SELECT p_partkey, greatest(share, 0.05) AS w FROM k WHERE score >= (SELECT quantile_cont(score, 0.9) FROM k) AND score > 0) SELECT p_partkey, round(w / (SELECT sum(w) FROM e), 9) AS extreme_share FROM e",
    "g16_mixture_sampling": f"""WITH i AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) / CAST(sum(p_size) OVER () AS DOUBLE) AS hi, (sum(p_size) OVER (ORDER BY p_partkey) - p_size) / CAST(sum(p_size) OVER () AS DOUBLE) AS lo FROM part),
        d AS (SELECT {_U.format(1)} AS r, {_U.format(2)} AS u FROM orders)
        SELECT CASE WHEN r < CAST(0.5 AS DOUBLE) THEN 'positive' WHEN r < CAST(0.8 AS DOUBLE) THEN 'hard' ELSE 'uniform' END AS kind, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM d JOIN i ON u >= lo AND u < hi GROUP BY 1""",
    "g17_dilation": fx.sql(
        "WITH m AS (SELECT scene_id, y, x FROM px64 WHERE v > CAST(0.15 AS DOUBLE)), p AS (SELECT DISTINCT scene_id, y + dy AS y, x + dx AS x FROM m, (SELECT unnest([-2,-1,0,1,2]) AS dy), (SELECT unnest([-2,-1,0,1,2]) AS dx))"
        " SELECT s.scene_id, count(p.y) AS n, CAST(sum(p.y * 64 + p.x) AS BIGINT) AS places FROM (SELECT DISTINCT scene_id FROM px64) s LEFT JOIN p ON p.scene_id = s.scene_id AND p.y BETWEEN 0 AND 63 AND p.x BETWEEN 0 AND 63 GROUP BY 1",
        "px64",
    ),
    "g18_edge_layer": fx.sql(
        "WITH g AS (" + sobel_sql("m", "g", "SELECT *, CASE WHEN v > CAST(0.15 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END AS m FROM px64", "zero") + "), e AS (SELECT *, g / greatest(max(g) OVER (PARTITION BY scene_id), 1e-6) > CAST(0.1 AS DOUBLE) AS edge FROM g)"
        " SELECT scene_id, count(*) FILTER (edge) AS n, CAST(sum(y * 64 + x) FILTER (edge) AS BIGINT) AS places FROM e GROUP BY 1",
        "px64",
    ),
    "g19_colour_only": fx.sql(f"SELECT scene_id, count(*) FILTER (change > CAST(0.35 AS DOUBLE) AND edge < CAST(0.15 AS DOUBLE)) AS n FROM ({_SIG}) GROUP BY 1", "pairs8"),
    "g20_background_weight": fx.sql(f"SELECT scene_id, y, x, round(weight, 6) AS weight FROM ({_BG})", "pairs8"),
    "g21_top_k_mean": fx.sql("SELECT scene_id, round(avg(CAST(prob AS DOUBLE)), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY prob DESC, y, x) AS r FROM px8) WHERE r <= 10 GROUP BY 1", "px8"),
    "g21_masked_top_k_mean": fx.sql(f"SELECT scene_id, round(avg(p), 6) AS top_mean FROM (SELECT scene_id, t2 * weight AS p, row_number() OVER (PARTITION BY scene_id ORDER BY t2 * weight DESC, y, x) AS r FROM ({_BG}) WHERE weight > 0) WHERE r <= 5 GROUP BY 1", "pairs8"),
}
