"""Queries of the spectral family and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import spectral as sp
from rasterloom.plans import fixtures as fx
from rasterloom.plans.evaluation import rounded


def e1(spark, d):
    return fx.obs(spark, d).groupBy("sensor").agg(F.round(F.sum(sp.scale_offset(F.col("raw_nir")).cast("double")), 4).alias("total"), F.max(F.round(sp.scale_offset(F.col("raw_green")).cast("double"), 6)).alias("top"))


def e2(spark, d):
    return sp.with_qa_valid(fx.obs(spark, d)).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))


def channels(spark, d):
    return sp.prepared(fx.obs(spark, d))


SUMS = ["green", "red", "nir", "ndvi", "ndwi"]


def sums(df, *by):
    return df.groupBy(*by).agg(*[F.round(F.sum(F.col(b).cast("double")), 3).alias(b) for b in SUMS], F.count_if("valid").alias("n_valid"))


def e3(spark, d):
    o = fx.obs(spark, d)
    v, ok = sp.normalised_difference(o.raw_nir.cast("float") - 9000, o.raw_red.cast("float") - 9000, F.col("qa_pixel") == 0, epsilon=100.0)
    return o.select("sensor", v.alias("v"), ok.alias("ok")).groupBy("sensor").agg(F.round(F.sum(F.col("v").cast("double")), 3).alias("v"), F.count_if("ok").alias("ok"))


def e4(spark, d):
    c = channels(spark, d)
    return c.groupBy("split").agg(F.round(F.avg(F.when(F.col("valid"), F.col("ndvi").cast("double"))), 6).alias("ndvi"), F.round(F.avg(F.when(F.col("valid"), F.col("ndwi").cast("double"))), 6).alias("ndwi"))


def e5(spark, d):
    return sums(channels(spark, d), "sensor")


def e6(spark, d):
    return sums(sp.prepared(fx.obs(spark, d), "1996-01-01", "1997-06-30", sp.sensors_of("landsat7_consistent")), "split")


def e7(spark, d):
    return rounded(sp.median_composite(channels(spark, d), ["px"]), *SUMS)


def windows(spark, d):
    w = spark.range(4).select(F.col("id"), F.explode(sp.expansion_steps(F.lit(20), F.lit(50))).alias("expansion"))
    mid = F.add_months(F.to_date(F.lit("1995-01-01")), (F.col("id") * 8).cast("int"))
    return w.select(F.concat_ws("/", "id", "expansion").alias("name"), "id", "expansion", F.date_sub(mid, F.col("expansion")).alias("start"), F.date_add(F.last_day(mid), F.col("expansion")).alias("end"))


def diagnostics(spark, d):
    w = windows(spark, d)
    got = sp.window_diagnostics(sp.with_qa_valid(fx.obs(spark, d)), w)
    return w.select("name", "id", "expansion").join(got, "name")


def e8(spark, d):
    return rounded(diagnostics(spark, d).drop("name"), "valid_fraction", "observation_fraction")


def e9(spark, d):
    return rounded(sp.choose_window(diagnostics(spark, d), ["id"], 0.35), "valid_fraction")


def e10(spark, d):
    return rounded(sp.channel_audit(channels(spark, d), ["sensor"]), "valid_fraction", "min_ndvi", "max_ndvi")


def mask8(spark, d):
    p = fx.px8(spark, d)
    return p.select("scene_id", "y", "x", F.col("prob").cast("double").alias("v"), ((F.col("y") + F.col("x") + F.col("scene_id")) % 3 != 0).alias("valid"))


def e11(spark, d):
    return rounded(sp.resize_valid(mask8(spark, d), ["v"], "valid", (8, 8), (12, 20)), "v")


#: A source of 8 x 8 pixels of 0.01 degrees, and a target that leaves it on two sides: west, north, width, height, rows, columns; box; shape.
SOURCE, BOX, SHAPE = (10.0, 50.0, 0.01, 0.01, 8, 8), (10.013, 49.913, 10.093, 49.988), (10, 12)


def e12(spark, d):
    return rounded(sp.align_valid(mask8(spark, d), ["v"], "valid", SOURCE, BOX, SHAPE), "v")


def e13(spark, d):
    return sp.align_mask(mask8(spark, d).drop("v"), "valid", SOURCE, BOX, SHAPE)


def e14(spark, d):
    return rounded(sp.training_stats(channels(spark, d), ["sensor"], ["ndvi", "ndwi"]), "mean", "std")


def e15(spark, d):
    return rounded(sp.training_stats(channels(spark, d), [], SUMS, floor=0.0), "mean", "std")


def e16(spark, d):
    c = channels(spark, d)
    n = sp.normalise(c, sp.training_stats(c, ["sensor"], ["ndvi", "ndwi"]), ["sensor"], ["ndvi", "ndwi"])
    return n.where("split <> 'train'").groupBy("sensor", "split").agg(F.round(F.sum("ndvi"), 3).alias("ndvi"), F.round(F.sum("ndwi"), 3).alias("ndwi"))


def e17(spark, d):
    s = sp.training_stats(channels(spark, d), [], ["ndvi", "ndwi", "red"], floor=0.0)
    s = s.withColumn("split_used", F.when(F.col("band") == "red", "val").otherwise("train")).withColumn("other_splits_used", F.col("band") == "ndwi")
    return sp.stats_problems(s, ["green", "red", "ndvi", "ndwi"])


def e18(spark, d):
    return rounded(sp.coverage_report(fx.date_records(spark, d)), "mean_fraction", "min_fraction", "max_fraction")


def e19(spark, d):
    r = fx.date_records(spark, d).where(F.col("status").isin(sp.OK))
    return sp.one_per_group(r, ["split", "region_id"], [F.col("id")]).select("split", "region_id", "key")


def e20(spark, d):
    c = channels(spark, d)
    side = lambda keep: c.where(keep).groupBy("px").agg(F.max_by("ndvi", F.struct("acquired", "raw_green", "raw_red", "raw_nir", "valid")).alias("ndvi"), F.max_by("ndwi", F.struct("acquired", "raw_green", "raw_red", "raw_nir", "valid")).alias("ndwi"), F.max(F.struct("acquired", "raw_green", "raw_red", "raw_nir", "valid")).alias("m")).select("px", "ndvi", "ndwi", F.col("m.valid").alias("valid"))
    return rounded(sp.paired_change(side("acquired < '1998-01-01'"), side("acquired >= '1998-01-01'"), ["px"]), "d_ndvi", "d_ndwi")


QUERIES = {
    "e1_scale_offset": e1, "e2_qa_mask": e2, "e3_normalised_difference": e3, "e4_ndvi_ndwi": e4, "e5_five_channels": e5, "e6_scene_preparation": e6, "e7_median_composite": e7, "e8_window_diagnostics": e8, "e9_window_choice": e9,
    "e10_channel_audit": e10, "e11_valid_resize": e11, "e12_align_valid": e12, "e13_align_mask": e13, "e14_sensor_stats": e14, "e15_global_stats": e15, "e16_normalisation": e16, "e17_stats_guard": e17, "e18_coverage_report": e18, "e19_one_per_group": e19, "e20_paired_change": e20,
}

_B = lambda b: f"CAST(CAST(raw_{b} AS FLOAT) * CAST(2.75e-5 AS FLOAT) AS FLOAT) + CAST(-0.2 AS FLOAT)"
_WORD = lambda t: "CASE sensor " + " ".join(f"WHEN '{s}' THEN {sum(1 << b for b in bits)}" for s, bits in t.items()) + " END"
QA = f"(qa_pixel & ({_WORD(sp.QA_PIXEL_BITS)})) = 0 AND (qa_radsat & ({_WORD(sp.QA_RADSAT_BITS)})) = 0"


def nd(a: str, b: str, valid: str, eps: str = "1e-6") -> tuple[str, str]:
    raw = f"CASE WHEN abs({a} + {b}) > {eps} THEN CAST(({a} - {b}) / ({a} + {b}) AS FLOAT) END"
    ok = f"coalesce({valid} AND abs({raw}) <= 1.05, false)"
    return f"CASE WHEN {ok} THEN least(greatest({raw}, -1), 1) ELSE 0 END", ok


_V, _O1 = nd("n0", "r0", "ok0")
_W, _O2 = nd("g0", "n0", "ok0")
CH = f"b AS (SELECT *, {_B('green')} AS g0, {_B('red')} AS r0, {_B('nir')} AS n0, {QA} AS ok0 FROM obs), i AS (SELECT *, {_V} AS v0, {_W} AS w0, {_O1} AND {_O2} AS valid FROM b)"
CH += ", ch AS (SELECT *, " + ", ".join(f"CASE WHEN valid THEN CAST({s} AS FLOAT) ELSE CAST(0 AS FLOAT) END AS {n}" for s, n in (("g0", "green"), ("r0", "red"), ("n0", "nir"), ("v0", "ndvi"), ("w0", "ndwi"))) + " FROM i)"
_SUMS = ", ".join(f"round(sum(CAST({b} AS DOUBLE)), 3) AS {b}" for b in SUMS) + ", count(*) FILTER (valid) AS n_valid"
_WINS = """w AS (SELECT id || '/' || expansion AS name, id, expansion, CAST(m AS DATE) - CAST(expansion AS INT) AS s, last_day(m) + CAST(expansion AS INT) AS e FROM
 (SELECT range AS id, CAST(unnest([0, 20, 40, 50]) AS INT) AS expansion, CAST(DATE '1995-01-01' + to_months(CAST(range * 8 AS INT)) AS DATE) AS m FROM range(4))),
 q AS (SELECT w.id, w.expansion, o.* FROM (SELECT *, """ + QA + """ AS valid FROM obs) o JOIN w ON acquired BETWEEN s AND e),
 p AS (SELECT id, expansion, px, max(valid) AS a, count(*) FILTER (valid) AS n, count(*) AS t FROM q GROUP BY ALL),
 dg AS (SELECT p.id, p.expansion, (SELECT count(DISTINCT (acquired, sensor)) FROM q WHERE q.id = p.id AND q.expansion = p.expansion) AS scenes, count(*) AS pixels, avg(CASE WHEN a THEN CAST(1 AS DOUBLE) ELSE 0 END) AS valid_fraction, CAST(sum(n) AS DOUBLE) / sum(t) AS observation_fraction FROM p GROUP BY ALL)"""  # fmt: skip
_ST = lambda by, bands, floor: f"st AS (SELECT {by} band, count(*) AS n, avg(v) AS mean, sqrt(greatest(sum(v * v) / count(*) - pow(sum(v) / count(*), 2), {floor})) AS std FROM (" + " UNION ALL ".join(f"SELECT *, '{b}' AS band, CAST({b} AS DOUBLE) AS v FROM ch WHERE split = 'train' AND valid" for b in bands) + f") GROUP BY {by} band)"
_AX = lambda n, m, a: f"(SELECT t{a}, n{a}, s AS {a}, sum(f) AS f{a} FROM (SELECT t{a}, n{a}, lo AS s, 1 - (pos - lo) AS f FROM _{a} UNION ALL SELECT t{a}, n{a}, least(lo + 1, {n} - 1), pos - lo FROM _{a}) GROUP BY ALL)"
_AX0 = lambda n, m, a: f"_{a} AS (SELECT CAST(range AS INT) AS t{a}, CAST(least(floor(range * ({n} / CAST({m} AS DOUBLE))), {n} - 1) AS INT) AS n{a}, greatest((range + 0.5) * ({n} / CAST({m} AS DOUBLE)) - 0.5, 0) AS pos, CAST(least(floor(greatest((range + 0.5) * ({n} / CAST({m} AS DOUBLE)) - 0.5, 0)), {n} - 1) AS INT) AS lo FROM range({m}))"
_N3, _K3 = nd("a", "b", "qa_pixel = 0", "100")
_LAST = lambda c: f"(SELECT px, max_by(ndvi, (acquired, raw_green, raw_red, raw_nir, valid)) AS v, max_by(ndwi, (acquired, raw_green, raw_red, raw_nir, valid)) AS w, max_by(valid, (acquired, raw_green, raw_red, raw_nir, valid)) AS ok FROM ch WHERE {c} GROUP BY px)"
_BEFORE, _AFTER = _LAST("acquired < DATE '1998-01-01'"), _LAST("acquired >= DATE '1998-01-01'")
_F = "count(*) AS n, count(f) AS acceptable, round(avg(f), 6) AS mean_fraction, round(min(f), 6) AS min_fraction, round(max(f), 6) AS max_fraction"
_ALIGN = (
    "m AS (SELECT scene_id, y, x, CAST(prob AS DOUBLE) AS v, CASE WHEN (y + x + scene_id) % 3 <> 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS m FROM px8),"
    " t AS (SELECT DISTINCT scene_id, CAST(r.range AS INT) AS ty, CAST(c.range AS INT) AS tx, (CAST(50 AS DOUBLE) - (49.988 - (r.range + 0.5) * (CAST(0.075 AS DOUBLE) / 10))) / 0.01 AS py, (10.013 + (c.range + 0.5) * (CAST(0.08 AS DOUBLE) / 12) - CAST(10 AS DOUBLE)) / 0.01 AS px FROM m, range(10) r, range(12) c),"
    " n AS (SELECT DISTINCT ty, tx, CAST(floor(py - 0.5) AS INT) + dy AS y, CAST(floor(px - 0.5) AS INT) + dx AS x, (CASE WHEN dy = 1 THEN py - 0.5 - floor(py - 0.5) ELSE 1 - (py - 0.5 - floor(py - 0.5)) END) * (CASE WHEN dx = 1 THEN px - 0.5 - floor(px - 0.5) ELSE 1 - (px - 0.5 - floor(px - 0.5)) END) AS f FROM (SELECT DISTINCT ty, tx, py, px FROM t), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))"
)
ORACLES = {
    "e1_scale_offset": fx.sql(f"SELECT sensor, round(sum(CAST({_B('nir')} AS DOUBLE)), 4) AS total, max(round(CAST({_B('green')} AS DOUBLE), 6)) AS top FROM obs GROUP BY 1", "obs"),
    "e2_qa_mask": fx.sql(f"SELECT sensor, count(*) AS n, count(*) FILTER ({QA}) AS n_valid FROM obs GROUP BY 1", "obs"),
    "e3_normalised_difference": fx.sql(f"WITH x AS (SELECT *, CAST(raw_nir AS FLOAT) - CAST(9000 AS FLOAT) AS a, CAST(raw_red AS FLOAT) - CAST(9000 AS FLOAT) AS b FROM obs) SELECT sensor, round(sum(CAST({_N3} AS DOUBLE)), 3) AS v, count(*) FILTER ({_K3}) AS ok FROM x GROUP BY 1", "obs"),
    "e4_ndvi_ndwi": fx.sql(f"WITH {CH} SELECT split, round(avg(CAST(ndvi AS DOUBLE)) FILTER (valid), 6) AS ndvi, round(avg(CAST(ndwi AS DOUBLE)) FILTER (valid), 6) AS ndwi FROM ch GROUP BY 1", "obs"),
    "e5_five_channels": fx.sql(f"WITH {CH} SELECT sensor, {_SUMS} FROM ch GROUP BY 1", "obs"),
    "e6_scene_preparation": fx.sql(f"WITH {CH} SELECT split, {_SUMS} FROM ch WHERE acquired BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND sensor = 'LANDSAT_7' GROUP BY 1", "obs"),
    "e7_median_composite": fx.sql(f"WITH {CH} SELECT px, " + ", ".join(f"round(median(CAST({b} AS DOUBLE)) FILTER (valid), 6) AS {b}" for b in SUMS) + ", count(*) FILTER (valid) AS observations FROM ch GROUP BY 1", "obs"),
    "e8_window_diagnostics": fx.sql(f"WITH {_WINS} SELECT id, expansion, scenes, pixels, round(valid_fraction, 6) AS valid_fraction, round(observation_fraction, 6) AS observation_fraction FROM dg", "obs"),
    "e9_window_choice": fx.sql(
        f"WITH {_WINS}, a AS (SELECT id, min(expansion) FILTER (scenes > 0 AND valid_fraction >= 0.35) AS f, max(expansion) AS l, sum(scenes) AS sc, count(*) AS attempts FROM dg GROUP BY 1)"
        " SELECT a.id, CAST(coalesce(f, l) AS INT) AS expansion, round(valid_fraction, 6) AS valid_fraction, CASE WHEN sc = 0 THEN 'source_unavailable' WHEN f IS NULL THEN 'insufficient_valid_pixels' WHEN valid_fraction >= 1 THEN 'ok' ELSE 'ok_partial' END AS status, attempts"
        " FROM a JOIN dg ON dg.id = a.id AND dg.expansion = coalesce(f, l)",
        "obs",
    ),
    "e10_channel_audit": fx.sql(
        f"WITH {CH} SELECT sensor, count(*) FILTER (valid AND abs(ndvi) > 1.0001) AS bad_ndvi, count(*) FILTER (valid AND abs(ndwi) > 1.0001) AS bad_ndwi, CAST(0 AS BIGINT) AS wrong_ndvi, count(*) FILTER (NOT valid AND (ndvi <> 0 OR ndwi <> 0 OR green <> 0)) AS nonzero_invalid,"
        " round(avg(CASE WHEN valid THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS valid_fraction, round(min(CAST(ndvi AS DOUBLE)), 6) AS min_ndvi, round(max(CAST(ndvi AS DOUBLE)), 6) AS max_ndvi FROM ch GROUP BY 1",
        "obs",
    ),
    "e11_valid_resize": fx.sql(
        f"WITH m AS (SELECT scene_id, y, x, CAST(prob AS DOUBLE) AS v, CASE WHEN (y + x + scene_id) % 3 <> 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS m FROM px8), {_AX0(8, 12, 'y')}, {_AX0(8, 20, 'x')}, g AS (SELECT * FROM {_AX(8, 12, 'y')}, {_AX(8, 20, 'x')}),"
        " s AS (SELECT scene_id, ty, tx, any_value(ny) AS ny, any_value(nx) AS nx, sum(fy * fx * m * v) AS a, sum(fy * fx * m) AS s FROM m JOIN g USING (y, x) GROUP BY 1, 2, 3)"
        " SELECT s.scene_id, ty, tx, round(CASE WHEN n.m > 0.5 AND s > 1e-6 THEN a / greatest(s, 1e-6) ELSE 0 END, 6) AS v, n.m > 0.5 AND s > 1e-6 AS valid FROM s JOIN m n ON n.scene_id = s.scene_id AND n.y = ny AND n.x = nx",
        "px8",
    ),
    "e12_align_valid": fx.sql(
        f"WITH {_ALIGN}, j AS (SELECT t.scene_id, t.ty, t.tx, sum(f * m * v) AS a, sum(f * m) AS s, sum(f) AS w FROM t JOIN n USING (ty, tx) JOIN m ON m.scene_id = t.scene_id AND m.y = n.y AND m.x = n.x GROUP BY 1, 2, 3)"
        " SELECT t.scene_id, t.ty, t.tx, round(CASE WHEN coalesce(k.m, 0) > 0 AND s > 1e-6 * w AND abs(a / s) >= 1e-7 THEN a / s ELSE 0 END, 6) AS v, coalesce(k.m, 0) > 0 AS valid FROM t LEFT JOIN j USING (scene_id, ty, tx) LEFT JOIN m k ON k.scene_id = t.scene_id AND k.y = floor(t.py) AND k.x = floor(t.px)",
        "px8",
    ),
    "e13_align_mask": fx.sql(f"WITH {_ALIGN} SELECT t.scene_id, ty, tx, coalesce(k.m, 0) > 0 AS valid FROM t LEFT JOIN m k ON k.scene_id = t.scene_id AND k.y = floor(py) AND k.x = floor(px)", "px8"),
    "e14_sensor_stats": fx.sql(f"WITH {CH}, {_ST('sensor,', ['ndvi', 'ndwi'], '1e-12')} SELECT sensor, band, n, round(mean, 6) AS mean, round(std, 6) AS std FROM st", "obs"),
    "e15_global_stats": fx.sql(f"WITH {CH}, {_ST('', SUMS, '0')} SELECT band, n, round(mean, 6) AS mean, round(std, 6) AS std FROM st", "obs"),
    "e16_normalisation": fx.sql(
        f"WITH {CH}, {_ST('sensor,', ['ndvi', 'ndwi'], '1e-12')} SELECT sensor, split, " + ", ".join(f"round(sum(CASE WHEN valid THEN (CAST({b} AS DOUBLE) - (SELECT mean FROM st WHERE st.sensor = ch.sensor AND band = '{b}')) / (SELECT std FROM st WHERE st.sensor = ch.sensor AND band = '{b}') ELSE 0 END), 3) AS {b}" for b in ("ndvi", "ndwi")) + " FROM ch WHERE split <> 'train' GROUP BY 1, 2",
        "obs",
    ),
    "e17_stats_guard": fx.sql(
        f"""WITH {CH}, {_ST('', ['ndvi', 'ndwi', 'red'], '0')}, s AS (SELECT *, CASE WHEN band = 'red' THEN 'val' ELSE 'train' END AS used, band = 'ndwi' AS leaks FROM st)
        SELECT band, 'split' AS problem FROM s WHERE used <> 'train' UNION ALL SELECT band, 'leak' FROM s WHERE leaks UNION ALL SELECT band, 'not_finite' FROM s WHERE NOT (isfinite(mean) AND isfinite(std)) UNION ALL SELECT band, 'no_spread' FROM s WHERE std <= 0
        UNION ALL SELECT band, 'missing' FROM (SELECT unnest(['green', 'red', 'ndvi', 'ndwi']) AS band) WHERE band NOT IN (SELECT band FROM st)""",
        "obs",
    ),
    "e18_coverage_report": fx.sql(f"WITH f AS (SELECT *, CASE WHEN status IN ('ok', 'ok_partial') THEN valid_fraction END AS f FROM date_records) SELECT split, region_id, status, {_F} FROM f GROUP BY GROUPING SETS ((split, status), (region_id, status), (split), ())", "date_records"),
    "e19_one_per_group": fx.sql("SELECT split, region_id, min_by(key, id) AS key FROM date_records WHERE status IN ('ok', 'ok_partial') GROUP BY 1, 2", "date_records"),
    "e20_paired_change": fx.sql(
        f"WITH {CH} SELECT a.px, round(CASE WHEN a.ok AND b.ok THEN CAST(b.v - a.v AS DOUBLE) END, 6) AS d_ndvi, round(CASE WHEN a.ok AND b.ok THEN CAST(b.w - a.w AS DOUBLE) END, 6) AS d_ndwi, a.ok AND b.ok AS valid FROM {_BEFORE} a JOIN {_AFTER} b USING (px)",
        "obs",
    ),
}
