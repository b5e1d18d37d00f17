"""Queries of the map-feature family and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import mapfeatures as mf
from rasterloom.plans import fixtures as fx

CELL = 0.125


def boxed(spark, d):
    """Features with their box as a GeoJSON polygon; every fifth one with a corner pushed in."""
    f = fx.features(spark, d)
    pair = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), y, F.lit("]"))
    s, n = F.col("s").cast("string"), F.col("n").cast("string")
    odd = F.when(F.col("feature_id") % 5 == 0, ((F.col("s") + F.col("n")) / 2).cast("string")).otherwise(n)
    ring = F.concat_ws(",", pair("w", s), pair("e", s), pair("e", odd), pair("w", n), pair("w", s))
    return f.withColumn("geometry", F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))


def f1(spark, d):
    f = fx.features(spark, d)
    flat = F.map_concat("tags", F.create_map(F.lit("@osmId"), F.lit("way/1"), F.lit("type"), F.lit("Feature")))
    nested = F.create_map(F.lit("tags"), F.to_json("tags"), F.lit("other"), F.lit("x"))
    p = f.select("feature_id", F.when(F.col("feature_id") % 2 == 0, nested).otherwise(flat).alias("p"))
    return p.select("feature_id", F.explode(mf.feature_tags(F.col("p"))).alias("key", "value"))


def f2(spark, d):
    b = boxed(spark, d).select("feature_id", mf.geometry_bbox(F.col("geometry")).alias("b"))
    return b.select("feature_id", *[F.round(f"b.{k}", 6).alias(k) for k in "wsen"])


def f3(spark, d):
    return boxed(spark, d).select("feature_id", mf.is_box_polygon(F.col("geometry")).alias("is_box"))


def f4(spark, d):
    f = boxed(spark, d)
    i = F.col("feature_id")
    name = F.when(i % 97 == 0, F.lit("way/7")).when(i % 31 == 0, F.lit("odd")).otherwise(F.concat(F.lit("way/"), i.cast("string")))
    f = f.withColumns({"osm_id": name, "osm_type": F.when(i % 13 == 0, "node").otherwise("way"), "qw": F.lit(0.0), "qs": F.lit(0.0), "qe": F.lit(0.5), "qn": F.lit(2.0)})
    f = f.withColumn("geometry", F.when(i % 41 == 0, '{"type":"Polygon","coordinates":[]}').otherwise(F.col("geometry")))
    return mf.extraction_problems(f)


def f5(spark, d):
    f = fx.features(spark, d)
    q = {"w": F.lit(0.25), "s": F.lit(0.25), "e": F.lit(0.5), "n": F.lit(0.75)}
    return f.where(mf.boxes_meet({k: F.col(k) for k in "wsen"}, q)).select("feature_id")


def f6(spark, d):
    return mf.spatial_join(fx.features(spark, d), fx.map_tiles(spark), CELL)


def f7(spark, d):
    return mf.category_counts(f6(spark, d).join(fx.features(spark, d).select("feature_id", "tags"), "feature_id"), ["tile_id"])


def f8(spark, d):
    t = mf.tile_summary(fx.features(spark, d), fx.map_tiles(spark), CELL)
    return t.select("tile_id", F.posexplode("vector").alias("slot", "value")).withColumn("value", F.round("value", 6))


def f9(spark, d):
    return mf.top_values(f6(spark, d).join(fx.features(spark, d).select("feature_id", "tags"), "feature_id"), ["tile_id"], "feature_id", k=2)


def f10(spark, d):
    return mf.tile_summary(fx.features(spark, d), fx.map_tiles(spark), CELL).select("tile_id", "sentence")


def f11(spark, d):
    return mf.tile_summary(fx.features(spark, d), fx.map_tiles(spark), CELL).drop("vector")


def f12(spark, d):
    return fx.features(spark, d).select("feature_id", F.explode(mf.spatial_channels(F.col("tags"))).alias("channel"))


def f13(spark, d):
    b = boxed(spark, d)
    many = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.col("geometry"), F.lit(',{"type":"LineString","coordinates":[[0,0],[1,1],[2,2]]},{"type":"MultiPoint","coordinates":[[5,5],[6,6]]}]}'))
    p = mf.geometry_parts(b.select("feature_id", F.when(F.col("feature_id") % 3 == 0, many).otherwise(F.col("geometry")).alias("g")), "g", ["feature_id"])
    return p.select("feature_id", "member", "kind", "part", F.size("points").alias("n_points"))


def f14(spark, d):
    """Features whose box meets a tile, drawn on its 16 by 16 grid, as pixels counted by tile and channel."""
    f, t = fx.features(spark, d), fx.map_tiles(spark)
    j = mf.spatial_join(f, t, CELL).join(f, "feature_id").join(F.broadcast(t), "tile_id")  # 64 tiles
    x, y = lambda c: (F.col(c) - F.col("tw")) / (F.col("te") - F.col("tw")) * 15, lambda c: (F.col("tn") - F.col(c)) / (F.col("tn") - F.col("ts")) * 15
    ring = F.array(*[F.array(x(a), y(b)) for a, b in (("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s"))])
    parts = j.select("tile_id", F.explode(mf.spatial_channels(F.col("tags"))).alias("channel"), F.lit("polygon").alias("kind"), ring.alias("points"))
    return mf.burn_in(parts, 16, 16, ["tile_id", "channel"]).groupBy("tile_id", "channel").agg(F.count(F.lit(1)).alias("pixels"))


def gates(spark, d):
    e = fx.table(spark, d, "embeddings")
    part = lambda a: F.transform(F.slice("embedding", a, 5), lambda v: F.lit(0.5) + v.cast("double"))
    return e.select("vec_id", part(1).alias("gates"), part(6).alias("similarities"), (F.lit(0.9) + F.element_at("embedding", 11).cast("double")).alias("confidence"))


def f15(spark, d):
    return mf.gate_problems(gates(spark, d), "vec_id")


def f16(spark, d):
    g = gates(spark, d).withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: i / F.lit(16.0)))
    return g.select("vec_id", F.posexplode(mf.apply_gates(F.col("vector"), F.col("gates"))).alias("slot", "value")).withColumn("value", F.round("value", 6))


def f17(spark, d):
    r = fx.date_records(spark, d)
    kept = F.when(F.col("id") % 3 == 0, F.col("valid_fraction") * 2)
    a, b = mf.reliability(kept, F.when(F.col("id") % 2 == 0, "geometry").when(F.col("id") % 5 == 0, "bbox"), F.when(F.col("id") % 7 == 0, "feature_bounding_boxes_not_exact_geometries"))
    return r.select("key", F.round(a, 6).alias("reliability"), F.round(b, 6).alias("spatial_reliability"))


QUERIES = {
    "f1_feature_tags": f1, "f2_geometry_bbox": f2, "f3_box_polygon": f3, "f4_extraction_audit": f4, "f5_box_intersection": f5, "f6_spatial_join": f6, "f7_category_counts": f7, "f8_structure_vector": f8, "f9_top_values": f9,
    "f10_summary_sentence": f10, "f11_tile_summary": f11, "f12_channel_categories": f12, "f13_geometry_parts": f13, "f14_burn_in": f14, "f15_gate_audit": f15, "f16_gate_application": f16, "f17_reliability": f17,
}

_MEET = "w <= te AND tw <= e AND s <= tn AND ts <= n"
_CATS = {
    "building": "family = 'building'", "road": "family = 'highway'", "railway": "family = 'railway'", "water": "family = 'waterway'", "vegetation": "family = 'natural' AND value = 'wood'", "residential": "value = 'residential'",
    "industrial_commercial": "false", "construction": "family IN ('landuse', 'building') AND value = 'construction'", "amenity": "family = 'amenity'",
}
_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _CATS.items())
_J = f"j AS (SELECT * FROM features JOIN map_tiles ON {_MEET}), c AS (SELECT tile_id, {_COUNTS}, count(*) AS features FROM j GROUP BY 1)"
_ALLC = "a AS (SELECT tile_id, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in [*_CATS, "features"]) + " FROM map_tiles LEFT JOIN c USING (tile_id))"
_SENT = "'Historical OSM snapshot: ' || coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {n} > 0 THEN {n} || ' {lab}' END" for n, lab in mf.LABELS.items()) + "), ''), 'no matching mapped features')"
_P = {n: f"CAST({n} > 0 AS INT)" for n in _CATS}
_BU, _TR = "least(1, building / CAST(120 AS DOUBLE))", "least(1, (road + railway) / CAST(180 AS DOUBLE))"
_BUILT = f"least(1, CAST(0.55 AS DOUBLE) * {_P['building']} + 0.25 * {_P['residential']} + 0.2 * {_P['industrial_commercial']} + 0.35 * {_BU})"
_NET = f"least(1, CAST(0.55 AS DOUBLE) * {_P['road']} + 0.2 * {_P['railway']} + 0.25 * {_TR})"
_URB = f"least(1, greatest(0, 0.5 * {_BUILT} + 0.3 * {_NET} - 0.2 * {_P['water']} - 0.1 * {_P['vegetation']} + 0.25 * {_P['construction']}))"
_VEC = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in [*_P.values(), _BU, _TR, "least(1, water / CAST(30 AS DOUBLE))", "least(1, vegetation / CAST(60 AS DOUBLE))", _BUILT, _NET, _URB]) + "]"
_G = "SELECT vec_id, list_transform(embedding[1:5], lambda x: least(greatest(0.5 + CAST(x AS DOUBLE), 0), 1)) AS g FROM embeddings"
_PER = "[g[1], g[2], g[2], g[3], g[4], g[5], g[5], g[5], g[5], g[1], g[2], g[3], g[4], greatest(g[1], g[5]), g[2], greatest(g[1], g[2], g[5])]"
_CH = "list_filter([CASE WHEN family = 'building' THEN 0 END, CASE WHEN family IN ('highway', 'railway') THEN 1 END, CASE WHEN family = 'waterway' THEN 2 END, CASE WHEN family = 'natural' AND value = 'wood' THEN 3 END, CASE WHEN family IN ('landuse', 'amenity') THEN 4 END], lambda x: x IS NOT NULL)"
ORACLES = {
    "f1_feature_tags": fx.sql("SELECT feature_id, family AS key, value FROM features", "features"),
    "f2_geometry_bbox": fx.sql("SELECT feature_id, round(w, 6) AS w, round(s, 6) AS s, round(e, 6) AS e, round(n, 6) AS n FROM features", "features"),
    "f3_box_polygon": fx.sql("SELECT feature_id, feature_id % 5 <> 0 AS is_box FROM features", "features"),
    "f4_extraction_audit": fx.sql(
        """WITH i AS (SELECT *, CASE WHEN feature_id % 97 = 0 THEN 'way/7' WHEN feature_id % 31 = 0 THEN 'odd' ELSE 'way/' || feature_id END AS o FROM features)
        SELECT feature_id, 'id_form' AS problem FROM i WHERE o = 'odd' UNION ALL SELECT feature_id, 'repeated' FROM (SELECT *, count(*) OVER (PARTITION BY o) AS c FROM i) WHERE c > 1
        UNION ALL SELECT feature_id, 'type' FROM i WHERE split_part(o, '/', 1) <> CASE WHEN feature_id % 13 = 0 THEN 'node' ELSE 'way' END
        UNION ALL SELECT feature_id, 'no_geometry' FROM i WHERE feature_id % 41 = 0 UNION ALL SELECT feature_id, 'outside' FROM i WHERE feature_id % 41 <> 0 AND NOT (w <= 0.5)""",
        "features",
    ),
    "f5_box_intersection": fx.sql("SELECT feature_id FROM features WHERE w <= 0.5 AND 0.25 <= e AND s <= 0.75 AND 0.25 <= n", "features"),
    "f6_spatial_join": fx.sql(f"SELECT feature_id, tile_id FROM features JOIN map_tiles ON {_MEET}", "features", "map_tiles"),
    "f7_category_counts": fx.sql(f"WITH {_J} SELECT * FROM c", "features", "map_tiles"),
    "f8_structure_vector": fx.sql(f"WITH {_J}, {_ALLC} SELECT tile_id, slot, round(value, 6) AS value FROM (SELECT tile_id, CAST(unnest(range(16)) AS INT) AS slot, unnest({_VEC}) AS value FROM a)", "features", "map_tiles"),
    "f9_top_values": fx.sql(
        "WITH n AS (SELECT tile_id, family, value, count(*) AS n, min(feature_id) AS f FROM features JOIN map_tiles ON " + _MEET + " WHERE family IN ('building', 'highway', 'railway', 'amenity') GROUP BY 1, 2, 3)"
        " SELECT tile_id, family, value, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, family ORDER BY n DESC, f) AS r FROM n) WHERE r <= 2",
        "features", "map_tiles",
    ),
    "f10_summary_sentence": fx.sql(f"WITH {_J}, {_ALLC} SELECT tile_id, {_SENT} AS sentence FROM a", "features", "map_tiles"),
    "f11_tile_summary": fx.sql(f"WITH j AS (SELECT * FROM features JOIN map_tiles ON {_MEET}), c AS (SELECT tile_id, {_COUNTS}, count(*) AS features FROM j GROUP BY 1), {_ALLC} SELECT *, {_SENT} AS sentence FROM a", "features", "map_tiles"),
    "f12_channel_categories": fx.sql(f"SELECT feature_id, CAST(unnest({_CH}) AS INT) AS channel FROM features", "features"),
    "f13_geometry_parts": fx.sql(
        "SELECT feature_id, 0 AS member, 'polygon' AS kind, 0 AS part, 5 AS n_points FROM features UNION ALL SELECT feature_id, 1, 'line', 0, 3 FROM features WHERE feature_id % 3 = 0 UNION ALL SELECT feature_id, 2, 'point', unnest([0, 1]), 1 FROM features WHERE feature_id % 3 = 0",
        "features",
    ),
    "f14_burn_in": fx.sql(
        f"""WITH j AS (SELECT tile_id, unnest({_CH}) AS channel, (w - tw) / (te - tw) * 15 AS x0, (e - tw) / (te - tw) * 15 AS x1, (tn - n) / (tn - ts) * 15 AS y0, (tn - s) / (tn - ts) * 15 AS y1 FROM features JOIN map_tiles ON {_MEET}),
        p AS (SELECT DISTINCT tile_id, channel, y, x FROM j, (SELECT range AS y FROM range(16)), (SELECT range AS x FROM range(16)) WHERE x BETWEEN x0 - 1e-9 AND x1 + 1e-9 AND y BETWEEN y0 - 1e-9 AND y1 + 1e-9)
        SELECT tile_id, CAST(channel AS INT) AS channel, count(*) AS pixels FROM p GROUP BY 1, 2""",
        "features", "map_tiles",
    ),
    "f15_gate_audit": "WITH g AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: 0.5 + CAST(x AS DOUBLE)) AS g, CAST(0.9 AS DOUBLE) + CAST(embedding[11] AS DOUBLE) AS c FROM embeddings) SELECT vec_id, 'gates' AS problem FROM g WHERE list_min(g) < 0 OR list_max(g) > 1 UNION ALL SELECT vec_id, 'confidence' FROM g WHERE c < 0 OR c > 1",
    "f16_gate_application": f"SELECT vec_id, slot, round((slot + 1) / CAST(16 AS DOUBLE) * v, 6) AS value FROM (SELECT vec_id, CAST(unnest(range(16)) AS INT) AS slot, unnest({_PER}) AS v FROM ({_G}))",
    "f17_reliability": fx.sql(
        """WITH k AS (SELECT key, CASE WHEN id % 2 = 0 THEN 'geometry' WHEN id % 5 = 0 THEN 'bbox' ELSE 'geometry' END AS g, id % 7 = 0 AS boxes, CASE WHEN id % 3 = 0 THEN valid_fraction * 2 END AS st FROM date_records),
        v AS (SELECT *, least(greatest(coalesce(st, CASE WHEN g = 'geometry' THEN CAST(0.75 AS DOUBLE) ELSE 0.5 END), 0), 1) AS r FROM k) SELECT key, round(r, 6) AS reliability, round(CASE WHEN g = 'geometry' AND NOT boxes THEN r ELSE 0 END, 6) AS spatial_reliability FROM v""",
        "date_records",
    ),
}
