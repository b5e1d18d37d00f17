"""Map features: tags, boxes, spatial joins to tiles, category summaries and burn-in to pixel grids."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions.scalars import once

#: Property names that are bookkeeping, not tags (fixed values).
BOOKKEEPING = ["metadata", "type", "geometry", "id", "osmId"]
#: Tag values that make water, vegetation and land use (fixed values).
WATER = ["water", "wetland", "bay"]
GREEN_NATURAL = ["wood", "grassland", "scrub", "heath", "tree_row"]
GREEN_LANDUSE = ["forest", "grass", "meadow", "orchard", "vineyard"]
GREEN_LEISURE = ["park", "garden", "nature_reserve"]
BUSINESS = ["industrial", "commercial", "retail"]
#: Count names and how the summary sentence calls them (fixed values).
LABELS = {
    "building": "buildings", "road": "roads", "railway": "railways", "water": "water features", "vegetation": "vegetation or parks", "residential": "residential land use",
    "industrial_commercial": "industrial or commercial land use", "construction": "construction", "amenity": "amenities",
}
FAMILIES = ["building", "highway", "railway", "amenity"]


def feature_tags(properties: Column) -> Column:
    """The nested ``tags`` object (JSON text) if there is one, else the properties that are neither @-names nor bookkeeping."""
    nested = F.from_json(F.element_at(properties, "tags"), "map<string,string>")
    own = F.map_filter(properties, lambda k, v: ~k.startswith("@") & ~k.isin(BOOKKEEPING))
    return F.coalesce(nested, own)


def coordinate_pairs(geometry: Column) -> Column:
    """All [x, y] pairs of a GeoJSON text, of any geometry or collection, as structs."""
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
    found = F.regexp_extract_all(geometry, F.lit(rf"(\[\s*{number}\s*,\s*{number})"), 1)
    parts = F.transform(found, lambda p: F.split(F.regexp_replace(p, r"[\[\s]", ""), ","))
    return F.transform(parts, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))


def _box(p: Column) -> Column:
    """(w, s, e, n) over coordinate pairs."""
    x, y = F.transform(p, lambda a: a["x"]), F.transform(p, lambda a: a["y"])
    return F.when(F.size(p) > 0, F.struct(F.array_min(x).alias("w"), F.array_min(y).alias("s"), F.array_max(x).alias("e"), F.array_max(y).alias("n")))


def geometry_bbox(geometry: Column) -> Column:
    """(w, s, e, n) over all coordinates, null where there are none."""
    return once(coordinate_pairs(geometry), _box)


def is_box_polygon(geometry: Column, tolerance: float = 1e-12) -> Column:
    """Whether a GeoJSON text is a polygon of one closed ring whose points all lie on its box, with all four corners. Coordinates and box are read once."""
    near = lambda v, a, c: (F.abs(v - a) <= tolerance) | (F.abs(v - c) <= tolerance)

    def on_box(p: Column, b: Column) -> Column:
        corner = lambda x, y: F.exists(p, lambda q: (q["x"] == x) & (q["y"] == y))
        closed = (F.element_at(p, 1)["x"] == F.element_at(p, -1)["x"]) & (F.element_at(p, 1)["y"] == F.element_at(p, -1)["y"])
        on_edges = F.forall(p, lambda q: near(q["x"], b["w"], b["e"]) & near(q["y"], b["s"], b["n"]))
        corners = corner(b["w"], b["s"]) & corner(b["w"], b["n"]) & corner(b["e"], b["s"]) & corner(b["e"], b["n"])
        return F.when(F.size(p) >= 4, closed & on_edges & corners)

    rings = F.size(F.split(F.regexp_replace(geometry, r"\s", ""), r"\],\[\[")) == 1
    polygon = F.get_json_object(geometry, "$.type") == "Polygon"
    ring = once(coordinate_pairs(geometry), lambda p: once(_box(p), lambda b: on_box(p, b)))
    return F.coalesce(F.when(polygon & rings, ring), F.lit(False))


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two closed boxes given as w, s, e, n."""
    return (a["w"] <= b["e"]) & (b["w"] <= a["e"]) & (a["s"] <= b["n"]) & (b["s"] <= a["n"])


def spatial_join(features: DataFrame, tiles: DataFrame, cell: float, feature: str = "feature_id", tile: str = "tile_id") -> DataFrame:
    """Pairs (feature, tile) whose boxes meet: w, s, e, n of features against tw, ts, te, tn of tiles.

    Both sides name the grid cells they cover and meet by an equi-join on the cell. A pair is kept in
    the one cell that holds the lower left corner of its overlap, so no distinct is needed.
    """
    at = lambda c: F.floor(c / F.lit(cell)).cast("int")
    cells = lambda d, w, s, e, n: d.withColumn("_cx", F.explode(F.sequence(at(F.col(w)), at(F.col(e))))).withColumn("_cy", F.explode(F.sequence(at(F.col(s)), at(F.col(n)))))
    f = cells(features.select(feature, "w", "s", "e", "n"), "w", "s", "e", "n")
    t = cells(tiles.select(tile, "tw", "ts", "te", "tn"), "tw", "ts", "te", "tn")
    c = F.col
    j = f.join(t, ["_cx", "_cy"]).where(boxes_meet({k: c(k) for k in "wsen"}, {k: c(f"t{k}") for k in "wsen"}))
    own = (at(F.greatest("w", "tw")) == c("_cx")) & (at(F.greatest("s", "ts")) == c("_cy"))
    return j.where(own).select(feature, tile)


def tag(tags: Column, name: str) -> Column:
    return F.element_at(tags, name)


def has(tags: Column, name: str) -> Column:
    return F.array_contains(F.map_keys(tags), name)


def categories(tags: Column) -> dict[str, Column]:
    """The nine categories that a feature may count in, none of which excludes another."""
    among = lambda name, values: F.coalesce(tag(tags, name).isin(values), F.lit(False))
    return {
        "building": has(tags, "building"),
        "road": has(tags, "highway"),
        "railway": has(tags, "railway"),
        "water": has(tags, "waterway") | has(tags, "water") | among("natural", WATER),
        "vegetation": among("natural", GREEN_NATURAL) | among("landuse", GREEN_LANDUSE) | among("leisure", GREEN_LEISURE),
        "residential": among("landuse", ["residential"]),
        "industrial_commercial": among("landuse", BUSINESS),
        "construction": among("landuse", ["construction"]) | among("building", ["construction"]),
        "amenity": has(tags, "amenity"),
    }


def category_counts(df: DataFrame, by: list[str], tags: str = "tags") -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in categories(F.col(tags)).items()], F.count(F.col(tags)).alias("features"))


def feature_blends(here: dict[str, Column], c: dict[str, Column]) -> list[Column]:
    """Four capped counts and three blends of presences and counts."""
    # The caps and weights below.
    one = lambda x: F.least(F.lit(1.0), x)
    buildings, water, green = (one(c[n] / F.lit(float(cap))) for n, cap in (("building", 120), ("water", 30), ("vegetation", 60)))
    transport = one((c["road"] + c["railway"]) / F.lit(180.0))
    built = one(0.55 * here["building"] + 0.25 * here["residential"] + 0.20 * here["industrial_commercial"] + 0.35 * buildings)
    network = one(0.55 * here["road"] + 0.20 * here["railway"] + 0.25 * transport)
    urban = one(0.50 * built + 0.30 * network - 0.20 * here["water"] - 0.10 * here["vegetation"] + 0.25 * here["construction"])
    return [buildings, transport, water, green, built, network, urban]


def structure_vector(c: dict[str, Column]) -> list[Column]:
    """The 16 numbers of a summary: nine presences, four capped counts, three blends, the last not below 0."""
    here = {n: (c[n] > 0).cast("double") for n in LABELS}
    *first, urban = feature_blends(here, c)
    return [*here.values(), *first, F.greatest(F.lit(0.0), urban)]


# Words that tell of a kind of feature.
KEYWORDS = {
    "building": ["building", "built-up", "built up", "residential", "industrial"], "road": ["road", "transport", "highway", "street"], "railway": ["railway", "rail"], "water": ["water", "river", "wetland"],
    "vegetation": ["vegetation", "forest", "wood", "park", "green"], "residential": ["residential", "neighborhood", "neighbourhood"], "industrial_commercial": ["industrial", "commercial"], "construction": ["construction"], "amenity": ["amenity", "parking"],
}


def keyword_array(text: Column, counts: dict[str, Column]) -> Column:
    """The same 16 numbers, as an array, from a text and, where there are any, counts: a kind is present if a word of it is in the text or it is counted.

    The text is put in lower case once and searched once for each kind, with plain comparisons, as the words are fixed.
    """
    c = {n: F.greatest(F.coalesce(counts[n].cast("double"), F.lit(0.0)), F.lit(0.0)) if n in counts else F.lit(0.0) for n in LABELS}
    said = lambda low, n: functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in KEYWORDS[n]))
    found = once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(*[(said(low, n) | (c[n] > 0)).cast("double") for n in LABELS]))

    def vector(v: Column) -> Column:
        here = {n: v[i] for i, n in enumerate(LABELS)}
        return F.array(*here.values(), *feature_blends(here, c))

    return once(found, vector)


def keyword_vector(text: Column, counts: dict[str, Column]) -> list[Column]:
    """``keyword_array`` as 16 columns."""
    v = keyword_array(text, counts)
    return [v[i] for i in range(len(LABELS) + 7)]


def summary_sentence(c: dict[str, Column]) -> Column:
    parts = F.array_compact(F.array(*[F.when(c[n] > 0, F.concat(c[n].cast("string"), F.lit(" " + label))) for n, label in LABELS.items()]))
    return F.concat(F.lit("Historical OSM snapshot: "), F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("no matching mapped features"))


def top_values(df: DataFrame, by: list[str], order: str, tags: str = "tags", k: int = 10) -> DataFrame:
    """The k most frequent values of each tag family of each group; ties by first appearance in ``order``."""
    long = df.select(*by, order, F.explode(F.map_filter(tags, lambda n, v: n.isin(FAMILIES))).alias("family", "value"))
    n = long.groupBy(*by, "family", "value").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*by, "family").orderBy(F.desc("n"), "_first"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k).drop("_first")


def tile_summary(features: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """A row per tile, empty ones too: counts, vector, sentence, features. Counting comes before the join back to all tiles."""
    pairs = spatial_join(features, tiles, cell).join(features.select("feature_id", "tags"), "feature_id")
    counts = category_counts(pairs, ["tile_id"])
    all_ = tiles.select("tile_id").join(counts, "tile_id", "left").fillna(0)
    c = {n: F.col(n) for n in LABELS}
    return all_.select("tile_id", *LABELS, F.array(*structure_vector(c)).alias("vector"), summary_sentence(c).alias("sentence"), "features")


def spatial_channels(tags: Column) -> Column:
    """Which of the five channels (building, transport, water, vegetation, land use) a feature is drawn in."""
    k = categories(tags)
    among = lambda name, values: F.coalesce(tag(tags, name).isin(values), F.lit(False))
    tests = [
        k["building"],
        k["road"] | k["railway"] | has(tags, "public_transport"),
        k["water"],
        k["vegetation"] | among("landuse", ["recreation_ground"]),
        has(tags, "landuse") | has(tags, "amenity") | has(tags, "leisure"),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))


def geometry_parts(df: DataFrame, geometry: str, keep: list[str]) -> DataFrame:
    """A row per part of each GeoJSON text: its kind (polygon, line, point) and the points of its outer ring or line.

    Collections are opened one level; holes are dropped.
    """
    g = F.col(geometry)
    members = F.when(F.get_json_object(g, "$.type") == "GeometryCollection", F.from_json(F.get_json_object(g, "$.geometries"), "array<string>")).otherwise(F.array(g))
    d = df.select(*keep, F.posexplode(members).alias("member", "_g"))
    kind, co = F.get_json_object("_g", "$.type"), F.get_json_object("_g", "$.coordinates")
    ring, line = "array<array<array<double>>>", "array<array<double>>"
    first = lambda a: F.slice(a, 1, 1)
    lists = (
        F.when(kind == "Polygon", first(F.from_json(co, ring)))
        .when(kind == "MultiPolygon", F.transform(F.from_json(co, f"array<{ring}>"), lambda p: p[0]))
        .when(kind == "LineString", F.array(F.from_json(co, line)))
        .when(kind == "MultiLineString", F.from_json(co, ring))
        .when(kind == "Point", F.array(F.array(F.from_json(co, "array<double>"))))
        .when(kind == "MultiPoint", F.transform(F.from_json(co, line), lambda p: F.array(p)))
    )
    shape = F.when(kind.endswith("Polygon"), "polygon").when(kind.endswith("LineString"), "line").otherwise("point")
    return d.select(*keep, "member", shape.alias("kind"), F.posexplode(lists).alias("part", "points"))


#: A pixel centre lies on a border that is nearer than this.
ON = 1e-9


def _reach(p: Column, q: Column, y: Column, r: float) -> list[Column]:
    """Intervals of x, of which the hull is where row y is within r of the segment p to q: about both ends, and beside the segment. Null ones don't count."""
    dx, dy = q[0] - p[0], q[1] - p[1]
    size = dx * dx + dy * dy
    v, limit = y - p[1], F.lit(r) * F.sqrt(size)

    def disc(c: Column) -> Column:
        half = F.sqrt(F.lit(r * r) - (y - c[1]) ** 2)
        return F.when(F.abs(y - c[1]) <= r, F.struct((c[0] - half).alias("a"), (c[0] + half).alias("b")))

    def span(over: Column, a: Column, b: Column, holds: Column) -> tuple[Column, Column]:
        """Where a linear condition on x holds: between a and b if it depends on x, else everywhere or nowhere (null)."""
        none = F.when(holds, F.lit(float("inf")))
        return F.when(over, F.least(a, b)).otherwise(-none), F.when(over, F.greatest(a, b)).otherwise(none)

    across = F.nullif(dy, F.lit(0.0))
    along = F.nullif(dx, F.lit(0.0))
    a0, b0 = span(dy != 0, (v * dx - limit) / across, (v * dx + limit) / across, F.abs(v * dx) <= limit)
    a1, b1 = span(dx != 0, -v * dy / along, (size - v * dy) / along, (v * dy >= 0) & (v * dy <= size))
    a, b = F.when(a0.isNotNull() & a1.isNotNull(), F.greatest(a0, a1)), F.least(b0, b1)
    return [disc(p), disc(q), F.when((size > 0) & (a <= b), F.struct((p[0] + a).alias("a"), (p[0] + b).alias("b")))]


def burn_in(parts: DataFrame, height: int, width: int, keys: list[str]) -> DataFrame:
    """Pixels that parts cover, in pixel coordinates: ``points`` of (x, y) from 0 to width - 1 and height - 1.

    Polygons are filled by the even-odd rule at pixel centres, borders included; lines have width
    max(1, round(min(height, width) / 128)); points are discs.

    By scan lines: each edge is met by the pixel rows that it spans and by no other. There it gives a
    crossing (of a polygon's inside) or a run of pixels (of a border, a line, a disc); a row's crossings,
    in order, are runs by pairs. Only runs become pixels. Parts that repeat are drawn once.
    """
    line = max(1, round(min(height, width) / 128))
    d = parts.select(*keys, "kind", F.transform("points", lambda p: F.array(p[0].cast("double"), p[1].cast("double"))).alias("points")).where(F.size("points") > 0).distinct()
    d = d.withColumn("_id", F.sha2(F.to_json(F.struct("kind", "points")), 256))
    polygon = (F.col("kind") == "polygon") & (F.size("points") >= 2)
    alone = F.size("points") < 2
    reach = F.when(polygon, F.lit(ON)).when(alone, F.lit(float(line))).otherwise(F.lit(line / 2.0))
    ends = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(1))), F.when(alone, F.col("points")).otherwise(F.slice("points", 2, F.size("points"))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    edges = d.select(*keys, "_id", polygon.alias("_polygon"), reach.alias("_r"), F.inline(ends))
    low, high = F.least(F.col("p")[1], F.col("q")[1]) - F.col("_r"), F.greatest(F.col("p")[1], F.col("q")[1]) + F.col("_r")
    y0, y1 = F.greatest(F.ceil(low), F.lit(0)).cast("int"), F.least(F.floor(high), F.lit(height - 1)).cast("int")
    rows = edges.withColumns({"_y0": y0, "_y1": y1}).where("_y0 <= _y1").withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    p, q, y = F.col("p"), F.col("q"), F.col("y").cast("double")

    run = lambda a, b: (F.greatest(F.ceil(a), F.lit(0)).cast("int"), F.least(F.floor(b), F.lit(width - 1)).cast("int"))
    hull = lambda r: F.array_compact(F.array(*_reach(p, q, y, r)))
    near = F.when(F.col("_polygon"), hull(ON)).when(F.col("_r") == line, hull(float(line))).otherwise(hull(line / 2.0))
    touched = rows.withColumn("_h", near).where(F.size("_h") > 0)
    a, b = F.array_min(F.transform("_h", lambda h: h["a"])), F.array_max(F.transform("_h", lambda h: h["b"]))
    x0, x1 = run(a - ON, b + ON)
    borders = touched.select(*keys, "y", x0.alias("x0"), x1.alias("x1"))

    crossing = (q[0] - p[0]) * (y - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0]
    cut = rows.where(F.col("_polygon") & ((p[1] > y) != (q[1] > y))).groupBy(*keys, "_id", "y").agg(F.sort_array(F.collect_list(crossing)).alias("_c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_c") - 1, F.lit(2)), lambda i: F.struct(F.element_at("_c", i).alias("a"), F.element_at("_c", i + 1).alias("b")))
    filled = cut.where(F.size("_c") >= 2).select(*keys, "y", F.inline(pairs))
    x0, x1 = run(F.col("a"), F.ceil("b") - 1)  # from a on, before b
    runs = borders.unionByName(filled.select(*keys, "y", x0.alias("x0"), x1.alias("x1"))).where("x0 <= x1").distinct()
    return runs.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x")).distinct()


def apply_gates(vector: Column, gates: Column) -> Column:
    """The 16 numbers times their category's gate; blends take the greatest of theirs. Gates that are NaN or infinite are 0."""
    clean = F.transform(gates, lambda g: F.when(g.isNull() | F.isnan(g) | (F.abs(g) == float("inf")), F.lit(0.0)).otherwise(F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))))
    b, t, w, v, u = (clean[i] for i in range(5))
    per = F.array(b, t, t, w, v, u, u, u, u, b, t, w, v, F.greatest(b, u), t, F.greatest(b, t, u))
    return F.zip_with(vector, per, lambda a, g: a * g)


def gate_problems(df: DataFrame, key: str, gates: str = "gates", similarities: str = "similarities", confidence: str = "confidence") -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    share = lambda x: bad(x) | (x < 0) | (x > 1)
    rules = F.array_compact(
        F.array(
            F.when((F.size(gates) != 5) | F.exists(gates, share), "gates"), F.when((F.size(similarities) != 5) | F.exists(similarities, bad), "similarities"), F.when(share(F.col(confidence)), "confidence")
        )
    )
    return df.select(key, F.explode(rules).alias("problem"))


def reliability(stored: Column, geometry: Column, semantics: Column) -> tuple[Column, Column]:
    """Reliability of a context, and that of its geometry: 0 unless the geometry is exact."""
    kind = F.lower(F.coalesce(geometry, F.lit("geometry")))
    value = F.least(F.greatest(F.coalesce(stored, F.when(kind == "geometry", 0.75).otherwise(0.5)), F.lit(0.0)), F.lit(1.0))
    exact = (kind == "geometry") & (F.coalesce(semantics, F.lit("")) != "feature_bounding_boxes_not_exact_geometries")
    return value, F.when(exact, value).otherwise(F.lit(0.0))


def extraction_problems(df: DataFrame, key: str = "feature_id") -> DataFrame:
    """Features that break a rule of an extraction: id form, repeated id, id against type, no tags, geometry without box, box off the query's."""
    n = F.count(F.lit(1)).over(Window.partitionBy("osm_id"))
    b = geometry_bbox(F.col("geometry"))
    q = {k: F.col(f"q{k}") for k in "wsen"}
    d = df.withColumn("_n", n).withColumn("_b", b)
    rules = F.array_compact(
        F.array(
            F.when(~F.col("osm_id").rlike(r"^(node|way|relation)/[0-9]+$"), "id_form"), F.when(F.col("_n") > 1, "repeated"), F.when(F.split("osm_id", "/")[0] != F.col("osm_type"), "type"), F.when(F.size("tags") < 1, "no_tags"),
            F.when(F.col("_b").isNull(), "no_geometry"), F.when(~boxes_meet({k: F.col(f"_b.{k}") for k in "wsen"}, q), "outside"),
        )
    )
    return d.select(key, F.explode(rules).alias("problem"))
