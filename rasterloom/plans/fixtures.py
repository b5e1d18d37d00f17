"""Views that give the operators input from the driver's tables, for Spark, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.series import placed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(c: Column, n: int = 10) -> Column:
    r = c % n
    return F.when(r < 6, "train").when(r < 8, "val").otherwise("test")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, i (place from 0) and v (double) of every element of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select(
        F.col("vec_id").alias("scene_id"),
        F.expr("cast(i div 8 as int)").alias("y"),
        (F.col("i") % 8).alias("x"),
        F.least(F.greatest(F.lit(0.5) + F.col("v"), F.lit(0.0)), F.lit(1.0)).cast("float").alias("prob"),
        (F.col("v") + ((F.col("vec_id") * 31 + F.col("i") * 17) % 7 - 3).cast("double") * F.lit(0.03) > F.lit(0.05)).alias("truth"),
        split_of(F.col("vec_id")).alias("split"),
    )


def px64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of 64 vectors, 8 by 8; those that the last one lacks, 63 at most, are the table's first again."""
    p = pixels(spark, sf_dir).select("vec_id", "i", "v")
    n = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    rest = n.where("n % 64 > 0").select("n", F.explode(F.expr("sequence(n, n - n % 64 + 63)")).alias("new")).withColumn("vec_id", F.col("new") % F.col("n"))
    again = p.join(F.broadcast(rest), "vec_id").select(F.col("new").alias("vec_id"), "i", "v")
    return p.unionByName(again).select(
        F.expr("cast(vec_id div 64 as bigint)").alias("scene_id"),
        F.expr("cast(((vec_id % 64) div 8) * 8 + i div 8 as int)").alias("y"),
        F.expr("cast((vec_id % 8) * 8 + i % 8 as int)").alias("x"),
        F.col("v"),
    )


def tiles16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-pixel tiles at stride 8 of px64, in rows of pixels: each tile adds its own small offset to the probability."""
    p = px64(spark, sf_dir)
    starts = F.array_distinct(F.array(*[F.lit(i) for i in range(0, 49, 8)]))
    t = p.withColumn("ty", F.explode(starts)).where("y BETWEEN ty AND ty + 15").withColumn("tx", F.explode(starts)).where("x BETWEEN tx AND tx + 15")
    prob = F.least(F.greatest(F.lit(0.5) + F.col("v") + ((F.col("ty") * 7 + F.col("tx") * 3) % 5).cast("double") * F.lit(0.01), F.lit(0.0)), F.lit(1.0))
    return t.select("scene_id", "ty", "tx", (F.col("y") - F.col("ty")).alias("dy"), (F.col("x") - F.col("tx")).alias("dx"), prob.alias("prob"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("px"),
        F.to_date("l_shipdate").alias("acquired"),
        F.when(F.col("l_returnflag") == "A", "LANDSAT_5").when(F.col("l_returnflag") == "N", "LANDSAT_7").otherwise("LANDSAT_8").alias("sensor"),
        (F.lit(7300.0) + F.lit(200.0) * F.col("l_quantity")).alias("raw_green"),
        (F.lit(7300.0) + F.lit(100000.0) * F.col("l_discount")).alias("raw_red"),
        (F.lit(7300.0) + F.lit(100000.0) * F.col("l_tax")).alias("raw_nir"),
        F.when(F.col("l_orderkey") % 5 == 0, F.col("l_orderkey") % 64).otherwise(0).cast("int").alias("qa_pixel"),
        F.when(F.col("l_suppkey") % 7 == 0, F.col("l_suppkey")).otherwise(0).cast("int").alias("qa_radsat"),
        split_of(F.col("l_suppkey")).alias("split"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map features from parts: a box on the unit square, tags by type and brand."""
    p = table(spark, sf_dir, "part")
    west, south = (F.col("p_partkey") * 37 % 1000) / F.lit(1000.0), (F.col("p_partkey") * 91 % 1000) / F.lit(1000.0)
    size = F.col("p_size") / F.lit(1000.0)
    kinds = ["building", "highway", "railway", "waterway", "natural", "landuse", "amenity"]
    values = {"natural": "wood", "landuse": "residential", "amenity": "school", "building": "yes", "highway": "primary", "railway": "rail", "waterway": "river"}
    family = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 7 + 1).cast("int"))
    value = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), family)
    tagged = F.when(F.col("p_size") % 3 == 0, F.lit("construction")).otherwise(value)
    return p.select(
        F.col("p_partkey").alias("feature_id"), west.alias("w"), south.alias("s"), (west + size).alias("e"), (south + size).alias("n"), F.create_map(family, tagged).alias("tags"), family.alias("family"), tagged.alias("value")
    )


def map_tiles(spark: SparkSession) -> DataFrame:
    t = spark.range(64).select(F.col("id").alias("tile_id"), F.expr("(id % 8) * 0.125D").alias("tw"), F.expr("(id div 8) * 0.125D").alias("ts"))
    return t.withColumn("te", F.col("tw") + F.lit(0.125)).withColumn("tn", F.col("ts") + F.lit(0.125))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("image_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("captions"), split_of(F.col("doc_id")).alias("split"))


def date_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each order: key split_index, region, month, status and valid fraction."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "ok_partial").otherwise("failed_retryable")
    split = split_of(F.col("o_orderkey"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(split, F.lit("_"), F.col("o_orderkey").cast("string")).alias("key"),
        split.alias("split"),
        F.col("c_nationkey").cast("int").alias("region_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        status.alias("status"),
        (F.floor(F.col("o_totalprice")).cast("long") % 1001 / F.lit(1000.0)).alias("valid_fraction"),
        F.col("o_custkey").alias("owner"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("metric"), "ts", "event_id", "value")
    return placed(e, ["run", "metric"], ["ts", "event_id"], "at").select("run", "metric", (F.col("at") + 1).cast("int").alias("step"), "value")


_SPLIT = "CASE WHEN {0} % 10 < 6 THEN 'train' WHEN {0} % 10 < 8 THEN 'val' ELSE 'test' END"
SQL = {
    "pixels": "SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "px8": f"""SELECT vec_id AS scene_id, CAST(i // 8 AS INT) AS y, i % 8 AS x, CAST(least(greatest(CAST(0.5 AS DOUBLE) + v, 0), 1) AS FLOAT) AS prob,
        v + CAST((vec_id * 31 + i * 17) % 7 - 3 AS DOUBLE) * CAST(0.03 AS DOUBLE) > CAST(0.05 AS DOUBLE) AS truth, {_SPLIT.format('vec_id')} AS split FROM pixels""",
    "px64": """SELECT vec_id // 64 AS scene_id, CAST(((vec_id % 64) // 8) * 8 + i // 8 AS INT) AS y, CAST((vec_id % 8) * 8 + i % 8 AS INT) AS x, v
        FROM (SELECT vec_id, i, v FROM pixels UNION ALL SELECT id, i, v FROM (SELECT n, unnest(range(n, (n + 63) // 64 * 64)) AS id FROM (SELECT max(vec_id) + 1 AS n FROM embeddings)) JOIN pixels ON vec_id = id % n)""",
    "tiles16": """SELECT scene_id, ty, tx, y - ty AS dy, x - tx AS dx,
        least(greatest(CAST(0.5 AS DOUBLE) + v + CAST((ty * 7 + tx * 3) % 5 AS DOUBLE) * CAST(0.01 AS DOUBLE), 0), 1) AS prob
        FROM px64, (SELECT CAST(unnest([0,8,16,24,32,40,48]) AS INT) AS ty), (SELECT CAST(unnest([0,8,16,24,32,40,48]) AS INT) AS tx)
        WHERE y BETWEEN ty AND ty + 15 AND x BETWEEN tx AND tx + 15""",
    "obs": f"""SELECT l_partkey AS px, CAST(l_shipdate AS DATE) AS acquired,
        CASE l_returnflag WHEN 'A' THEN 'LANDSAT_5' WHEN 'N' THEN 'LANDSAT_7' ELSE 'LANDSAT_8' END AS sensor,
        7300 + 200 * l_quantity AS raw_green, 7300 + 100000 * l_discount AS raw_red, 7300 + 100000 * l_tax AS raw_nir,
        CAST(CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 64 ELSE 0 END AS INT) AS qa_pixel,
        CAST(CASE WHEN l_suppkey % 7 = 0 THEN l_suppkey ELSE 0 END AS INT) AS qa_radsat, {_SPLIT.format('l_suppkey')} AS split FROM lineitem""",
    "features": """SELECT feature_id, w, s, w + size AS e, s + size AS n, family,
        CASE WHEN p_size % 3 = 0 THEN 'construction' ELSE CASE family WHEN 'natural' THEN 'wood' WHEN 'landuse' THEN 'residential' WHEN 'amenity' THEN 'school'
          WHEN 'building' THEN 'yes' WHEN 'highway' THEN 'primary' WHEN 'railway' THEN 'rail' ELSE 'river' END END AS value
        FROM (SELECT p_partkey AS feature_id, (p_partkey * 37 % 1000) / CAST(1000 AS DOUBLE) AS w, (p_partkey * 91 % 1000) / CAST(1000 AS DOUBLE) AS s, p_size / CAST(1000 AS DOUBLE) AS size, p_size,
          ['building','highway','railway','waterway','natural','landuse','amenity'][CAST(p_partkey % 7 + 1 AS INT)] AS family FROM part)""",
    "map_tiles": """SELECT tile_id, tw, ts, tw + CAST(0.125 AS DOUBLE) AS te, ts + CAST(0.125 AS DOUBLE) AS tn FROM
        (SELECT range AS tile_id, (range % 8) * CAST(0.125 AS DOUBLE) AS tw, (range // 8) * CAST(0.125 AS DOUBLE) AS ts FROM range(64))""",
    "captions": f"SELECT doc_id AS image_id, string_split(coalesce(text, ''), chr(10)) AS captions, {_SPLIT.format('doc_id')} AS split FROM documents",
    "date_records": f"""SELECT o_orderkey AS id, {_SPLIT.format('o_orderkey')} || '_' || CAST(o_orderkey AS VARCHAR) AS key, {_SPLIT.format('o_orderkey')} AS split,
        CAST(c_nationkey AS INT) AS region_id, strftime(o_orderdate, '%Y-%m') AS month,
        CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'ok_partial' ELSE 'failed_retryable' END AS status,
        (CAST(floor(o_totalprice) AS BIGINT) % 1001) / CAST(1000 AS DOUBLE) AS valid_fraction, o_custkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey""",
    "logs": """SELECT run, metric, CAST(row_number() OVER (PARTITION BY run, metric ORDER BY ts, event_id) AS INT) AS step, value
        FROM (SELECT user_id % 5 AS run, event_type AS metric, ts, event_id, value FROM events)""",
}
_NEEDS = {"px8": ["pixels"], "px64": ["pixels"], "tiles16": ["pixels", "px64"]}


def sql(query: str, *views: str) -> str:
    """``query`` (its own WITH parts may follow the views) with the views it names before it."""
    names = list(dict.fromkeys(n for v in views for n in [*_NEEDS.get(v, []), v]))
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    query = query.strip()
    return f"WITH {head}, {query[5:]}" if query.startswith("WITH ") else f"WITH {head} {query}"


def pairs8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after values of 8 by 8 scenes: even vectors before, odd ones after."""
    p = pixels(spark, sf_dir)
    at = [F.expr("vec_id div 2").alias("scene_id"), F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x")]
    both = p.groupBy(*at).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("v"))).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("scene_id", "y", "x", (F.lit(0.5) + F.col("a")).alias("t1"), (F.lit(0.5) + F.col("b")).alias("t2"), (F.col("b") > 0.15).alias("label"))


SQL["pairs8"] = """SELECT a.vec_id // 2 AS scene_id, CAST(a.i // 8 AS INT) AS y, a.i % 8 AS x, CAST(0.5 AS DOUBLE) + a.v AS t1, CAST(0.5 AS DOUBLE) + b.v AS t2, b.v > CAST(0.15 AS DOUBLE) AS label
    FROM pixels a JOIN pixels b ON b.vec_id = a.vec_id + 1 AND a.i = b.i WHERE a.vec_id % 2 = 0"""
_NEEDS["pairs8"] = ["pixels"]
