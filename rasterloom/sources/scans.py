"""Scans and sinks: caption corpora, listings, shards, manifests, features, archives, logs and reports.

Every scan reads through Spark's readers alone, so any store that Spark knows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions.scalars import sample_key
from rasterloom.functions.storage import checkpointed
from rasterloom.operators.captions import not_blank, numbered
from rasterloom.sources.json_parts import json_elements

IMAGE = "struct<filename:string,imgid:bigint,split:string,sentences:array<struct<raw:string>>>"
#: Which shard serves which split of a caption data set: those that differ from "<name>_<split>" (fixed values).
SHARD_EXCEPTIONS = {("coco", "val"): "coco_test"}
WITHOUT_VAL = {"sbu", "vg"}


def caption_corpus(spark: SparkSession, path: str, prefix: str, keep_blank: bool = True) -> DataFrame:
    """Files of ``{"images": [{filename, imgid, split, sentences: [{raw}]}]}``: a row per image with its captions. A file may have any size."""
    found, _, _ = json_elements(spark, path, 2)
    d = found.where("outer = 'images'").select(F.from_json("element", IMAGE).alias("i")).select("i.*")
    caps = F.transform("sentences", lambda s: s["raw"])
    if not keep_blank:
        caps = F.filter(caps, not_blank)
    return d.select(F.concat(F.lit(prefix), F.col("imgid").cast("string")).alias("image_id"), "filename", "split", caps.alias("captions"))


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths, names, stems and sizes of files; contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length")
    return with_names(f)


def with_names(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def listed_with_annotations(files: DataFrame, annotations: DataFrame, name: str = "filename") -> tuple[DataFrame, DataFrame]:
    """Files that have an annotation, and one row of counts: files, matched, annotated."""
    a = annotations.withColumnRenamed(name, "name")
    f, g = files.select("name", F.lit(1).alias("_f")), a.select("name", F.lit(1).alias("_a"))
    counts = f.join(g, "name", "full_outer").agg(F.count("_f").alias("files"), F.count_if(F.col("_f").isNotNull() & F.col("_a").isNotNull()).alias("matched"), F.count("_a").alias("annotated"))
    return files.join(a, "name"), counts


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return with_names(files).select("name", "content")


def image_archives(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the files that archives hold: Parquet shards of (name, content), of which a folder may have any number."""
    return spark.read.schema("name string, content binary").parquet(path)


def write_image_archives(files: DataFrame, path: str, shards: int) -> None:
    """Files (name, content) in ``shards`` archives, dealt by name."""
    files.select("name", "content").repartition(shards, "name").write.parquet(path)


def write_image_table(files: DataFrame, annotations: DataFrame, out: str) -> None:
    """Bytes of images (name, content) with their captions, one folder a split."""
    files.join(annotations, files.name == annotations.filename).select("content", "captions", "image_id", "split").write.partitionBy("split").mode("overwrite").parquet(out)


def export_captions(corpus: DataFrame, out: str) -> None:
    """Training split: a row per caption; the others: a row per image with its captions."""
    t = corpus.where("split = 'train'").select("split", "image_id", "filename", F.posexplode("captions").alias("pos", "caption"))
    t.write.partitionBy("split").mode("overwrite").json(f"{out}/train")
    corpus.where("split <> 'train'").write.partitionBy("split").mode("overwrite").json(f"{out}/eval")


def load_shards(spark: SparkSession, path: str, shards: list[str]) -> DataFrame:
    """The shards of a list that exist, with promoted schemas, each row tagged by its own shard."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for s in shards:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{s}")
        if p.getFileSystem(conf).exists(p):
            there.append(spark.read.parquet(f"{path}/{s}").withColumn("shard", F.lit(s)))
    if not there:
        raise ValueError("none of the shards exists")
    out = there[0]
    for d in there[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def shard_catalogue(spark: SparkSession, names: list[str]) -> DataFrame:
    """(dataset, split, shard) of each data set; some serve val from test, some have no val and test."""
    rows = [(n, s, SHARD_EXCEPTIONS.get((n, s), f"{n}_{s}")) for n in names for s in ("train", "val", "test") if s == "train" or n not in WITHOUT_VAL]
    each = [F.struct(F.lit(a).alias("dataset"), F.lit(b).alias("split"), F.lit(c).alias("shard")) for a, b, c in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


RECORD = "filename string, source_pair_id string, split string, status string, valid_fraction double"


def manifest(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    """Manifests in any of three layouts: {"samples": [...]}, {"records": [...]} or an object keyed by name.

    A manifest may have any size. Keys are normalised; a missing source_pair_id is the key, a missing split the key's. Repeated keys are an error.
    """
    one = f"struct<{','.join(c.strip().replace(' ', ':', 1) for c in record.split(','))}>"
    found, _, _ = json_elements(spark, path, None)
    lists = found.where("level = 2 AND outer IN ('samples', 'records')").select(F.from_json("element", one).alias("r")).select("r.*")
    maps = found.where("level = 1").select(F.explode(F.from_json(F.concat(F.lit("{"), "element", F.lit("}")), f"map<string,{one}>")).alias("k", "v")).select("k", "v.*")
    maps = maps.withColumn("filename", F.coalesce("filename", "k")).drop("k")
    both = lists.unionByName(maps).withColumn("key", sample_key(F.col("filename"), strict=True))
    both = both.withColumn("source_pair_id", F.coalesce("source_pair_id", "key")).withColumn("split", F.coalesce("split", F.split("key", "_")[0]))
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    checked = both.withColumn("_n", n)
    return checked.withColumn("key", F.when(F.col("_n") == 1, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("repeated key "), "key")))).drop("_n")


def coordinate_table(spark: SparkSession, path: str) -> DataFrame:
    """Objects of name to [w, n, e, s], of any size: key and box."""
    found, _, _ = json_elements(spark, path, 1)
    m = found.select(F.explode(F.from_json(F.concat(F.lit("{"), "element", F.lit("}")), "map<string,array<double>>")).alias("name", "c"))
    return m.select(sample_key(F.col("name")).alias("key"), F.col("c")[0].alias("w"), F.col("c")[3].alias("s"), F.col("c")[2].alias("e"), F.col("c")[1].alias("n"))


def missing_and_extra(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    a = expected.join(found, key, "left_anti").select(key, F.lit("missing").alias("state"))
    return a.unionByName(found.join(expected, key, "left_anti").select(key, F.lit("extra").alias("state")))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature of FeatureCollections of any size, ordered by block and n within a path; geometry stays GeoJSON text. Anything else is an error."""
    found, members, paths = json_elements(spark, path, 2)
    kinds = members.select("path", F.from_json(F.concat(F.lit("{"), "member", F.lit("}")), "map<string,string>")["type"].alias("type")).groupBy("path").agg(F.max(F.col("type") == "FeatureCollection").alias("ok"))
    checked = paths.join(kinds, "path", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    bad = F.raise_error(F.concat(F.lit("no FeatureCollection: "), "path"))
    f = found.where("outer = 'features'").join(checked.where("ok").select("path"), "path")
    out = f.select("path", "block", "n", F.from_json(F.get_json_object("element", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object("element", "$.geometry").alias("geometry"))
    wrong = checked.where("NOT ok").select(bad.cast("string").alias("path"), *[F.lit(None).cast(x.dataType).alias(x.name) for x in out.schema.fields[1:]])
    return out.unionByName(wrong)


def aligned_triples(a: DataFrame, b: DataFrame, label: DataFrame) -> DataFrame:
    """Stems that all three listings have, with the three paths."""
    return a.select("stem", F.col("path").alias("a")).join(b.select("stem", F.col("path").alias("b")), "stem").join(label.select("stem", F.col("path").alias("label")), "stem")


PROTOCOL = {"protocol_name": "tile256_stride128", "tile_size": 256, "tile_stride": 128, "blend": "hann", "threshold_stage": "after_stitching"}


def write_scene_archive(stitched: DataFrame, out: str, protocol: dict = PROTOCOL) -> None:
    """Stitched pixels as rows of arrays, one per scene row, with the protocol beside them, a folder a split."""
    r = stitched.groupBy("split", "scene_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "prob", "truth", "weight_sum", "coverage"))).alias("_a"))
    cols = [F.col(f"_a.{c}").alias(c) for c in ("prob", "truth", "weight_sum", "coverage")]
    r.select("split", "scene_id", "y", *cols, *[F.lit(v).alias(k) for k, v in protocol.items()]).write.partitionBy("split").mode("overwrite").parquet(out)


def read_scene_archive(spark: SparkSession, path: str, split: str, protocol: dict = PROTOCOL) -> DataFrame:
    """Pixels of one split. Rows of another protocol, or with arrays of unequal length, are an error."""
    d = spark.read.parquet(path).where(F.col("split") == split)
    ok = (F.size("prob") == F.size("truth")) & (F.size("prob") == F.size("weight_sum")) & (F.size("prob") == F.size("coverage"))
    for k, v in protocol.items():
        ok = ok & (F.col(k) == v)
    d = d.withColumn("y", F.when(ok, F.col("y")).otherwise(F.raise_error(F.concat(F.lit("scene archive of another protocol: "), F.col("scene_id").cast("string"))).cast("int")))
    return d.select("split", "scene_id", "y", F.posexplode(F.arrays_zip("prob", "truth", "weight_sum", "coverage")).alias("x", "v")).select("split", "scene_id", "y", "x", "v.*")


def write_report(metrics: DataFrame, scenes: DataFrame, out: str) -> None:
    """Split metrics as JSON, scenes as CSV with a header."""
    metrics.write.mode("overwrite").json(f"{out}/metrics")
    scenes.write.mode("overwrite").option("header", True).csv(f"{out}/scenes")


def merge_submissions(spark: SparkSession, pattern: str, schema: str, out: str, order: str = "image_id") -> None:
    """Per-worker JSON parts as one ordered submission: rows rise within each file, and files from name to name."""
    spark.read.schema(schema).json(pattern).dropDuplicates().orderBy(order).write.mode("overwrite").json(out)


def log_lines(spark: SparkSession, path: str, metrics: list[str], stream: bool = False) -> DataFrame:
    """JSON-lines logs, whose numbers may be texts: (run, step, metric, value), batch or stream."""
    schema = "run bigint, step bigint, " + ", ".join(f"`{m}` string" for m in metrics)
    d = (spark.readStream if stream else spark.read).schema(schema).json(path)
    return d.select("run", "step", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])).alias("v")).select("run", "step", "v.metric", "v.value").where("value IS NOT NULL")


def date_view(samples: DataFrame, key: str, date: str) -> DataFrame:
    """One date's record of every sample, flat."""
    return samples.select(key, f"{date}.*")


def checksums(df: DataFrame, content: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.sha2(content, 256).alias("sha256"))


def checksum_mismatches(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    d = declared.select(key, F.lower("sha256").alias("declared"))
    return d.join(found, key, "left").where(~F.col("sha256").eqNullSafe(F.col("declared"))).select(key, "declared", F.col("sha256").alias("found"))


def provenance(tiles: DataFrame, by: str, tile: str, source: str, each: int = 4096) -> DataFrame:
    """Per split: sources, tiles, and a digest of the ordered tile names.

    The digest is a tree's: the SHA-256 of ``each`` names in order, joined by newlines, then of ``each``
    such digests, twice at least and until a split has one. So no row or task has all names of a split.
    """
    at = numbered(tiles.select(F.col(by).alias("_by"), F.col(tile).alias("_h")), ["_by", "_h"], "_n")
    first = at.groupBy(F.col("_by").alias("_own")).agg(F.min("_n").alias("_first"))
    level = at.join(first, F.col("_by").eqNullSafe(F.col("_own"))).select("_by", (F.col("_n") - F.col("_first")).alias("_n"), "_h")
    done = 0
    while done < 2 or level.where("_n > 0").limit(1).count():
        names = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_h"))), lambda x: x["_h"])
        # A first group of one row is all that its split has.
        alone = F.lit(done >= 2) & (F.col("_m") == 0) & (F.size("_names") == 1)
        level = level.groupBy("_by", F.floor(F.col("_n") / each).alias("_m")).agg(names.alias("_names"))
        level = checkpointed(level.select("_by", F.col("_m").alias("_n"), F.when(alone, F.col("_names")[0]).otherwise(F.sha2(F.array_join("_names", "\n"), 256)).alias("_h")))
        done += 1
    counts = tiles.groupBy(by).agg(F.countDistinct(source).alias("sources"), F.count(F.lit(1)).alias("tiles"))
    return counts.join(level, F.col(by).eqNullSafe(F.col("_by"))).select(by, "sources", "tiles", F.col("_h").alias("digest"))
