"""Queries of scans, sinks and streams: each writes files derived from the tables, reads them back and is compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom.functions.storage import shared_folder
from rasterloom.operators.evaluation import at_least, evaluate_split
from rasterloom.plans import fixtures as fx
from rasterloom.plans.evaluation import METRICS, T, rounded
from rasterloom.sources import scans as sc
from rasterloom.streaming import series as st


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def dealt(df, key, least, each=5000):
    """``df`` with a group ``b`` for about ``each`` rows, ``least`` groups at least, and the number of groups: so no file grows with the table."""
    n = max(least, -(-df.count() // each))
    return df.withColumn("b", F.pmod(F.col(key), F.lit(n))), n


def corpus_files(spark, d):
    c = fx.captions(spark, d)
    one = F.struct(F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("filename"), F.col("image_id").alias("imgid"), "split", F.transform("captions", lambda t: F.struct(t.alias("raw"))).alias("sentences"))
    out = folder(spark)
    c, n = dealt(c, "image_id", 8, 1000)
    c.groupBy("b").agg(F.collect_list(one).alias("images")).select(F.to_json(F.struct("images")).alias("value")).repartition(n).write.text(out)
    return out


def corpus(spark, d):
    return sc.caption_corpus(spark, corpus_files(spark, d), "docs_")


def a1(spark, d):
    return corpus(spark, d).select("image_id", "filename", "split", F.size("captions").alias("n"), F.sha2(F.array_join("captions", "\n"), 256).alias("sha"))


def a2(spark, d):
    files = sc.with_names(fx.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("/data/img_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path")))
    ann = fx.captions(spark, d).where("image_id % 2 = 0").select(F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("filename"), "captions")
    return sc.listed_with_annotations(files, ann)[1]


def a3(spark, d):
    """Documents as image files in archives, about 64 MB each, read back as bytes."""
    c = fx.captions(spark, d).select("image_id", "captions", "split", F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("filename"))
    body = fx.table(spark, d, "documents").select(F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    images, out = folder(spark), folder(spark)
    size = body.agg(F.sum(F.length("content"))).first()[0] or 0
    sc.write_image_archives(body, images, 1 + size // (64 << 20))
    sc.write_image_table(sc.image_archives(spark, images), c, out)
    t = spark.read.parquet(out)
    return t.select("image_id", "split", F.size("captions").alias("captions"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha"))


def a4(spark, d):
    out = folder(spark)
    sc.export_captions(corpus(spark, d), out)
    t = spark.read.schema("split string, image_id string, pos int, caption string").json(f"{out}/train").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count("caption").alias("captions"))
    e = spark.read.schema("split string, image_id string, captions array<string>").json(f"{out}/eval").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("captions")).alias("captions"))
    return t.unionByName(e)


def a5(spark, d):
    out, e = folder(spark), fx.table(spark, d, "events")
    e.where("user_id % 3 = 0").select("event_id", "value").write.parquet(f"{out}/s0")
    e.where("user_id % 3 = 2").select("event_id", "value", "event_type").write.parquet(f"{out}/s2")
    return sc.load_shards(spark, out, ["s0", "s1", "s2"]).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count("event_type").alias("typed"))


def a6(spark, d):
    c = fx.captions(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    cat = sc.shard_catalogue(spark, ["coco", "sbu", "vg", "f30k", "nwpu"])
    return c.join(F.broadcast(cat), "split").select("dataset", "split", "shard", "images")


def a7(spark, d):
    r = fx.date_records(spark, d)
    rec = F.struct(F.concat("key", F.lit(".png")).alias("filename"), "status", "valid_fraction")
    out = folder(spark)
    r, n = dealt(r, "id", 5)
    r.where("id % 3 = 0").groupBy("b").agg(F.collect_list(rec).alias("samples")).select(F.to_json(F.struct("samples")).alias("value")).repartition(n).write.text(f"{out}/a")
    r.where("id % 3 = 1").groupBy("b").agg(F.collect_list(rec).alias("records")).select(F.to_json(F.struct("records")).alias("value")).repartition(n).write.text(f"{out}/b")
    pair = F.struct("key", F.struct("status", "valid_fraction"))
    r.where("id % 3 = 2").groupBy("b").agg(F.map_from_entries(F.collect_list(pair)).alias("m")).select(F.to_json("m").alias("value")).repartition(n).write.text(f"{out}/c")
    return rounded(sc.manifest(spark, [f"{out}/{x}" for x in "abc"]).select("key", "source_pair_id", "split", "status", "valid_fraction"), "valid_fraction")


def a8(spark, d):
    f = fx.features(spark, d)
    pair = F.struct(F.concat(F.lit("train_"), F.col("feature_id").cast("string"), F.lit(".png")), F.array("w", "n", "e", "s"))
    out = folder(spark)
    f, n = dealt(f, "feature_id", 4)
    f.groupBy("b").agg(F.map_from_entries(F.collect_list(pair)).alias("m")).select(F.to_json("m").alias("value")).repartition(n).write.text(out)
    return rounded(sc.coordinate_table(spark, out), "w", "s", "e", "n")


def a8_complete(spark, d):
    found = a8(spark, d).where("key NOT LIKE '%7'").select("key")
    want = fx.features(spark, d).where("feature_id % 11 <> 0").select(F.concat(F.lit("train_"), F.col("feature_id").cast("string")).alias("key"))
    return sc.missing_and_extra(found, want, "key")


def a9(spark, d):
    f = fx.features(spark, d)
    geo = F.struct(F.lit("Point").alias("type"), F.array("w", "s").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.map_concat("tags", F.create_map(F.lit("@osmId"), F.concat(F.lit("node/"), F.col("feature_id").cast("string")))).alias("properties"), geo.alias("geometry"))
    out = folder(spark)
    f, n = dealt(f, "feature_id", 6)
    f.groupBy("b").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).repartition(n).write.text(out)
    g = sc.geojson_features(spark, out)
    return g.select(F.element_at("properties", "@osmId").alias("osm_id"), F.size("properties").alias("n"), F.round(F.get_json_object("geometry", "$.coordinates[0]").cast("double"), 6).alias("x"))


def a10(spark, d):
    k = fx.date_records(spark, d).select("id", "key")
    part = lambda p, m: sc.with_names(k.where(f"id % {m} <> 0").select(F.concat(F.lit(f"/data/{p}/"), "key", F.lit(".png")).alias("path")))
    return sc.aligned_triples(part("A", 2), part("B", 3), part("label", 5)).select("stem", "label")


def a11(spark, d):
    px = fx.px8(spark, d).withColumns({"weight_sum": F.lit(1.5), "coverage": F.lit(2)})
    out = folder(spark)
    sc.write_scene_archive(px, out)
    r = sc.read_scene_archive(spark, out, "val")
    return rounded(evaluate_split(r, "val", 0.55), *METRICS)


def a12(spark, d):
    px, out = fx.px8(spark, d), folder(spark)
    scenes = px.groupBy("scene_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if("truth").alias("true_pixels"))
    sc.write_report(evaluate_split(px, "val", 0.55), scenes, out)
    return spark.read.option("header", True).schema("scene_id bigint, pixels bigint, true_pixels bigint").csv(f"{out}/scenes")


def a13(spark, d):
    out, e = folder(spark), fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("caption"))
    for i in range(3):
        e.where(f"image_id % 3 = {i} OR image_id % 30 = 0").write.json(f"{out}/parts/rank_{i}.json")
    sc.merge_submissions(spark, f"{out}/parts/rank_*.json", "image_id bigint, caption string", f"{out}/all")
    return spark.read.schema("image_id bigint, caption string").json(f"{out}/all")


def log_files(spark, d):
    out = folder(spark)
    e = fx.logs(spark, d).groupBy("run", "step").pivot("metric", ["click", "view", "purchase", "signup", "error"]).agg(F.max("value"))
    texts = [F.col(c).cast("string").alias(c) for c in e.columns[2:]]
    e.select("run", "step", *texts).write.json(out)
    return out, e.columns[2:]


def a14(spark, d):
    out, names = log_files(spark, d)
    return sc.log_lines(spark, out, names).groupBy("run", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def a15(spark, d):
    s = fx.date_records(spark, d).select("key", F.struct("month", "status").alias("t1"), F.struct(F.lit("1999-01").alias("month"), "valid_fraction").alias("t2"))
    return sc.date_view(s, "key", "t1")


def a16(spark, d):
    docs = fx.table(spark, d, "documents")
    found = sc.checksums(docs.where("doc_id % 10 <> 0"), F.encode("text", "UTF-8"), ["doc_id"])
    declared = docs.select("doc_id", F.upper(F.sha2(F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("text")), 256)).alias("sha256"))
    return sc.checksum_mismatches(found, declared, "doc_id")


def a17(spark, d):
    from rasterloom.plans.tiling import tiles

    t = tiles(spark, d).withColumn("split", fx.split_of(F.col("scene_id"), 10))
    return sc.provenance(t, "split", "patch_id", "scene_id")


def drained(spark, stream, mode: str):
    """The rows of a stream that has taken all there is, from a table of files in the shared folder."""
    out = folder(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_windows(spark, d):
    """Closed windows of the event stream; those that the watermark has not passed are still open."""
    e = fx.table(spark, d, "events")
    out = folder(spark)
    e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(out)
    s = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out)
    got = drained(spark, st.windowed_statistics(s, late="0 seconds"), "append")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("top", 6).alias("top"))


def stream_counts(spark, d):
    """Pixels of even scenes arrive first; the stream stops, and goes on with the others from its state."""
    px, out = folder(spark), folder(spark)
    rows = fx.px8(spark, d).select("scene_id", "split", "prob", "truth")
    for part in (0, 1):
        rows.where(F.col("scene_id") % 2 == part).write.mode("append").parquet(px)
        s = spark.readStream.schema(rows.schema).parquet(px)
        st.running_counts(s, at_least("prob", T), out).awaitTermination()
    return st.latest_counts(spark, out, "split string")


def stream_average(spark, d):
    """The stream takes the odd steps of all series and those up to 50, stops, and goes on with the others from its state: what came early waits there."""
    logs, out = folder(spark), folder(spark)
    rows = fx.logs(spark, d).select("run", "metric", F.col("step").cast("long").alias("step"), "value")
    early = (F.col("step") <= 50) | ((F.col("step") <= 90) & (F.col("step") % 2 == 1))
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(logs)
        s = spark.readStream.schema("run bigint, metric string, step bigint, value double").parquet(logs)
        st.streaming_average(s, ["run", "metric"], "step", "value", out).awaitTermination()
    return rounded(spark.read.schema("run bigint, metric string, step bigint, average double").parquet(f"{out}/rows"), "average").select("run", "metric", "step", "average")


def stream_logs(spark, d):
    """Log lines as they arrive, in two portions, and the exponential average of each metric, whose steps must follow each other, from them."""
    out, logs, names = folder(spark), folder(spark), ["click", "view", "purchase", "signup", "error"]
    files, _ = log_files(spark, d)
    lines = spark.read.text(files)
    for part in (0, 1):
        lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == part).write.mode("append").text(logs)
        rows = sc.log_lines(spark, logs, names, stream=True)
        st.streaming_average(rows, ["run", "metric"], "step", "value", out).awaitTermination()
    got = spark.read.schema("run bigint, metric string, step bigint, average double").parquet(f"{out}/rows")
    return got.groupBy("run", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("steps"), F.round(F.max_by("average", "step"), 6).alias("average"))


QUERIES = {
    "a1_caption_corpus": a1, "a2_annotated_listing": a2, "a3_image_table": a3, "a4_caption_exports": a4, "a5_shards": a5, "a6_shard_catalogue": a6, "a7_manifest_scan": a7, "a8_coordinate_scan": a8, "a8_completeness": a8_complete, "a9_feature_scan": a9,
    "a10_aligned_triples": a10, "a11_scene_archive": a11, "a12_report_sinks": a12, "a13_merged_submission": a13, "a14_log_lines": a14, "a15_date_view": a15, "a16_checksums": a16, "a17_provenance": a17,
    "stream_window_statistics": stream_windows, "stream_confusion_counts": stream_counts, "stream_exponential_average": stream_average,
    "stream_log_lines": stream_logs,
}

from rasterloom.plans import evaluation as _ev  # noqa: E402
from rasterloom.plans import retrieval as _rt  # noqa: E402
from rasterloom.plans import tiling as _tl  # noqa: E402

ORACLES = {
    "a3_image_table": fx.sql(
        "SELECT image_id, split, len(captions) AS captions, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha FROM captions JOIN documents ON doc_id = image_id", "captions"
    ),
    "a1_caption_corpus": fx.sql("SELECT 'docs_' || image_id AS image_id, 'img_' || image_id || '.jpg' AS filename, split, CAST(len(captions) AS INT) AS n, sha256(array_to_string(captions, chr(10))) AS sha FROM captions", "captions"),
    "a2_annotated_listing": "SELECT count(*) FILTER (doc_id % 3 <> 0) AS files, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 2 = 0) AS matched, count(*) FILTER (doc_id % 2 = 0) AS annotated FROM documents",
    "a4_caption_exports": fx.sql("SELECT split, CASE WHEN split = 'train' THEN CAST(sum(len(captions)) AS BIGINT) ELSE count(*) END AS rows, CAST(sum(len(captions)) AS BIGINT) AS captions FROM captions GROUP BY 1", "captions"),
    "a5_shards": "SELECT 's' || (user_id % 3) AS shard, count(*) AS n, CASE WHEN user_id % 3 = 2 THEN count(*) ELSE 0 END AS typed FROM events WHERE user_id % 3 <> 1 GROUP BY user_id % 3",
    "a6_shard_catalogue": fx.sql(
        "WITH c AS (SELECT split, count(*) AS images FROM captions GROUP BY 1) SELECT dataset, split, CASE WHEN dataset = 'coco' AND split = 'val' THEN 'coco_test' ELSE dataset || '_' || split END AS shard, images FROM c, (SELECT unnest(['coco', 'sbu', 'vg', 'f30k', 'nwpu']) AS dataset) WHERE split = 'train' OR dataset NOT IN ('sbu', 'vg')",
        "captions",
    ),
    "a7_manifest_scan": fx.sql("SELECT key, key AS source_pair_id, split, status, round(valid_fraction, 6) AS valid_fraction FROM date_records", "date_records"),
    "a8_coordinate_scan": fx.sql("SELECT 'train_' || feature_id AS key, round(w, 6) AS w, round(s, 6) AS s, round(e, 6) AS e, round(n, 6) AS n FROM features", "features"),
    "a8_completeness": fx.sql("SELECT 'train_' || feature_id AS key, CASE WHEN feature_id % 10 = 7 THEN 'missing' ELSE 'extra' END AS state FROM features WHERE (feature_id % 10 = 7) <> (feature_id % 11 = 0)", "features"),
    "a9_feature_scan": fx.sql("SELECT 'node/' || feature_id AS osm_id, 2 AS n, round(w, 6) AS x FROM features", "features"),
    "a10_aligned_triples": fx.sql("SELECT key AS stem, '/data/label/' || key || '.png' AS label FROM date_records WHERE id % 2 <> 0 AND id % 3 <> 0 AND id % 5 <> 0", "date_records"),
    "a11_scene_archive": _ev.ORACLES["h3_split_evaluation"],
    "a12_report_sinks": fx.sql("SELECT scene_id, count(*) AS pixels, count(*) FILTER (truth) AS true_pixels FROM px8 GROUP BY 1", "px8"),
    "a13_merged_submission": "SELECT vec_id AS image_id, 'c' || label AS caption FROM embeddings",
    "a14_log_lines": fx.sql("SELECT run, metric, count(*) AS n, round(sum(value), 4) AS total FROM logs WHERE metric IN ('click', 'view', 'purchase', 'signup', 'error') GROUP BY 1, 2", "logs"),
    "a15_date_view": fx.sql("SELECT key, month, status FROM date_records", "date_records"),
    "a16_checksums": "SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE text END) AS declared, CASE WHEN doc_id % 10 <> 0 THEN sha256(text) END AS found FROM documents WHERE doc_id % 10 = 0 OR (doc_id % 7 = 0 AND text <> 'other')",
    "a17_provenance": fx.sql(
        f"WITH {_tl.TILES}, s AS (SELECT scene_id, {_tl.NAME}, CASE WHEN scene_id % 10 < 6 THEN 'train' WHEN scene_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM t),"
        " n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY patch_id) - 1 AS place FROM s), leaf AS (SELECT split, place // 4096 AS part, sha256(string_agg(patch_id, chr(10) ORDER BY patch_id)) AS h FROM n GROUP BY 1, 2),"
        " d AS (SELECT split, sha256(string_agg(h, chr(10) ORDER BY part)) AS digest FROM leaf GROUP BY 1) SELECT split, count(DISTINCT scene_id) AS sources, count(*) AS tiles, digest FROM n JOIN d USING (split) GROUP BY split, digest", "px64"
    ),
    "stream_window_statistics": """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, avg(value) AS mean, max(value) AS top FROM events GROUP BY 1, 2)
        SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, n, round(mean, 6) AS mean, round(top, 6) AS top FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""",
    "stream_confusion_counts": _ev.ORACLES["h1_confusion_counts"],
    "stream_exponential_average": _rt.ORACLES["k1_exponential_average"],
    "stream_log_lines": f"SELECT run, metric, count(*) AS n, CAST(max(step) AS BIGINT) AS steps, round(max_by(average, step), 6) AS average FROM ({_rt.ORACLES['k1_exponential_average'].replace('round(average, 6) AS average', 'average')}) GROUP BY 1, 2",
}
