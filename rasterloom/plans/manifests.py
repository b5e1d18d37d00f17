"""Queries of the manifest and instance families and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions.scalars import month_timestamp
from rasterloom.operators import instances as ins
from rasterloom.operators import manifests as mn
from rasterloom.plans import fixtures as fx
from rasterloom.plans.evaluation import rounded


def samples(spark, d):
    return fx.date_records(spark, d).select("id", "key", "split", (F.col("id") % 1000).cast("int").alias("idx"), "region_id", "month", "status", "valid_fraction")


def ranges(spark):
    r = spark.range(75).select((F.col("id") % 25).cast("int").alias("region_id"), F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.expr("cast(id div 25 + 1 as int)")).alias("split"))
    return r.where("NOT (split = 'test' AND region_id % 5 = 0)").select("region_id", "split", (F.col("region_id") * 40).alias("lo"), (F.col("region_id") * 40 + 35).alias("hi"))


def d1(spark, d):
    return mn.assign_regions(samples(spark, d).select("id", "split", "idx"), ranges(spark)).select("id", "region_id")


def d2(spark, d):
    m = mn.assign_regions(samples(spark, d).select("id", "split", "idx"), ranges(spark))
    want = samples(spark, d).where("split <> 'val'").groupBy("split").agg((F.count(F.lit(1)) + F.when(F.col("split") == "test", 1).otherwise(0)).alias("n"))
    return mn.mapping_audit(m, want)


def d3(spark, d):
    s = samples(spark, d)
    dates = s.select("key", "month", month_timestamp(F.col("month")).alias("timestamp"))
    box = s.where("id % 4 <> 0").select("key", *[(F.col("idx") / F.lit(1000.0) + i).alias(c) for i, c in enumerate("wsen")])
    r = mn.assemble_records(s.select("key", "region_id"), box, dates, dates.where("month >= '1997-01'"), "key")
    return r.select("key", "region_id", F.round("bbox.e", 6).alias("e"), F.col("t1.query_timestamp").alias("t1"), F.col("t2.image_month").alias("t2"))


def listing(spark, d):
    s = samples(spark, d).select(F.col("key").alias("name"), "id")
    one = lambda p, cond: s.where(cond).select(F.lit(p).alias("part"), "name")
    return one("A", "id % 10 <> 3").unionByName(one("B", "true")).unionByName(one("label", "id % 7 <> 2")).unionByName(one("B", "id < 5").withColumn("name", F.concat("name", F.lit("x"))))


def d4(spark, d):
    f = listing(spark, d)
    a = mn.dataset_audit(samples(spark, d).select(F.col("key").alias("name")), f)
    n = mn.aligned(f, ["A", "B", "label"]).agg(F.count(F.lit(1)).alias("aligned"))
    return a.join(F.broadcast(n))


def dated(spark, d):
    s = samples(spark, d).withColumn("date", F.explode(F.array(F.lit("t1"), F.lit("t2"))))
    t = month_timestamp(F.when(F.col("date") == "t1", F.col("month")).otherwise(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 5), "yyyy-MM")))
    odd = F.col("id") % 9
    status = F.when(F.col("date") == "t1", F.col("status")).when(odd == 0, "ok_empty").when(odd == 1, "failed_permanent").when(odd == 2, "authentication_required").when(odd == 3, "pending").otherwise(F.col("status"))
    return s.withColumn("timestamp", t).withColumn("status", status).withColumn("error_code", F.when((F.col("date") == "t2") & (F.col("id") % 11 == 0), 403).cast("int"))


def d14(spark, d):
    return mn.initial_status(dated(spark, d).drop("status"), ["t2"], "1997-06-01T00:00:00Z").groupBy("date", "status").agg(F.count(F.lit(1)).alias("n"))


def d5(spark, d):
    cur = mn.initial_status(dated(spark, d).drop("status"), ["t1", "t2"], "1996-06-01T00:00:00Z").where("id % 13 <> 0")
    cur = cur.withColumn("region_id", F.when(F.col("id") % 17 == 0, F.lit(99)).otherwise(F.col("region_id")))
    prev = dated(spark, d).where("id % 19 <> 0")
    return mn.merge_resume(cur.select("id", "date", "split", "region_id", "status"), prev, ["id", "date"], ["split", "region_id"]).select("id", "date", "status", "action", F.round("valid_fraction", 6).alias("valid_fraction"))


def errors(spark, d):
    return dated(spark, d).where("id % 23 = 0").select("id", "date", F.lit("broken").alias("error"))


def d6(spark, d):
    return mn.work_plan(dated(spark, d), errors(spark, d), ["id", "date"], "transient").select("id", "date", "effective")


def d7(spark, d):
    r = dated(spark, d).withColumns({"feature_count": (F.col("id") % 3).cast("int"), "sha256": F.sha2(F.col("id").cast("string"), 256)})
    f = r.where("id % 5 <> 0").select("id", "date", F.when(F.col("id") % 8 == 1, 7).otherwise(F.col("feature_count")).alias("features"), F.when(F.col("id") % 6 == 1, "x").otherwise(F.col("sha256")).alias("sha256"), (F.col("valid_fraction") + F.when(F.col("id") % 4 == 3, 0.1).otherwise(0.0)).alias("fraction"))
    return mn.cache_errors(r, f, ["id", "date"])


def d8(spark, d):
    r = dated(spark, d)
    r = r.withColumns({"status": F.when(F.col("id") % 29 == 0, "odd").otherwise(F.col("status")), "invalid_fraction": 1 - F.col("valid_fraction") + F.when(F.col("id") % 31 == 0, 0.5).otherwise(0.0), "sha256": F.when(F.col("id") % 37 == 0, "bad").otherwise(F.sha2(F.col("key"), 256))})
    return mn.quality_problems(r, ["id", "date"], 0.2)


def eligible(spark, d):
    r = dated(spark, d)
    return mn.eligibility(r.select("id", "date"), r.where("id % 43 <> 0"), r.where("id % 3 <> 0"), ["id", "date"], 0.3)


def d9(spark, d):
    return eligible(spark, d)


def d10(spark, d):
    return mn.exclusion_statistics(mn.exclusions(eligible(spark, d), "id", ["t1", "t2"], "mask"))


def d11(spark, d):
    a = samples(spark, d)
    b = a.withColumn("region_id", F.when(F.col("id") % 21 == 0, F.lit(-5)).otherwise(F.col("region_id"))).withColumn("split", F.when(F.col("id") % 33 == 0, "none").otherwise(F.col("split"))).where("id % 2 = 0")
    return mn.agreement(a, b, "id", ["split", "region_id"])


def d11_regions(spark, d):
    s = samples(spark, d)
    mapped = mn.assign_regions(s.select("id", "split", "idx"), ranges(spark))
    return mn.region_fallback(s.where("id % 4 = 0").withColumn("region_id", F.when(F.col("id") % 8 == 0, F.col("region_id"))), s.where("id % 3 = 0").withColumn("region_id", F.lit(None).cast("int")), mapped, "id")


def d12(spark, d):
    r = dated(spark, d).where("date = 't1'").withColumn("policy", F.when(F.col("id") % 501 == 0, "month_start").otherwise("month_end"))
    return mn.timestamp_problems(r, ["id"], month_timestamp(F.when(F.col("id") % 101 == 0, F.lit("1990-01")).otherwise(F.col("month"))))


def d13(spark, d):
    docs = fx.captions(spark, d).select(F.concat(F.lit("doc_"), F.col("image_id").cast("string")).alias("image_id"), "captions", "split")
    conv = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("captions")).select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("image_id"), "captions")
    return docs.unionByName(conv, allowMissingColumns=True).groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum(F.size("captions")).alias("captions"))


#: Pixels between peaks: more than the window of a candidate, so that the choice among them counts.
APART = 6


def mask64(spark, d):
    return fx.px64(spark, d).where("v > 0.15")


def labelled(spark, d):
    return ins.label_components(mask64(spark, d)).hint("merge").join(fx.px64(spark, d), ["scene_id", "y", "x"])


def i1(spark, d):
    return ins.label_components(mask64(spark, d))


def peaks(spark, d, px):
    return ins.with_fallback(ins.separated_peaks(ins.peak_candidates(px, "v", 0.2, 2), APART), px, "v")


def i2(spark, d):
    return rounded(ins.peak_candidates(labelled(spark, d), "v", 0.2, 2), "score")


def i3(spark, d):
    px = labelled(spark, d)
    return rounded(ins.separated_peaks(ins.peak_candidates(px, "v", 0.2, 2), APART), "score")


def i4(spark, d):
    return rounded(peaks(spark, d, labelled(spark, d)), "score")


def decoded(spark, d):
    px = ins.checkpointed(labelled(spark, d))
    return ins.decode_instances(px, peaks(spark, d, px), F.col("v") * 4 - 1, F.lit(0.5) - F.col("v"), 64, 64)


def i5(spark, d):
    return decoded(spark, d)


def i6(spark, d):
    return ins.support_problems(decoded(spark, d).where("NOT (y = 10)").withColumn("instance", F.when(F.col("x") == 3, 0).otherwise(F.col("instance"))), mask64(spark, d).where("x <> 5"))


def components_as_instances(spark, d):
    return ins.label_components(mask64(spark, d)).withColumnRenamed("label", "instance")


def i7(spark, d):
    px = ins.checkpointed(labelled(spark, d))
    markers = px.where("(x + 2 * y) % 3 = 0").withColumn("marker", F.col("y") * 64 + F.col("x"))
    return ins.nearest_markers(px.select("scene_id", "label", "y", "x"), markers, 2).select("scene_id", "y", "x", "marker")


def i8(spark, d):
    return ins.instance_centres(components_as_instances(spark, d))


def i9(spark, d):
    return rounded(ins.centre_targets(i8(spark, d), 1.0, 64, 64), "heat")


def i9_offsets(spark, d):
    c = components_as_instances(spark, d)
    return ins.offset_targets(c, ins.instance_centres(c))


def i10(spark, d):
    return ins.instance_counts(components_as_instances(spark, d))


QUERIES = {
    "d1_region_assignment": d1, "d2_mapping_audit": d2, "d3_record_assembly": d3, "d4_dataset_audit": d4, "d5_resume_merge": d5, "d6_work_plan": d6, "d7_cache_audit": d7, "d8_quality_rules": d8, "d9_eligibility": d9, "d10_exclusion_statistics": d10,
    "d11_agreement": d11, "d11_region_fallback": d11_regions, "d12_timestamp_agreement": d12, "d13_concatenated": d13, "d14_initial_status": d14, "i1_components": i1, "i2_peak_candidates": i2, "i3_separated_peaks": i3, "i4_fallback_peaks": i4,
    "i5_offset_voting": i5, "i6_support_audit": i6, "i7_nearest_markers": i7, "i8_instance_centres": i8, "i9_centre_targets": i9, "i9_offset_targets": i9_offsets, "i10_instance_counts": i10,
}

_SM = "s AS (SELECT id, key, split, CAST(id % 1000 AS INT) AS idx, region_id, month, status, valid_fraction FROM date_records)"
_RG = "rg AS (SELECT region_id, split, region_id * 40 AS lo, region_id * 40 + 35 AS hi FROM (SELECT CAST(range AS INT) AS region_id FROM range(25)), (SELECT unnest(['train', 'val', 'test']) AS split) WHERE NOT (split = 'test' AND region_id % 5 = 0))"
_MAP = "mp AS (SELECT s.id, s.split, rg.region_id FROM s LEFT JOIN rg ON s.split = rg.split AND idx BETWEEN lo AND hi)"
_TS = lambda m: f"strftime(last_day({m}), '%Y-%m-%d') || 'T23:59:59Z'"
_M = "CAST(month || '-01' AS DATE)"
_DT = f"""dt AS (SELECT s.* EXCLUDE (status), date, CASE WHEN date = 't1' THEN {_TS(_M)} ELSE {_TS(_M + " + INTERVAL 5 MONTH")} END AS timestamp,
 CASE WHEN date = 't1' THEN status WHEN id % 9 = 0 THEN 'ok_empty' WHEN id % 9 = 1 THEN 'failed_permanent' WHEN id % 9 = 2 THEN 'authentication_required' WHEN id % 9 = 3 THEN 'pending' ELSE status END AS status, CASE WHEN date = 't2' AND id % 11 = 0 THEN 403 END AS error_code FROM s, (SELECT unnest(['t1', 't2']) AS date))"""
_SUC, _FAIL = "('ok', 'ok_empty', 'ok_partial')", "('authentication_required', 'failed_retryable', 'failed_permanent', 'source_unavailable', 'insufficient_valid_pixels')"
_D = f"{_SM}, {_DT}"
_EL = f"""el AS (SELECT id, date, CASE WHEN id % 43 = 0 THEN 'missing' ELSE status END AS status, CASE WHEN id % 43 = 0 THEN 'missing_record' WHEN status NOT IN {_SUC} THEN 'status_' || status WHEN id % 3 = 0 AND status <> 'ok_empty' THEN 'missing_file' WHEN status <> 'ok_empty' AND valid_fraction < 0.3 THEN 'insufficient_valid_fraction' END AS reason FROM dt)"""
_CC = """m AS (SELECT scene_id, y, x, v FROM px64 WHERE v > CAST(0.15 AS DOUBLE)), reach AS (SELECT scene_id, y, x, y * 64 + x AS root FROM m UNION SELECT m.scene_id, m.y, m.x, r.root FROM reach r JOIN m ON m.scene_id = r.scene_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
 rt AS (SELECT scene_id, y, x, min(root) AS root FROM reach GROUP BY 1, 2, 3), lb AS (SELECT rt.scene_id, rt.y, rt.x, CAST(dense_rank() OVER (PARTITION BY rt.scene_id ORDER BY root) AS INT) AS label, v FROM rt JOIN m ON m.scene_id = rt.scene_id AND m.y = rt.y AND m.x = rt.x)"""
_PK = """, cand AS (SELECT a.* FROM lb a WHERE a.v >= 0.2 AND a.v >= (SELECT max(b.v) FROM lb b WHERE b.scene_id = a.scene_id AND b.label = a.label AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2) - CAST(1e-7 AS DOUBLE)),
 touch AS (SELECT scene_id, y, x, y * 64 + x AS root FROM cand UNION SELECT c.scene_id, c.y, c.x, t.root FROM touch t JOIN cand c ON c.scene_id = t.scene_id AND abs(c.y - t.y) <= 1 AND abs(c.x - t.x) <= 1),
 plateau AS (SELECT scene_id, y, x, min(root) AS root FROM touch GROUP BY 1, 2, 3), pk AS (SELECT c.scene_id, c.label, max(c.v) AS score, min((-c.v, c.y, c.x)) AS p FROM cand c JOIN plateau USING (scene_id, y, x) GROUP BY 1, 2, root)"""
_SEP = """, o AS (SELECT scene_id, label, score, p[2] AS y, p[3] AS x, row_number() OVER (PARTITION BY scene_id, label ORDER BY score DESC, p[2], p[3]) AS n FROM pk),
 walk AS (SELECT scene_id, label, n, [{'score': score, 'y': y, 'x': x}] AS kept FROM o WHERE n = 1 UNION ALL SELECT o.scene_id, o.label, o.n, CASE WHEN (SELECT min(pow(k.y - o.y, 2) + pow(k.x - o.x, 2)) FROM (SELECT unnest(w.kept) AS k)) < 36 THEN w.kept ELSE list_append(w.kept, {'score': o.score, 'y': o.y, 'x': o.x}) END
  FROM walk w JOIN o ON o.scene_id = w.scene_id AND o.label = w.label AND o.n = w.n + 1),
 sep0 AS (SELECT scene_id, label, unnest(max_by(kept, n)) AS k FROM walk GROUP BY 1, 2), sep AS (SELECT scene_id, label, k.score AS score, k.y AS y, k.x AS x FROM sep0)"""
_FB = """, fb AS (SELECT scene_id, label, min((-v, y, x)) AS p FROM lb WHERE NOT EXISTS (SELECT 1 FROM sep WHERE sep.scene_id = lb.scene_id AND sep.label = lb.label) GROUP BY 1, 2),
 pks AS (SELECT * FROM sep UNION ALL SELECT scene_id, label, -p[1], p[2], p[3] FROM fb)"""
_DEC = """, vote AS (SELECT scene_id, label, y, x, least(greatest(y + (v * 4 - 1), 0), 63) AS vy, least(greatest(x + (CAST(0.5 AS DOUBLE) - v), 0), 63) AS vx FROM lb),
 won AS (SELECT vote.scene_id, vote.label, vote.y, vote.x, min((round(pow(vy - pks.y, 2) + pow(vx - pks.x, 2), 9), -score, pks.y, pks.x)) AS p FROM vote JOIN pks ON pks.scene_id = vote.scene_id AND pks.label = vote.label GROUP BY 1, 2, 3, 4),
 dec AS (SELECT scene_id, y, x, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY label, p[2], p[3], p[4]) AS INT) AS instance FROM won)"""
_SUP = """, held AS (SELECT scene_id, y, x, CASE WHEN x = 3 THEN 0 ELSE instance END AS instance FROM dec WHERE y <> 10), want AS (SELECT scene_id, y, x FROM m WHERE x <> 5)"""
_NEAR = """, mk AS (SELECT scene_id, label, y * 64 + x AS marker, y AS my, x AS mx FROM lb WHERE (x + 2 * y) % 3 = 0),
 far AS (SELECT lb.scene_id, lb.label, y, x, marker, pow(y - my, 2) + pow(x - mx, 2) AS d FROM lb JOIN mk ON mk.scene_id = lb.scene_id AND mk.label = lb.label),
 one AS (SELECT scene_id, label, y, x, min_by(marker, (d, marker)) AS marker FROM far GROUP BY 1, 2, 3, 4), area AS (SELECT scene_id, label, marker, count(*) AS area FROM one GROUP BY 1, 2, 3),
 stay AS (SELECT scene_id, label, marker FROM area QUALIFY area >= 2 OR row_number() OVER (PARTITION BY scene_id, label ORDER BY area DESC, marker) = 1)"""
_CE = ", ce AS (SELECT scene_id, label AS instance, avg(y) AS cy, avg(x) AS cx, count(*) AS area FROM lb GROUP BY 1, 2), cn AS (SELECT ce.scene_id, ce.instance, area, min((round(pow(y - cy, 2) + pow(x - cx, 2), 9), y, x)) AS p FROM lb JOIN ce ON ce.scene_id = lb.scene_id AND ce.instance = lb.label GROUP BY 1, 2, 3), cp AS (SELECT scene_id, instance, area, p[2] AS y, p[3] AS x FROM cn)"


def recursive(query: str) -> str:
    return fx.sql("WITH " + query, "px64").replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "d1_region_assignment": fx.sql(f"WITH {_SM}, {_RG}, {_MAP} SELECT id, region_id FROM mp", "date_records"),
    "d2_mapping_audit": fx.sql(f"WITH {_SM}, {_RG}, {_MAP} SELECT split, CASE WHEN split = 'val' THEN 0 ELSE count(*) + CASE WHEN split = 'test' THEN 1 ELSE 0 END END AS expected, count(*) AS found, count(*) FILTER (region_id IS NULL) AS unmapped, split = 'train' AS same FROM mp GROUP BY split", "date_records"),
    "d3_record_assembly": fx.sql(f"WITH {_SM} SELECT key, region_id, CASE WHEN id % 4 <> 0 THEN round(idx / CAST(1000 AS DOUBLE) + 2, 6) END AS e, {_TS(_M)} AS t1, CASE WHEN month >= '1997-01' THEN month END AS t2 FROM s", "date_records"),
    "d4_dataset_audit": fx.sql(
        f"WITH {_SM}, n AS (SELECT count(*) AS n, count(*) FILTER (id % 10 <> 3) AS a, count(*) FILTER (id % 7 <> 2) AS l, count(*) FILTER (id < 5) AS x, count(*) FILTER (id % 10 <> 3 AND id % 7 <> 2) AS aligned FROM s)"
        " SELECT 'A' AS part, n AS expected, a AS found, n - a AS missing, CAST(0 AS BIGINT) AS extra, aligned FROM n UNION ALL SELECT 'B', n, n + x, 0, x, aligned FROM n UNION ALL SELECT 'label', n, l, n - l, 0, aligned FROM n",
        "date_records",
    ),
    "d5_resume_merge": fx.sql(
        f"""WITH {_D}, c AS (SELECT *, CASE WHEN timestamp < '1996-06-01T00:00:00Z' THEN 'unavailable_before_history' ELSE 'pending' END AS now FROM dt WHERE id % 13 <> 0),
        a AS (SELECT *, CASE WHEN id % 19 = 0 THEN 'new' WHEN id % 17 = 0 THEN 'mismatch' WHEN now <> 'pending' THEN 'kept_status' WHEN error_code = 403 THEN 'reset' WHEN status IN {_SUC} OR status IN {_FAIL} THEN 'carried' ELSE 'still_pending' END AS action FROM c)
        SELECT id, date, CASE WHEN action = 'carried' THEN status ELSE now END AS status, action, CASE WHEN action = 'carried' THEN round(valid_fraction, 6) END AS valid_fraction FROM a""",
        "date_records",
    ),
    "d6_work_plan": fx.sql(
        f"WITH {_D}, e AS (SELECT *, CASE WHEN status IN {_SUC} AND id % 23 = 0 THEN 'failed_retryable' ELSE status END AS effective FROM dt) SELECT id, date, effective FROM e WHERE effective IN ('pending', 'failed_retryable', 'authentication_required')", "date_records"
    ),
    "d7_cache_audit": fx.sql(
        f"""WITH {_D}, e AS (SELECT id, date, CASE WHEN id % 5 = 0 THEN 'no file' WHEN id % 8 = 1 THEN 'feature count' WHEN status = 'ok_empty' AND id % 3 > 0 THEN 'empty record has features' WHEN status = 'ok' AND id % 3 = 0 THEN 'record has no features'
        WHEN id % 6 = 1 THEN 'checksum' WHEN id % 4 = 3 THEN 'fraction' END AS error FROM dt WHERE status IN {_SUC}) SELECT * FROM e WHERE error IS NOT NULL""",
        "date_records",
    ),
    "d8_quality_rules": fx.sql(
        f"""WITH {_D}, q AS (SELECT id, date, valid_fraction, CASE WHEN id % 29 = 0 THEN 'odd' ELSE status END AS st FROM dt) SELECT id, date, 'status' AS problem FROM q WHERE st = 'odd' UNION ALL SELECT id, date, 'incomplete' FROM q WHERE st = 'pending'
        UNION ALL SELECT id, date, 'too_small' FROM q WHERE st = 'ok' AND valid_fraction < 0.2 UNION ALL SELECT id, date, 'sum' FROM q WHERE id % 31 = 0 UNION ALL SELECT id, date, 'hash' FROM q WHERE st IN {_SUC} AND id % 37 = 0""",
        "date_records",
    ),
    "d9_eligibility": fx.sql(f"WITH {_D}, {_EL} SELECT *, reason IS NULL AS available FROM el", "date_records"),
    "d10_exclusion_statistics": fx.sql(
        f"WITH {_D}, {_EL}, x AS (SELECT id, count(*) FILTER (reason IS NULL) = 0 AS excluded FROM el GROUP BY 1), y AS (SELECT id, date || ':' || reason AS reason FROM el WHERE reason IS NOT NULL) SELECT excluded, coalesce(reason, 'none') AS reason, count(*) AS n FROM x LEFT JOIN y USING (id) GROUP BY 1, 2", "date_records"
    ),
    "d11_agreement": fx.sql(f"WITH {_SM} SELECT id, 'split' AS field FROM s WHERE id % 2 = 0 AND id % 33 = 0 UNION ALL SELECT id, 'region_id' FROM s WHERE id % 2 = 0 AND id % 21 = 0", "date_records"),
    "d11_region_fallback": fx.sql(f"WITH {_SM}, {_RG}, {_MAP} SELECT s.id, CAST(coalesce(CASE WHEN s.id % 8 = 0 THEN s.region_id END, mp.region_id, -1) AS INT) AS region_id FROM s JOIN mp USING (id) WHERE s.id % 4 = 0 OR s.id % 3 = 0", "date_records"),
    "d12_timestamp_agreement": fx.sql("SELECT CAST(id AS VARCHAR) AS id, 'timestamp' AS problem FROM date_records WHERE id % 101 = 0 UNION ALL SELECT 'all', 'policies'", "date_records"),
    "d13_concatenated": fx.sql("WITH u AS (SELECT split, len(captions) AS n FROM captions UNION ALL SELECT NULL, count(text) FROM conversations GROUP BY conv_id) SELECT split, count(*) AS images, CAST(sum(n) AS BIGINT) AS captions FROM u GROUP BY 1", "captions"),
    "d14_initial_status": fx.sql(f"WITH {_D} SELECT date, CASE WHEN date = 't1' THEN 'not_requested' WHEN timestamp < '1997-06-01T00:00:00Z' THEN 'unavailable_before_history' ELSE 'pending' END AS status, count(*) AS n FROM dt GROUP BY 1, 2", "date_records"),
    "i1_components": recursive(f"{_CC} SELECT scene_id, y, x, label FROM lb"),
    "i2_peak_candidates": recursive(f"{_CC}{_PK} SELECT scene_id, label, round(score, 6) AS score, p[2] AS y, p[3] AS x FROM pk"),
    "i3_separated_peaks": recursive(f"{_CC}{_PK}{_SEP} SELECT scene_id, label, round(score, 6) AS score, y, x FROM sep"),
    "i4_fallback_peaks": recursive(f"{_CC}{_PK}{_SEP}{_FB} SELECT scene_id, label, round(score, 6) AS score, y, x FROM pks"),
    "i5_offset_voting": recursive(f"{_CC}{_PK}{_SEP}{_FB}{_DEC} SELECT scene_id, y, x, instance FROM dec"),
    "i6_support_audit": recursive(
        f"{_CC}{_PK}{_SEP}{_FB}{_DEC}{_SUP} SELECT scene_id, 'outside' AS problem, count(*) AS n FROM held WHERE x = 5 GROUP BY 1 UNION ALL SELECT scene_id, 'bad_id', count(*) FROM held WHERE x <> 5 AND instance < 1 GROUP BY 1"
        " UNION ALL SELECT scene_id, 'unassigned', count(*) FROM want WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.scene_id = want.scene_id AND held.y = want.y AND held.x = want.x) GROUP BY 1"
        " UNION ALL SELECT scene_id, 'gap', max(instance) - count(DISTINCT instance) FROM held WHERE instance >= 1 GROUP BY 1 HAVING max(instance) > count(DISTINCT instance)"
    ),
    "i7_nearest_markers": recursive(f"{_CC}{_NEAR} SELECT scene_id, y, x, min_by(marker, (d, marker)) AS marker FROM far JOIN stay USING (scene_id, label, marker) GROUP BY 1, 2, 3"),
    "i8_instance_centres": recursive(f"{_CC}{_CE} SELECT * FROM cp"),
    "i9_centre_targets": recursive(f"{_CC}{_CE} SELECT scene_id, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x, round(max(exp(-(dy * dy + dx * dx) / CAST(2 AS DOUBLE))), 6) AS heat FROM cp, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63 GROUP BY 1, 2, 3"),
    "i9_offset_targets": recursive(f"{_CC}{_CE} SELECT lb.scene_id, lb.y, lb.x, cp.y - lb.y AS offset_y, cp.x - lb.x AS offset_x FROM lb JOIN cp ON cp.scene_id = lb.scene_id AND cp.instance = lb.label"),
    "i10_instance_counts": recursive(f"{_CC} SELECT scene_id, count(DISTINCT (scene_id, label)) AS instances FROM lb GROUP BY ROLLUP (scene_id)"),
}
