"""Queries of scalar functions and caption operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import scalars as sc
from rasterloom.operators import captions as cp
from rasterloom.operators import mapfeatures as mf
from rasterloom.operators.spectral import expansion_steps
from rasterloom.operators.tiling import uniform
from rasterloom.plans import fixtures as fx


def named(spark, d):
    """Names of samples in different forms, some broken."""
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    i = F.col("id").cast("string")
    split = F.when(F.col("id") % 3 == 0, "Train").when(F.col("id") % 3 == 1, "VAL").otherwise("test")
    name = F.when(F.col("id") % 7 == 0, F.concat(F.lit("a\\b/"), split, F.lit("_00"), i, F.lit("_y0_x256"))).when(F.col("id") % 7 == 1, F.concat(split, F.lit("_"), i, F.lit("_r1_c2"))).when(F.col("id") % 7 == 2, F.concat(F.lit("odd"), i)).otherwise(F.concat(split, F.lit("_0"), i, F.lit(".png")))
    return o.select("id", name.alias("name"))


def b1(spark, d):
    return named(spark, d).select("id", sc.sample_key(F.col("name")).alias("key"), sc.sample_key(F.col("name"), extension=True).alias("file"))


def b2(spark, d):
    k = named(spark, d).select("id", sc.sample_key(F.col("name")).alias("key")).where("key IS NOT NULL")
    a, b = sc.split_and_index(F.col("key"))
    return k.select("id", a.alias("split"), b.alias("idx"))


def b3(spark, d):
    r = fx.date_records(spark, d).select("key")
    return r.orderBy(*sc.natural_order(F.col("key"))).select("key")


def b4(spark, d):
    r = fx.date_records(spark, d).where((F.col("split") == "val") & F.col("region_id").isin(1, 2, 3))
    return r.orderBy(*sc.natural_order(F.col("key"))).limit(50).select("key", "region_id")


def months(spark, d):
    return fx.date_records(spark, d).select("id", "month", "owner")


def b5(spark, d):
    m = months(spark, d)
    return m.select("id", F.date_format(sc.month_start(F.col("month")), "yyyy-MM-dd").alias("first"), F.date_format(sc.month_end(F.col("month")), "yyyy-MM-dd").alias("last"))


def b6(spark, d):
    return months(spark, d).select("id", sc.month_timestamp(F.col("month")).alias("ends"), sc.month_timestamp(F.col("month"), "month_start").alias("starts"))


def b7(spark, d):
    t = F.when(F.col("id") % 3 == 0, F.concat(F.col("month"), F.lit("-11T10:00:00+02:00"))).when(F.col("id") % 3 == 1, F.concat(F.col("month"), F.lit("-11T10:00:00Z"))).otherwise(F.concat(F.col("month"), F.lit("-11T10:00:00")))
    return months(spark, d).select("id", F.date_format(sc.utc_timestamp(t), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def b8(spark, d):
    at = sc.utc_timestamp(sc.month_timestamp(F.col("month")))
    return months(spark, d).select("id", sc.before_history(at, sc.utc_timestamp(F.lit("1997-03-01T00:00:00Z"))).alias("before"))


def b9(spark, d):
    a, b = sc.month_window(F.col("month"), (F.col("id") % 40 - 5).cast("int"))
    return months(spark, d).select("id", F.date_format(a, "yyyy-MM-dd").alias("a"), F.date_format(b, "yyyy-MM-dd").alias("b"))


def month_pairs(spark, d):
    m = months(spark, d)
    return m.select("id", F.col("month").alias("m1"), F.date_format(F.add_months(sc.month_start(F.col("month")), (F.col("id") % 4).cast("int")), "yyyy-MM").alias("m2"))


def b10(spark, d):
    return month_pairs(spark, d).select("id", sc.paired_expansion(F.col("m1"), F.col("m2"), (F.col("id") % 60).cast("int")).alias("days"))


def b11(spark, d):
    o = fx.table(spark, d, "part").select("p_partkey", F.explode(expansion_steps((F.col("p_partkey") % 9 + 1).cast("int"), F.col("p_size"))).alias("days"))
    return o


def b12(spark, d):
    f = fx.features(spark, d)
    n = F.when(F.col("feature_id") % 11 == 0, F.col("s")).when(F.col("feature_id") % 17 == 0, F.lit(91.0)).otherwise(F.col("n"))
    e = F.when(F.col("feature_id") % 13 == 0, F.lit(-190.0)).otherwise(F.col("e"))
    return f.select("feature_id", F.coalesce(sc.bbox_problem(F.col("w"), n, e, F.col("s")), F.lit("ok")).alias("state"))


def b13(spark, d):
    f = fx.features(spark, d)
    x, y = (F.col("feature_id") % 5 * 256).cast("int"), (F.col("feature_id") % 4 * 256).cast("int")
    b = sc.tile_bbox({k: F.col(k) for k in "wsen"}, x, y, F.lit(256), F.lit(256), F.lit(1024), F.lit(1024))
    return f.select("feature_id", *[F.round(v, 9).alias(k) for k, v in b.items()])


SENSORS = ["Landsat 5", "LANDSAT_7 ETM+", "LC08_L2", "le07", "Sentinel 2", ""]


def b14(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in SENSORS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return fx.table(spark, d, "orders").select("o_orderkey", sc.clean_sensor(s).alias("sensor"), sc.sensor_id(s).alias("sensor_id"))


def b15(spark, d):
    from rasterloom.operators.spectral import sensors_of

    return fx.obs(spark, d).where(F.col("sensor").isin(sensors_of("landsat7_consistent"))).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))


def b16(spark, d):
    day = F.when(F.col("o_orderkey") % 9 == 0, F.lit(None).cast("string")).otherwise(F.date_format(F.date_add("o_orderdate", 1500), "yyyy-MM-dd'T'HH:mm"))
    return fx.table(spark, d, "orders").select("o_orderkey", sc.slc_mode(day).alias("mode"))


ERRORS = ["ConnectionError", "ValueError", "FileNotFoundError", "HTTPError", "OSError"]
CODES = [503, 404, 429, 400]


def b17(spark, d):
    k = F.col("o_orderkey")
    err = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (k % 5 + 1).cast("int"))
    code = F.when(err == "HTTPError", F.element_at(F.array(*[F.lit(c) for c in CODES]), (k % 4 + 1).cast("int")))
    return fx.table(spark, d, "orders").select("o_orderkey", sc.failure_status(err, code).alias("status"))


def b18(spark, d):
    k = F.col("c_custkey")
    a, b, c = F.when(k % 2 == 0, "  "), F.when(k % 3 == 0, F.col("c_mktsegment")), F.col("c_name")
    return fx.table(spark, d, "customer").select("c_custkey", sc.first_filled(a, b, c).alias("value"))


def b19(spark, d):
    name = F.concat(F.lit("COCO_val2014_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jpg"))
    return fx.table(spark, d, "documents").select("doc_id", sc.image_number(name).alias("number"))


def b20(spark, d):
    p = fx.px8(spark, d)
    return p.groupBy("split").agg(F.round(F.sum(sc.binarise((F.col("prob").cast("double") * 255), 0.1)), 6).alias("total"))


def c1(spark, d):
    return cp.pairs(fx.captions(spark, d)).select("image_id", "pos", F.sha2(cp.clean_caption(F.col("caption")), 256).alias("clean"))


def c2(spark, d):
    return cp.pairs(fx.captions(spark, d)).where(cp.not_blank(F.col("caption"))).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def c3(spark, d):
    return fx.captions(spark, d).select("image_id", F.size(F.array_distinct("captions")).alias("n"))


def c4(spark, d):
    return cp.caption_index(fx.captions(spark, d))


def c5(spark, d):
    return cp.pairs(fx.captions(spark, d)).groupBy("split", "replica").agg(F.count(F.lit(1)).alias("n"))


def c6(spark, d):
    p = cp.pairs(fx.captions(spark, d))
    return p.agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("caption").alias("distinct_texts"))


def text_ids(spark, d):
    return cp.dense_ids(cp.pairs(fx.captions(spark, d)), "caption", ["image_id", "pos"], "text_id")


def c7(spark, d):
    return text_ids(spark, d).select(F.sha2("caption", 256).alias("text_sha"), "text_id")


def c8(spark, d):
    e = fx.table(spark, d, "events").withColumn("name", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return cp.dense_ids(e, "name", ["event_id"], "dense")


def c9(spark, d):
    return cp.relevance(cp.pairs(fx.captions(spark, d)), text_ids(spark, d), distinct=False)


def c9_train(spark, d):
    p = cp.pairs(fx.captions(spark, d).where("split = 'train'"))
    ids = cp.dense_ids(p, "caption", ["image_id", "pos"], "text_id")
    return cp.relevance(p, ids, distinct=True)


def c10(spark, d):
    return cp.pairs(fx.captions(spark, d).where("split = 'test'")).select("image_id", F.sha2("caption", 256).alias("text_sha"))


def c11(spark, d):
    c = fx.captions(spark, d)
    t, s = F.col("captions")[0], F.try_element_at("captions", F.lit(2))
    out = {m: F.sha2(cp.context_text(F.when(F.col("image_id") % 2 == 0, t), s, F.slice("captions", 3, 3), m, "no context", 24), 256).alias(m) for m in ("phrases", "summary", "concat", "any")}
    return c.select("image_id", *out.values())


def c12(spark, d):
    p = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("patch"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"))
    e = fx.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("entry")).where("c_custkey % 2 = 0")
    e = e.unionByName(p.where("id % 10 = 0").select(F.col("patch").alias("name"), F.lit("patch").alias("entry")))
    return cp.first_entry(p, e, [F.col("patch"), F.col("source")], "id", "name", "entry").select("id", F.coalesce("entry", F.lit("none")).alias("entry"))


def c13(spark, d):
    c = fx.captions(spark, d).withColumn("r", F.col("image_id") % 5)
    first, second = F.col("captions")[0], F.try_element_at("captions", F.lit(2))
    text, phrases = cp.entry_text(F.when(F.col("r") == 0, first), F.when(F.col("r") == 1, F.slice("captions", 1, 3)), F.when(F.col("r") != 2, F.slice("captions", 2, 3)), F.when(F.col("r").isin(0, 2), second), "none")
    return c.select("image_id", F.sha2(text, 256).alias("text"), F.size(phrases).alias("n"), F.sha2(F.array_join(phrases, "|"), 256).alias("phrases"))


def c14(spark, d):
    docs = fx.table(spark, d, "documents")
    counts = {"building": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") % 150), "road": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") % 7), "water": F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 40), "vegetation": F.col("doc_id") % 4 - 1}
    v = docs.select("doc_id", F.posexplode(mf.keyword_array(F.col("text"), counts)).alias("slot", "value"))
    return v.select("doc_id", "slot", F.round("value", 6).alias("value"))


def tokens(spark, d):
    c = cp.pairs(fx.captions(spark, d)).select("image_id", F.col("pos").alias("caption_pos"), F.col("caption").alias("t"))
    return cp.token_rows(c, ["image_id", "caption_pos"], "t", 24)


def c15(spark, d):
    return tokens(spark, d)


def simple_tokens(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select("vec_id", "pos", F.when(F.col("pos") == 0, cp.CLS).when(F.col("pos") > 40, cp.PAD).otherwise((F.col("vec_id") * 64 + F.col("pos")) % 20000 + 103).cast("int").alias("token"))


def c16(spark, d):
    k = [F.col("vec_id"), F.col("pos")]
    return cp.masked_tokens(simple_tokens(spark, d), "vec_id", uniform(*k, 1), uniform(*k, 2), uniform(*k, 3), 0.15)


def c17(spark, d):
    i = fx.table(spark, d, "embeddings").select("vec_id")
    return cp.exact_mask(i, "vec_id", 36, 0.6, uniform(F.col("vec_id"), F.col("cell")), 2)


def c18(spark, d):
    a = fx.table(spark, d, "documents").where("doc_id % 10 < 8").select("doc_id", "lang", (F.col("n_chars") % 50).alias("label"))
    return cp.answer_vocabulary(a, "lang", "label", ["doc_id"])


def c19(spark, d):
    c = fx.captions(spark, d)
    z = F.explode(F.arrays_zip(F.transform(F.sequence(F.lit(1), F.size("captions")), lambda i: i).alias("question"), F.transform("captions", lambda t: F.length(t)).alias("score"))).alias("q")
    q = c.select("image_id", z).select("image_id", F.col("q.question").alias("question"), F.col("q.score").alias("score"))
    return q.withColumn("answer", F.when(F.col("score") % 2 == 0, "True").otherwise("False") == "True")


def c20(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("index"))
    total = e.agg(F.count(F.lit(1)).alias("total"))
    return cp.negative_draws(e, "vec_id", "index", 3, total, uniform).select("vec_id", "draw", "target")


QUERIES = {
    "b1_sample_key": b1, "b2_split_and_index": b2, "b3_natural_order": b3, "b4_row_selection": b4, "b5_month_bounds": b5, "b6_month_timestamp": b6, "b7_utc_parse": b7, "b8_before_history": b8, "b9_month_window": b9,
    "b10_paired_windows": b10, "b11_expansion_steps": b11, "b12_box_validation": b12, "b13_tile_box": b13, "b14_sensor_family": b14, "b15_sensor_policy": b15, "b16_slc_mode": b16, "b17_failure_status": b17, "b18_alias_fallback": b18,
    "b19_image_number": b19, "b20_binarise_smooth": b20, "c1_clean_caption": c1, "c2_blank_filter": c2, "c3_caption_dedupe": c3, "c4_caption_index": c4, "c5_replica_flag": c5, "c6_distinct_texts": c6, "c7_dense_text_id": c7, "c8_dense_image_id": c8,
    "c9_relevance": c9, "c9_relevance_train": c9_train, "c10_pair_flattening": c10, "c11_context_text": c11, "c12_patch_lookup": c12, "c13_entry_text": c13, "c14_keyword_vector": c14, "c15_hashed_tokens": c15, "c16_masked_tokens": c16, "c17_exact_mask": c17, "c18_answer_vocabulary": c18,
    "c19_question_rows": c19, "c20_negative_draws": c20,
}

_NAME = "CASE WHEN id % 3 = 0 THEN 'train' WHEN id % 3 = 1 THEN 'val' ELSE 'test' END"
_M1 = "CAST(month || '-01' AS DATE)"
_PAIRS = "p AS (SELECT image_id, split, CAST(generate_subscripts(captions, 1) - 1 AS INT) AS pos, unnest(captions) AS caption FROM captions)"
_U = lambda *k: "CAST(('0x' || substr(md5(" + " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in k) + "), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE)"
_CLEAN = r"""regexp_replace(replace(replace(replace(translate(lower(t), ',.''!?"()*#:;~', ''), '-', ' '), '/', ' '), '<person>', 'person'), '[ \t\n\x0B\f\r]{2,}', ' ', 'g')"""
_WORDS = "array_to_string(list_filter(string_split_regex(coalesce(nullif({0}, ''), 'no context'), '\\s+'), lambda w: w <> '')[1:24], ' ')"
_REST = "coalesce(nullif(t, ''), nullif(s, ''), nullif(j, ''))"
_KINDS = {
    "building": "building|built-up|built up|residential|industrial", "road": "road|transport|highway|street", "railway": "rail", "water": "water|river|wetland", "vegetation": "vegetation|forest|wood|park|green",
    "residential": "residential|neighborhood|neighbourhood", "industrial_commercial": "industrial|commercial", "construction": "construction", "amenity": "amenity|parking",
}
_HINT = {"building": "CASE WHEN doc_id % 2 = 0 THEN n_chars % 150 ELSE 0 END", "road": "CASE WHEN doc_id % 3 = 0 THEN n_chars % 7 ELSE 0 END", "water": "CASE WHEN doc_id % 5 = 0 THEN doc_id % 40 ELSE 0 END", "vegetation": "greatest(doc_id % 4 - 1, 0)"}
_KEYWORD_SQL = (
    "WITH a AS (SELECT doc_id, " + ", ".join(f"{_HINT.get(n, '0')} AS n_{n}, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{w}') OR {_HINT.get(n, '0')} > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS h_{n}" for n, w in _KINDS.items()) + " FROM documents),"
    " b AS (SELECT *, least(n_building / CAST(120 AS DOUBLE), 1) AS c0, least((n_road + n_railway) / CAST(180 AS DOUBLE), 1) AS c1, least(n_water / CAST(30 AS DOUBLE), 1) AS c2, least(n_vegetation / CAST(60 AS DOUBLE), 1) AS c3 FROM a),"
    " c AS (SELECT *, least(0.55 * h_building + 0.25 * h_residential + 0.20 * h_industrial_commercial + 0.35 * c0, 1) AS d0, least(0.55 * h_road + 0.20 * h_railway + 0.25 * c1, 1) AS d1 FROM b),"
    " e AS (SELECT doc_id, [" + ", ".join(f"h_{n}" for n in _KINDS) + ", c0, c1, c2, c3, d0, d1, least(0.50 * d0 + 0.30 * d1 - 0.20 * h_water - 0.10 * h_vegetation + 0.25 * h_construction, 1)] AS v FROM c)"
    " SELECT doc_id, CAST(unnest(range(16)) AS INT) AS slot, round(unnest(v), 6) AS value FROM e"
)
ORACLES = {
    "c13_entry_text": fx.sql(
        r"""WITH e AS (SELECT image_id, image_id % 5 AS r, captions AS c FROM captions), f AS (SELECT image_id, CASE WHEN r = 0 THEN c[1] END AS t, CASE WHEN r = 1 THEN c[1:3] END AS l, CASE WHEN r <> 2 THEN c[2:4] ELSE [] END AS p, CASE WHEN r IN (0, 2) THEN c[2] END AS s FROM e),
        g AS (SELECT image_id, trim(coalesce(t, ''), @) AS t, trim(coalesce(s, ''), @) AS s, l IS NOT NULL AS has, list_filter(list_transform(coalesce(l, []), lambda x: trim(x, @)), lambda x: x <> '') AS l, list_filter(list_transform(p, lambda x: trim(x, @)), lambda x: x <> '') AS p FROM f),
        h AS (SELECT *, list_concat(l, p) AS q, CASE WHEN has THEN array_to_string(l, ' ; ') ELSE t END AS given FROM g),
        k AS (SELECT image_id, CASE WHEN given <> '' THEN given WHEN s <> '' THEN s WHEN len(q) > 0 THEN array_to_string(q, ' ; ') ELSE 'none' END AS text, [x.v FOR x IN list_transform(q, lambda v, i: {'v': v, 'i': i}) IF list_position(q, x.v) = x.i] AS u FROM h)
        SELECT image_id, sha256(text) AS text, CAST(len(u) AS INT) AS n, sha256(coalesce(array_to_string(u, '|'), '')) AS phrases FROM k""".replace("@", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"),
        "captions",
    ),
    "c14_keyword_vector": _KEYWORD_SQL,
    "b1_sample_key": f"WITH o AS (SELECT o_orderkey AS id FROM orders), k AS (SELECT id, CASE WHEN id % 7 <> 2 THEN {_NAME} || '_' || id END AS key FROM o) SELECT id, key, key || '.png' AS file FROM k",
    "b2_split_and_index": f"WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 2) SELECT id, {_NAME} AS split, CAST(id AS INT) AS idx FROM o",
    "b3_natural_order": fx.sql("SELECT key FROM date_records ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, id", "date_records"),
    "b4_row_selection": fx.sql("SELECT key, region_id FROM date_records WHERE split = 'val' AND region_id IN (1, 2, 3) ORDER BY id LIMIT 50", "date_records"),
    "b5_month_bounds": fx.sql(f"SELECT id, strftime({_M1}, '%Y-%m-%d') AS first, strftime(last_day({_M1}), '%Y-%m-%d') AS last FROM date_records", "date_records"),
    "b6_month_timestamp": fx.sql(f"SELECT id, strftime(last_day({_M1}), '%Y-%m-%d') || 'T23:59:59Z' AS ends, month || '-01T00:00:00Z' AS starts FROM date_records", "date_records"),
    "b7_utc_parse": fx.sql("SELECT id, month || '-11 ' || CASE WHEN id % 3 = 0 THEN '08' ELSE '10' END || ':00:00' AS utc FROM date_records", "date_records"),
    "b8_before_history": fx.sql(f"SELECT id, last_day({_M1}) < DATE '1997-03-01' AS before FROM date_records", "date_records"),
    "b9_month_window": fx.sql(f"SELECT id, strftime({_M1} - CAST(greatest(id % 40 - 5, 0) AS INT), '%Y-%m-%d') AS a, strftime(last_day({_M1}) + CAST(greatest(id % 40 - 5, 0) AS INT), '%Y-%m-%d') AS b FROM date_records", "date_records"),
    "b10_paired_windows": fx.sql(
        f"WITH m AS (SELECT id, last_day({_M1}) AS e1, CAST({_M1} + to_months(CAST(id % 4 AS INT)) AS DATE) AS s2 FROM date_records), x AS (SELECT m.id, max(r.range) AS days FROM m, range(60) r WHERE r.range <= m.id % 60 AND e1 + CAST(r.range AS INT) < s2 - CAST(r.range AS INT) GROUP BY 1)"
        " SELECT m.id, CAST(days AS INT) AS days FROM m LEFT JOIN x USING (id)",
        "date_records",
    ),
    "b11_expansion_steps": "SELECT p_partkey, CAST(unnest(list_sort(list_distinct(list_append(range(0, p_size + 1, p_partkey % 9 + 1), p_size)))) AS INT) AS days FROM part",
    "b12_box_validation": fx.sql("SELECT feature_id, CASE WHEN feature_id % 13 = 0 THEN 'longitude' WHEN feature_id % 11 = 0 THEN 'south_north' WHEN feature_id % 17 = 0 THEN 'latitude' WHEN w >= e THEN 'west_east' WHEN s >= n THEN 'south_north' ELSE 'ok' END AS state FROM features", "features"),
    "b13_tile_box": fx.sql(
        "WITH k AS (SELECT *, feature_id % 5 AS a, feature_id % 4 AS b, feature_id % 5 < 4 AS ok FROM features) SELECT feature_id, CASE WHEN ok THEN round(w + a / CAST(4 AS DOUBLE) * (e - w), 9) END AS w, CASE WHEN ok THEN round(n - (b + 1) / CAST(4 AS DOUBLE) * (n - s), 9) END AS s,"
        " CASE WHEN ok THEN round(w + (a + 1) / CAST(4 AS DOUBLE) * (e - w), 9) END AS e, CASE WHEN ok THEN round(n - b / CAST(4 AS DOUBLE) * (n - s), 9) END AS n FROM k",
        "features",
    ),
    "b14_sensor_family": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'landsat-5' WHEN 1 THEN 'landsat-7' WHEN 2 THEN 'landsat-8' WHEN 3 THEN 'landsat-7' WHEN 4 THEN 'sentinel-2' ELSE '' END AS sensor, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS sensor_id FROM orders",
    "b15_sensor_policy": fx.sql("SELECT sensor, count(*) AS n FROM obs WHERE sensor = 'LANDSAT_7' GROUP BY 1", "obs"),
    "b16_slc_mode": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN CAST(o_orderdate AS DATE) + 1500 >= DATE '2003-05-31' THEN 'off' ELSE 'on' END AS mode FROM orders",
    "b17_failure_status": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'failed_retryable' WHEN 1 THEN 'failed_permanent' WHEN 2 THEN 'source_unavailable' WHEN 3 THEN CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'failed_retryable' ELSE 'failed_permanent' END ELSE 'failed_retryable' END AS status FROM orders",
    "b18_alias_fallback": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer",
    "b19_image_number": "SELECT doc_id, CAST(doc_id AS INT) AS number FROM documents",
    "b20_binarise_smooth": fx.sql("SELECT split, round(sum(CASE WHEN CAST(prob AS DOUBLE) * 255 > 127 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END), 6) AS total FROM px8 GROUP BY 1", "px8"),
    "c1_clean_caption": fx.sql(f"WITH {_PAIRS}, q AS (SELECT image_id, pos, caption AS t FROM p) SELECT image_id, pos, sha256(array_to_string(string_split(trim(rtrim({_CLEAN}, chr(10)), ' '), ' ')[1:30], ' ')) AS clean FROM q", "captions"),
    "c2_blank_filter": fx.sql(f"WITH {_PAIRS} SELECT split, count(*) AS n FROM p WHERE regexp_matches(caption, '[A-Za-z0-9]|[^\\x00-\\x7F]') GROUP BY 1", "captions"),
    "c3_caption_dedupe": fx.sql("SELECT image_id, CAST(len(list_distinct(captions)) AS INT) AS n FROM captions", "captions"),
    "c4_caption_index": fx.sql(f"WITH {_PAIRS} SELECT image_id, pos, row_number() OVER (ORDER BY image_id, pos) - 1 AS index FROM p", "captions"),
    "c5_replica_flag": fx.sql(f"WITH {_PAIRS} SELECT split, pos > 0 AS replica, count(*) AS n FROM p GROUP BY 1, 2", "captions"),
    "c6_distinct_texts": fx.sql(f"WITH {_PAIRS} SELECT count(*) AS texts, count(DISTINCT caption) AS distinct_texts FROM p", "captions"),
    "c7_dense_text_id": fx.sql(f"WITH {_PAIRS}, f AS (SELECT caption, min((image_id, pos)) AS f FROM p GROUP BY 1) SELECT sha256(caption) AS text_sha, row_number() OVER (ORDER BY f) - 1 AS text_id FROM f", "captions"),
    "c8_dense_image_id": "WITH f AS (SELECT 'u' || user_id AS name, min(event_id) AS f FROM events GROUP BY 1) SELECT name, row_number() OVER (ORDER BY f) - 1 AS dense FROM f",
    "c9_relevance": fx.sql(f"WITH {_PAIRS}, f AS (SELECT caption, min((image_id, pos)) AS f FROM p GROUP BY 1), i AS (SELECT caption, row_number() OVER (ORDER BY f) - 1 AS text_id FROM f) SELECT image_id, pos, text_id FROM p JOIN i USING (caption)", "captions"),
    "c9_relevance_train": fx.sql(f"WITH {_PAIRS}, t AS (SELECT * FROM p WHERE split = 'train'), f AS (SELECT caption, min((image_id, pos)) AS f FROM t GROUP BY 1), i AS (SELECT caption, row_number() OVER (ORDER BY f) - 1 AS text_id FROM f) SELECT DISTINCT image_id, text_id FROM t JOIN i USING (caption)", "captions"),
    "c10_pair_flattening": fx.sql(f"WITH {_PAIRS} SELECT image_id, sha256(caption) AS text_sha FROM p WHERE split = 'test'", "captions"),
    "c11_context_text": fx.sql(
        "WITH a AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN trim(captions[1]) ELSE '' END AS t, trim(coalesce(captions[2], '')) AS s, list_filter(list_transform(captions[3:5], lambda x: trim(x)), lambda x: x <> '') AS ph FROM captions),"
        " b AS (SELECT *, array_to_string(ph, ' ; ') AS j, list_filter([nullif(t, ''), CASE WHEN s <> '' AND NOT contains(lower(t), lower(s)) THEN s END], lambda x: x IS NOT NULL) || ph AS al FROM a),"
        " c AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(list_distinct(al), lambda x: list_position(al, x))), lambda i: al[i]), ' ; ') AS e FROM b)"
        f" SELECT image_id, sha256({_WORDS.format("coalesce(nullif(j, ''), " + _REST + ")")}) AS phrases, sha256({_WORDS.format("coalesce(nullif(s, ''), " + _REST + ")")}) AS summary, sha256({_WORDS.format('e')}) AS concat, sha256({_WORDS.format(_REST)}) AS any FROM c",
        "captions",
    ),
    "c12_patch_lookup": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'patch' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END AS entry FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "c16_masked_tokens": f"""WITH t AS (SELECT vec_id, CAST(range AS INT) AS pos, CASE WHEN range = 0 THEN 101 WHEN range > 40 THEN 0 ELSE CAST((vec_id * 64 + range) % 20000 + 103 AS INT) END AS token FROM embeddings, range(64)),
        u AS (SELECT *, {_U('vec_id', 'pos', 1)} < CAST(0.15 AS DOUBLE) AND token NOT IN (0, 101) AS c, {_U('vec_id', 'pos', 2)} AS k, {_U('vec_id', 'pos', 3)} AS w FROM t)
        SELECT vec_id, pos, CASE WHEN NOT c THEN token WHEN k < CAST(0.8 AS DOUBLE) THEN 103 WHEN k < CAST(0.9 AS DOUBLE) THEN CAST(floor(w * 30522) AS INT) ELSE token END AS input, CASE WHEN c THEN token ELSE -100 END AS target FROM u""",
    "c17_exact_mask": f"""WITH c AS (SELECT vec_id, range AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_U('vec_id', 'range')}, range) AS r FROM embeddings, range(36))
        SELECT vec_id, CAST((cell // 6) * 2 + dy AS INT) AS py, CAST((cell % 6) * 2 + dx AS INT) AS px, CASE WHEN r <= 22 THEN 1 ELSE 0 END AS masked FROM c, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)""",
    "c18_answer_vocabulary": "SELECT lang, max_by(n_chars % 50, doc_id) AS label FROM documents WHERE doc_id % 10 < 8 GROUP BY 1",
    "c19_question_rows": fx.sql("WITH q AS (SELECT image_id, CAST(generate_subscripts(captions, 1) AS INT) AS question, CAST(length(unnest(captions)) AS INT) AS score FROM captions) SELECT *, score % 2 = 0 AS answer FROM q", "captions"),
    "c20_negative_draws": f"SELECT vec_id, CAST(range AS INT) AS draw, CAST(floor({_U('vec_id', 'range')} * (SELECT count(*) FROM embeddings)) AS BIGINT) AS target FROM embeddings, range(3)",
}
