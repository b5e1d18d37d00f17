"""Queries of the retrieval and series families and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions.storage import checkpointed
from rasterloom.operators import retrieval as rt
from rasterloom.operators import series as se
from rasterloom.operators.retrieval import LANES, MIX
from rasterloom.operators.tiling import uniform
from rasterloom.plans import fixtures as fx
from rasterloom.plans.evaluation import rounded

KS = [1, 5, 10]


def vectors(spark, d):
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("raw"), "label").withColumn("vec", rt.l2_normalised(F.col("raw")))


def j1(spark, d):
    v = vectors(spark, d).select("id", F.posexplode("vec").alias("pos", "v"))
    return rounded(v, "v")


def sides(spark, d):
    """Images and texts. A vector without length is all NaN, as its SQL divides by zero; a null one stays null."""
    nan = F.when(F.col("raw").isNotNull(), F.transform("raw", lambda x: F.lit(float("nan"))))
    v = vectors(spark, d).withColumn("vec", F.coalesce("vec", nan))
    return v.where("id % 2 = 0").select("id", "vec"), v.where("id % 2 = 1").select("id", "vec")


def top(spark, d, k=10):
    return rt.top_k_both(*sides(spark, d), k, block=128)


def j2(spark, d):
    """All scores of the images whose id is divisible by 100, against all texts."""
    i, t = sides(spark, d)
    return rounded(rt.all_scores(i.where("id % 100 = 0"), t, block=128, scale=100.0), "score")


def j3(spark, d):
    return rounded(top(spark, d).select("side", "query", "found", "rank", "score"), "score")


def own(spark, d):
    i = fx.table(spark, d, "embeddings").select("vec_id").where("vec_id % 2 = 1")
    a = i.select(F.lit("text").alias("side"), (F.col("vec_id") - 1).alias("query"), F.col("vec_id").alias("found"))
    return a.unionByName(i.select(F.lit("image").alias("side"), F.col("vec_id").alias("query"), (F.col("vec_id") - 1).alias("found")))


def grouped(found):
    """Of what was found, that which is relevant by repeated captions: text group (id div 2) mod 40. Other relevant pairs can't be hits, and grow with the square of the table."""
    return found.where("(query div 2) % 40 = (found div 2) % 40").select("side", "query", "found")


R = [f"r{k}" for k in KS]


def j4(spark, d):
    return rounded(rt.recall(top(spark, d), own(spark, d), KS), *R)


def grouped_recall(spark, d):
    t = checkpointed(top(spark, d))
    return rt.recall(t, grouped(t), KS)


def j5(spark, d):
    return rounded(grouped_recall(spark, d), *R)


def j6(spark, d):
    return rt.mean_recall(grouped_recall(spark, d), KS)


def reranked(spark, d):
    t = checkpointed(top(spark, d))
    label = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("found"), (1 + F.col("label") % 3).alias("f"))
    second = t.join(label, "found").select("query", "found", (F.col("score") * F.col("f")).alias("score"))
    return rt.rerank(t, second)


def j7(spark, d):
    return rounded(reranked(spark, d).select("side", "query", "found", "score", "rank"), "score")


def j8(spark, d):
    r = checkpointed(reranked(spark, d))
    return rounded(rt.best_positive_ranks(r, grouped(r), KS), *R, "mean")


def j9(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 32").alias("batch"), F.col("label").alias("group"))
    return rounded(rt.soft_targets(e, "batch", "group", "vec_id"), "target")


def j10(spark, d):
    v = vectors(spark, d).select("id", "vec", F.expr("(id div 2) % 40").alias("group"))
    return rt.negative_draws(v.where("id % 2 = 0"), v.where("id % 2 = 1"), block=128)


def j11(spark, d):
    return rt.last_n(fx.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 128)


def j12(spark, d):
    return rt.sampled(fx.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 50, uniform(F.col("vec_id"), 9))


def j13(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("arrival"), F.col("value").alias("priority"))
    return rt.priority_merge(e.where("arrival % 2 = 0"), e.where("arrival % 2 = 1"), "key", "arrival", "priority", 40)


def memory(spark, d):
    e = fx.table(spark, d, "embeddings").where("vec_id < 128")
    return e.select(F.col("vec_id").alias("memory"), F.col("embedding").alias("mvec"), F.element_at("embedding", 1).cast("double").alias("mscore"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("mlabel"))


def memory_pairs(spark, d):
    q = fx.table(spark, d, "embeddings").where("vec_id >= 128").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"), F.element_at("embedding", 2).cast("double").alias("qscore"))
    return rt.cosine_pairs(q, memory(spark, d), 128)


def j14(spark, d):
    return rounded(rt.memory_score(memory_pairs(spark, d), 0.2), "score", "similarity")


def j14_confidence(spark, d):
    return rounded(rt.memory_confidence(rt.memory_score(memory_pairs(spark, d), 0.2), 0.2), "confidence")


def j15(spark, d):
    return rounded(rt.memory_target(memory_pairs(spark, d), 0.2), "target", "weight")


def j16(spark, d):
    s = rt.memory_target(memory_pairs(spark, d), 0.2)
    return s.select("query", F.round(rt.blended(F.col("target"), F.lit(0.4), F.col("weight"), 0.3, 0.1), 6).alias("blended"))


def codebook(spark, d):
    return fx.table(spark, d, "embeddings").where("vec_id % 16 = 0 AND vec_id < 2048").select(F.col("vec_id").alias("code"), F.col("embedding").alias("cvec"))


def assigned(spark, d):
    v = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return v, rt.nearest_code(v, codebook(spark, d), 128)


def j17(spark, d):
    return assigned(spark, d)[1]


def j18(spark, d):
    return rounded(rt.code_perplexity(assigned(spark, d)[1], codebook(spark, d)), "perplexity")


def j19(spark, d):
    v, a = assigned(spark, d)
    state = codebook(spark, d).select("code", F.lit(2.0).alias("size"), F.transform("cvec", lambda x: x.cast("double")).alias("sum"))
    return rounded(rt.codebook_update(v, a, state, 0.9), "size", "sum", "weight")


def j20(spark, d):
    used = codebook(spark, d).where("code % 32 = 0").select("code", F.expr("code div 32").alias("compact"))
    return rt.remapped(assigned(spark, d)[1], used, "code", -1)


def k1(spark, d):
    return rounded(se.exponential_average(fx.logs(spark, d), ["run", "metric"], "step", "value", block=64).select("run", "metric", "step", "average"), "average")


def k2(spark, d):
    return rounded(se.window_statistics(fx.logs(spark, d), ["run", "metric"], "step", "value").select("run", "metric", "step", "median", "mean", "max", "last"), "median", "mean", "max", "last")


def k3(spark, d):
    return rounded(se.weighted_mean(fx.logs(spark, d), ["run", "metric"], "value", (F.col("step") % 3 + 1)), "mean")


def k4(spark, d):
    return rounded(se.best_value(fx.logs(spark, d), ["run"], "value"), "best")


def k5(spark, d):
    return rounded(se.best_step(fx.logs(spark, d), ["run", "metric"], "step", "value"), "best")


QUERIES = {
    "j1_l2_normalisation": j1, "j2_similarity": j2, "j3_top_k": j3, "j4_recall_own": j4, "j5_recall_repeated": j5, "j6_mean_recall": j6, "j7_rerank": j7, "j8_best_positive_rank": j8, "j9_soft_targets": j9, "j10_negative_sampling": j10,
    "j11_fifo_memory": j11, "j12_memory_sample": j12, "j13_priority_merge": j13, "j14_memory_score": j14, "j14_memory_confidence": j14_confidence, "j15_memory_target": j15, "j16_score_blend": j16, "j17_nearest_code": j17, "j18_code_perplexity": j18,
    "j19_codebook_update": j19, "j20_code_remap": j20, "k1_exponential_average": k1, "k2_window_statistics": k2, "k3_weighted_mean": k3, "k4_best_value": k4, "k5_best_step": k5,
}

_V = "v0 AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), v AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vec FROM v0)"
_S = _V + ", s AS (SELECT a.id AS i, b.id AS t, list_dot_product(a.vec, b.vec) AS score FROM v a, v b WHERE a.id % 2 = 0 AND b.id % 2 = 1), a AS (SELECT 'text' AS side, i AS query, t AS found, score FROM s UNION ALL SELECT 'image', t, i, score FROM s)"
_T = _S + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY side, query ORDER BY score DESC, found) AS INT) AS rank FROM a), top AS (SELECT * FROM r WHERE rank <= 10)"
_OWN = "rel AS (SELECT 'text' AS side, vec_id - 1 AS query, vec_id AS found FROM embeddings WHERE vec_id % 2 = 1 UNION ALL SELECT 'image', vec_id, vec_id - 1 FROM embeddings WHERE vec_id % 2 = 1)"
_GRP = "p AS (SELECT a.vec_id AS i, b.vec_id AS t FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND (a.vec_id // 2) % 40 = (b.vec_id // 2) % 40), rel AS (SELECT 'text' AS side, i AS query, t AS found FROM p UNION ALL SELECT 'image', t, i FROM p)"
_REC = lambda t, rel: f"{rel}, h AS (SELECT {t}.side, {t}.query, min(CASE WHEN rel.found IS NOT NULL THEN rank END) AS f FROM {t} LEFT JOIN rel USING (side, query, found) GROUP BY 1, 2), q AS (SELECT side, " + ", ".join(f"avg(CASE WHEN coalesce(f, 99999) <= {k} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS r{k}" for k in KS) + ", count(*) AS queries FROM h GROUP BY 1)"
_RR = _T + ", two AS (SELECT side, query, found, score * (1 + label % 3) AS score FROM top JOIN embeddings ON vec_id = found), rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY side, query ORDER BY score DESC, found) AS INT) AS rank FROM two)"
_RND = ", ".join(f"round(r{k}, 6) AS r{k}" for k in KS)
_U = "greatest(CAST(('0x' || substr(md5(query || '|' || found), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE), 1e-12)"
#: Numbers for each pair: words come in (marked by 2**40), are shifted onto themselves (below 64) and multiplied, as the list says.
_M = f"16, {MIX[0]}, 15, {MIX[1]}, 16"
_LANE = lambda first: f"list_reduce(CAST([{first}, 1099511627776 + (query >> 32), {_M}, 1099511627776 + (query & 4294967295), {_M}, 1099511627776 + (found >> 32), {_M}, 1099511627776 + (found & 4294967295), {_M}, 2199023255552 + {first}, {_M}] AS UBIGINT[]), lambda a, c: CASE WHEN c >= 2199023255552 THEN (a + c - 2199023255552) % 4294967296 WHEN c >= 1099511627776 THEN xor(a, c - 1099511627776) WHEN c < 64 THEN xor(a, a >> c) ELSE a * c % 4294967296 END)"
_MP = _V + """, m AS (SELECT id AS memory, vec AS mv, e[1] AS mscore, CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS mlabel FROM v WHERE id < 128), mp AS (SELECT id AS query, e[2] AS qscore, memory, mscore, mlabel, list_dot_product(vec, mv) AS cos FROM v, m WHERE id >= 128)"""
_SH = lambda x: f"sm AS (SELECT *, CASE WHEN cos < 0.2 THEN -1 ELSE {x} END AS sim FROM mp), lh AS (SELECT *, (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w + 1e-8) AS d FROM sm WINDOW w AS (PARTITION BY query)), sh AS (SELECT *, d / (sum(d) OVER (PARTITION BY query) + 1e-8) AS share FROM lh)"
_CLOSE = "cos * (1 - pow(mscore - qscore, 2))"
_SC = f"{_MP}, {_SH('cos')}, sc AS (SELECT query, sum(share * mscore) AS score, avg(cos) FILTER (cos >= 0.2) AS similarity FROM sh GROUP BY 1)"
_TG = f"{_MP}, {_SH(_CLOSE)}, tg AS (SELECT query, greatest(sum(share * CAST(mlabel AS DOUBLE)), 0) AS target, greatest(coalesce(avg({_CLOSE}) FILTER (cos >= 0.2), 0) - CAST(0.2 AS DOUBLE), 0) / (1 - CAST(0.2 AS DOUBLE)) AS weight FROM sh GROUP BY 1)"
_CB = _V + ", cb AS (SELECT id AS code, e AS c FROM v WHERE id % 16 = 0 AND id < 2048), asg AS (SELECT id, arg_min(code, (round(list_dot_product(e, e) + list_dot_product(c, c) - 2 * list_dot_product(e, c), 9), code)) AS code FROM v, cb GROUP BY 1)"
ORACLES = {
    "j1_l2_normalisation": f"WITH {_V} SELECT id, CAST(unnest(range(64)) AS INT) AS pos, round(unnest(vec), 6) AS v FROM v",
    "j2_similarity": f"WITH {_S} SELECT i AS query, t AS found, round(score * 100, 6) AS score FROM s WHERE i % 100 = 0",
    "j3_top_k": f"WITH {_T} SELECT side, query, found, rank, round(score, 6) AS score FROM top",
    "j4_recall_own": f"WITH {_T}, {_REC('top', _OWN)} SELECT side, {_RND}, queries FROM q",
    "j5_recall_repeated": f"WITH {_T}, {_REC('top', _GRP)} SELECT side, {_RND}, queries FROM q",
    "j6_mean_recall": f"WITH {_T}, {_REC('top', _GRP)}, m AS (SELECT side, (r1 + r5 + r10) / 3 * 100 AS m FROM q) SELECT side, round(m, 2) AS r_mean FROM m UNION ALL SELECT 'all', round(avg(m), 2) FROM m",
    "j7_rerank": f"WITH {_RR} SELECT side, query, found, round(score, 6) AS score, rank FROM rr",
    "j8_best_positive_rank": f"WITH {_RR}, {_REC('rr', _GRP)} SELECT side, " + ", ".join(f"round(r{k} * 100, 6) AS r{k}" for k in KS) + ", round((r1 + r5 + r10) / 3 * 100, 6) AS mean FROM q",
    "j9_soft_targets": "WITH e AS (SELECT vec_id, vec_id // 32 AS batch, label FROM embeddings) SELECT a.batch, a.vec_id, b.vec_id AS other, round(1 / CAST(count(*) OVER (PARTITION BY a.batch, a.vec_id) AS DOUBLE), 6) AS target FROM e a JOIN e b ON a.batch = b.batch AND a.label = b.label",
    "j10_negative_sampling": f"WITH {_S}, {_GRP}, u AS (SELECT side, query, found, score, {_LANE(LANES[0])} AS hi, {_LANE(LANES[1])} AS lo FROM a WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.side = a.side AND rel.query = a.query AND rel.found = a.found)), c AS (SELECT side, query, found, score, -ln(-ln((hi * 2097152 + (lo >> 11) + CAST(0.5 AS DOUBLE)) / CAST(9007199254740992 AS DOUBLE))) AS g FROM u) SELECT side, query, max_by(found, score + g) AS negative, max_by(found, g - score) AS typical FROM c GROUP BY 1, 2",
    "j11_fifo_memory": "SELECT vec_id, label FROM embeddings ORDER BY vec_id DESC LIMIT 128",
    "j12_memory_sample": "SELECT vec_id, label FROM embeddings ORDER BY CAST(('0x' || substr(md5(vec_id || '|9'), 1, 12)) AS BIGINT), vec_id LIMIT 50",
    "j13_priority_merge": "WITH o AS (SELECT user_id AS key, max(event_id) AS arrival, max_by(value, event_id) AS priority FROM events GROUP BY 1) SELECT * FROM o ORDER BY priority DESC, key LIMIT 40",
    "j14_memory_score": f"WITH {_SC} SELECT query, round(score, 6) AS score, round(similarity, 6) AS similarity FROM sc",
    "j14_memory_confidence": f"WITH {_SC} SELECT round(coalesce((avg(similarity) - CAST(0.2 AS DOUBLE)) / (1 - CAST(0.2 AS DOUBLE)), 0), 6) AS confidence FROM sc",
    "j15_memory_target": f"WITH {_TG} SELECT query, round(target, 6) AS target, round(weight, 6) AS weight FROM tg",
    "j16_score_blend": f"WITH {_TG}, b AS (SELECT query, target, CAST(0.3 AS DOUBLE) * pow(weight, exp(CAST(0.1 AS DOUBLE)) + 1) AS b FROM tg) SELECT query, round(b * target + (1 - b) * CAST(0.4 AS DOUBLE), 6) AS blended FROM b",
    "j17_nearest_code": f"WITH {_CB} SELECT id, code FROM asg",
    "j18_code_perplexity": f"WITH {_CB}, n AS (SELECT cb.code, count(asg.id) / CAST((SELECT count(*) FROM asg) AS DOUBLE) AS p FROM cb LEFT JOIN asg ON asg.code = cb.code GROUP BY 1) SELECT round(exp(-sum(p * ln(p + 1e-10))), 6) AS perplexity, count(*) FILTER (p > 0) AS used FROM n",
    "j19_codebook_update": f"""WITH {_CB}, l AS (SELECT asg.code, CAST(unnest(range(64)) AS INT) AS pos, unnest(e) AS x FROM v JOIN asg USING (id)), b AS (SELECT code, pos, sum(x) AS bs, count(*) AS bn FROM l GROUP BY 1, 2),
        s AS (SELECT code, CAST(unnest(range(64)) AS INT) AS pos, unnest(c) AS x FROM cb), n AS (SELECT code, pos, 0.9 * CAST(2 AS DOUBLE) + (1 - CAST(0.9 AS DOUBLE)) * coalesce(bn, 0) AS size, CAST(0.9 AS DOUBLE) * x + (1 - CAST(0.9 AS DOUBLE)) * coalesce(bs, 0) AS sum FROM s LEFT JOIN b USING (code, pos)),
        w AS (SELECT sum(size) AS n, count(*) AS k FROM n WHERE pos = 0) SELECT code, pos, round(size, 6) AS size, round(sum, 6) AS sum, round(sum / ((size + 1e-5) / (n + k * 1e-5) * n), 6) AS weight FROM n, w""",
    "j20_code_remap": f"WITH {_CB} SELECT code, id, CASE WHEN code % 32 = 0 THEN code // 32 ELSE -1 END AS compact FROM asg",
    "k1_exponential_average": fx.sql(
        "WITH RECURSIVE r AS (SELECT run, metric, step, value AS average FROM logs WHERE step = 1 UNION ALL SELECT l.run, l.metric, l.step, CAST(0.99 AS DOUBLE) * r.average + (1 - CAST(0.99 AS DOUBLE)) * l.value FROM r JOIN logs l ON l.run = r.run AND l.metric = r.metric AND l.step = r.step + 1)"
        " SELECT run, metric, step, round(average, 6) AS average FROM r",
        "logs",
    ).replace("WITH logs", "WITH RECURSIVE logs").replace(", RECURSIVE r AS", ", r AS"),
    "k2_window_statistics": fx.sql(
        "WITH w AS (SELECT *, list_sort(list(value) OVER w) AS v, avg(value) OVER w AS m, max(value) OVER w AS x FROM logs WINDOW w AS (PARTITION BY run, metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
        " SELECT run, metric, step, round(v[CAST(ceil(len(v) / 2.0) AS INT)], 6) AS median, round(m, 6) AS mean, round(x, 6) AS max, round(value, 6) AS last FROM w",
        "logs",
    ),
    "k3_weighted_mean": fx.sql("SELECT run, metric, round(sum(value * (step % 3 + 1)) / sum(step % 3 + 1), 6) AS mean FROM logs GROUP BY 1, 2", "logs"),
    "k4_best_value": fx.sql("SELECT run, round(greatest(0, max(value)), 6) AS best FROM logs GROUP BY 1", "logs"),
    "k5_best_step": fx.sql("SELECT run, metric, min_by(step, (-value, step)) AS step, round(max(value), 6) AS best FROM logs GROUP BY 1, 2", "logs"),
}
