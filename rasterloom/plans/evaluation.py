"""Queries of the evaluation family and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import evaluation as ev
from rasterloom.plans import fixtures as fx

T = 0.55
METRICS = ["precision", "recall", "f1", "iou", "accuracy"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def h1(spark, d):
    return ev.confusion_counts(fx.px8(spark, d), ev.at_least("prob", T), by=["split"])


def h2(spark, d):
    return rounded(ev.with_metrics(h1(spark, d)), *METRICS)


def h2_eps(spark, d):
    return rounded(ev.with_metrics(h1(spark, d), epsilon=1e-12), *METRICS)


def h3(spark, d):
    return rounded(ev.evaluate_split(fx.px8(spark, d), "val", T), *METRICS)


def h4(spark, d):
    n = fx.table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors"))
    return ev.threshold_grid(spark).select("threshold").join(F.broadcast(n))


def h5(spark, d):
    return rounded(ev.sweep(fx.px8(spark, d).where("split = 'val'")), *METRICS)


def h6(spark, d):
    return rounded(ev.best_threshold(ev.sweep(fx.px8(spark, d).where("split = 'val'"))), *METRICS)


def h8(spark, d):
    px = fx.px8(spark, d)
    art = ev.freeze(ev.best_threshold(ev.sweep(px.where("split = 'val'"))), "px8")
    return rounded(ev.evaluate_frozen(px, art, "px8"), *METRICS)


def h7(spark, d):
    return ev.freeze(ev.best_threshold(ev.sweep(fx.px8(spark, d).where("split = 'val'"))), "px8").select("threshold", "frozen_on", "dataset_id")


def h9(spark, d):
    px = fx.px8(spark, d)
    more = px.where("scene_id % 50 = 0 AND y = 0").unionByName(px)
    return ev.prediction_audit(more, 10, "val")


def h10(spark, d):
    px = fx.px8(spark, d).withColumns({"half": (F.col("prob") * F.lit(0.5).cast("float")).cast("float"), "flipped": (F.lit(1.0).cast("float") - F.col("prob")).cast("float"), "wide": (F.col("prob") * F.lit(2.0).cast("float")).cast("float")})
    return ev.matching_columns(px, ["prob", "half", "flipped", "wide"], {"tp": 1000, "fp": 1000, "fn": 1000, "tn": 1000}, T)


def h11(spark, d):
    return rounded(ev.official_check(ev.evaluate_split(fx.px8(spark, d), "val", T), {"tp": 5, "fp": 7, "iou": 0.5, "accuracy": 0.8}), "computed", "official")


def h12(spark, d):
    px = fx.px8(spark, d)
    return px.select("split", ev.error_class(ev.at_least("prob", T), F.col("truth")).alias("class")).groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))


def h13(spark, d):
    return rounded(ev.scene_summary(fx.px8(spark, d), T), "mean_prob", "predicted_ratio", "true_ratio", *METRICS)


def h14(spark, d):
    return rounded(ev.best_and_worst(ev.scene_summary(fx.px8(spark, d), T), 5), *METRICS).select("side", "scene_id", *ev.COUNTS, *METRICS)


def logits(spark, d):
    e = fx.table(spark, d, "embeddings")
    target = F.when(F.col("vec_id") % 11 == 0, -100).otherwise((F.col("vec_id") % 8).cast("int"))
    return e.select("vec_id", F.slice("embedding", 1, 8).alias("logits"), target.alias("target"), F.slice("embedding", 9, 8).alias("scores"))


def h15(spark, d):
    return rounded(ev.accuracy(logits(spark, d), "logits", "target"), "accuracy")


def h16(spark, d):
    return fx.table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count("value"), 6).alias("mean"), F.count("value").alias("n"))


def h17(spark, d):
    return rounded(ev.soft_score(logits(spark, d), "logits", "scores"), "score")


PRED = f"prob >= CAST({T} AS FLOAT)"
_COUNTS = "count(*) FILTER ({p} AND truth) AS tp, count(*) FILTER ({p} AND NOT truth) AS fp, count(*) FILTER (NOT ({p}) AND truth) AS fn, count(*) FILTER (NOT ({p}) AND NOT truth) AS tn"
COUNTS = _COUNTS.format(p=PRED)


def metrics_sql(eps: str = "") -> str:
    one = lambda a, b, n: (f"round(CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0 END, 6) AS {n}" if not eps else f"round(({a}) / ({b} + {eps}), 6) AS {n}")
    return ", ".join([one("tp", "(tp + fp)", "precision"), one("tp", "(tp + fn)", "recall"), one("2 * tp", "(2 * tp + fp + fn)", "f1"), one("tp", "(tp + fp + fn)", "iou"), one("tp + tn", "(tp + fp + fn + tn)", "accuracy")])


M = metrics_sql()
_SWEEP = f"""g AS (SELECT round(CAST(0.5 AS DOUBLE) + range * CAST(0.001 AS DOUBLE), 12) AS threshold FROM range(491)),
c AS (SELECT threshold, count(*) FILTER (prob >= CAST(threshold AS FLOAT) AND truth) AS tp, count(*) FILTER (prob >= CAST(threshold AS FLOAT) AND NOT truth) AS fp,
 count(*) FILTER (prob < CAST(threshold AS FLOAT) AND truth) AS fn, count(*) FILTER (prob < CAST(threshold AS FLOAT) AND NOT truth) AS tn FROM px8, g WHERE split = 'val' GROUP BY threshold),
b AS (SELECT threshold FROM c ORDER BY CASE WHEN tp + fp + fn > 0 THEN tp / CAST(tp + fp + fn AS DOUBLE) ELSE 0 END DESC, threshold LIMIT 1)"""
_SCENES = f"s AS (SELECT scene_id, avg(CAST(prob AS DOUBLE)) AS mp, avg(CASE WHEN {PRED} THEN 1.0 ELSE 0.0 END) AS pr, avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END) AS tr, {COUNTS} FROM px8 GROUP BY scene_id)"

QUERIES = {
    "h1_confusion_counts": h1,
    "h2_derived_metrics": h2,
    "h2_metrics_epsilon": h2_eps,
    "h3_split_evaluation": h3,
    "h4_threshold_grid": h4,
    "h5_threshold_sweep": h5,
    "h6_threshold_choice": h6,
    "h7_frozen_threshold": h7,
    "h8_frozen_evaluation": h8,
    "h9_prediction_audit": h9,
    "h10_candidate_columns": h10,
    "h11_official_check": h11,
    "h12_error_classes": h12,
    "h13_scene_summary": h13,
    "h14_best_and_worst": h14,
    "h15_accuracy_ignore": h15,
    "h16_running_mean": h16,
    "h17_soft_score": h17,
}
_ALL = lambda p: _COUNTS.format(p=p)
ORACLES = {
    "h1_confusion_counts": fx.sql(f"SELECT split, {COUNTS} FROM px8 GROUP BY split", "px8"),
    "h2_derived_metrics": fx.sql(f"WITH c AS (SELECT split, {COUNTS} FROM px8 GROUP BY split) SELECT *, {M} FROM c", "px8"),
    "h2_metrics_epsilon": fx.sql(f"WITH c AS (SELECT split, {COUNTS} FROM px8 GROUP BY split) SELECT *, {metrics_sql('1e-12')} FROM c", "px8"),
    "h3_split_evaluation": fx.sql(f"WITH c AS (SELECT {COUNTS} FROM px8 WHERE split = 'val') SELECT *, {M} FROM c", "px8"),
    "h4_threshold_grid": "SELECT round(CAST(0.5 AS DOUBLE) + range * CAST(0.001 AS DOUBLE), 12) AS threshold, (SELECT count(*) FROM embeddings) AS vectors FROM range(491)",
    "h5_threshold_sweep": fx.sql(f"WITH {_SWEEP} SELECT *, {M} FROM c", "px8"),
    "h6_threshold_choice": fx.sql(f"WITH {_SWEEP} SELECT *, {M} FROM c WHERE threshold = (SELECT threshold FROM b)", "px8"),
    "h7_frozen_threshold": fx.sql(f"WITH {_SWEEP} SELECT threshold, 'val' AS frozen_on, 'px8' AS dataset_id FROM b", "px8"),
    "h8_frozen_evaluation": fx.sql(f"WITH {_SWEEP}, t AS (SELECT {_ALL('prob >= CAST((SELECT threshold FROM b) AS FLOAT)')} FROM px8 WHERE split = 'test') SELECT *, {M} FROM t", "px8"),
    "h9_prediction_audit": fx.sql(
        """WITH m AS (SELECT * FROM px8 UNION ALL SELECT * FROM px8 WHERE scene_id % 50 = 0 AND y = 0),
        s AS (SELECT scene_id, count(*) FILTER (split <> 'val') AS wrong_split, count(*) - count(DISTINCT (y, x)) AS repeated, count(*) FILTER (prob < 0 OR prob > 1) AS bad_prob FROM m GROUP BY scene_id)
        SELECT CAST(scene_id AS VARCHAR) AS scene, 'wrong_split' AS rule, wrong_split AS n FROM s WHERE wrong_split > 0
        UNION ALL SELECT CAST(scene_id AS VARCHAR), 'repeated', repeated FROM s WHERE repeated > 0
        UNION ALL SELECT CAST(scene_id AS VARCHAR), 'bad_prob', bad_prob FROM s WHERE bad_prob > 0
        UNION ALL SELECT 'all', 'scene_count', count(*) FROM s HAVING count(*) <> 10""",
        "px8",
    ),
    "h10_candidate_columns": fx.sql(
        "WITH u AS (SELECT 'prob' AS name, prob, truth FROM px8 UNION ALL SELECT 'half', CAST(prob * CAST(0.5 AS FLOAT) AS FLOAT), truth FROM px8 UNION ALL SELECT 'flipped', CAST(CAST(1 AS FLOAT) - prob AS FLOAT), truth FROM px8"
        f" UNION ALL SELECT 'wide', CAST(prob * CAST(2 AS FLOAT) AS FLOAT), truth FROM px8), c AS (SELECT name, {COUNTS} FROM u GROUP BY name HAVING min(prob) >= 0 AND max(prob) <= 1)"
        " SELECT *, abs(tp - 1000) + abs(fp - 1000) + abs(fn - 1000) + abs(tn - 1000) AS distance, tp = 1000 AND fp = 1000 AND fn = 1000 AND tn = 1000 AS same FROM c",
        "px8",
    ),
    "h11_official_check": fx.sql(
        f"WITH c AS (SELECT {COUNTS} FROM px8 WHERE split = 'val'), m AS (SELECT tp, fp, tp / CAST(tp + fp + fn AS DOUBLE) AS iou, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy FROM c)"
        " SELECT 'tp' AS name, CAST(tp AS DOUBLE) AS computed, CAST(5 AS DOUBLE) AS official, tp = 5 AS same FROM m UNION ALL SELECT 'fp', CAST(fp AS DOUBLE), 7, fp = 7 FROM m"
        " UNION ALL SELECT 'iou', round(iou, 6), 0.5, abs(iou - 0.5) <= 1e-12 FROM m UNION ALL SELECT 'accuracy', round(accuracy, 6), 0.8, abs(accuracy - 0.8) <= 1e-12 FROM m",
        "px8",
    ),
    "h12_error_classes": fx.sql(f"SELECT split, CASE WHEN {PRED} AND truth THEN 'TP' WHEN {PRED} THEN 'FP' WHEN truth THEN 'FN' ELSE 'TN' END AS class, count(*) AS n FROM px8 GROUP BY 1, 2", "px8"),
    "h13_scene_summary": fx.sql(f"WITH {_SCENES} SELECT scene_id, round(mp, 6) AS mean_prob, round(CAST(pr AS DOUBLE), 6) AS predicted_ratio, round(CAST(tr AS DOUBLE), 6) AS true_ratio, tp, fp, fn, tn, {M} FROM s", "px8"),
    "h14_best_and_worst": fx.sql(
        f"WITH {_SCENES}, r AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN tp / CAST(tp + fp + fn AS DOUBLE) ELSE 0 END AS q FROM s), k AS (SELECT *, row_number() OVER (ORDER BY q DESC, scene_id) AS a, row_number() OVER (ORDER BY q, scene_id) AS z FROM r)"
        f" SELECT 'best' AS side, scene_id, tp, fp, fn, tn, {M} FROM k WHERE a <= 5 UNION ALL SELECT 'worst', scene_id, tp, fp, fn, tn, {M} FROM k WHERE z <= 5",
        "px8",
    ),
    "h15_accuracy_ignore": "WITH l AS (SELECT embedding[1:8] AS l, vec_id % 8 AS t FROM embeddings WHERE vec_id % 11 <> 0) SELECT count(*) AS n, round(avg(CASE WHEN list_position(l, list_max(l)) - 1 = t THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l",
    "h16_running_mean": "SELECT event_type, round(sum(value) / count(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type",
    "h17_soft_score": "SELECT round(avg(CAST(embedding[9:16][list_position(embedding[1:8], list_max(embedding[1:8]))] AS DOUBLE)), 6) AS score FROM embeddings",
}
