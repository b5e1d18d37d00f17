"""Confusion counts, threshold sweeps and metrics over pixel tables.

Counts are summed over all pixels before any metric is taken; scene metrics are never averaged.
Probabilities are float32 and compared with float32 thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTS = ["tp", "fp", "fn", "tn"]


def at_least(prob: str, threshold: float) -> Column:
    return F.col(prob) >= F.lit(threshold).cast("float")


def count_columns(pred: Column, truth: Column) -> list[Column]:
    return [
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
        F.count_if(~pred & ~truth).alias("tn"),
    ]


def confusion_counts(df: DataFrame, pred: Column, truth: str = "truth", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*count_columns(pred, F.col(truth)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame, epsilon: float | None = None) -> DataFrame:
    """Adds precision, recall, f1, iou and accuracy; 0 for empty denominators. With ``epsilon`` every denominator is raised by it."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    div = ratio if epsilon is None else lambda a, b: a / (b + F.lit(epsilon))
    return counts.withColumns(
        {"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "iou": div(tp, tp + fp + fn), "accuracy": div(tp + tn, tp + fp + fn + tn)}
    )


def evaluate_split(df: DataFrame, split: str, threshold: float) -> DataFrame:
    """Counts and metrics of one split at one threshold; the filter on split prunes partitions."""
    own = df.where(F.col("split") == split)
    return with_metrics(confusion_counts(own, at_least("prob", threshold)))


def threshold_grid(spark: SparkSession, start: float = 0.5, stop: float = 0.99, step: float = 0.001) -> DataFrame:
    n = round((stop - start) / step)
    return spark.range(n + 1).select(F.col("id").alias("i"), F.round(F.lit(start) + F.col("id") * F.lit(step), 12).alias("threshold"))


def sweep(df: DataFrame, start: float = 0.5, stop: float = 0.99, step: float = 0.001) -> DataFrame:
    """Counts and metrics at every threshold from one pass over the pixels.

    A pixel's bucket is the number of grid thresholds not above it. It is guessed from the
    probability and set right by comparing with the thresholds beside the guess, as float32, so that
    borders are exact. The grid's few hundred bucket sums are then added from the top.
    """
    n = round((stop - start) / step)
    value = lambda i: F.round(F.lit(start) + i * F.lit(step), 12).cast("float")
    guess = F.least(F.greatest(F.floor((F.col("prob").cast("double") - start) / step), F.lit(-1)), F.lit(n)).cast("long")
    one = lambda g: F.when((g < n) & (F.col("prob") >= value(g + 1)), g + 1).when((g >= 0) & (F.col("prob") < value(g)), g - 1).otherwise(g)
    b = df.select("prob", "truth", guess.alias("g")).select("truth", one(F.col("g")).alias("i"))
    sums = b.groupBy("i").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    grid = df.sparkSession.range(-1, n + 1).select(F.col("id").alias("i"))
    # n + 2 rows from here on, whatever the input.
    all_ = grid.join(F.broadcast(sums), "i", "left").fillna(0, ["pos", "neg"])
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("i")
    counts = all_.select("i", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("q"))
    counts = counts.where("i >= 0").select(
        F.round(F.lit(start) + F.col("i") * F.lit(step), 12).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn")
    )
    return with_metrics(counts)


def best_threshold(swept: DataFrame, metric: str = "iou", lowest: bool = True, tolerance: float = 1e-15) -> DataFrame:
    """The row of the best metric; near ties go to the lowest or highest threshold."""
    top = swept.agg(F.max(metric).alias("top"))
    own = swept.join(F.broadcast(top), F.col(metric) >= F.col("top") - F.lit(tolerance)).drop("top")
    return own.orderBy(F.asc("threshold") if lowest else F.desc("threshold")).limit(1)


def freeze(best: DataFrame, dataset_id: str, split: str = "val") -> DataFrame:
    """A one-row artefact of a chosen threshold, with what it was chosen on and a digest of that."""
    body = best.select("threshold", F.lit(split).alias("frozen_on"), F.lit(dataset_id).alias("dataset_id"))
    return body.withColumn("digest", F.sha2(F.concat_ws("|", F.format_number("threshold", 12), "frozen_on", "dataset_id"), 256))


def evaluate_frozen(df: DataFrame, artefact: DataFrame, dataset_id: str, split: str = "test") -> DataFrame:
    """Evaluates a split at a frozen threshold; refuses one that wasn't frozen on val, or of other data, or changed."""
    digest = F.sha2(F.concat_ws("|", F.format_number("threshold", 12), "frozen_on", "dataset_id"), 256)
    ok = (F.col("frozen_on") == "val") & (F.col("dataset_id") == dataset_id) & (F.col("digest") == digest)
    one = artefact.withColumn("ok", F.coalesce(F.assert_true(ok, "threshold is not frozen on val for these data"), F.lit(True))).where("ok").select("threshold")
    own = df.where(F.col("split") == split).join(F.broadcast(one))
    return with_metrics(own.agg(*count_columns(F.col("prob") >= F.col("threshold").cast("float"), F.col("truth"))))


def error_class(pred: Column, truth: Column) -> Column:
    return F.when(pred & truth, "TP").when(pred, "FP").when(truth, "FN").otherwise("TN")


def scene_summary(df: DataFrame, threshold: float) -> DataFrame:
    pred = at_least("prob", threshold)
    agg = df.groupBy("scene_id").agg(
        F.avg(F.col("prob").cast("double")).alias("mean_prob"), F.avg(pred.cast("double")).alias("predicted_ratio"), F.avg(F.col("truth").cast("double")).alias("true_ratio"), *count_columns(pred, F.col("truth"))
    )
    return with_metrics(agg)


def best_and_worst(scenes: DataFrame, k: int, metric: str = "iou") -> DataFrame:
    """The k best scenes, best first, and the k worst, worst first; ties by scene."""
    top = scenes.orderBy(F.desc(metric), "scene_id").limit(k).withColumn("side", F.lit("best"))
    low = scenes.orderBy(F.asc(metric), "scene_id").limit(k).withColumn("side", F.lit("worst"))
    return top.unionByName(low)


def matching_columns(df: DataFrame, columns: list[str], official: dict[str, int], threshold: float) -> DataFrame:
    """Of columns in [0, 1], whose counts at the threshold equal the official ones, and how far each is off: one pass over the pixels."""
    aggs = []
    for c in columns:
        aggs.append(F.struct(*count_columns(at_least(c, threshold), F.col("truth")), F.min(c).alias("low"), F.max(c).alias("high")).alias(c))
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))).alias("name", "r"))
    off = sum((F.abs(F.col(f"r.{k}") - F.lit(official[k])) for k in COUNTS), F.lit(0))
    return rows.where("r.low >= 0 AND r.high <= 1").select("name", *[F.col(f"r.{k}").alias(k) for k in COUNTS], off.alias("distance"), (off == 0).alias("same"))


def official_check(computed: DataFrame, official: dict[str, float], tolerance: float = 1e-12) -> DataFrame:
    """One row per figure: computed, official, and whether counts are equal and metrics within the tolerance."""
    names = [c for c in computed.columns if c in official]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("computed"), F.lit(float(official[n])).alias("official")) for n in names])).alias("p")
    out = computed.select(pairs).select("p.*")
    return out.withColumn("same", F.when(F.col("name").isin(COUNTS), F.col("computed") == F.col("official")).otherwise(F.abs(F.col("computed") - F.col("official")) <= tolerance))


def prediction_audit(df: DataFrame, expected_scenes: int, split: str) -> DataFrame:
    """What is wrong with a set of predictions, as rows: wrong split, repeated pixels, probability outside [0, 1], number of scenes."""
    own = df.groupBy("scene_id").agg(
        F.count_if(F.col("split") != split).alias("wrong_split"),
        (F.count(F.lit(1)) - F.countDistinct("y", "x")).alias("repeated"),
        F.count_if((F.col("prob") < 0) | (F.col("prob") > 1) | F.isnan("prob") | F.col("prob").isNull()).alias("bad_prob"),
    )
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in ("wrong_split", "repeated", "bad_prob")])).alias("r")
    rows = own.select(F.col("scene_id").cast("string").alias("scene"), rules).where("r.n > 0").select("scene", "r.rule", "r.n")
    total = own.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected_scenes).select(F.lit("all").alias("scene"), F.lit("scene_count").alias("rule"), "n")
    return rows.unionByName(total)


def accuracy(df: DataFrame, logits: str, target: str, ignore: int = -100) -> DataFrame:
    """Share of rows whose first greatest logit is the target; rows with the ignored target don't count."""
    guess = F.array_position(logits, F.array_max(logits)) - 1
    own = df.where(F.col(target) != ignore)
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg((guess == F.col(target)).cast("double")).alias("accuracy"))


def soft_score(df: DataFrame, logits: str, targets: str) -> DataFrame:
    """Mean target score of the first greatest logit."""
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    return df.agg(F.avg(F.element_at(targets, at).cast("double")).alias("score"))
