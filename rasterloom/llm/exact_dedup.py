"""Exact deduplication by skew-safe combining.

Equal texts meet in three steps, none of which needs all rows of a group in one task:

1. each task combines its own rows (the partial aggregation over digest, salt and text);
2. the salted digest groups are merged, so that one hot text is spread over ``salts`` tasks;
3. the winners of the salts, at most ``salts`` rows a text, are combined for good.

Every step groups by the text beside its digest, so two texts with one digest stay apart. The winners
go back to the rows by a join that broadcasts the heaviest digests, a fixed number, so that a hot
text's rows stay spread there too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import join_hot, stored, table

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key stays. Null texts count as empty. Rows with a null
    key count in group_size, and stay only if their whole group has no key. Rows that repeat key
    and text are copies of one document: they are counted, and marked alike. An empty table gives
    no rows; other columns are ignored, whatever they are called.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("k"), body.alias("t")).withColumn("h", digest(F.col("t")))
    salted = rows.groupBy("h", F.pmod(F.xxhash64("k"), F.lit(salts)).alias("salt"), "t").agg(
        F.max("k").alias("k"), F.count(F.lit(1)).alias("n")
    )
    # Dealt by digest alone, so that the count of texts to a digest needs no further exchange.
    groups = salted.select("h", "t", "k", "n").repartition("h").groupBy("h", "t").agg(F.max("k").alias("keep"), F.sum("n").alias("n"))
    digests = groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.max("keep").alias("keep"), F.sum("n").alias("n"))
    shared = stored(digests.where("n > 1"), "exact-groups")
    found = join_hot(rows.select("k", "h"), shared.where("texts = 1").drop("texts"), ["h"], "n", "k")
    clashed = shared.where("texts > 1").select("h")
    if not clashed.isEmpty():  # different texts under one digest: these rows are matched by text too
        some = rows.join(clashed, "h", "left_semi")
        own = some.groupBy("h", "t").agg(F.max("k").alias("keep"), F.count(F.lit(1)).alias("n"))
        apart = some.join(own, ["h", "t"]).select("h", "k", "keep", "n")
        found = found.join(clashed, "h", "left_anti").unionByName(apart)
    alone = F.col("n").isNull()
    return found.select(
        F.col("k").alias(key),
        F.when(alone, F.col("k")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("k").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("h").alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
