"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept and returns documents with the same columns;
the last returns the pieces of the packed sequences. ``run`` writes each stage's result to the shared
folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.storage import dropped
from rasterloom.llm.common import fresh, stored, table
from rasterloom.llm.exact_dedup import exact_dedup
from rasterloom.llm.jaccard_join import jaccard_join
from rasterloom.llm.packing import best_fit_packing
from rasterloom.llm.quality import keep_quality, train
from rasterloom.llm.substring_dedup import substring_dedup
from rasterloom.operators.captions import numbered

#: Near duplicates: five-word shingles, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, does not reject."""
    return keep_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def text_sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the largest doc_id.

    Decided for each row by doc_id and text: an id's other texts stay. Rows without an id go if a row
    with one has their text. Of rows that repeat id (or its absence) and text one stays, the least by
    its other columns. All columns are kept, whatever their names.
    """
    k, s, n, kept, h, row = (fresh(c, docs.columns) for c in ("key", "sha", "copies", "stays", "digest", "whole"))
    decided = exact_dedup(docs).groupBy(F.col("doc_id").alias(k), F.col("text_sha256").alias(s)).agg(F.first("kept").alias(kept), F.count(F.lit(1)).alias(n))
    odd = stored(decided.where(~F.col(kept) | (F.col(n) > 1)), "exact-decided")
    same = F.col("doc_id").eqNullSafe(F.col(k)) & (F.col(h) == F.col(s))
    marked = docs.withColumn(h, text_sha())
    left = marked.join(odd, same, "left_anti").select(*own_columns(docs))
    twice = odd.where(F.col(kept))
    if twice.isEmpty():
        return left
    one = marked.join(twice, same, "left_semi").groupBy("doc_id", h).agg(F.min(F.struct(*own_columns(docs))).alias(row))
    return left.unionByName(one.select(f"{row}.*"))


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest doc_id.

    Decided for each row: where ids are missing or repeat, rows are numbered by id and digest of the
    text, those without an id last, and the smallest number stays. Rows that repeat id and text are
    one. All columns are kept, whatever their names.
    """
    none, k, s, n, h, row = (fresh(c, docs.columns) for c in ("none", "key", "sha", "copies", "digest", "row"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n)).where(F.col("doc_id").isNull() | (F.col(n) > 1))
    if odd.isEmpty():
        gone = jaccard_join(docs, SHINGLE, PERCENT).where("component_id <> doc_id").select(F.col("doc_id").alias(k))
        return docs.join(gone, F.col("doc_id") == F.col(k), "left_anti").select(*own_columns(docs))
    pairs = docs.select(F.col("doc_id").isNull().alias(none), F.col("doc_id").alias(k), text_sha().alias(s)).distinct()
    numbers = numbered(stored(pairs, "near-pairs"), [none, k, s], row).select(F.col(row).cast("long").alias(row), k, s)
    same = F.col("doc_id").eqNullSafe(F.col(k)) & (F.col(h) == F.col(s))
    rows = stored(docs.withColumn(h, text_sha()).join(numbers, same).select(*own_columns(docs), row), "near-rows")
    gone = jaccard_join(rows, SHINGLE, PERCENT, key=row).where(F.col("component_id") != F.col(row)).select(F.col(row).alias(k))
    return rows.join(gone, F.col(row) == F.col(k), "left_anti").select(*own_columns(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go.

    n_chars, where there is such a column, is that of what is left. All other columns are kept, and a
    text that is null stays null.
    """
    none = fresh("none", docs.columns)
    found = substring_dedup(docs.withColumn(none, F.col("text").isNull()), carry=[*[c for c in docs.columns if c != "text"], none])
    changed = F.col("n_removed") > 0
    text = F.when(~F.col(f"rest.{none}"), F.col("kept")).alias("text")
    kept = found.where(~changed | (F.col("kept") != ""))

    def column(c: str) -> Column:
        own = F.col(f"rest.`{c}`")
        return F.when(changed, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own).alias(c) if c == "n_chars" else own.alias(c)

    return kept.select(*[text if c == "text" else column(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})


STAGES = [("quality", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("substring dedup", passages), ("best-fit packing", packing)]

#: The classifier and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
