"""Manifests of samples with two dates: regions, audits, resume merges, work plans, rules and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.storage import bounded

SUCCESS = ["ok", "ok_empty", "ok_partial"]
ACCEPTABLE = ["ok", "ok_partial"]
TRANSIENT = ["authentication_required", "failed_retryable"]
FAILED = ["authentication_required", "failed_retryable", "failed_permanent", "source_unavailable", "insufficient_valid_pixels"]
ALLOWED = [*SUCCESS, *FAILED, "pending", "not_requested", "unavailable_before_history"]


def assign_regions(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """(split, idx) samples with the region whose inclusive range holds them, null without one. ``ranges`` is a row per region and split, a few dozen; its size is checked."""
    r = bounded(ranges.select(F.col("split").alias("_s"), "lo", "hi", "region_id"))
    return samples.join(r, (F.col("split") == F.col("_s")) & F.col("idx").between(F.col("lo"), F.col("hi")), "left").drop("_s", "lo", "hi")


def mapping_audit(mapped: DataFrame, expected: DataFrame) -> DataFrame:
    """Samples per split against the expected (split, n), with those without a region."""
    got = mapped.groupBy("split").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("region_id").isNull()).alias("unmapped"))
    return expected.join(got, "split", "full_outer").select("split", F.coalesce("n", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"), (F.col("n").eqNullSafe(F.col("found"))).alias("same"))


def assemble_records(samples: DataFrame, boxes: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One nested record per sample: box and both dates (month, timestamp) joined by key."""
    d = lambda x, n: x.select(key, F.struct(F.col("month").alias("image_month"), F.col("timestamp").alias("query_timestamp")).alias(n))
    b = boxes.select(key, F.struct(*"wsen").alias("bbox"))
    return samples.join(b, key, "left").join(d(first, "t1"), key, "left").join(d(second, "t2"), key, "left")


def dataset_audit(expected: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """For each part (A, B, label): expected, found, missing and extra names, from one outer join."""
    parts = found.select("part").distinct()
    want = expected.select(key).join(F.broadcast(parts)).withColumn("_w", F.lit(1))
    j = want.join(found.withColumn("_f", F.lit(1)), ["part", key], "full_outer")
    return j.groupBy("part").agg(F.count("_w").alias("expected"), F.count("_f").alias("found"), F.count_if(F.col("_f").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("extra"))


def aligned(found: DataFrame, parts: list[str], key: str = "name") -> DataFrame:
    """Names that every part has."""
    own = found.where(F.col("part").isin(parts)).groupBy(key).agg(F.countDistinct("part").alias("n"))
    return own.where(F.col("n") == len(parts)).select(key)


def initial_status(dates: DataFrame, requested: list[str], history_start: str) -> DataFrame:
    """not_requested, unavailable_before_history or pending for each (sample, date)."""
    s = F.when(~F.col("date").isin(requested), "not_requested").when(F.col("timestamp") < history_start, "unavailable_before_history").otherwise("pending")
    return dates.withColumn("status", s)


def merge_resume(current: DataFrame, previous: DataFrame, on: list[str], invariants: list[str]) -> DataFrame:
    """The new skeleton with finished records of the old manifest carried in: status, fraction and what was done.

    Pending dates take the old record if it ended; dates not requested are never revived; an old
    access failure (code 403) is reset. Rows whose invariants changed are marked, and carry nothing.
    """
    old = previous.select(*on, *[F.col(c).alias(f"_{c}") for c in [*invariants, "status", "valid_fraction", "error_code"]])
    j = current.join(old, on, "left")
    broken = F.lit(False)
    for c in invariants:
        broken = broken | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = F.col("_status").isNotNull()
    act = (
        F.when(~known, "new").when(broken, "mismatch").when(F.col("status") == "not_requested", "not_requested").when(F.col("status") != "pending", "kept_status").when(F.col("_error_code") == 403, "reset")
        .when(F.col("_status").isin(*SUCCESS, *FAILED), "carried").otherwise("still_pending")
    )
    take = F.col("action") == "carried"
    out = j.withColumn("action", act)
    return out.select(*on, *invariants, F.when(take, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(take, F.col("_valid_fraction")).alias("valid_fraction"), "action")


def work_plan(dates: DataFrame, cache_errors: DataFrame, on: list[str], retry: str = "none") -> DataFrame:
    """Dates that are still to do, with why. ``retry`` of failures: none, transient or all.

    Dates before history and permanent failures are left; a success stays done unless its cache is
    broken, which makes it a retryable failure.
    """
    j = dates.join(cache_errors.select(*on, F.col("error").alias("_e")), on, "left")
    status = F.when(F.col("status").isin(SUCCESS) & F.col("_e").isNotNull(), "failed_retryable").otherwise(F.col("status"))
    d = j.withColumn("effective", status)
    skip = F.col("effective").isin(*SUCCESS, "unavailable_before_history", "not_requested", "failed_permanent")
    failed = F.col("effective").isin(FAILED)
    again = F.lit(True) if retry == "all" else F.col("effective").isin(TRANSIENT) if retry == "transient" else F.lit(False)
    return d.where(~skip & (~failed | again)).select(*on, "status", "effective")


def cache_errors(records: DataFrame, files: DataFrame, on: list[str], tolerance: float = 1e-6) -> DataFrame:
    """The first rule that a success record breaks against the facts of its file."""
    f = files.select(*on, F.lit(True).alias("_there"), F.col("features").alias("_n"), F.col("sha256").alias("_h"), F.col("fraction").alias("_f"))
    j = records.where(F.col("status").isin(SUCCESS)).join(f, on, "left")
    error = F.coalesce(
        F.when(F.col("_there").isNull(), F.lit("no file")),
        F.when(F.col("_n") != F.col("feature_count"), F.lit("feature count")),
        F.when((F.col("status") == "ok_empty") & (F.col("_n") > 0), F.lit("empty record has features")),
        F.when((F.col("status") == "ok") & (F.col("_n") == 0), F.lit("record has no features")),
        F.when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("_h")), F.lit("checksum")),
        F.when(F.abs(F.col("valid_fraction") - F.col("_f")) > tolerance, F.lit("fraction")),
    )
    return j.select(*on, error.alias("error")).where("error IS NOT NULL")


def quality_problems(records: DataFrame, on: list[str], least: float = 0.0, tolerance: float = 1e-6) -> DataFrame:
    """A row per broken rule of each date record."""
    v, i = F.col("valid_fraction"), F.col("invalid_fraction")
    rules = F.array_compact(
        F.array(
            F.when(~F.col("status").isin(ALLOWED), "status"), F.when(F.col("status").isin("pending"), "incomplete"), F.when(F.col("status").isin(SUCCESS) & (v.isNull() | (v < 0) | (v > 1)), "fraction"),
            F.when((F.col("status") == "ok") & (v < least), "too_small"), F.when(F.abs(v + i - 1) > tolerance, "sum"), F.when(F.col("status").isin(SUCCESS) & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash"),
        )
    )
    return records.select(*on, F.explode(rules).alias("problem"))


def eligibility(sources: DataFrame, manifest: DataFrame, files: DataFrame, on: list[str], least: float, allow_partial: bool = True) -> DataFrame:
    """Whether each source and date can be used, its status, and the first reason against it."""
    j = sources.join(manifest.select(*on, "status", "valid_fraction"), on, "left").join(files.select(*on).withColumn("_there", F.lit(True)), on, "left")
    s = F.col("status")
    reason = (
        F.when(s.isNull(), "missing_record").when(~s.isin(SUCCESS), F.concat(F.lit("status_"), s)).when((s == "ok_partial") & F.lit(not allow_partial), "partial_not_allowed")
        .when(F.col("_there").isNull() & (s != "ok_empty"), "missing_file").when((s != "ok_empty") & (F.coalesce("valid_fraction", F.lit(0.0)) < least), "insufficient_valid_fraction")
    )
    out = j.select(*on, F.coalesce(s, F.lit("missing")).alias("status"), reason.alias("reason"))
    return out.withColumn("available", F.col("reason").isNull())


def exclusions(eligible: DataFrame, key: str, required: list[str], policy: str = "strict") -> DataFrame:
    """Per sample the ordered distinct reasons of its required dates, and whether the policy (strict or mask) leaves it out."""
    own = eligible.where(F.col("date").isin(required))
    why = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("date", F.concat_ws(":", "date", "reason").alias("r"))))), lambda x: x["r"]))
    g = own.groupBy(key).agg(why.alias("reasons"), F.count_if("available").alias("n"))
    out = F.size("reasons") > 0 if policy == "strict" else F.col("n") == 0
    return g.select(key, "reasons", out.alias("excluded"))


def exclusion_statistics(excluded: DataFrame) -> DataFrame:
    one = excluded.select("excluded", F.explode_outer("reasons").alias("reason"))
    return one.groupBy("excluded", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def agreement(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that differ between two manifests, where both have the sample."""
    j = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    rules = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields]))
    return j.select(key, F.explode(rules).alias("field"))


def region_fallback(a: DataFrame, b: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """The region of each sample: of either manifest, else of the ranges, else -1."""
    j = a.select(key, F.col("region_id").alias("_a")).join(b.select(key, F.col("region_id").alias("_b")), key, "full_outer").join(ranges.select(key, F.col("region_id").alias("_r")), key, "left")
    return j.select(key, F.coalesce("_a", "_b", "_r", F.lit(-1)).alias("region_id"))


def timestamp_problems(records: DataFrame, on: list[str], derived: Column) -> DataFrame:
    """Records whose stored timestamp isn't the one of their month, and whether more than one policy is about."""
    bad = records.where(~F.col("timestamp").eqNullSafe(derived)).select(*[F.col(c).cast("string").alias(c) for c in on], F.lit("timestamp").alias("problem"))
    policies = records.agg(F.countDistinct("policy").alias("n")).where("n > 1").select(*[F.lit("all").alias(c) for c in on], F.lit("policies").alias("problem"))
    return bad.unionByName(policies)
