"""Reflectance, quality masks, spectral indices, composites and training statistics over pixel tables.

Invalid values are stored as 0 beside a validity flag, never as null or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions.storage import bounded

BANDS = ["green", "red", "nir", "ndvi", "ndwi"]
#: Bits of the pixel-quality and saturation words that make a pixel invalid, by spacecraft (fixed values).
QA_PIXEL_BITS = {"LANDSAT_5": [0, 1, 3, 4, 5], "LANDSAT_7": [0, 1, 3, 4, 5], "LANDSAT_8": [0, 1, 2, 3, 4, 5]}
QA_RADSAT_BITS = {"LANDSAT_5": [1, 2, 3, 9], "LANDSAT_7": [1, 2, 3, 9], "LANDSAT_8": [2, 3, 4]}
POLICIES = {"landsat7_consistent": ["LANDSAT_7"]}
SCALE, OFFSET = 2.75e-5, -0.2
OK = ["ok", "ok_partial"]


def single(x: float) -> Column:
    return F.lit(x).cast("float")


def scale_offset(value: Column, scale: float = SCALE, offset: float = OFFSET) -> Column:
    return value.cast("float") * single(scale) + single(offset)


def qa_masks(spark: SparkSession) -> DataFrame:
    """A row per spacecraft: the two words with all bits set that make a pixel invalid."""
    word = lambda bits: sum(1 << b for b in bits)
    rows = [F.struct(F.lit(s).alias("sensor"), F.lit(word(QA_PIXEL_BITS[s])).alias("pixel_mask"), F.lit(word(QA_RADSAT_BITS[s])).alias("radsat_mask")) for s in QA_PIXEL_BITS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_qa_valid(df: DataFrame, sensor: str = "sensor", pixel: str = "qa_pixel", radsat: str = "qa_radsat") -> DataFrame:
    """Adds ``valid``. Rows of an unknown spacecraft are an error."""
    m = df.join(F.broadcast(qa_masks(df.sparkSession)), sensor, "left")  # one row a spacecraft
    clear = (F.col(pixel).bitwiseAND(F.col("pixel_mask")) == 0) & (F.col(radsat).bitwiseAND(F.col("radsat_mask")) == 0)
    return m.withColumn("valid", F.when(F.col("pixel_mask").isNull(), F.raise_error(F.concat(F.lit("unsupported spacecraft "), F.col(sensor)))).otherwise(clear)).drop("pixel_mask", "radsat_mask")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def normalised_difference(a: Column, b: Column, valid: Column, epsilon: float = 1e-6, gross: float = 1.05) -> tuple[Column, Column]:
    """(a - b) / (a + b) clipped to [-1, 1], and whether it is valid; 0 where it isn't. ``epsilon`` bounds the sum, and isn't added."""
    total = a + b
    raw = F.when(F.abs(total).cast("double") > epsilon, ((a - b) / total).cast("float"))
    ok = F.coalesce(valid & finite(a) & finite(b) & finite(raw) & (F.abs(raw).cast("double") <= gross), F.lit(False))
    return F.when(ok, F.least(F.greatest(raw, single(-1.0)), single(1.0))).otherwise(single(0.0)), ok


def compose_channels(df: DataFrame, green: str = "green", red: str = "red", nir: str = "nir", valid: str = "valid", epsilon: float = 1e-6) -> DataFrame:
    """The five channels with one validity: that of the input, of every band, and of both indices; all 0 where it fails."""
    g, r, n = F.col(green), F.col(red), F.col(nir)
    ndvi, ok1 = normalised_difference(n, r, F.col(valid), epsilon)
    ndwi, ok2 = normalised_difference(g, n, F.col(valid), epsilon)
    d = df.withColumns({"_ndvi": ndvi, "_ndwi": ndwi, "_ok": ok1 & ok2 & finite(g)})
    named = {"green": g, "red": r, "nir": n, "ndvi": F.col("_ndvi"), "ndwi": F.col("_ndwi")}
    return d.withColumns({k: F.when(F.col("_ok"), v).otherwise(single(0.0)) for k, v in named.items()} | {valid: F.col("_ok")}).drop("_ndvi", "_ndwi", "_ok")


def prepared(df: DataFrame, start: str | None = None, end: str | None = None, sensors: list[str] | None = None) -> DataFrame:
    """Filtered by date (end inclusive) and sensor, masked and composed. The filters reach the scan."""
    d = df
    if start:
        d = d.where(F.col("acquired") >= F.to_date(F.lit(start)))
    if end:
        d = d.where(F.col("acquired") <= F.to_date(F.lit(end)))
    if sensors:
        d = d.where(F.col("sensor").isin(sensors))
    d = with_qa_valid(d)
    d = d.withColumns({b: scale_offset(F.col(f"raw_{b}")) for b in ("green", "red", "nir")})
    return compose_channels(d)


def sensors_of(policy: str) -> list[str]:
    if policy not in POLICIES:
        raise ValueError(f"unknown sensor policy {policy!r}")
    return POLICIES[policy]


def median_composite(df: DataFrame, by: list[str], bands: list[str] = BANDS, valid: str = "valid") -> DataFrame:
    """Exact median of the valid values of each band, and how many there are; null and 0 where none is."""
    one = lambda b: F.when(F.col(valid), F.col(b).cast("double"))
    return df.groupBy(*by).agg(*[F.median(one(b)).alias(b) for b in bands], F.count_if(valid).alias("observations"))


def expansion_steps(step: Column, most: Column) -> Column:
    """0, step, 2 * step, ... up to ``most``, which is added where it isn't met."""
    return F.array_distinct(F.concat(F.when(most > 0, F.sequence(F.lit(0), most, step)).otherwise(F.array(F.lit(0))), F.array(F.greatest(most, F.lit(0)))))


def window_diagnostics(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window (name, start, end): scenes, pixels, share of pixels with a valid observation, mean share of valid observations.

    Two levels: first each window's pixels, which combines before the exchange, then the windows. The number of windows is checked.
    """
    w = df.join(bounded(windows), F.col("acquired").between(F.col("start"), F.col("end")))
    px = w.groupBy("name", "px").agg(F.max("valid").alias("any"), F.count_if("valid").alias("n"), F.count(F.lit(1)).alias("of"))
    days = w.groupBy("name").agg(F.countDistinct("acquired", "sensor").alias("scenes"))
    out = px.groupBy("name").agg(F.count(F.lit(1)).alias("pixels"), F.avg(F.col("any").cast("double")).alias("valid_fraction"), (F.sum("n") / F.sum("of")).alias("observation_fraction"))
    return days.join(out, "name")


def choose_window(attempts: DataFrame, by: list[str], least: float) -> DataFrame:
    """Of each key's attempts (expansion, scenes, valid_fraction) the first good enough, else the last, with its status."""
    good = (F.col("scenes") > 0) & (F.col("valid_fraction") >= least)
    a = attempts.groupBy(*by).agg(
        F.min(F.when(good, F.struct("expansion", "scenes", "valid_fraction"))).alias("first"), F.max(F.struct("expansion", "scenes", "valid_fraction")).alias("last"), F.sum("scenes").alias("all"), F.count(F.lit(1)).alias("attempts")
    )
    pick = F.coalesce("first", "last")
    status = (
        F.when(F.col("all") == 0, "source_unavailable").when(F.col("first").isNull(), "insufficient_valid_pixels").when(pick["valid_fraction"] >= 1.0, "ok").otherwise("ok_partial")
    )
    return a.select(*by, pick["expansion"].alias("expansion"), pick["valid_fraction"].alias("valid_fraction"), status.alias("status"), "attempts")


def channel_audit(df: DataFrame, by: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Per group: indices out of range, index errors, non-zero values in invalid pixels, valid share, least and greatest index."""
    ndvi, ok = normalised_difference(F.col("nir"), F.col("red"), F.col("valid"))
    bad = lambda c: F.count_if(F.col("valid") & ~(finite(F.col(c)) & (F.abs(F.col(c)) <= 1 + tolerance)))
    return df.groupBy(*by).agg(
        bad("ndvi").alias("bad_ndvi"), bad("ndwi").alias("bad_ndwi"),
        F.count_if(F.col("valid") & ok & (F.abs(ndvi - F.col("ndvi")) > tolerance)).alias("wrong_ndvi"),
        F.count_if(~F.col("valid") & ((F.col("ndvi") != 0) | (F.col("ndwi") != 0) | (F.col("green") != 0))).alias("nonzero_invalid"),
        F.avg(F.col("valid").cast("double")).alias("valid_fraction"), F.min(F.col("ndvi").cast("double")).alias("min_ndvi"), F.max(F.col("ndvi").cast("double")).alias("max_ndvi"),
    )


def training_stats(df: DataFrame, by: list[str], bands: list[str], floor: float = 1e-12, split: str = "train") -> DataFrame:
    """Count, mean and population standard deviation of the valid values of one split, a row per group and band.

    Variance is merged from partial means in double and has a floor. Groups of valid rows with one value
    or none are an error. The validity stays out of the filter, which would repeat what it is computed from.
    """
    own = df.where(F.col("split") == split)
    value = lambda b: F.when(F.col("valid") & finite(F.col(b).cast("double")), F.col(b).cast("double"))
    wide = own.groupBy(*by).agg(F.count_if("valid").alias("_rows"), *[f(value(b)).alias(f"_{s}_{b}") for b in bands for s, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))])
    if by:
        wide = wide.where("_rows > 0")
    s = wide.select(*by, F.inline(F.array(*[F.struct(F.lit(b).alias("band"), *[F.col(f"_{s}_{b}").alias(s) for s in ("n", "mean", "var")]) for b in bands])))
    std = F.sqrt(F.greatest(F.col("var"), F.lit(floor)))
    checked = F.when(F.col("n") > 1, F.col("n")).otherwise(F.raise_error("a group has one valid value or none").cast("long"))
    return s.select(*by, "band", checked.alias("n"), "mean", std.alias("std"))


def normalise(df: DataFrame, stats: DataFrame, by: list[str], bands: list[str], valid: str = "valid") -> DataFrame:
    """(value - mean) / std of the row's group, 0 where invalid. Valid rows of a group without statistics are an error.

    ``stats`` has a row per group and band, a handful, which is checked; without ``by`` one set of statistics serves all rows.
    """
    wide = stats.groupBy(*by).pivot("band", bands).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    d = df.join(bounded(wide), by, "left") if by else df.join(F.broadcast(wide))
    one = lambda b: F.when(~F.col(valid), F.lit(0.0)).when(F.col(f"{b}_mean").isNull(), F.raise_error("no statistics for a group with valid pixels").cast("double")).otherwise((F.col(b).cast("double") - F.col(f"{b}_mean")) / F.col(f"{b}_std"))
    return d.withColumns({b: one(b) for b in bands}).drop(*[f"{b}_{s}" for b in bands for s in ("mean", "std")])


def stats_problems(stats: DataFrame, order: list[str]) -> DataFrame:
    """Why statistics must not be used: not of train only, not finite, no spread, bands missing. No rows: they may."""
    rules = F.array_compact(F.array(F.when(F.col("split_used") != "train", "split"), F.when(F.col("other_splits_used"), "leak"), F.when(~finite(F.col("mean")) | ~finite(F.col("std")), "not_finite"), F.when(F.col("std") <= 0, "no_spread")))
    rows = stats.select("band", F.explode(rules).alias("problem"))
    want = stats.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in order])).alias("band"))
    return rows.unionByName(want.join(stats, "band", "left_anti").withColumn("problem", F.lit("missing")))


def paired_change(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Index differences, after minus before, where both are valid."""
    a, b = (d.select(*on, F.col("ndvi").alias(f"v{i}"), F.col("ndwi").alias(f"w{i}"), F.col("valid").alias(f"ok{i}")) for i, d in ((1, before), (2, after)))
    j = a.join(b, on)
    both = F.col("ok1") & F.col("ok2")
    diff = lambda x: F.when(both, (F.col(f"{x}2") - F.col(f"{x}1")).cast("double"))
    return j.select(*on, diff("v").alias("d_ndvi"), diff("w").alias("d_ndwi"), both.alias("valid"))


def coverage_report(records: DataFrame) -> DataFrame:
    """Counts by split, region and status with all their totals, and the valid fractions of acceptable records."""
    ok = F.when(F.col("status").isin(OK), F.col("valid_fraction"))
    return records.groupingSets([[F.col("split"), F.col("status")], [F.col("region_id"), F.col("status")], [F.col("split")], []], "split", "region_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count(ok).alias("acceptable"), F.avg(ok).alias("mean_fraction"), F.min(ok).alias("min_fraction"), F.max(ok).alias("max_fraction")
    )


def one_per_group(samples: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return samples.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def _along(df: DataFrame, axis: DataFrame, name: str, keep: list[str], sums: dict[str, Column], nearest: str) -> DataFrame:
    """``df`` carried to the target places of one axis: weighted sums, the weight, and what the nearest source place has.

    ``axis`` has a few rows for each target row or column (t, name, f, near), whatever the scenes, and is broadcast.
    """
    f = F.col(f"f{name}")
    weighed = [F.sum(f * c).alias(n) for n, c in sums.items()]
    return df.join(F.broadcast(axis), name).groupBy(*keep, f"t{name}").agg(*weighed, F.max(F.when(F.col(f"n{name}"), F.col(nearest))).alias("_n"))


def _carried(df: DataFrame, values: list[str], valid: str, ys: DataFrame, xs: DataFrame, scene: str) -> DataFrame:
    """(scene, ty, tx) with the weighted sums of valid values (``_`` before the name), of validity (_s), of weights (_w), and the nearest pixel's validity (_n): rows first, then columns."""
    m = F.col(valid).cast("double")
    first = {**{f"_{v}": m * F.col(v) for v in values}, "_s": m, "_w": F.lit(1.0)}
    d = _along(df.select(scene, "y", "x", valid, *values), ys, "y", [scene, "x"], first, valid)
    return _along(d, xs, "x", [scene, "ty"], {n: F.col(n) for n in first}, "_n")


def resize_valid(df: DataFrame, values: list[str], valid: str, source: tuple[int, int], target: tuple[int, int], scene: str = "scene_id") -> DataFrame:
    """Bilinear resize (half-pixel centres) of values times validity over resized validity; valid where the nearest pixel is and there is support.

    The weights are products of one for the row and one for the column, so rows are resized first, then columns.
    """
    spark = df.sparkSession

    def axis(n: int, m: int, name: str) -> DataFrame:
        at = F.greatest((F.col("id") + 0.5) * (n / m) - 0.5, F.lit(0.0))
        lo = F.least(F.floor(at), F.lit(n - 1)).cast("int")
        part = at - lo
        near = F.least(F.floor(F.col("id") * (n / m)), F.lit(n - 1)).cast("int")
        ends = F.array(F.struct(lo.alias("s"), (F.lit(1.0) - part).alias("f")), F.struct(F.least(lo + 1, F.lit(n - 1)).alias("s"), part.alias("f")), F.struct(near.alias("s"), F.lit(0.0).alias("f")))
        d = spark.range(m).select(F.col("id").cast("int").alias(f"t{name}"), near.alias("near"), F.explode(ends).alias("e"))
        return d.groupBy(f"t{name}", F.col("e.s").alias(name), (F.col("e.s") == F.col("near")).alias(f"n{name}")).agg(F.sum("e.f").alias(f"f{name}"))

    out = _carried(df, values, valid, axis(source[0], target[0], "y"), axis(source[1], target[1], "x"), scene)
    ok = F.coalesce("_n", F.lit(False)) & (F.col("_s") > 1e-6)
    return out.select(scene, "ty", "tx", *[F.when(ok, F.col(f"_{v}") / F.greatest("_s", F.lit(1e-6))).otherwise(F.lit(0.0)).alias(v) for v in values], ok.alias("valid"))


def _axes(spark: SparkSession, source: tuple[float, float, float, float, int, int], bbox: tuple[float, float, float, float], shape: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """For each target row (and column) the source rows it takes from: t, place, bilinear weight between pixel centres, whether it is the nearest.

    The source is west, north, pixel width, pixel height, rows and columns; the target a box (west,
    south, east, north) and a shape. At most two rows a target row or column.
    """
    west, north, dx, dy, h, w = source
    left, south, right, top = bbox

    def axis(n: int, m: int, name: str, place: Column) -> DataFrame:
        lo = F.floor(place - 0.5)
        part = place - 0.5 - lo
        ends = F.array(F.struct(lo.alias("s"), (F.lit(1.0) - part).alias("f")), F.struct((lo + 1).alias("s"), part.alias("f")))
        d = spark.range(m).select(F.col("id").cast("int").alias(f"t{name}"), F.floor(place).alias("near"), F.explode(ends).alias("e"))
        return d.select(f"t{name}", F.col("e.s").cast("int").alias(name), F.col("e.f").alias(f"f{name}"), (F.col("e.s") == F.col("near")).alias(f"n{name}")).where(F.col(name).between(0, n - 1))

    ys = axis(h, shape[0], "y", (north - (top - (F.col("id") + 0.5) * ((top - south) / shape[0]))) / dy)
    return ys, axis(w, shape[1], "x", (left + (F.col("id") + 0.5) * ((right - left) / shape[1]) - west) / dx)


def _whole(df: DataFrame, got: DataFrame, scene: str, shape: tuple[int, int]) -> DataFrame:
    all_ = df.select(scene).distinct().withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))))
    return all_.join(got, [scene, "ty", "tx"], "left")


def align_valid(
    df: DataFrame, values: list[str], valid: str, source: tuple[float, float, float, float, int, int], bbox: tuple[float, float, float, float], shape: tuple[int, int], scene: str = "scene_id"
) -> DataFrame:
    """Values on the target's grid, of the same reference system: bilinear over the valid source pixels; valid where the nearest source pixel is.

    Invalid target pixels, those outside the source too, are 0, as are values under 1e-7.
    """
    s = _carried(df, values, valid, *_axes(df.sparkSession, source, bbox, shape), scene)
    out = _whole(df, s, scene, shape)
    ok = F.coalesce("_n", F.lit(False))
    cell = lambda v: F.when(ok & (F.col("_s") > 1e-6 * F.col("_w")), F.col(f"_{v}") / F.col("_s")).otherwise(F.lit(0.0))
    return out.select(scene, "ty", "tx", *[F.when(F.abs(cell(v)) < 1e-7, F.lit(0.0)).otherwise(cell(v)).alias(v) for v in values], ok.alias("valid"))


def align_mask(df: DataFrame, mask: str, source: tuple[float, float, float, float, int, int], bbox: tuple[float, float, float, float], shape: tuple[int, int], scene: str = "scene_id") -> DataFrame:
    """A mask on the target's grid: that of the nearest source pixel, false outside."""
    ys, xs = (F.broadcast(a.where(f"n{n}").select(f"t{n}", n)) for a, n in zip(_axes(df.sparkSession, source, bbox, shape), "yx", strict=True))
    got = df.join(ys, "y").join(xs, "x").select(scene, "ty", "tx", F.col(mask).alias("_m"))
    return _whole(df, got, scene, shape).select(scene, "ty", "tx", F.coalesce("_m", F.lit(False)).alias(mask))
