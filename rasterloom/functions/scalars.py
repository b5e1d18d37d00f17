"""Scalar functions on keys, months, dates, boxes and sensor names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITS = ["train", "val", "test"]
RETRYABLE_CODES = [429, 500, 502, 503, 504]
SLC_FAILURE = "2003-05-31"


def sample_key(value: Column, extension: bool = False, strict: bool = False) -> Column:
    """``Train_0012.png``, a path to it or ``train_12_y0_x256`` becomes ``train_12`` (with ``.png`` on request).

    Folders, tile ends and extensions go, case is folded, leading zeros are dropped. What doesn't
    fit is null, or an error if ``strict``.
    """
    name = F.trim(F.element_at(F.split(F.regexp_replace(value, r"\\", "/"), "/"), -1))
    tile = r"(?i)(?:_y\d+_x\d+|_r\d+_c\d+)$"
    stem = F.regexp_replace(F.regexp_replace(name, tile, ""), r"(?<=.)\.[^.]+$", "")
    part = lambda v, n: F.regexp_extract(v, r"(?i)^(train|val|test)_(\d+)$", n)
    made = lambda v, n: F.when(n != "", F.concat(F.lower(part(v, 1)), F.lit("_"), n.cast("bigint").cast("string"), F.lit(".png" if extension else "")))
    key = once(stem, lambda v: once(part(v, 2), lambda n: made(v, n)))
    return F.coalesce(key, F.raise_error(F.concat(F.lit("not a sample key: "), value))) if strict else key


def split_and_index(key: Column) -> tuple[Column, Column]:
    return F.regexp_extract(key, r"^([a-z]+)_(\d+)", 1), F.regexp_extract(key, r"^([a-z]+)_(\d+)", 2).cast("int")


def natural_order(key: Column) -> list[Column]:
    """Sort keys: train, val, test, others; then the number; then the key."""
    split, index = split_and_index(key)
    rank = F.when(split == "train", 0).when(split == "val", 1).when(split == "test", 2).otherwise(3)
    return [rank, F.coalesce(index, F.lit(-1)), key]


def month_start(month: Column) -> Column:
    """First day of ``YYYY-MM``, null for anything else."""
    return F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(month, F.lit("-01"))))


def month_end(month: Column) -> Column:
    return F.last_day(month_start(month))


def month_timestamp(month: Column, policy: str = "month_end") -> Column:
    if policy not in ("month_start", "month_end"):
        raise ValueError(f"unknown timestamp policy {policy!r}")
    day, time = (month_start(month), "00:00:00") if policy == "month_start" else (month_end(month), "23:59:59")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f"T{time}Z"))


def utc_timestamp(value: Column) -> Column:
    """ISO text as a timestamp; without a zone it is UTC (the session's zone must be). Null where it can't be read."""
    return F.try_to_timestamp(value)


def before_history(query: Column, start: Column) -> Column:
    return query < start


def month_window(month: Column, days: Column) -> tuple[Column, Column]:
    more = F.greatest(days, F.lit(0)).cast("int")
    return F.date_sub(month_start(month), more), F.date_add(month_end(month), more)


def paired_expansion(first: Column, second: Column, requested: Column) -> Column:
    """The greatest expansion up to the requested one that keeps the two windows apart; null where even none does.

    Windows grow towards each other by one day each, so the room between the months halves.
    """
    room = F.floor((F.datediff(month_start(second), month_end(first)) - 1) / 2)
    fit = F.least(F.greatest(requested, F.lit(0)).cast("bigint"), room)
    return F.when(fit >= 0, fit.cast("int"))


def bbox_problem(w: Column, n: Column, e: Column, s: Column) -> Column:
    """Why a [w, n, e, s] record is no box, or null."""
    bad = lambda v, most: v.isNull() | F.isnan(v) | (F.abs(v) > most)
    return F.when(bad(w, 180) | bad(e, 180), "longitude").when(bad(n, 90) | bad(s, 90), "latitude").when(w >= e, "west_east").when(s >= n, "south_north")


def tile_bbox(box: dict[str, Column], x: Column, y: Column, tw: Column, th: Column, width: Column, height: Column) -> dict[str, Column]:
    """The lon/lat box of a pixel window, by linear interpolation; null where the window leaves the grid."""
    inside = (x >= 0) & (y >= 0) & (tw > 0) & (th > 0) & (x + tw <= width) & (y + th <= height)
    across, down = box["e"] - box["w"], box["n"] - box["s"]
    out = {"w": box["w"] + x / width * across, "s": box["n"] - (y + th) / height * down, "e": box["w"] + (x + tw) / width * across, "n": box["n"] - y / height * down}
    return {k: F.when(inside, v) for k, v in out.items()}


def clean_sensor(value: Column) -> Column:
    """landsat-5, -7 or -8 from free text, else the text as it was cleaned."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[ _]+", "-")
    has = lambda *names: F.greatest(*[t.contains(n) for n in names], F.lit(False))
    return F.when(has("landsat-5", "lt05", "tm5"), "landsat-5").when(has("landsat-7", "le07", "etm"), "landsat-7").when(has("landsat-8", "lc08", "oli"), "landsat-8").otherwise(t)


def sensor_id(value: Column) -> Column:
    """1, 2 or 3 for the families, 0 for none; 7 is looked for first."""
    t = clean_sensor(value)
    return F.when(t == "landsat-7", 2).when(t == "landsat-5", 1).when(t == "landsat-8", 3).otherwise(0)


def slc_mode(day: Column) -> Column:
    d = F.to_date(F.substring(day, 1, 10))
    return F.when(d >= F.to_date(F.lit(SLC_FAILURE)), "off").when(d.isNotNull(), "on")


def failure_status(error: Column, code: Column) -> Column:
    retry = code.isin(RETRYABLE_CODES) | error.isin("ConnectionError", "Timeout", "ConnectTimeout", "ReadTimeout")
    return F.when(F.coalesce(retry, F.lit(False)), "failed_retryable").when(error == "FileNotFoundError", "source_unavailable").when(error.isin("ValueError", "TypeError", "KeyError") | code.isNotNull(), "failed_permanent").otherwise("failed_retryable")


def first_filled(*values: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def image_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d+)\.[^.]*$", 1), F.lit("")).cast("int")


def binarise(mask: Column, smoothing: float = 0.0) -> Column:
    g = (mask > 127).cast("double")
    return g * F.lit(1.0 - smoothing) + F.lit(0.5 * smoothing)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; a column that an expression names twice is computed twice."""
    return F.element_at(F.transform(F.array(value), f), 1)
