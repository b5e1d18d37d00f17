"""Run logs as series: exponential averages, windowed and global statistics, best values."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions.storage import fresh, in_ranges


def decayed_sum(df: DataFrame, by: list[str], order: str, value: str, decay: float, name: str, block: int = 1024) -> DataFrame:
    """``name``: the sum of all values up to a row, each weighed by ``decay`` to the number of steps since; ``order`` runs from 1 without gaps.

    Within a block of steps the sum has a closed form. What the blocks before add is the same sum over
    blocks, with a row a block and the decay of a whole block, and is found the same way, until a
    block's decay is below what a double can tell from nothing. Powers stay below 1e200 throughout.
    """
    block = max(1, min(block, int(460 / -math.log(decay))))
    b, i, carry = f"_b_{name}", f"_i_{name}", f"_c_{name}"
    d = df.withColumn(b, F.floor((F.col(order) - 1) / block)).withColumn(i, (F.col(order) - 1) % block)
    inside = Window.partitionBy(*by, b).orderBy(order)
    d = d.withColumn(name, F.pow(F.lit(decay), F.col(i)) * F.sum(F.col(value) * F.pow(F.lit(decay), -F.col(i))).over(inside))
    ends = d.groupBy(*by, b).agg(F.max_by(name, order).alias("_e"))
    whole, sum_ = decay**block, f"{name}_"
    if whole > 1e-18:
        ends = decayed_sum(ends.withColumn("_o", F.col(b) + 1), by, "_o", "_e", whole, sum_, block)
    else:
        ends = ends.withColumn(sum_, F.col("_e"))
    ends = ends.select(*by, b, F.coalesce(F.lag(sum_).over(Window.partitionBy(*by).orderBy(b)), F.lit(0.0)).alias(carry))
    out = d.join(ends, [*by, b])
    return out.withColumn(name, F.col(name) + F.pow(F.lit(decay), F.col(i) + 1) * F.col(carry)).drop(b, i, carry)


def exponential_average(df: DataFrame, by: list[str], order: str, value: str, beta: float = 0.99, block: int = 1024) -> DataFrame:
    """a0 = x0, then a = beta * a + (1 - beta) * x, along the order of each series; ``order`` runs from 1 without gaps."""
    weighed = df.withColumn("_x", F.when(F.col(order) == 1, F.col(value)).otherwise((1 - beta) * F.col(value)))
    return decayed_sum(weighed, by, order, "_x", beta, "average", block).drop("_x")


def placed(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: each row's place in its series, from 0, by the given order, nulls first.

    Rows are dealt by ranges of series and order; a range numbers what it has of a series and adds what
    the ranges before have of it, so a long series is many tasks' work.
    """
    taken = list(df.columns)
    part, own, start = (fresh(c, taken) for c in ("range", "own", "start"))
    d = in_ranges(df, [*by, *order], part)
    sums = d.groupBy(part, *by).agg(F.count(F.lit(1)).alias(own))
    over = Window.partitionBy(*by).orderBy(part)
    names = [fresh(f"of_{c}", taken) for c in (part, *by)]
    sums = sums.select(*[F.col(c).alias(n) for c, n in zip((part, *by), names, strict=True)], (F.sum(own).over(over) - F.col(own)).alias(start))
    d = d.withColumn(own, F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)) - 1)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip((part, *by), names, strict=True)]
    return d.join(sums, reduce(and_, same)).select(*taken, (F.col(own) + F.col(start)).alias(name))


def window_statistics(df: DataFrame, by: list[str], order: str, value: str, size: int = 20, block: int = 1 << 16) -> DataFrame:
    """Over the last ``size`` values: lower median, mean, max and last.

    A series is cut into blocks of ``block`` rows, and a block is given the ``size`` - 1 rows before it
    as a halo, so a task sorts a block and never a series.
    """
    taken = list(df.columns)
    at, b, halo, v = (fresh(c, taken) for c in ("at", "block", "halo", "values"))
    block = max(block, size)
    d = placed(df, by, [order], at).withColumn(b, F.floor(F.col(at) / block))
    last = F.col(at) % block > block - size
    copies = F.array(F.struct(F.col(b), F.lit(False).alias(halo)), F.when(last, F.struct((F.col(b) + 1).alias(b), F.lit(True).alias(halo))))
    d = d.withColumn(v, F.array_compact(copies)).select(*taken, at, F.inline(v))
    w = Window.partitionBy(*by, b).orderBy(at).rowsBetween(1 - size, 0)
    d = d.withColumn(v, F.array_sort(F.collect_list(value).over(w)))
    middle = F.element_at(v, F.ceil(F.size(v) / 2).cast("int"))
    d = d.withColumns({"median": middle, "mean": F.avg(value).over(w), "max": F.max(value).over(w), "last": F.col(value)})
    return d.where(~F.col(halo)).drop(at, b, halo, v)


def weighted_mean(df: DataFrame, by: list[str], value: str, n: Column) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * n) / F.sum(n)).alias("mean"))


def best_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.greatest(F.lit(0.0), F.max(value)).alias("best"))


def best_step(df: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """The first step that reaches the greatest value."""
    return df.groupBy(*by).agg(F.max_by(step, F.struct(value, -F.col(step))).alias("step"), F.max(value).alias("best"))
