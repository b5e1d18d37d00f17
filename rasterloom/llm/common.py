"""What the operators of this subpackage share: reading tables, shared storage, Arrow helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.storage import shared_folder

#: Words everywhere in this subpackage: runs of bytes other than space and 0x09 to 0x0D.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str = "text", as_name: str = "b") -> "F.Column":
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias(as_name)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not in ``columns`` in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, spread: str, most: int = 1000) -> DataFrame:
    """Left join with a table that has a row for each value of ``on``, where one value may hold any share of the left rows.

    ``weight`` says how many left rows a value has. The ``most`` heaviest values are broadcast, a
    fixed number whatever the input, and their left rows are dealt by ``spread`` instead; no other
    value then has more than one part in ``most`` of the left rows.
    """
    taken = [*left.columns, *right.columns]
    far, near, side = fresh("far", taken), fresh("near", taken), fresh("side", taken)
    values = [c for c in right.columns if c not in on]
    heavy = right.orderBy(F.desc(weight)).limit(most).select(*on, F.struct(*values).alias(far))
    marked = left.join(F.broadcast(heavy), on, "left")
    marked = marked.withColumn(side, F.when(F.col(far).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))))
    rest = right.select(*on, F.struct(*values).alias(near), F.lit(0).cast("long").alias(side))
    both = marked.join(rest, [*on, side], "left")
    return both.select(*left.columns, *[F.coalesce(F.col(far)[v], F.col(near)[v]).alias(v) for v in values])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes of a binary or string Arrow array and its offsets, from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser) over uint64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def size_of(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a table, both counted over all of it."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def sql_crc32(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a value's ASCII text: each byte comes in, then eight steps of one bit."""
    steps = f"flatten(list_transform(str_split(CAST({value} AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform({steps}, lambda x: CAST(x AS BIGINT))), lambda a, x: {step}), 4294967295)"
