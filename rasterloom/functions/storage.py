"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where it is unset, a local session (tests) gets one of its own; a cluster's executors would not
    see the driver's folders, so there it must be set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read back.

    Unlike checkpoint(), this also drops the constraints that the optimizer has derived for the plan,
    which grow from round to round in loops.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``checkpointed`` wrote, once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        at = shared_folder(spark).split(":", 1)[-1].rstrip("/") + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if at.lstrip("/") in folder + "/":  # the shared folder's own, never a caller's
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not in ``columns`` in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_ranges(df: DataFrame, order: list[str], part: str = "_p") -> DataFrame:
    """``df`` dealt by ranges of the order, with each row's range number.

    The result is checkpointed: the borders of ranges come from a sample, which another run of the
    same plan may draw differently, and everything that uses the numbers must see one deal. There are
    as many ranges as the session has shuffle partitions; small neighbours become one.
    """
    return checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))


def before(df: DataFrame, total: Column, name: str, part: str = "_p") -> DataFrame:
    """For each range the sum of ``total`` over the ranges before it: a row for each range."""
    from pyspark.sql.window import Window

    sums = df.groupBy(part).agg(total.alias("_t"))
    return sums.select(part, (F.sum("_t").over(Window.orderBy(part)) - F.col("_t")).alias(name))


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` for a join: computed once and broadcast if it has ``most`` rows at most; else as it is, for a join without broadcast."""
    rows = df.limit(most + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= most else df
