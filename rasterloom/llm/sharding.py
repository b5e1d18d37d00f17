"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring that is cut into ``CELLS`` equal cells. A row belongs
to the first point clockwise from the cell of its key's hash; a row that meets a full shard goes on
clockwise. Capacities are whole numbers that add up to the rows there are and differ by one at
most, so every row finds a place and the shards are level, while only rows at full shards move from
where plain consistent hashing puts them.

Which rows of a cell go where depends only on how many rows each cell has. So the plan is made from
a histogram of ``CELLS`` counts, a fixed size whatever the input, and the rows are placed by their
rank in their cell. Ranks are counted in two steps, within the rows of a cell that one task read and
over the tasks, so no task ranks more rows than it read, even if one key has most of them. No Python
runs on rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.llm.common import stored, table

SHARDS, VNODES = 8, 64
CELL_BITS = 15
CELLS = 1 << CELL_BITS


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; a shard's points don't depend on the other shards."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"shard-{s}/{v}".encode()).digest()[:8], "big") % CELLS
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def ways_round(points: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each point, the shards in the order in which a row from there meets them, going clockwise."""
    ways = []
    for i in range(len(points)):
        way = list(dict.fromkeys(points[(i + j) % len(points)][1] for j in range(len(points))))
        ways.append(way[:shards])
    return ways


def ring_plan(counts: dict[int, int], shards: int = SHARDS, vnodes: int = VNODES) -> list[dict[str, int]]:
    """Where each run of rows of each cell goes: cell, ranks from lo to below hi, shard and the first rank's slot.

    In round r every run that has met only full shards tries the r-th shard on its way; rows that
    have a place keep it. Capacities add up to all rows, so after a round for each shard all have one.
    """
    points, total = ring_points(shards, vnodes), sum(counts.values())
    places, ways = [p for p, _ in points], ways_round(points, shards)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, plan = [0] * shards, []
    left = [(cell, 0, n) for cell, n in sorted(counts.items())]
    for r in range(shards):
        on = []
        for cell, lo, hi in left:
            s = ways[bisect.bisect_left(places, cell) % len(points)][r]
            take = min(hi - lo, room[s] - used[s])
            if take:
                plan.append({"cell": cell, "lo": lo, "hi": lo + take, "shard": s, "slot0": used[s]})
                used[s] += take
            if lo + take < hi:
                on.append((cell, lo + take, hi))
        left = on
    return plan


def ring_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", vnodes: int = VNODES) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Shards' row counts differ by at most one; slots run from 0 without gaps in each shard. Size is
    the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of the empty text. Ring
    places come from the key, and from the text's checksum where the key is null, so rows without a
    key spread too. Ties in a place are ordered by key and checksum; equal rows are interchangeable.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("k"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    place = F.xxhash64(F.coalesce(F.col("k").cast("string"), F.concat(F.lit("crc:"), F.col("text_crc32").cast("string"))))
    rows = rows.withColumn("cell", F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int")).withColumn("part", F.spark_partition_id())
    rows = stored(rows, "ring-rows")  # which also settles each row's part
    sizes = stored(rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")), "ring-sizes")
    counts = {r["cell"]: r["n"] for r in sizes.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # CELLS rows at most
    plan = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(ring_plan(counts, shards, vnodes))), "array<struct<cell:int,lo:long,hi:long,shard:int,slot0:long>>"))
    )
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("cell", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("cell", "part").orderBy("k", "text_crc32", "size"))
    ranked = rows.withColumn("within", within).join(starts, ["cell", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    # The plan has a row a cell and at most one more for each shard and round: its size is bounded by CELLS.
    placed = ranked.join(F.broadcast(plan), ["cell"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        F.col("k").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"))
