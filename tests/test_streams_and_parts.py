"""JSON documents read in parts, series in blocks, and streams that stop and go on."""

import json
import math
import os
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from rasterloom.functions.storage import shared_folder
from rasterloom.operators import series as se
from rasterloom.sources import scans as sc
from rasterloom.sources.json_parts import json_elements
from rasterloom.streaming import series as st


@pytest.fixture
def small_ranges(spark):
    """Ranges of some hundred bytes: a document of a few kilobytes is many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for c in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{c}")


def hard_value(rng, deep=0):
    pick = rng.random()
    if pick < 0.35:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "a", " ", "\n", "\\\"", "}}"]) for _ in range(rng.randint(0, 40)))
    if pick < 0.6 or deep > 3:
        return rng.choice([None, True, 1.5, -3, "x", "", {}, []])
    if pick < 0.8:
        return {hard_value_name(rng): hard_value(rng, deep + 1) for _ in range(rng.randint(0, 5))}
    return [hard_value(rng, deep + 1) for _ in range(rng.randint(0, 5))]


def hard_value_name(rng):
    return "".join(rng.choice("abc\\\"{}[],: é") for _ in range(rng.randint(1, 6)))


def put(folder, docs, indent=None):
    os.makedirs(folder, exist_ok=True)
    for name, d in docs.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(d if isinstance(d, str) else json.dumps(d, ensure_ascii=False, indent=indent))


def told(df):
    rows = sorted(df.collect(), key=lambda r: (r.path, r.block, r.n))
    out = {}
    for r in rows:
        out.setdefault(os.path.basename(r.path)[:-5], []).append((r.outer, r.element))
    return out


@pytest.mark.parametrize("indent", [2])
def test_elements_of_hard_documents(spark, tmp_path, small_ranges, indent):
    rng = random.Random(5)
    docs = {f"list{i}": [hard_value(rng) for _ in range(150)] for i in range(2)} | {f"map{i}": {f"k{j}{hard_value_name(rng)}": hard_value(rng) for j in range(150)} for i in range(2)}
    docs |= {"none": {}, "empty": []}
    put(tmp_path / "a", docs, indent)
    found, _, paths = json_elements(spark, str(tmp_path / "a"), 1)
    got = told(found)
    assert paths.count() == 6 and spark.read.option("lineSep", "}").text(str(tmp_path / "a")).select("_metadata.file_block_start").distinct().count() > 5
    for name, d in docs.items():
        own = [e for _, e in got.get(name, [])]
        assert (json.loads("[" + ",".join(own) + "]") if isinstance(d, list) else json.loads("{" + ",".join(own) + "}")) == d, name


def test_members_of_lists_and_layouts(spark, tmp_path, small_ranges):
    rng = random.Random(6)
    docs = {f"d{i}": {"note": "plain", "meta": {"a": 1, "b": [1, 2]}, "samples": [hard_value(rng) for _ in range(120)], "type": "T,{", "none": [], "last": [{"z": 1}]} for i in range(3)}
    docs["keyed"] = {f"k{j}": {"v": j, "w": {"u": "}"}} for j in range(90)}
    put(tmp_path / "b", docs)
    found, members, _ = json_elements(spark, str(tmp_path / "b"), None)
    got = told(found)
    for i in range(3):
        d = docs[f"d{i}"]
        of = lambda name: [e for o, e in got[f"d{i}"] if o == name]
        assert json.loads("[" + ",".join(of("samples")) + "]") == d["samples"]
        assert json.loads("{" + ",".join(of("meta")) + "}") == d["meta"] and [json.loads(e) for e in of("last")] == d["last"] and of("none") == []
    assert json.loads("{" + ",".join(e for _, e in got["keyed"]) + "}") == docs["keyed"]
    plain = sorted(m.member.strip() for m in members.collect())
    assert plain == sorted(['"note": "plain"', '"type": "T,{"'] * 3)


def test_a_document_larger_than_a_range(spark, tmp_path):
    """Eight megabytes in one line, read by more than one task, none of which has it whole."""
    n = 60_000
    put(tmp_path / "c", {"big": {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"@osmId": f"node/{i}", "t": "x" * (i % 50)}, "geometry": {"type": "Point", "coordinates": [i / 7, 1]}} for i in range(n)]}})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        f = sc.geojson_features(spark, str(tmp_path / "c"))
        rows = f.select(F.element_at("properties", "@osmId").alias("id"), F.get_json_object("geometry", "$.coordinates[0]").cast("double").alias("x"), "block").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.id for r in rows} == {f"node/{i}" for i in range(n)} and len(rows) == n and len({r.block for r in rows}) > 6
    assert all(abs(r.x - int(r.id[5:]) / 7) < 1e-9 for r in rows)


def test_other_documents_are_an_error(spark, tmp_path):
    put(tmp_path / "d", {"bad": {"type": "Feature", "features": []}})
    with pytest.raises(Exception, match="no FeatureCollection"):
        sc.geojson_features(spark, str(tmp_path / "d")).collect()


def test_window_statistics_in_blocks(spark):
    rng = random.Random(1)
    rows = [(r, m, i, rng.random()) for r in (0, 1, None) for m in ("a", "b") for i in range(1, 230 if m == "a" else 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "run int, metric string, step int, value double, block int").repartition(6)
    for size, block in ((20, 21), (20, 64), (5, 5), (1, 3), (300, 10)):
        got = {(r.run, r.metric, r.step): (r.median, r["mean"], r.max, r.last) for r in se.window_statistics(df, ["run", "metric"], "step", "value", size, block).collect()}
        assert len(got) == len(rows)
        by = {}
        for r, m, i, v in rows:
            own = by.setdefault((r, m), [])
            own.append(v)
            last = own[-size:]
            assert got[r, m, i] == (statistics.median_low(last), pytest.approx(sum(last) / len(last)), max(last), v)


def test_a_long_series_is_many_tasks_work(spark):
    """One series: its windows come from more than one block, and no task has all its rows."""
    df = spark.range(400_000).select(F.lit(1).alias("run"), F.col("id").alias("step"), (F.col("id") % 1000).cast("double").alias("value"))
    out = se.window_statistics(df, ["run"], "step", "value", 20, 1 << 14)
    tasks = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("max").alias("s")).collect()
    assert sum(t.n for t in tasks) == 400_000 and len(tasks) > 1 and max(t.n for t in tasks) < 400_000


def folder(spark):
    import uuid

    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def averages(values, beta=0.9):
    out = []
    for v in values:
        out.append(v if not out else beta * out[-1] + (1 - beta) * v)
    return out


SCHEMA = "run bigint, step bigint, value double"


def average_after(spark, src, out, rows, patience=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(SCHEMA).parquet(src)
    q = st.streaming_average(s, ["run"], "step", "value", out, 0.9, patience)
    if patience is None:
        q.awaitTermination()
    else:
        time.sleep(12)
        q.stop()
    return {(r.run, r.step): r.average for r in spark.read.schema("run bigint, step bigint, average double").parquet(f"{out}/rows").collect()}


def test_average_stops_and_goes_on(spark):
    """Three runs of one stream, rows out of order and early ones waiting in the state; the same as the batch form."""
    rng = random.Random(2)
    rows = [(r, i, rng.random()) for r in (1, 2) for i in range(1, 60)]
    rng.shuffle(rows)
    src, out = folder(spark), folder(spark)
    for part in (rows[:50], rows[50:51], rows[51:]):
        got = average_after(spark, src, out, part)
    for r in (1, 2):
        want = averages([v for _, i, v in sorted(x for x in rows if x[0] == r)])
        assert [got[r, i] for i in range(1, 60)] == pytest.approx(want)
    assert len(got) == len(rows)


def test_a_timer_ends_the_wait(spark):
    src, out = folder(spark), folder(spark)
    got = average_after(spark, src, out, [(1, 1, 1.0), (1, 3, 3.0), (1, 4, 4.0), (2, 1, 7.0)], patience=1)
    want = averages([1.0, 3.0, 4.0])
    assert got == {(1, 1): 1.0, (1, 3): pytest.approx(want[1]), (1, 4): pytest.approx(want[2]), (2, 1): 7.0}
    got = average_after(spark, src, out, [(1, 2, 2.0), (1, 5, 5.0)], patience=60_000)  # the second step is too late
    assert (1, 2) not in got and got[1, 5] == pytest.approx(0.9 * want[2] + 0.5)


def test_counts_stop_and_go_on(spark):
    src, out, schema = folder(spark), folder(spark), "split string, prob double, truth boolean"
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.random(), rng.random() < 0.5) for _ in range(400)]
    for part in (rows[:100], rows[100:101], rows[101:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        st.running_counts(spark.readStream.schema(schema).parquet(src), F.col("prob") >= 0.4, out).awaitTermination()
    got = {r.split: tuple(r)[1:] for r in st.latest_counts(spark, out, "split string").collect()}
    for s in ("a", "b", None):
        own = [(p >= 0.4, t) for x, p, t in rows if x == s]
        assert got[s] == tuple(sum(o == c for o in own) for c in ((True, True), (True, False), (False, True), (False, False)))
    assert math.isclose(sum(map(sum, got.values())), 400)
