"""Steps whose shuffles, driver traffic or time grew faster than their input: same results, and how often rows travel."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.scalars import sample_key
from rasterloom.operators import captions as cp
from rasterloom.operators import instances as ins
from rasterloom.operators import mapfeatures as mf
from rasterloom.operators import retrieval as rt
from rasterloom.plans.retrieval import grouped
from rasterloom.sources import scans


def vectors_of(spark, v, at, group=None):
    rows = [(2 * n + at, [float(c) for c in r], n % 7) for n, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, group long")
    return df if group else df.drop("group")


def test_rows_travel_as_often_at_any_size():
    assert [rt.cells_of(n, 128) for n in (0, 1, 128, 129, 1000, 10_000, 100_000, 500_000)] == [1, 1, 1, 2, 8, 8, 8, 8]
    assert rt.cells_of(10_000_000, 128) == -(-10_000_000 // rt.CELL_ROWS)


@pytest.mark.parametrize("rows", [50, 1 << 20])
def test_top_k_of_sides_from_one_table(spark, monkeypatch, rows):
    """Many blocks, both sides from one table: the step failed on columns that both had."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 4))
    v[6] = v[10] = v[20]
    both = spark.createDataFrame([(n, [float(c) for c in r]) for n, r in enumerate(v)], "id long, vec array<double>")
    monkeypatch.setattr(rt, "PRUNE_FROM", 1)
    monkeypatch.setattr(rt, "CELL_ROWS", rows)
    got = defaultdict(list)
    for r in sorted(rt.top_k_both(both.where("id % 2 = 0"), both.where("id % 2 = 1"), 3, 16).collect(), key=lambda r: r["rank"]):
        got[r.side, r["query"]].append(r.found)
    s = v[0::2] @ v[1::2].T
    for side, m, own, other in (("text", s, 0, 1), ("image", s.T, 1, 0)):
        for q, row in enumerate(m):
            assert got[side, 2 * q + own] == [2 * f + other for f in sorted(range(150), key=lambda f: (-row[f], f))[:3]]
    assert len(got) == 300


def test_draws_do_not_depend_on_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(90, 4)), rng.normal(size=(70, 4))
    a, b = vectors_of(spark, x, 0, True), vectors_of(spark, y, 1, True)
    seen = []
    pairs = rt.block_pairs

    def counted(*args, **named):
        seen.append(named.get("cells"))
        return pairs(*args, **named)

    monkeypatch.setattr(rt, "block_pairs", counted)
    i, j = np.arange(90) * 2, np.arange(70) * 2 + 1
    ok = (np.arange(90) % 7)[:, None] != np.arange(70) % 7
    want = {}
    for side, m, q, f, may in (("text", x @ y.T, i, j, ok), ("image", (x @ y.T).T, j, i, ok.T)):
        noise = -np.log(-np.log(rt.pair_uniform(q, f)))
        hard, easy = (np.where(may, z, -np.inf).argmax(axis=1) for z in (m + noise, noise - m))
        want |= {(side, int(q[n])): (int(f[hard[n]]), int(f[easy[n]])) for n in range(len(q))}
    for grid, most in ((8, 1 << 20), (2, 1 << 20), (1, 20)):
        monkeypatch.setattr(rt, "GRID", grid)
        monkeypatch.setattr(rt, "CELL_ROWS", most)
        assert {(r.side, r["query"]): (r.negative, r.typical) for r in rt.negative_draws(a, b, 16).collect()} == want
    assert seen == [True] * 3


def test_pair_numbers_with_wide_ids():
    """The same number whether or not the ids beside it share their upper word."""
    q, f = np.array([3, -1, 1 << 40]), np.array([5, 6, 1 << 33, -9])
    u = rt.pair_uniform(q, f)
    assert all(rt.pair_uniform(q, f[n : n + 1])[:, 0].tolist() == u[:, n].tolist() for n in range(4))
    assert rt.pair_uniform(q, f[:0]).shape == (3, 0)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_box_is_read_once(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1],[0,1],[0,0]]]}'
    texts = [square, square.replace("[2,1]", "[2,0.5]"), square.replace("[0,0]]]", "[0,1]]]"), square.replace("Polygon", "LineString"), square.replace("]]]", "]],[[0,0],[2,0],[2,1],[0,0]]]"), '{"type":"Polygon","coordinates":[]}', None, "no"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, g string").select("id", mf.is_box_polygon(F.col("g")).alias("ok"))
    assert [r.ok for r in df.orderBy("id").collect()] == [True] + [False] * 7
    assert plan_of(df).count("regexp_extract_all") == 1
    box = spark.createDataFrame([(square,), (None,), ("{}",)], "g string").select(mf.geometry_bbox(F.col("g")).alias("b"))
    assert [tuple(r.b) if r.b else None for r in box.collect()] == [(0.0, 0.0, 2.0, 1.0), None, None]
    assert plan_of(box).count("regexp_extract_all") == 1


def test_a_text_is_searched_once_a_kind(spark):
    texts = ["A PARK by the Railway", "built up", "", None, "a rail, parking; Water"]
    df = spark.createDataFrame([(n, t, n) for n, t in enumerate(texts)], "id int, t string, c int")
    counts = {"road": F.col("c"), "water": -F.col("c")}
    got = df.select("id", mf.keyword_array(F.col("t"), counts).alias("v"), F.array(*mf.keyword_vector(F.col("t"), counts)).alias("w"))
    assert plan_of(df.select(mf.keyword_array(F.col("t"), counts).alias("v"))).count("lower(") == 1
    for r in got.collect():
        low = (texts[r.id] or "").lower()
        want = [float(any(w in low for w in mf.KEYWORDS[n]) or n == "road" and r.id > 0) for n in mf.LABELS]
        assert r.v[: len(want)] == want and r.v == r.w and len(r.v) == 16


def test_instances_send_no_joins_to_the_driver(spark, monkeypatch):
    """Tables of any size are joined by shuffle: small ones were broadcast in every round."""
    plans = []
    write = ins.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df)

    monkeypatch.setattr(ins, "checkpointed", noted)
    rows = [(s, y, x, (y * 7 + x * 3 + s) % 10 / 10) for s in range(2) for y in range(12) for x in range(12) if (x * y + s) % 5 or y == 6]
    px = write(spark.createDataFrame(rows, "scene_id int, y int, x int, v double"))
    px = write(ins.label_components(px).join(px, ["scene_id", "y", "x"]))
    peaks = ins.with_fallback(ins.separated_peaks(ins.peak_candidates(px, "v", 0.2, 2), 3), px, "v")
    ends = [ins.decode_instances(px, peaks, F.lit(0.5), F.lit(0.5), 12, 12), ins.nearest_markers(px.select("scene_id", "label", "y", "x"), px.where("x % 3 = 0").withColumn("marker", F.col("y") * 12 + F.col("x")), 2)]
    plans += [df._jdf.queryExecution().sparkPlan().toString() for df in ends]
    assert len(plans) > 10 and sum("Join" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_a_sample_key_is_cut_once(spark):
    names = ["Train_0012.png", r"a\b\VAL_7_y0_x256", "test_3_r1_c2", "train_.png", "x", "", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(names)], "id int, t string").select("id", sample_key(F.col("t"), True).alias("k"))
    assert plan_of(df).count("trim(") == 1
    assert [r.k for r in df.orderBy("id").collect()] == ["train_12.png", "val_7.png", "test_3.png", None, None, None, None]


def test_a_manifest_is_read_once_for_repeats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"samples": [{"filename": "train_1.png", "status": "ok"}, {"filename": "val_02.png", "split": "test"}]}')
    (tmp_path / "b.json").write_text('{"train_3": {"status": "ok", "valid_fraction": 0.5}}')
    df = scans.manifest(spark, str(tmp_path))
    assert plan_of(df).count("from_json(") == 2  # one a layout
    assert sorted((r.key, r.source_pair_id, r.split, r.status, r.valid_fraction) for r in df.collect()) == [("train_1", "train_1", "train", "ok", None), ("train_3", "train_3", "train", "ok", 0.5), ("val_2", "val_2", "test", None, None)]
    (tmp_path / "c.json").write_text('{"Train_0003.png": {"status": "ok"}}')
    with pytest.raises(Exception, match="repeated key train_3"):
        scans.manifest(spark, str(tmp_path)).collect()


def test_words_are_hashed_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(cp, "KEPT_WORDS", 2)
    df = spark.createDataFrame([(1, "a b a C!"), (2, ""), (3, None), (4, "a " * 30)], "id long, t string")
    got = cp.token_rows(df, "id", "t", 6)
    assert plan_of(got).count("regexp_extract_all") == 1 and "Join" not in plan_of(got)
    rows = defaultdict(list)
    for r in got.orderBy("id", "pos").collect():
        assert r.pos == len(rows[r.id]) and r.attention == int(r.token != 0)
        rows[r.id].append(r.token)
    one = lambda w: 103 + int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % (30522 - 103)
    assert rows == {1: [101, one("a"), one("b"), one("a"), one("c"), 102], 2: [101, 102, 0, 0, 0, 0], 3: [101, 102, 0, 0, 0, 0], 4: [101, *[one("a")] * 4, 102]}
    assert [r.token for r in cp.token_rows(df.where("id = 1"), "id", "t", 1).collect()] == [101]


def test_relevance_is_asked_of_what_was_found(spark):
    found = spark.createDataFrame([("text", 0, 1, 1), ("text", 0, 3, 2), ("text", 2, 83, 1), ("image", 81, 0, 1)], "side string, query long, found long, rank int")
    assert {tuple(r) for r in grouped(found).collect()} == {("text", 0, 1), ("text", 2, 83), ("image", 81, 0)}
