"""Cases with known results: counts, sweeps, windows, stitching, discs, captions and spectral values."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalars as sc
from rasterloom.functions import storage
from rasterloom.operators import captions as cp
from rasterloom.operators import evaluation as ev
from rasterloom.operators import instances as ins
from rasterloom.operators import retrieval as rt
from rasterloom.operators import series as se
from rasterloom.operators import spectral as sp
from rasterloom.operators import tiling as tl
from rasterloom.plans import fixtures
from rasterloom.sources import scans


def pixels(spark, rows):
    return spark.createDataFrame(rows, "scene_id int, split string, y int, x int, prob float, truth boolean")


def test_counts(spark):
    p = pixels(spark, [(0, "val", 0, 0, 1.0, True), (0, "val", 0, 1, 1.0, False), (0, "val", 1, 0, 0.0, True), (0, "val", 1, 1, 0.0, False)])
    assert tuple(ev.confusion_counts(p, ev.at_least("prob", 0.5)).first()) == (1, 1, 1, 1)


def two_scenes(spark):
    a = [[0.9, 0.8], [0.1, 0.2]], [[1, 1], [0, 0]]
    b = [[0.7, 0.1], [0.2, 0.3]], [[1, 0], [0, 0]]
    return pixels(spark, [(s, "val", y, x, p[y][x], bool(t[y][x])) for s, (p, t) in enumerate((a, b)) for y in (0, 1) for x in (0, 1)])


def test_split_and_sweep(spark):
    p = two_scenes(spark)
    r = ev.evaluate_split(p, "val", 0.65).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 0, 0, 5) and r.iou == 1.0
    s = ev.sweep(p, 0.5, 0.9, 0.05)
    for t in s.collect():
        own = ev.evaluate_split(p, "val", t.threshold).first()
        assert (own.tp, own.fp, own.fn, own.tn) == (t.tp, t.fp, t.fn, t.tn)
    assert ev.best_threshold(s).first().threshold == 0.5
    assert ev.best_threshold(s, lowest=False).first().threshold == 0.7


def test_float32_border(spark):
    p = pixels(spark, [(0, "val", 0, 0, float(np.float32(0.89)), True)])
    assert ev.evaluate_split(p, "val", 0.89).first().tp == 1
    assert ev.sweep(p).where("threshold = 0.89").first().tp == 1


def test_grid(spark):
    g = [r.threshold for r in ev.threshold_grid(spark).orderBy("i").collect()]
    assert len(g) == 491 and g[390] == 0.890


def test_published_metrics(spark):
    c = spark.createDataFrame([(5865362, 1100057, 972042, 126280267)], "tp long, fp long, fn long, tn long")
    r = ev.with_metrics(c).first()
    assert abs(r.iou - 0.7389468748255897) < 1e-12 and abs(r.f1 - 0.8498786081658802) < 1e-12
    empty = spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    assert ev.with_metrics(empty).first().iou == 0


def test_frozen_threshold_is_checked(spark):
    p = two_scenes(spark)
    art = ev.freeze(ev.best_threshold(ev.sweep(p, 0.5, 0.9, 0.05)), "two")
    assert ev.evaluate_frozen(p, art, "two", "val").first().tp == 3
    with pytest.raises(Exception, match="not frozen"):
        ev.evaluate_frozen(p, art.withColumn("threshold", F.lit(0.6)), "two", "val").collect()
    with pytest.raises(Exception, match="not frozen"):
        ev.evaluate_frozen(p, art, "other", "val").collect()


def test_windows_and_coverage(spark):
    s = spark.createDataFrame([(0, 1024, 1024)], "scene_id int, height int, width int")
    w = tl.scene_windows(s, 256, 128)
    assert w.count() == 49
    assert sorted(r[0] for r in w.select("ty").distinct().collect()) == [128 * i for i in range(7)]
    assert [r.start for r in spark.range(1).select(F.explode(tl.tile_starts(F.lit(100), 256, 128)).alias("start")).collect()] == [0]
    assert [r.start for r in spark.range(1).select(F.explode(tl.tile_starts(F.lit(600), 256, 128)).alias("start")).collect()] == [0, 128, 256, 344]
    with pytest.raises(ValueError):
        tl.tile_starts(F.lit(5), 2, 3)


def test_stitch_of_a_known_function(spark):
    """Tiles of one function give it back, with coverage 1, 2 and 4."""
    px = spark.range(64 * 64).select(F.lit(0).alias("scene_id"), F.expr("cast(id div 64 as int)").alias("gy"), F.expr("cast(id % 64 as int)").alias("gx"))
    px = px.withColumn("prob", ((3 * F.col("gy") + 5 * F.col("gx")) % 997) / 996.0)
    starts = F.array(*[F.lit(i) for i in (0, 8, 16, 24, 32, 40, 48)])
    t = px.withColumn("ty", F.explode(starts)).where("gy between ty and ty + 15").withColumn("tx", F.explode(starts)).where("gx between tx and tx + 15")
    t = t.select("scene_id", "ty", "tx", (F.col("gy") - F.col("ty")).alias("dy"), (F.col("gx") - F.col("tx")).alias("dx"), "prob")
    got = tl.stitch(t, 16, ["prob"]).join(px.select("scene_id", F.col("gy").alias("y"), F.col("gx").alias("x"), F.col("prob").alias("want")), ["scene_id", "y", "x"])
    r = got.agg(F.max(F.abs(F.col("prob") - F.col("want"))).alias("off"), F.collect_set("coverage").alias("c"), F.count(F.lit(1)).alias("n")).first()
    assert r.off < 3e-7 and sorted(r.c) == [1, 2, 4] and r.n == 4096


def test_blend_weight_formula(spark):
    h = np.hanning(16)
    want = 0.2 + 0.8 * np.outer(h, h) / np.outer(h, h).max()
    got = np.zeros((16, 16))
    for r in spark.range(256).select(F.expr("id div 16").alias("y"), (F.col("id") % 16).alias("x")).select("y", "x", tl.blend_weight(F.col("y"), F.col("x"), 16).alias("w")).collect():
        got[r.y, r.x] = r.w
    assert np.abs(got - want).max() < 1e-12


def test_touching_discs(spark):
    """Two discs that touch: one component, two instances, support unchanged."""
    yy, xx = np.mgrid[:96, :96]
    mask = ((yy - 48) ** 2 + (xx - 32) ** 2 <= 256) | ((yy - 48) ** 2 + (xx - 64) ** 2 <= 256)
    d1, d2 = np.hypot(yy - 48, xx - 32), np.hypot(yy - 48, xx - 64)
    score = np.maximum(0.95 * np.exp(-(d1**2) / 72), 0.90 * np.exp(-(d2**2) / 72))
    rows = [(0, int(y), int(x), float(score[y, x])) for y, x in zip(*np.nonzero(mask))]
    px = spark.createDataFrame(rows, "scene_id int, y int, x int, score double")
    lab = ins.label_components(px).join(px, ["scene_id", "y", "x"]).cache()
    assert lab.select("label").distinct().count() == 1
    peaks = ins.with_fallback(ins.separated_peaks(ins.peak_candidates(lab, "score", 0.5, 2), 10), lab, "score")
    assert sorted((r.y, r.x) for r in peaks.collect()) == [(48, 32), (48, 64)]
    inst = ins.decode_instances(lab, peaks, F.lit(0.0), F.lit(0.0), 96, 96)
    assert inst.select("instance").distinct().count() == 2 and inst.count() == int(mask.sum())
    assert ins.support_problems(inst, px).count() == 0


def test_components_touch_at_corners(spark):
    rows = [(0, 0, 0), (0, 1, 1), (0, 0, 3), (0, 5, 5), (1, 0, 0)]
    m = spark.createDataFrame(rows, "scene_id int, y int, x int")
    got = {(r.scene_id, r.y, r.x): r.label for r in ins.label_components(m).collect()}
    assert got == {(0, 0, 0): 1, (0, 1, 1): 1, (0, 0, 3): 2, (0, 5, 5): 3, (1, 0, 0): 1}


def test_nearest_markers_drop_small_areas(spark):
    px = spark.createDataFrame([(0, 1, 0, x) for x in range(6)], "scene_id int, label int, y int, x int")
    m = spark.createDataFrame([(0, 1, 1, 0, 0), (0, 1, 2, 0, 1)], "scene_id int, label int, marker int, y int, x int")
    got = [r.marker for r in ins.nearest_markers(px, m, 2).orderBy("x").collect()]
    assert got == [2] * 6


def test_clean_caption(spark):
    cases = {"A <person>, walks - by/there!": "a <person> walks by there", "Two   dogs.\n": "two dogs", "one\ttwo": "one\ttwo", None: None}
    d = spark.createDataFrame([(k,) for k in cases], "c string").select("c", cp.clean_caption(F.col("c")).alias("o"))
    got = {r.c: r.o for r in d.collect()}
    assert got["A <person>, walks - by/there!"] == "a person walks by there" and got["Two   dogs.\n"] == "two dogs" and got["one\ttwo"] == "one\ttwo"
    long = spark.createDataFrame([(" ".join("w" * 1 for _ in range(50)),)], "c string").select(cp.clean_caption(F.col("c"), 30).alias("o")).first().o
    assert len(long.split(" ")) == 30


def test_hashed_tokens(spark):
    import hashlib

    d = spark.createDataFrame([(1, "Hello, world!"), (2, None), (3, "a b c d e f g h")], "id long, t string")
    got = {}
    for r in cp.token_rows(d, "id", "t", 6).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.token)
    word = lambda w: 103 + int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % (30522 - 103)
    assert got[1] == [101, word("hello"), word(","), word("world"), word("!"), 102]
    assert got[2] == [101, 102, 0, 0, 0, 0]
    assert got[3] == [101, *map(word, "abcd"), 102]


def test_repeated_captions_count_as_hits(spark):
    """Six images of five captions with repeats: duplicate-aware recall is never below the plain one."""
    texts = [[i * 5 + j if (i + j) % 3 else j for j in range(5)] for i in range(6)]
    top = spark.createDataFrame([("text", i, (i * 7 + r) % 30, float(-r), r + 1) for i in range(6) for r in range(10)], "side string, query long, found long, score double, rank int")
    own = spark.createDataFrame([("text", i, i * 5 + j) for i in range(6) for j in range(5)], "side string, query long, found long")
    same = spark.createDataFrame([("text", i, a * 5 + b) for i in range(6) for a in range(6) for b in range(5) if texts[a][b] in texts[i]], "side string, query long, found long")
    a, b = rt.recall(top, own, [1, 5, 10]).first(), rt.recall(top, same, [1, 5, 10]).first()
    assert b.r1 >= a.r1 and b.r5 >= a.r5 and b.r10 >= a.r10 and a.queries == 6


def test_invalid_pixels_never_leak(spark):
    d = spark.createDataFrame([(0.2, 0.1, 0.4, True), (999.0, -999.0, 0.3, False), (float("nan"), 0.1, 0.2, True), (0.1, 0.0, 0.0, True)], "green float, red float, nir float, valid boolean")
    got = sp.compose_channels(d).collect()
    assert [r.valid for r in got] == [True, False, False, False]
    assert all(r.ndvi == 0 and r.ndwi == 0 and r.green == 0 for r in got[1:])
    assert abs(got[0].ndvi - 0.6) < 1e-6 and abs(got[0].ndwi + 1 / 3) < 1e-6


def test_training_statistics_refuse_one_value(spark):
    d = spark.createDataFrame([("train", True, 0.5), ("val", True, 9.0)], "split string, valid boolean, ndvi double")
    with pytest.raises(Exception, match="one valid value"):
        sp.training_stats(d, [], ["ndvi"]).collect()


def test_sample_keys(spark):
    d = spark.createDataFrame([("Train_0012.png",), ("a/b\\VAL_7_y0_x256",), ("test_3_r1_c2",), ("odd",), (None,)], "v string")
    assert [r[0] for r in d.select(sc.sample_key(F.col("v"))).collect()] == ["train_12", "val_7", "test_3", None, None]
    with pytest.raises(Exception, match="not a sample key"):
        d.select(sc.sample_key(F.col("v"), strict=True)).collect()


def test_paired_windows(spark):
    d = spark.createDataFrame([("2002-01", "2002-02", 10), ("2002-01", "2002-03", 30), ("2002-01", "2002-01", 5)], "a string, b string, n int")
    assert [r[0] for r in d.select(sc.paired_expansion(F.col("a"), F.col("b"), F.col("n"))).collect()] == [0, 14, None]


def test_exponential_average_over_blocks(spark):
    from rasterloom.operators.series import exponential_average

    v = [math.sin(i) for i in range(200)]
    d = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(v)], "run int, step int, value double")
    want, a = [], None
    for x in v:
        a = x if a is None else 0.9 * a + 0.1 * x
        want.append(a)
    got = [r.average for r in exponential_average(d, ["run"], "step", "value", 0.9, block=16).orderBy("step").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-9


def test_dense_numbers_follow_the_order(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = cp.numbered(d, ["v"], "n").collect()
    assert all(r.v == r.n for r in got)


def test_long_series_average(spark):
    """Beyond the length at which powers of the inverse overflow, in large blocks and small ones."""
    df = spark.range(1, 120_001).select(F.lit(1).alias("run"), F.col("id").alias("step"), F.when(F.col("id") == 1, 5.0).otherwise((F.col("id") % 7).cast("double")).alias("value"))
    want, a = [], None
    for i in range(1, 120_001):
        x = 5.0 if i == 1 else float(i % 7)
        a = x if a is None else 0.99 * a + 0.01 * x
        want.append(a)
    for block in (64, 1024):
        got = [r.average for r in se.exponential_average(df, ["run"], "step", "value", block=block).orderBy("step").collect()]
        assert max(abs(g - w) for g, w in zip(got, want, strict=True)) < 1e-9


def test_equal_peaks_stay_apart(spark):
    """Two discs' peaks of one height give two candidates; a plateau gives one, its first best pixel."""
    px = [(0, 3, x, 1, 1.0 if x in (5, 30, 31) else 0.3) for x in range(40)]
    df = spark.createDataFrame(px, "scene_id long, y int, x int, label int, v double")
    got = {(r.label, r.score, r.y, r.x) for r in ins.peak_candidates(df, "v", 0.5, 2).collect()}
    assert got == {(1, 1.0, 3, 5), (1, 1.0, 3, 30)}
    assert len(ins.separated_peaks(ins.peak_candidates(df, "v", 0.5, 2), 3).collect()) == 2


def test_provenance_digest_is_a_tree(spark):
    """Names in order, four at a time, then digests of four, until each split has one; the deal of rows has no say."""
    names = [("train" if i % 5 else None, f"t{i * 37 % 100:03}", i % 7) for i in range(100)]
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    want = {}
    for split in ("train", None):
        level, done = sorted(n for s, n, _ in names if s == split), 0
        while done < 2 or len(level) > 1:
            level, done = [sha(level[i : i + 4]) for i in range(0, len(level), 4)], done + 1
        want[split] = (7, sum(s == split for s, _, _ in names), level[0])
    for parts in (1, 9):
        d = spark.createDataFrame(names, "split string, tile string, source int").repartition(parts)
        assert {r.split: (r.sources, r.tiles, r.digest) for r in scans.provenance(d, "split", "tile", "source", each=4).collect()} == want


def test_mosaics_have_all_vectors(spark, tmp_path):
    """66 vectors make two mosaics; what the second lacks are the first vectors again."""
    d = spark.range(66).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding"))
    for n in (66, 64, 0):
        d.where(f"vec_id < {n}").write.parquet(str(tmp_path / str(n) / "embeddings.parquet"))
        got = fixtures.px64(spark, str(tmp_path / str(n))).groupBy("scene_id").agg(F.countDistinct("y", "x").alias("n"), F.sum("v").alias("v")).orderBy("scene_id").collect()
        assert [(r.n, r.v) for r in got] == {66: [(4096, 64.0 * 2016), (4096, 64.0 * 2020)], 64: [(4096, 64.0 * 2016)], 0: []}[n]


def test_first_columns_with_ties():
    rng = np.random.default_rng(3)
    ids = rng.permutation(40) * 7
    for k in (1, 5, 39, 40, 60):
        m = np.round(rng.random((25, 40)), 1)
        want = np.lexsort((np.broadcast_to(ids, m.shape), -m), axis=1)[:, :k]
        assert (rt.first_columns(m, ids, k) == want).all()


def test_broadcast_tables_are_bounded(spark):
    assert sorted(r.id for r in storage.bounded(spark.range(5), 5).collect()) == [0, 1, 2, 3, 4]
    assert storage.bounded(spark.range(0), 5).count() == 0
    # More rows are joined all the same, without a broadcast.
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few, many = storage.bounded(spark.range(5), 5), storage.bounded(spark.range(6), 5)
    assert hint(few) and not hint(many) and many.count() == 6
