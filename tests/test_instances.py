"""Peaks, votes, markers and drawn negatives against plain versions, and what they meet on the way."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import instances as ins
from rasterloom.operators import retrieval as rt


def test_window_maximum_of_odd_shapes(spark):
    """Thin, hollow and touching components: a place counts if a pixel of the same component is in reach, joined to it or not."""
    rng = np.random.default_rng(4)
    px = {}
    for scene in range(3):
        for y in range(24):
            for x in range(24):
                if (x * y + scene) % 5 == 0 or y == 7 or (x - 12) ** 2 + (y - 12) ** 2 in range(60, 90):
                    px[scene, y, x] = (int(rng.integers(1, 3)), float(np.round(rng.random(), 1)))
    df = spark.createDataFrame([(s, y, x, n, v) for (s, y, x), (n, v) in px.items()], "scene_id int, y int, x int, label int, v double")
    for d in (1, 2, 4):
        best = {
            (s, y, x): v
            for (s, y, x), (n, v) in px.items()
            if v >= 0.5 and v >= max(px[s, b, a][1] for b in range(y - d, y + d + 1) for a in range(x - d, x + d + 1) if px.get((s, b, a), (0,))[0] == n) - 1e-7
        }
        left, want = set(best), Counter()
        while left:
            stack, plateau = [left.pop()], []
            while stack:
                s, y, x = stack.pop()
                plateau.append((s, y, x))
                for b in (y - 1, y, y + 1):
                    for a in (x - 1, x, x + 1):
                        if (s, b, a) in left:
                            left.remove((s, b, a))
                            stack.append((s, b, a))
            for n in {px[p][0] for p in plateau}:
                s, y, x = min((p for p in plateau if px[p][0] == n), key=lambda p: (-best[p], p[1], p[2]))
                want[s, n, best[s, y, x], y, x] += 1
        assert Counter(tuple(r) for r in ins.peak_candidates(df, "v", 0.5, d).collect()) == want


def greedy(peaks, d):
    kept = defaultdict(list)
    for scene, label, score, y, x in sorted(peaks, key=lambda p: (-p[2], p[3], p[4])):
        if all((y - b) ** 2 + (x - a) ** 2 >= d * d for b, a in kept[scene, label]):
            kept[scene, label].append((y, x))
    return {(*k, y, x) for k, v in kept.items() for y, x in v}


@pytest.mark.parametrize("d", [1, 6])
def test_separated_peaks_are_the_greedy_ones(spark, d):
    rng = np.random.default_rng(d)
    peaks = {(s, int(rng.integers(1, 3)), int(y), int(x)): float(np.round(rng.random(), 1)) for s in range(2) for y, x in rng.integers(-20, 40, (150, 2))}
    peaks |= {(7, 1, 0, 2 * i): 1.0 - i / 100 for i in range(20)}  # each too close to the next best
    rows = [(s, n, v, y, x) for (s, n, y, x), v in peaks.items()]
    got = ins.separated_peaks(spark.createDataFrame(rows, "scene_id int, label int, score double, y int, x int"), d)
    assert {(r.scene_id, r.label, r.y, r.x) for r in got.collect()} == greedy(rows, d)


def test_a_component_with_ten_thousand_peaks(spark):
    """A pixel meets few of the peaks, and the nearest is that of all."""
    n = 100
    sites = spark.range(n * n).select(F.lit(0).alias("scene_id"), F.lit(1).alias("label"), F.col("id").cast("int").alias("site"), (F.floor(F.col("id") / n) * 7 + F.col("id") % 3).cast("double").alias("sy"), (F.col("id") % n * 7 + F.col("id") % 2).cast("double").alias("sx"))
    points = spark.range(40_000).select(F.lit(0).alias("scene_id"), F.lit(1).alias("label"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(7000)) / 10.0).alias("vy"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7000)) / 10.0).alias("vx"))
    placed, near = ins.site_candidates(points, sites)
    met = placed.join(near, ["scene_id", "label", "_ty", "_tx"]).count()
    assert met <= 16 * 40_000
    got = {r.y: r.site for r in ins.nearest_sites(points, sites).collect()}
    s = np.array([(r.sy, r.sx) for r in sites.orderBy("site").collect()])
    for r in points.limit(4000).collect():
        d = np.round((s[:, 0] - r.vy) ** 2 + (s[:, 1] - r.vx) ** 2, 9)
        assert got[r.y] == int(d.argmin())
    assert len(got) == 40_000


def test_nearest_with_far_and_crowded_sites(spark):
    """Clusters far from all points, components with one site or none, ties."""
    rng = np.random.default_rng(2)
    sites = [(0, 1, i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(500, 520, (200, 2)))] + [(0, 2, 0, -3.0, 4.0), (1, 1, 0, 0.0, 0.0), (1, 1, 1, 0.0, 8.0)]
    points = [(s, n, i, 0, float(y), float(x)) for s in (0, 1) for n in (1, 2, 3) for i, (y, x) in enumerate(rng.integers(-5, 300, (60, 2)))] + [(1, 1, 99, 0, 0.0, 4.0)]
    got = ins.nearest_sites(spark.createDataFrame(points, "scene_id int, label int, y int, x int, vy double, vx double"), spark.createDataFrame(sites, "scene_id int, label int, site int, sy double, sx double"))
    want = {}
    for s, n, y, _, vy, vx in points:
        own = [((vy - sy) ** 2 + (vx - sx) ** 2, i) for a, b, i, sy, sx in sites if (a, b) == (s, n)]
        if own:
            want[s, n, y] = min(own)[1]
    assert {(r.scene_id, r.label, r.y): r.site for r in got.collect()} == want
    none = ins.nearest_sites(spark.createDataFrame(points, "scene_id int, label int, y int, x int, vy double, vx double"), spark.createDataFrame([], "scene_id int, label int, site int, sy double, sx double"))
    assert none.count() == 0


def test_a_peak_without_votes_has_no_id(spark):
    px = spark.createDataFrame([(0, 0, x, 1, 0.0) for x in range(3)] + [(0, 9, x, 2, 0.0) for x in range(3)], "scene_id int, y int, x int, label int, v double")
    peaks = spark.createDataFrame([(0, 1, 0.9, 0, 0), (0, 1, 0.8, 40, 40), (0, 2, 0.7, 9, 1)], "scene_id int, label int, score double, y int, x int")
    got = ins.decode_instances(px, peaks, F.lit(0.0), F.lit(0.0), 64, 64)
    assert {(r.y, r.instance) for r in got.collect()} == {(0, 1), (9, 2)}


@pytest.mark.parametrize("n", [10, 50, 100])
def test_equal_scores_are_drawn_evenly(n):
    """Chi-square of 200,000 queries' greatest number, and of neighbouring queries' draws together."""
    queries = 200_000
    top = np.concatenate([rt.pair_uniform(np.arange(i, i + 20_000), np.arange(1, 2 * n, 2)).argmax(axis=1) for i in range(0, queries, 20_000)])
    bound = lambda k: k + 5 * math.sqrt(2 * k)
    one = np.bincount(top, minlength=n)
    assert ((one - queries / n) ** 2 / (queries / n)).sum() < bound(n - 1)
    two = np.bincount(top[:-1] // 10 * (n // 10) + top[1:] // 10, minlength=(n // 10) ** 2) if n > 10 else np.bincount(top[:-1] * n + top[1:], minlength=n * n)
    share = (queries - 1) / len(two)
    assert ((two - share) ** 2 / share).sum() < bound(len(two) - 1)


def test_pair_numbers_are_uniform_and_follow_the_softmax():
    u = rt.pair_uniform(np.array([0, 1, -5, 1 << 40, (1 << 40) + 1]), np.arange(100_000))
    for row in u:
        assert abs(row.mean() - 0.5) < 0.005 and np.unique(row).size == row.size and 0 < row.min() and row.max() < 1
    assert np.abs(np.corrcoef(u) - np.eye(5)).max() < 0.02
    score = np.array([0.0, 0.5, 1.0, -1.0])
    noise = -np.log(-np.log(rt.pair_uniform(np.arange(200_000), np.arange(4))))
    drawn = np.bincount((score + noise).argmax(axis=1), minlength=4) / 200_000
    assert drawn == pytest.approx(np.exp(score) / np.exp(score).sum(), abs=0.005)


def test_cosines_by_batches(spark):
    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(30, 4)), rng.normal(size=(5, 4))
    q[3] = 0
    qs = spark.createDataFrame([(i, [float(x) for x in v], "a") for i, v in enumerate(q)], "query long, vec array<double>, tag string").repartition(3)
    ms = spark.createDataFrame([(i, [float(x) for x in v], 0.5) for i, v in enumerate(m)], "memory long, mvec array<double>, mscore double")
    got = {(r.query, r.memory): r.cos for r in rt.cosine_pairs(qs, ms, 5).collect()}
    assert len(got) == 150 and all(got[3, j] is None for j in range(5))
    for (i, j), c in got.items():
        assert i == 3 or c == pytest.approx(q[i] @ m[j] / np.linalg.norm(q[i]) / np.linalg.norm(m[j]))
    assert rt.cosine_pairs(qs, ms.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        rt.cosine_pairs(qs, ms, 4)


def exact_top(i, x, j, y, k):
    s = x @ y.T
    out = {}
    for side, m, q, f in (("text", s, i, j), ("image", s.T, j, i)):
        for r, row in zip(q, m, strict=True):
            order = sorted(range(len(f)), key=lambda c: (-row[c], f[c]))[:k]
            out[side, r] = [int(f[c]) for c in order]
    return out


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_top_k_skips_pairs_of_blocks(spark, monkeypatch, spread):
    """Exact on clusters and on vectors without any; near clusters most pairs are never multiplied."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 8)) * 3
    x = middles[rng.integers(0, 30, 600)] + rng.normal(size=(600, 8)) * spread
    y = middles[rng.integers(0, 30, 640)] + rng.normal(size=(640, 8)) * spread
    y[5] = y[6]
    make = lambda v, at: spark.createDataFrame([(2 * n + at, [float(c) for c in r]) for n, r in enumerate(v)], "id long, vec array<double>")
    a, b = make(x, 0), make(y, 1)
    monkeypatch.setattr(rt, "PRUNE_FROM", 1)
    got = defaultdict(list)
    for r in sorted(rt.top_k_both(a, b, 5, 20).collect(), key=lambda r: r["rank"]):
        got[r.side, r["query"]].append(r.found)
    assert got == exact_top(np.arange(600) * 2, x, np.arange(640) * 2 + 1, y, 5)
    if spread < 0.1:
        p, q = (ins.checkpointed(rt.vector_blocks(d, 20)) for d in (a, b))
        _, first, left = rt.pruned_pairs(p, q, 5, 1.0)
        all_ = p.select("b").distinct().count() * q.select("b").distinct().count()
        assert first.count() + left.count() < 0.5 * all_
