"""Texts that are long, of one run, or made to collide; families that share a task; sets linked by subsets."""

import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import jaccard_join as jj
from rasterloom.llm.bpe import bpe_encode
from rasterloom.llm.grams import gram_hashes, word_hashes
from rasterloom.llm.jaccard_join import jaccard_join
from rasterloom.llm.media import ogg_column, read_media
from rasterloom.llm.packing import best_fit_packing, token_ids
from rasterloom.llm.substring_dedup import substring_dedup
from rasterloom.llm.suffix_dedup import suffix_dedup
from tests.llm.test_operators import brute_bytes, brute_links, brute_windows


def mirrored(n):
    """A Thue-Morse word of a and b of n bytes, and its mirror: they collide under any polynomial hash modulo 2**64."""
    w = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in w), "".join("ba"[x] for x in w)


@pytest.mark.parametrize("n", [32, 1024])
def test_mirrored_words_are_different(spark, n):
    a, b = mirrored(n)
    rows = [(1, " ".join([*(f"w{i}" for i in range(12)), a])), (2, " ".join([*(f"w{i}" for i in range(12)), b]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(d).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.component_id for r in jaccard_join(d, 4, 85).collect()} == {1: 1, 2: 2}
    letters = [(1, " ".join("ab"[c == "b"] for c in a)), (2, " ".join("ab"[c == "b"] for c in b))]
    assert {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(letters, "doc_id long, text string")).collect()} == {i: w[1] for i, w in brute_windows(letters).items()}


def test_hashes_depend_on_the_words_alone():
    rng = np.random.default_rng(1)
    some = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in [*range(1, 80), 200, 5000]]
    raw = np.frombuffer(b" ".join(some * 2), np.uint8)
    end = np.cumsum([len(w) + 1 for w in some * 2]) - 1
    start = end - [len(w) for w in some * 2]
    for seed in (0, 100):
        h = word_hashes(raw, start, end, seed)
        assert (h[: len(some)] == h[len(some) :]).all() and len(set(h.tolist())) == len(set(some))
        for n in (1, 2, 3, 7, 13):
            g = gram_hashes(h, np.array([3, 3 + len(some), 4]), n, seed)
            assert g[0] == g[1] != g[2]
    assert (word_hashes(raw, start, end, 0) != word_hashes(raw, start, end, 100)).all()


def long_text(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 9))) for _ in range(n))


def test_texts_of_hundreds_of_kilobytes(spark):
    """Longer than a run of texts is; repeats within and across them."""
    rng = np.random.default_rng(7)
    a = long_text(rng, 60_000)
    part = a[100_000:130_000]
    rows = [(1, a), (2, long_text(rng, 300) + part + long_text(rng, 50_000)), (3, part[:5000]), (4, a + " end"), (5, a[:200_000])]
    assert len(a.encode()) > 350_000
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(d).collect()}
    assert got == brute_windows(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(d, 4, 85).collect()} == brute_links(rows, 4, 85)
    want = brute_bytes(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(d).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {i: tuple(w[:3]) for i, w in want.items()}


def test_packing_takes_long_runs(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 2_000_000 + "word", "x" * 50_000, "a" + "\n" * 3000 + " b", "ab " * 900, "<|endoftext|>" + " " * 1500 + "don't", "é" * 1001]
    for t in texts:
        assert token_ids(t, path, (("<|endoftext|>", 50256),)).tolist() == lib.encode(t, add_special_tokens=False).ids
    d = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    out = best_fit_packing(d, path, {"<|endoftext|>": 50256}).collect()
    by = {f"k{i}": len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == by


def group(families, rng):
    """A task's rows: families of (sets of numbers)."""
    rows, k = [], 0
    for f, sets in enumerate(families):
        for s in sets:
            wide = np.array(sorted(s), np.uint64).view(np.uint8).reshape(-1, 8)[:, : jj.BYTES]
            rows.append({"i": 0, "j": 0, "chunk": 0, "family": f, "k": k, "n": len(s), "copies": 1 + k % 3, "members": wide.tobytes()})
            k += 1
    rng.shuffle(rows)
    return pa.Table.from_pylist(rows)


def test_families_are_verified_each_by_itself():
    rng = np.random.default_rng(9)
    families = []
    for _ in range(40):
        base = rng.integers(0, 60, 12).tolist()
        families.append([set(base) ^ set(rng.integers(0, 60, rng.integers(0, 4)).tolist()) for _ in range(rng.integers(1, 6))])
    t = group(families, rng)
    got = jj._verify(t, 70).to_pylist()
    sets = {k: (f, s) for k, (f, s) in enumerate((f, s) for f, sets in enumerate(families) for s in sets)}
    linked = lambda a, b: a != b and sets[a][0] == sets[b][0] and 100 * len(sets[a][1] & sets[b][1]) >= 70 * len(sets[a][1] | sets[b][1])
    links = {a: sum(1 + b % 3 for b in sets if linked(a, b)) for a in sets}
    assert {r["a"]: r["links"] for r in got if r["b"] is None} == {a: n for a, n in links.items() if n}
    least = {a: a for a in sets}
    for _ in sets:
        for a in sets:
            least[a] = min([least[a], *[least[b] for b in sets if linked(a, b)]])
    assert {r["a"]: r["b"] for r in got if r["b"] is not None} == {a: b for a, b in least.items() if b < a}


def test_verification_is_linear_in_small_families():
    rng = np.random.default_rng(2)
    took = []
    for m in (5_000, 20_000):
        t = group([[set(range(5 * i, 5 * i + 5)), set(range(5 * i, 5 * i + 6))] for i in range(m // 2)], rng)
        begin = time.perf_counter()
        assert len(jj._verify(t, 80)) == m + m // 2
        took.append(time.perf_counter() - begin)
    assert took[1] < 8 * took[0]


def test_cost_alone_chooses_subsets(spark, monkeypatch):
    """Short texts of few words: the operator's own boundary makes their sets light, and links come from subsets."""
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.permutation(list("abcdefghijkl"))[: rng.integers(3, 6)]) for i in range(500)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    chosen, own = [], jj.light_boundary
    monkeypatch.setattr(jj, "light_boundary", lambda sizes, percent: chosen.append(own(sizes, percent)) or chosen[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(d, 1, 70).collect()}
    assert chosen[0] > 3 and got == brute_links(list(texts.items()), 1, 70)
    assert any(g[2] for g in got.values())


def test_subsets_come_in_parts(monkeypatch):
    monkeypatch.setattr(jj, "SUBSETS_AT_ONCE", 7)
    members = np.arange(12, dtype=np.uint64) * np.uint64(977)
    parts = list(jj.subset_hashes(members, 85, 14))
    assert all(len(p) <= 7 for p in parts) and sum(map(len, parts)) == jj.subset_cost(85, 12, 14)


def test_keys_of_text(spark):
    from rasterloom.llm.quality import score, train

    rows = [(f"k{i}", f"some text {i}") for i in range(5)] + [(None, None)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    m = train(d, spark.createDataFrame([("k1", 1), ("k2", 0)], "doc_id string, quality int"))
    assert {r.doc_id for r in score(d, m).collect()} == {k for k, _ in rows}
    encoded = bpe_encode(d, public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.decoded for r in encoded.collect()}["k1"].startswith("some") and encoded.where("doc_id IS NULL").count() == 1
    assert {r.doc_id: r.error for r in read_media(ogg_column(d)).collect()} == {k: None for k, _ in rows}
    assert zlib.crc32(b"") == 0 and d.where(F.col("doc_id").isNull()).count() == 1
