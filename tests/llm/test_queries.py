"""Each registered query on the smallest documents: all columns of its contract against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from rasterloom.llm.entry import ORACLES, QUERIES
from rasterloom.llm.sharding import CELL_BITS, SHARDS, VNODES, ring_points, ways_round
from tests.llm.test_operators import brute_bytes, brute_links, brute_windows, sha

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall())


def rows(spark, name):
    return QUERIES[name](spark, DIR).collect()


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op1_bpe")}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))
    assert len(got) == len(texts)


def test_op2(spark, texts):
    got = rows(spark, "op2_quality")
    known = dict(duckdb.execute(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall())
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert held and np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.8


def test_op3(spark, texts):
    want = brute_links(list(texts.items()), 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows(spark, "op3_jaccard_join")} == want


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op4_best_fit_packing"):
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids, at = [*lib.encode(t, add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (r.length == 1024 or n == 0) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(by[i]) == 1)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist() and sum(r.length for r in s) <= 1024
    room = []  # best fit, the longest first
    for n in sorted((r.length for s in sequences.values() for r in s), reverse=True):
        at = min((i for i, x in enumerate(room) if x >= n), key=lambda i: room[i], default=None)
        if at is None:
            room.append(1024 - n)
        else:
            room[at] -= n
    assert len(sequences) <= len(room) * 1.01 + 1


def test_op5(spark, texts):
    """Every row lies in the first shard clockwise from its place that is not full: those before it on its way are."""
    got = rows(spark, "op5_ring_shards")
    size = Counter(r.shard for r in got)
    room = [len(texts) // SHARDS + (s < len(texts) % SHARDS) for s in range(SHARDS)]
    assert [size[s] for s in range(SHARDS)] == room and sorted(r.doc_id for r in got) == sorted(texts)
    points = ring_points(SHARDS, VNODES)
    ways = ways_round(points, SHARDS)
    plain = Counter()
    for r in got:
        cell = xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42) >> (64 - CELL_BITS)
        at = next((i for i, (p, _) in enumerate(points) if p >= cell), 0)
        way = ways[at]
        assert all(size[s] == room[s] for s in way[: way.index(r.shard)])
        plain[way[0]] += 1
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
    at_home = sum(min(plain[s], room[s]) for s in range(SHARDS))
    moved = sum(1 for r in got if ways[next((i for i, (p, _) in enumerate(points) if p >= xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42) >> (64 - CELL_BITS)), 0)][0] != r.shard)
    assert moved == len(texts) - at_home  # only rows that a full shard turned away
    for s in range(SHARDS):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(room[s]))


def test_ring_grows_into_the_new_shard():
    """Without bounds on loads, a further shard takes rows only into itself."""
    home = lambda n: [ways_round(ring_points(n, VNODES), n)[next((i for i, (p, _) in enumerate(ring_points(n, VNODES)) if p >= c), 0)][0] for c in range(0, 32768, 97)]
    before, after = home(8), home(9)
    assert all(a in (b, 8) for b, a in zip(before, after, strict=True)) and 0 < sum(a == 8 for a in after) < len(after) / 4


def test_op6(spark, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    want = {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), sha(t.encode())) for i, t in texts.items()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows(spark, "op6_exact_dedup")} == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    r = c.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    got = rows(spark, name)
    assert sorted(names) == sorted(got[0].asDict())
    assert sorted(map(str, (tuple(x[n] for n in names) for x in got))) == sorted(map(str, r.fetchall()))


def test_op8(spark, texts):
    want = {i: (*w[:3], sha(w[3])) for i, w in brute_bytes(list(texts.items())).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op8_suffix_dedup")} == want


def test_op9(spark, texts):
    want = {i: (*w[:2], sha(w[2].encode())) for i, w in brute_windows(list(texts.items())).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op9_substring_dedup")} == want


def test_op10(spark, texts):
    by = {}
    for r in rows(spark, "op10_ogg_media"):
        t = texts[r.doc_id].encode()
        payload = t.ljust(max(1, -(-len(t) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and by.setdefault(t, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
