"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import blocks
from rasterloom.llm import jaccard_join as jj
from rasterloom.llm import suffix_dedup as sd
from rasterloom.llm.bpe import bpe_encode
from rasterloom.llm.chat import chat_examples, read_back, read_turns
from rasterloom.llm.components import components
from rasterloom.llm.exact_dedup import exact_dedup
from rasterloom.llm.jaccard_join import jaccard_join, light_boundary, need, size_classes
from rasterloom.llm.media import BadOgg, lacing_of, page_checksum, read_media, read_ogg, read_samples, ogg_column, stream_pages, write_ogg
from rasterloom.llm.packing import best_fit, best_fit_packing
from rasterloom.llm.quality import AttentionMil, bags, keep_quality, score, train
from rasterloom.llm.sharding import ring_plan, ring_shards
from rasterloom.llm.substring_dedup import substring_dedup
from rasterloom.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, k string, t int, block string, h double, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(n))


def make_texts():
    rng = np.random.default_rng(5)
    shared, line = words(rng, 60), words(rng, 14)
    base = words(rng, 120).split(" ")
    out = [None, "", " \n\t ", "one", "One", "two words", words(rng, 4000), "x" * 3000, "ab" * 400 + " " + "ab" * 400, "a<|endoftext|>b don't 12 ﬁ́"]
    out += [f"{words(rng, 9)} {shared} {words(rng, 7)}" for _ in range(12)]
    out += [f"{words(rng, 5)}\n{line}\n{words(rng, 30)}" for _ in range(40)]
    for i in range(14):  # near copies of one text
        w = list(base)
        for j in rng.integers(0, 120, i % 5):
            w[j] = "z" + str(i)
        out.append(" ".join(w))
    small = [words(rng, 4 + i % 9) for i in range(10)]
    out += small + [s + " extra" for s in small[:5]] + [s.upper() for s in small[:3]]
    return out + out[3:9] + [shared, shared, line]


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "b", 0.5, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture
def many_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "block_count", lambda n: 5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without keys, repeated rows, and one key with two texts."""
    long = " ".join(f"w{i}" for i in range(40))
    return spark.createDataFrame([(None, long, "x", 1, "b", 0.5, 7)] * 2 + [(1, long, "x", 1, "b", 0.5, 7)] * 2 + [(1, "other", "x", 1, "b", 0.5, 7), (None, None, None, None, None, None, None)], SCHEMA)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_exact_dedup(docs, empty, odd):
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    for i, t in enumerate(TEXTS):
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), sha((t or "").encode()))
    assert exact_dedup(empty).count() == 0
    r = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd).collect())
    assert r == {(None, 1, 4, False): 2, (1, 1, 4, True): 2, (1, 1, 1, True): 1, (None, None, 1, True): 1}


def test_exact_dedup_compares_texts_under_one_digest(docs):
    weak = exact_dedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))
    a = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in weak.collect()}
    assert a == {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}


def test_sharding(docs, empty, odd):
    rows = ring_shards(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    by = defaultdict(list)
    for r in rows:
        t = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert ring_shards(empty).count() == 0 and ring_shards(odd).count() == 6


def test_ring_moves_little():
    """Without overflow a new shard takes rows only into itself; with it, capacities hold exactly."""
    counts = {c * 37 % 32768: 3 for c in range(800)}
    for shards in (1, 3, 8):
        plan = ring_plan(counts, shards)
        size = Counter()
        for p in plan:
            size[p["shard"]] += p["hi"] - p["lo"]
        assert sum(size.values()) == 2400 and max(size.values()) - min(size.values()) <= 1


def brute_windows(rows, n=13):
    first, out = {}, {}
    ws = {i: WORD.findall(t or "") for i, t in rows}
    for i, _ in rows:
        for j in range(len(ws[i]) - n + 1):
            first.setdefault(tuple(ws[i][j : j + n]), i)
    for i, _ in rows:
        gone = [False] * len(ws[i])
        for j in range(len(ws[i]) - n + 1):
            if first[tuple(ws[i][j : j + n])] < i:
                gone[j : j + n] = [True] * n
        out[i] = (len(gone), sum(gone), " ".join(w for w, g in zip(ws[i], gone) if not g))
    return out


def test_substring_dedup(docs, empty, odd, many_blocks):
    want = brute_windows(list(enumerate(TEXTS)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()}
    assert got == want
    carried = {r.rest.doc_id: r.kept for r in substring_dedup(docs, carry=["doc_id", "k"]).collect()}
    assert all(v == (want[i][2] if want[i][1] else TEXTS[i] or "") for i, v in carried.items())
    assert substring_dedup(empty).count() == 0
    r = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(odd).collect())
    assert r == {(None, 40, 40): 2, (1, 40, 0): 2, (1, 1, 0): 1, (None, 0, 0): 1}


def brute_bytes(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for x in range(len(b)) if gone[x] and not (x and gone[x - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_dedup(docs, empty, odd, many_blocks):
    want = brute_bytes(list(enumerate(TEXTS)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs).collect()}
    assert got == want
    assert suffix_dedup(empty).count() == 0
    r = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in suffix_dedup(odd).collect())
    size = len(" ".join(f"w{i}" for i in range(40)))
    assert r == [(False, 5, 0), (False, size, 0), (False, size, size), (True, 0, 0), (True, size, size), (True, size, size)]


def test_suffix_dedup_with_one_crowded_block(docs):
    """In one block forty surroundings of one line are more contexts than are compared as suffixes."""
    rng = np.random.default_rng(8)
    line = words(rng, 30)
    texts = [f"{words(rng, 12)} {line} {words(rng, 12)}" for _ in range(40)]
    d = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(d).collect()}
    assert got == brute_bytes(list(enumerate(texts)))


@pytest.fixture
def apart(spark):
    """Every group in a partition of its own, as on a cluster: nothing meets by being in one task anyhow."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def levels(monkeypatch, apart):
    """Thirteen blocks, three of which meet in a node: answers go through three levels."""
    monkeypatch.setattr(blocks, "block_count", lambda n: 13)
    of = blocks.Ways.of
    monkeypatch.setattr(blocks.Ways, "of", staticmethod(lambda *a, **k: of(*a, **k | {"fan": 3})))


def test_levels_give_the_same(docs, levels):
    rows = list(enumerate(TEXTS))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()} == brute_windows(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs).collect()} == brute_bytes(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(docs).collect()} == brute_links(rows, 4, 85)


def test_pieces_stay_in_proportion():
    """Packed pieces for each block are bounded at any size, in all three exchanges."""
    for n in (10**9, 10**12, 10**13, 10**14, 10**15):
        for bits, items, each in ((48, n // 12, blocks.RANGE_ITEMS), (50, n // 2, blocks.RANGE_ITEMS), (48, n // 60, 1 << 16)):
            w = blocks.Ways.of(blocks.block_count(n), bits, items, range_items=each)
            assert w.pieces() <= 16000 * w.blocks and w.nodes(len(w.fans) - 1) <= 100 * w.blocks + 256


@pytest.mark.parametrize("crowd", [1, 4, 30])
def test_crowded_anchors_are_split(docs, many_blocks, monkeypatch, crowd):
    """However finely the distances of crowded anchors are cut, the same bytes go."""
    monkeypatch.setattr(sd, "CROWD", crowd)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs).collect()}
    assert got == brute_bytes(list(enumerate(TEXTS)))


def repeats_of(df, texts):
    """Groups with their places; each place has the group's bytes, and no other place in any text has."""
    raw = [(t or "").encode() for t in texts]
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.group].append((r.doc_id, r.start, r.length))
    for places in groups.values():
        d, s, n = places[0]
        want = [(i, m.start(), n) for i, b in enumerate(raw) for m in re.finditer(b"(?=" + re.escape(b[:0] + raw[d][s : s + n]) + b")", b, re.S)]
        assert sorted(places) == want and len(want) > 1 and n >= 100
    return groups, raw


@pytest.mark.parametrize("crowd", [4096, 4])
def test_repeat_groups_have_all_occurrences(docs, empty, odd, many_blocks, monkeypatch, crowd):
    """Every group is whole, and what suffix dedup removes is all occurrences of the groups but the first of each."""
    monkeypatch.setattr(sd, "CROWD", crowd)
    groups, raw = repeats_of(sd.repeat_groups(docs), TEXTS)
    gone = [bytearray(len(b)) for b in raw]
    for places in groups.values():
        for d, s, n in sorted(places)[1:]:
            gone[d][s : s + n] = b"\1" * n
    want = brute_bytes(list(enumerate(TEXTS)))
    assert {i: bytes(x for x, g in zip(b, gone[i]) if not g) for i, b in enumerate(raw)} == {i: w[3] for i, w in want.items()}
    assert max(len(p) for p in groups.values()) >= 14
    assert sd.repeat_groups(empty).count() == 0
    per_group = Counter(r.group for r in sd.repeat_groups(odd).collect())
    assert per_group and set(per_group.values()) == {4}


def test_repeat_groups_through_levels(docs, levels):
    assert repeats_of(sd.repeat_groups(docs), TEXTS)[0]


def brute_links(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    parent, links = {i: i for i in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize("n,percent,chunk", [(4, 85, 2048), (5, 80, 4), (1, 60, 8)])
def test_jaccard_join(docs, many_blocks, n, percent, chunk):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(docs, n, percent, chunk=chunk).collect()}
    assert got == brute_links(list(enumerate(TEXTS)), n, percent)


def test_jaccard_join_edges(empty, odd):
    assert jaccard_join(empty).count() == 0
    r = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(odd).collect())
    assert r == {(None, 37, None): 2, (1, 37, 1): 2, (1, 1, 1): 1, (None, 0, None): 1}


def test_light_boundary_follows_cost():
    assert need(85, 13, 13) == 12 and need(85, 12, 13) == 12
    short = {s: (100, 200) for s in range(1, 33)}  # lists of two: scanning them is cheap
    long = {s: (100, 100 * 50_000) for s in range(1, 33)}  # lists of very common shingles
    assert light_boundary(short, 85) < light_boundary(long, 85) and light_boundary(long, 85) > 16
    assert light_boundary({}, 85) == 1


def test_size_classes_hold_all_partners():
    for percent in (60, 80, 85, 100):
        starts = size_classes(percent, 500)
        of = lambda n: sum(n >= s for s in starts[1:])
        assert all(of(m) - of(n) in (0, 1) for n in range(1, 400) for m in range(n, 100 * n // percent + 1))


def test_jaccard_join_by_subsets(spark, monkeypatch):
    """Sets of few common words: all their links come from subsets, none from lists."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.permutation(list("abcdefghij"))[: rng.integers(3, 8)]) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    monkeypatch.setattr(jj, "light_boundary", lambda sizes, percent: seen.append(max(sizes) + 1) or seen[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(d, 1, 70).collect()}
    want = brute_links(list(enumerate(texts)), 1, 70)
    assert got == want and seen and sum(w[2] for w in want.values()) > 60


def test_components(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (3, 3), (5, 4), (5, 4), (None, 2)], "a long, b long")
    assert {(r.node, r.component) for r in components(e).collect()} == {(9, 1), (8, 1), (7, 1), (1, 1), (3, 3), (5, 4), (4, 4)}
    assert components(e.limit(0)).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe_encode(docs, path).collect():
        e = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == e
        assert r.decoded == lib.decode(e, skip_special_tokens=False)
    assert bpe_encode(empty, path).count() == 0


def test_packing(docs, empty, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
    rows = best_fit_packing(docs, *args, limit=256).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by[i], key=lambda r: r.piece):
            assert r.start == at and (r.length == 256 or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        s = sorted(s, key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist() and sum(r.length for r in s) <= 256
    bins: list[int] = []  # first fit, the longest first
    for n in sorted((r.length for r in rows), reverse=True):
        i = next((i for i, b in enumerate(bins) if b + n <= 256), None)
        if i is None:
            bins.append(n)
        else:
            bins[i] += n
    assert len(seqs) <= len(bins)
    assert best_fit_packing(empty, *args).count() == 0 and best_fit_packing(odd, *args).count() == 6


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(1).integers(1, 90, 500)
    where, offset = best_fit(lengths, 100, 3, 5000.0, (1, 1, 1), rule)
    for s in set(where.tolist()):
        own = lengths[where == s]
        assert own.sum() <= 100 and len(own) <= 3 and ((own**2).sum() <= 5000 or len(own) == 1)
        assert sorted(offset[where == s].tolist())[0] == 0


def test_media(docs, empty):
    media = ogg_column(docs)
    for r in read_media(media).collect():
        t = (TEXTS[r.doc_id] or "").encode()
        assert r.error is None and bytes(r.payload) == t.ljust(max(1, -(-len(t) // 576)) * 576, b"\xff") and r.n_bytes == len(t)
    broken = media.withColumn("media", F.when(F.col("doc_id") == 0, None).otherwise(F.overlay("media", F.lit(b"zz"), F.lit(40))))
    assert all(r.payload is None and r.error for r in read_media(broken).collect())
    assert read_media(ogg_column(empty)).count() == 0


def test_ogg_pages():
    def slow(b):
        crc = 0
        for x in b:
            crc ^= x << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    assert page_checksum(b"OggS and more") == slow(b"OggS and more")
    assert lacing_of(510) == b"\xff\xff\x00" and lacing_of(3) == b"\x03"
    packets = [b"a" * 5000, b"", b"b" * 255, b"c" * 30]
    pages = stream_pages(7, packets, [10, 20, 30, 40], flags=4, segments=4)
    s = read_ogg(b"".join(pages))[7]
    assert s.packets == packets and s.granules[-1] == 40 and len(pages) > 3
    data = write_ogg(bytes(range(256)) * 40)
    assert read_samples(data)[0] == bytes(range(256)) * 40
    with pytest.raises(BadOgg):
        read_ogg(data[:-5])
    with pytest.raises(BadOgg):
        read_ogg(data[:100] + bytes([data[100] ^ 1]) + data[101:])


CHATS = [
    (1, 0, "system", "be"), (1, 1, "user", "hi </turn> ### x: \\"), (1, 2, "assistant", "yes\\"), (1, 3, "user", None), (1, 4, "assistant", "###\n</turn>"), (2, 0, "user", "no answer"), (3, 0, None, None),
    (4, 0, "assistant", ""), (4, 1, "user", "tail"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (None, 0, "user:\\", "é" * 3000),
]


def test_chat(spark):
    d = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    ex = chat_examples(d)
    rows = ex.collect()
    assert Counter(r.conv_id for r in rows) == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2, None: 1}
    back = defaultdict(list)
    for r in read_back(ex).collect():
        back[r.conv_id].append(r)
    for c in (1, 2, 3, 4, 5, None):
        turns = [(r or "", t or "") for i, _, r, t in CHATS if i == c]
        own = sorted(back[c], key=lambda r: r.example)
        assert own[-1].n_turns == len(turns) and own[-1].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns).encode())
        assert "".join(r.loss for r in own) == "".join(t for r, t in turns if r == "assistant")
    for r in rows:
        turns = read_turns(r.text)
        if r.loss_end > r.loss_start:
            assert turns[-1][0] == "assistant" and r.text.endswith(r.text[r.loss_start : r.loss_end] + "</turn>\n")
    with pytest.raises(ValueError):
        read_turns("### a: b")
    assert chat_examples(d.limit(0)).count() == 0


def made_bags(texts):
    raw = b"".join(t.encode() for t in texts)
    return bags(np.frombuffer(raw, np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]]))


def started(b):
    wide = b.x.astype(np.float64)
    return AttentionMil.start(len(wide), wide.sum(axis=0), (wide * wide).sum(axis=0))


def test_quality_gradient():
    """The written-out gradient against finite differences."""
    rng = np.random.default_rng(3)
    b, y = made_bags([words(rng, 150), words(rng, 30) + " !", ""]), np.array([1.0, 0.0, 1.0])
    assert b.sizes.tolist() == [3, 1, 1] and b.n_words.tolist() == [64, 64, 22, 31, 0] and b.n_grams[-1] == 0
    m = started(b)
    loss = lambda: -np.mean(y * np.log(m.forward(b)["score"]) + (1 - y) * np.log(1 - m.forward(b)["score"])) + sum((a**2).sum() for a in m.p.values()) * 1e-4 / 2
    g = m.gradient(b, y)
    for k in m.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), m.p[k].shape)
        m.p[k][i] += 1e-5
        up = loss()
        m.p[k][i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[k][i]) < 1e-5
        m.p[k][i] += 1e-5
    some = b.taken(np.array([2, 0]))
    assert np.allclose(m.score(some), m.score(b)[[2, 0]])


def test_attention_finds_the_passage_that_decides():
    """One passage of ten has the words that make a document bad: averaging all of them finds fewer."""
    rng = np.random.default_rng(6)
    vocabulary = words(rng, 400).split(" ")
    bad = words(rng, 6).split(" ")
    texts, y = [], []
    for i in range(480):
        w = rng.choice(vocabulary, 10 * 64).tolist()
        if i % 2:
            at = int(rng.integers(0, 10)) * 64
            for j in rng.integers(0, 64, 20):
                w[at + j] = str(rng.choice(bad))
        texts.append(" ".join(w))
        y.append(float(i % 2 == 0))
    y, right = np.array(y), {}
    for attention in (True, False):
        train_, test_ = made_bags(texts[:360]), made_bags(texts[360:])
        m = started(train_)

        def batches(b=train_):
            for epoch in range(25):
                order = np.random.default_rng(epoch).permutation(360)
                for at in range(0, 360, 64):
                    yield b.taken(order[at : at + 64]), y[order[at : at + 64]]

        m.fit(batches(), 150, attention=attention)
        right[attention] = float(np.mean((m.score(test_) >= 0.5) == (y[360:] > 0)))
    assert right[True] > 0.8 and right[True] >= right[False]


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(2)
    good = [words(rng, 60).capitalize() + "." for _ in range(60)]
    bad = [" ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in words(rng, 60).split()) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    m = train(d, labels)
    got = {r.doc_id: r.score for r in score(d, m).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 10 and np.mean([(got[i] >= 0.5) == (i < 60) for i in held]) > 0.9
    assert keep_quality(d, m, threshold=0.5).count() == sum(s >= 0.5 for s in got.values())
    all_ = score(docs, m).collect()
    assert len(all_) == len(TEXTS) and all(0 <= r.score <= 1 for r in all_)
    assert score(empty, m).count() == 0 and keep_quality(docs, m).columns == docs.columns
    nothing = train(empty, labels.limit(0))
    assert len({round(r.score, 9) for r in score(docs.limit(3), nothing).collect()}) <= 3
