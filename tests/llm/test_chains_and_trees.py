"""Conversation repair, the Merkle manifest and the language model against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import conversations as C
from rasterloom.llm import language_model as L
from rasterloom.llm import merkle as M
from rasterloom.llm.entry import QUERIES

DIR = "/root/testdata/sf0.001"
INK, WORD = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def crc(*parts):
    return zlib.crc32(":".join(" " if p is None else str(p) for p in parts).encode())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text, how = role if role is not None else " ", text if text is not None else " ", crc(conv, turn) % 20
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def plain_repair(rows):
    """rows: (turn, role, text) in order. Whole edit strings compared, every option tried."""
    seen, faults = set(), []
    for _, role, text in rows:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, edits, left = best(i + 1, last, 0)
            options.append((cost + 4, "D" + edits, left))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for new, price, name in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    to = step.get((last, new[:1]))
                    if to:
                        cost, edits, left = best(i + 1, to, 0)
                        options.append((cost + price + more, name + edits, (f"{new}:{text}", *left)))
        if inserted < 4:
            for new in ("user", "assistant"):
                to = step.get((last, new[0]))
                if to:
                    cost, edits, left = best(i, to, inserted + 1)
                    options.append((cost + 3, "I" + edits, (f"{new}:", *left)))
        return min(options, default=(math.inf, "", ()))

    if not rows:
        return 0, 0, 0, 0, 0, 0, "", sha("")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    cost, edits, left = best(0, "", 0)
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, sha("\n".join(left))


def plain_report(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], sha(f"{len(r[1])}:{r[1]}{r[2]}"))
    return {conv: plain_repair(sorted(own, key=key)) for conv, own in by.items()}


def report(df, conv="conv_id"):
    return {r[conv]: tuple(r)[1:] for r in df.collect()}


def test_op11(spark):
    rows = duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{DIR}/conversations.parquet'").fetchall()
    want = {c: plain_repair([]) for c, *_ in rows} | plain_report(damage(rows))
    got = report(QUERIES["op11_conversation_repair"](spark, DIR))
    assert got == want and sum(len(w[6]) > 0 for w in want.values()) > 10


def test_repair_of_any_rows(spark):
    rng = np.random.default_rng(3)
    texts = ["Yes.", "No", "  ", "", "What?\n ", " ", "Ünder!", "a" * 5000 + ".", None]
    roles = ["user", "assistant", "system", "tool", "", None, "System"]
    rows = []
    for conv in [None, *range(150)]:
        n = int(rng.integers(1, 9))
        for i in range(n):
            turn = None if rng.random() < 0.1 else i if rng.random() < 0.8 else int(rng.integers(-3, 9))
            rows.append((conv, turn, roles[rng.choice(7, p=[0.35, 0.3, 0.1, 0.08, 0.05, 0.06, 0.06])], texts[rng.integers(0, len(texts))], "x", 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string, there int").repartition(5)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    want = plain_report(clean)
    assert report(C.repair(df)) == want
    text_ids = df.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert report(C.repair(text_ids)) == {None if c is None else f"c{c}": w for c, w in want.items()}
    assert C.repair(df.limit(0)).count() == 0
    none = report(C.repair(df, there=F.lit(False)))
    assert set(none.values()) == {(0, 0, 0, 0, 0, 0, "", sha(""))} and set(none) == set(want)
    damaged = {c: plain_repair([]) for c, *_ in clean} | plain_report(damage([r[:4] for r in rows]))
    assert report(C.repair(C.damaged(df), there=F.col("there"))) == damaged
    by = defaultdict(list)
    for r in C.repair(df, rows=True).collect():
        by[r.conv_id].append(r)
    for c, w in want.items():
        own = sorted(by[c], key=lambda r: r.at)
        assert "".join(r.edit for r in own) == w[6]
        assert sha("\n".join(f"{r.role}:{r.text}" for r in own if r.role is not None)) == w[7]


def test_repair_of_a_giant_conversation(spark, monkeypatch):
    """Many Arrow batches, backpointers in a file; the same as a plain programme over all rows."""
    n = 60_000
    df = spark.range(n).select(F.lit("big").alias("conv_id"), F.col("id").alias("turn"), F.when(F.crc32(F.col("id").cast("string")) % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.lit("."))  .alias("text"))
    got = report(C.repair(df, in_memory=1000))["big"]
    # Plain: costs from the end on, whole table kept.
    after, chosen = C.AT_END, []
    roles = ["user" if zlib.crc32(str(i).encode()) % 3 == 0 else "assistant" for i in range(n)]
    for r in reversed(roles):
        after, c = C.row_step(after, r[0], C.NONE)
        chosen.append(c)
    assert got[5] == after[0] > 0 and got[0] == 0 and len(got[6].replace("I", "")) == n


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
    return levels


def plain_manifest(rows):
    """rows: (doc_id, source, leaf, new)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([r[2] for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]) for s in names}
    top = tree_of([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))):
            proof, h = "", r[3]
            for levels, pos in ((trees[s], at), (top, i)):
                for row in levels[:-1]:
                    run = row[pos // 3 * 3 : pos // 3 * 3 + 3]
                    proof += "".join(run[: pos % 3] + run[pos % 3 + 1 :])
                    h = sha("".join([*run[: pos % 3], h, *run[pos % 3 + 1 :]]))
                    pos //= 3
            out.append((r[0], r[2], trees[s][-1][0], top[-1][0], sha(proof), h))
    return out


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def test_op12(spark):
    docs = duckdb.execute(f"SELECT doc_id, source, lang, n_chars, text FROM '{DIR}/documents.parquet'").fetchall()
    rows = []
    for d in docs:
        new = (*d[:4], d[4].replace("\n", "")) if d[4] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 else d
        rows.append((d[0], d[1], leaf_of(d), leaf_of(new)))
    want = {r[0]: (*r[1:], r[5] == r[3]) for r in plain_manifest(rows)}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_merkle_manifest"](spark, DIR).collect()}
    assert got == want and {w[5] for w in want.values()} == {True, False}


@pytest.mark.parametrize("levels", [1, 8])
def test_manifest_of_any_rows(spark, levels):
    """Several stages, lone last runs, groups of one, null and repeated keys, clashing names."""
    rng = np.random.default_rng(levels)
    rows = []
    for s, n in ((None, 5), ("", 1), ("b", 100), ("Ä", 28), ("z", 1), ("a", 10), ("c", 3)):
        rows += [(None if i == 2 else int(rng.integers(0, 40)), s, sha(f"{s}{i}"), sha(f"new{i}") if i % 2 else sha(f"{s}{i}"), "x", 1) for i in range(n)]
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, new string, tree string, pos int").repartition(3)
    m = M.merkle_manifest(df, F.col("leaf"), F.col("new"), levels=levels)
    got = [tuple(r) for r in M.fold_leaves(m, levels=levels).collect()]
    order = lambda rs: sorted(rs, key=str)
    assert order(got) == order(plain_manifest([r[:4] for r in rows]))
    text = M.fold_leaves(M.merkle_manifest(df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), F.col("leaf"), F.col("new"), levels=levels), levels=levels)
    assert text.where("k LIKE 'k%'").count() > 100
    one = df.limit(1)
    (r,) = M.fold_leaves(M.merkle_manifest(one, F.col("leaf"), F.col("leaf"))).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("")
    assert M.fold_leaves(M.merkle_manifest(df.limit(0), F.col("leaf"), F.col("new"))).count() == 0


def test_states_are_those_of_sha256():
    words = np.array([np.frombuffer(hashlib.sha256(bytes([i])).digest(), ">u4") for i in range(7)]).T.astype(np.uint32)
    chunk = M.Chunk.of(words, 2, 3)
    for level in range(2):
        hexes = [M.to_bytes(chunk.rows[level][:, i : i + 1]).hex() for i in range(chunk.rows[level].shape[1])]
        assert M.to_bytes(chunk.rows[level + 1]).hex() == "".join(sha("".join(hexes[i : i + 3])) for i in range(0, len(hexes), 3))
    again = M.Chunk.read(*chunk.packed(), 7, 2, 3)
    assert all((a == b).all() for x, y in zip(chunk.states, again.states, strict=True) for a, b in zip(x, y, strict=True))
    assert (M.climbed(words[:, :1], chunk.ways()[4]) == chunk.folded(np.array([4]), words[:, :1])).all()


def plain_model(rows, order):
    """rows: (key, text, held). Counts in dictionaries, probabilities by recursion."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(k, [0, *WORD.findall((t or "").translate(lower)), 1], held) for k, t, held in rows]
    grams, after = Counter(), defaultdict(set)
    for _, seq, held in texts:
        if not held:
            for i in range(len(seq)):
                for o in range(1, min(order, i + 1) + 1):
                    grams[tuple(seq[i - o + 1 : i + 1])] += 1
                    if o > 1:
                        after[tuple(seq[i - o + 1 : i])].add(seq[i])
    n = sum(c for g, c in grams.items() if len(g) == 1 and g != (0,))
    v = sum(1 for g in grams if len(g) == 1 and g != (0,))

    def p(context, w):
        if not context:
            return (grams[w,] + 1) / (n + v + 1)
        low = p(context[1:], w)
        kinds = len(after[context])
        return (grams[(*context, w)] + kinds * low) / (grams[context] + kinds) if kinds else low

    out = {}
    for k, seq, held in texts:
        real = range(1, len(seq))
        base = sum(math.log10(p((), seq[i])) for i in real)
        score = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in real)
        out[k] = (held, len(seq) - 1, sum(grams[seq[i],] > 0 for i in real), n, base, score)
    return out, p


def close(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k][:4] == w[:4] and got[k][4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9), k


def scores(df, key="doc_id"):
    return {r[key]: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()}


def test_op13(spark):
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    want, p = plain_model([(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in docs], L.ORDER)
    got = scores(QUERIES["op13_language_model"](spark, DIR))
    close(got, want)
    held = [g for g in got.values() if g[0]]
    assert held and sum(g[5] for g in held) > sum(g[4] for g in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_of_any_texts(spark, order, monkeypatch):
    rng = np.random.default_rng(order)
    vocabulary = ["a", "B", "b", "Ä", "ä", "x" * 70, "X" * 70, "the", "end", " "]
    texts = [None, "", " \t", "a", "A b", "unseen words only", *(" ".join(rng.choice(vocabulary, rng.integers(1, 40))) for _ in range(60)), " ".join(rng.choice(vocabulary, 3000)), "the the the", "the the the"]
    rows = [(i if i else None, t, bool(i % 5 == 0 and i), "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean, rest string, block int").repartition(3)
    want, p = plain_model([r[:3] for r in rows], order)
    close(scores(L.language_model_scores(df, F.col("held"), order)), want)
    # A distribution: over all known tokens and one more, probabilities add up to one.
    known = {w.translate(str.maketrans("ABX", "abx")) for t in texts for w in WORD.findall(t or "")} | {1}
    train = {w.translate(str.maketrans("ABX", "abx")) for k, t, h, *_ in rows if not h for w in WORD.findall(t or "")} | {1}
    for context in [(), ("the",)[: order - 1], ("a", "b")[: order - 1]]:
        assert sum(p(context, w) for w in train) + p(context, "never") == pytest.approx(1)
    assert known >= train
    none = scores(L.language_model_scores(df, F.lit(True), order))
    assert all(s[2:] == (0, 0, 0.0, 0.0) for s in none.values())
    assert L.language_model_scores(df.limit(0), F.col("held"), order).count() == 0
    text_key = L.language_model_scores(df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), F.col("held"), order)
    assert {r.doc_id for r in text_key.collect()} == {None if r[0] is None else f"k{r[0]}" for r in rows}


def test_long_texts_are_cut_without_loss():
    """Segments of any length give what one reading gives."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefg"), n)).encode() for n in (0, 1, 5, 700, 2000)]
    t = L.Texts(pa.table({"t": pa.array(texts), "rest": pa.array([{"k": i, "held": i == 4} for i in range(5)])}), 3)
    counts = t.own
    after = [np.bincount(t.before(o)[counts[o - 1] > 0], minlength=len(t.keys[o - 2])).astype(np.uint64) for o in (2, 3)]
    a = L.Automaton(t, counts, after, 700, 8)
    whole = L.traversed(a, t.of[0], t.begin + 1, t.n_tokens, 3, 1 << 20)
    for segment in (1, 2, 3, 17, 512):
        assert L.traversed(a, t.of[0], t.begin + 1, t.n_tokens, 3, segment) == pytest.approx(whole)


def test_totals_choose_one_that_stands_for_all():
    keys = np.array([3, 5, 3, 7, 5, 3], np.uint64)
    own = np.array([0, 2, 1, 0, 4, 9], np.uint64)
    k, merged, of = L.TOTALS.merge(keys, own)
    said = L.TOTALS.spread(L.TOTALS.decide(k, merged), of, own, merged)
    assert (said >> np.uint64(1)).tolist() == [10, 6, 10, 0, 6, 10] and (said & np.uint64(1)).tolist() == [0, 1, 1, 0, 0, 0]
    assert L.TOTALS.unpack(L.TOTALS.pack(own * np.uint64(10**12)), 6).tolist() == (own * np.uint64(10**12)).tolist()


@pytest.mark.parametrize("bits", [8, 16, 30, 33, 40, 47, 55, 63, 64])
def test_packed_values_come_back(bits):
    from rasterloom.llm.blocks import pack, unpack

    rng = np.random.default_rng(bits)
    for n in (0, 1, 5, 1000):
        v = np.sort(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64))
        assert (unpack(pack(v)) == v).all()


def test_sql_of_the_repair_on_odd_rows():
    """Nulls in every column, ties, repeated rows, other roles: the SQL against the plain version."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    texts, roles = ["Yes.", "No", "  ", "", "What?\n ", "Ünder!", None], ["user", "assistant", "system", "tool", "", None]
    rows = [(None if conv == 7 else conv, None if rng.random() < 0.1 else int(rng.integers(-2, 9)), roles[rng.integers(0, 6)], texts[rng.integers(0, 7)]) for conv in range(120) for _ in range(rng.integers(1, 9))]
    c = duckdb.connect()
    c.register("conversations", pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}))
    got = {r[0]: r[1:] for r in c.execute(C.OP11_SQL).fetchall()}
    assert got == {conv: plain_repair([]) for conv, *_ in rows} | plain_report(damage(rows))
