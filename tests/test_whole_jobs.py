"""Queries whose SQL covers a part of their job only, against all of their input."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import captions as cp
from rasterloom.operators import mapfeatures as mf
from rasterloom.plans import fixtures as fx
from rasterloom.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("part", "orders", "customer", "documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_tile_summary_has_all_features(spark, duck):
    """Counts as the SQL of F7 has them for all features, sentences as that of F10."""
    got = {r.tile_id: r.asDict() for r in QUERIES["f11_tile_summary"](spark, DIR).collect()}
    r = duck.execute(ORACLES["f7_category_counts"])
    names = [c[0] for c in r.description]
    want = {t["tile_id"]: t for t in (dict(zip(names, x)) for x in r.fetchall())}
    assert len(got) == 64 and sum(t["features"] for t in want.values()) >= duck.execute("SELECT count(*) FROM part").fetchone()[0]
    for i, t in got.items():
        assert {n: t[n] for n in names} == want.get(i, {n: i if n == "tile_id" else 0 for n in names})
    assert {i: t["sentence"] for i, t in got.items()} == dict(duck.execute(ORACLES["f10_summary_sentence"]).fetchall())


def test_tile_summary_keeps_empty_tiles(spark):
    f = spark.createDataFrame([(1, 0.01, 0.01, 0.02, 0.02, {"building": "yes"})], "feature_id long, w double, s double, e double, n double, tags map<string,string>")
    rows = {r.tile_id: r for r in mf.tile_summary(f, fx.map_tiles(spark), 0.125).collect()}
    assert len(rows) == 64 and rows[0].features == rows[0].building == 1
    assert all(r.features == 0 and r.sentence.endswith("no matching mapped features") for i, r in rows.items() if i)


def test_natural_order_has_all_keys(spark, duck):
    keys = [k for (k,) in duck.execute(fx.sql("SELECT key FROM date_records", "date_records")).fetchall()]
    rank = lambda k: (["train", "val", "test"].index(k.split("_")[0]), int(k.split("_")[1]), k)
    got = [r.key for r in QUERIES["b3_natural_order"](spark, DIR).collect()]
    assert {k.split("_")[0] for k in got} == {"train", "val", "test"} and got == sorted(keys, key=rank)


def test_manifest_scan_has_all_splits(spark, duck):
    want = duck.execute(fx.sql("SELECT key, key, split, status, round(valid_fraction, 6) FROM date_records", "date_records")).fetchall()
    got = QUERIES["a7_manifest_scan"](spark, DIR).select("key", "source_pair_id", "split", "status", "valid_fraction").collect()
    assert {r.split for r in got} == {"train", "val", "test"} and sorted(map(tuple, got)) == sorted(want)


ODD = ["", " ", "?!", "-", "\t", "_", "Élan vital, déjà-vu", "東京 は、夜。", "Привет  мир!", "a  b", "naïve/<person>.", "Straße № ½ ² x_1", "שלום", "👍🏽 ok", "été", "\n\n", "x\n", "ΟΔΟΣ", None]


#: Marks that a caption loses (fixed value).
LOST = set(",.'!?\"()*#:;~")


def cleaned(t):
    """A caption cleaned character by character and cut to 30 words."""
    kept = "".join(" " if c in "-/" else c for c in t.lower() if c not in LOST)
    text, gap = "", ""
    for c in kept.replace("<person>", "person"):
        if c.isspace():
            gap += c
        else:
            text += (" " if len(gap) > 1 else gap) + c
            gap = ""
    words = (text + (" " if len(gap) > 1 else gap)).rstrip("\n").strip(" ").split(" ")
    return " ".join(words[:30])


def filled(t):
    return any(c not in LOST and c != " " for c in t)


def encoded(t, length=24):
    """Hashed tokens, one word after the other."""
    one = lambda w: 103 + int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % (30522 - 103)
    ids = [101, *map(one, re.findall(r"[A-Za-z0-9_]+|[^\w\s]", t.lower())[: length - 2])]
    ids += [102] * (len(ids) < length)
    return ids + [0] * (length - len(ids))


def texts_of(duck):
    docs = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    return {(i, p): c for i, t in docs for p, c in enumerate(t.split("\n"))}


def test_caption_operators_on_many_scripts(spark):
    d = spark.createDataFrame(list(enumerate(ODD)), "id long, t string").cache()
    said = [t for t in ODD if t is not None]
    got = d.where("t IS NOT NULL").orderBy("id").select(cp.clean_caption(F.col("t")).alias("c"), cp.not_blank(F.col("t")).alias("b")).collect()
    assert [r.c for r in got] == [cleaned(t) for t in said] and [r.b for r in got] == [filled(t) for t in said]
    tokens = defaultdict(list)
    for r in cp.token_rows(d, "id", "t", 24).orderBy("id", "pos").collect():
        tokens[r.id].append(r.token)
    assert tokens == {i: encoded(t or "") for i, t in enumerate(ODD)}


def test_caption_queries_take_whole_captions(spark, duck):
    texts = texts_of(duck)
    got = {(r.image_id, r.pos): r.clean for r in QUERIES["c1_clean_caption"](spark, DIR).collect()}
    assert got == {k: hashlib.sha256(cleaned(t).encode()).hexdigest() for k, t in texts.items()}
    split = lambda i: "train" if i % 10 < 6 else "val" if i % 10 < 8 else "test"
    assert dict(map(tuple, QUERIES["c2_blank_filter"](spark, DIR).collect())) == Counter(split(i) for (i, _), t in texts.items() if filled(t))
    tokens = defaultdict(dict)
    for r in QUERIES["c15_hashed_tokens"](spark, DIR).collect():
        tokens[r.image_id, r.caption_pos][r.pos] = r.token
    assert {k: [v[i] for i in range(24)] for k, v in tokens.items()} == {k: encoded(t) for k, t in texts.items()}
