"""The pipeline's deduplication stages on tables whose doc_ids are missing or repeat."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def told(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_exact_decides_rows(spark):
    rows = [(5, "a", "x"), (5, "b", "x"), (9, "a", "x"), (None, "a", "x"), (None, "c", "x"), (None, "c", "w"), (7, "d", "y"), (7, "d", "x"), (7, "d", "z"), (8, "e", "x"), (None, None, "x"), (2, "", "x")]
    docs = made(spark, rows)
    out = cp.exact(spark, docs, "")
    want = [(5, "b", "x"), (9, "a", "x"), (None, "c", "w"), (7, "d", "x"), (8, "e", "x"), (2, "", "x")]
    assert out.columns == docs.columns and told(out) == sorted(want, key=str)


def test_near_decides_rows(spark):
    text = lambda p, n=60: " ".join(f"{p}{i}" for i in range(n))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(3, a, "x"), (5, a + " more", "x"), (5, b, "x"), (None, b + " more", "x"), (None, c, "x"), (None, text("d"), "x"), (6, c + " more", "x"), (None, "", "x")]
    docs = made(spark, rows)
    out = cp.near(spark, docs, "")
    want = [(3, a, "x"), (5, b, "x"), (None, text("d"), "x"), (6, c + " more", "x"), (None, "", "x")]
    assert out.columns == docs.columns and told(out) == sorted(want, key=str)
    plain = docs.where("doc_id IN (3, 6)")
    assert told(cp.near(spark, plain, "")) == [(3, a, "x"), (6, c + " more", "x")]


NAMES = ["_h", "_k", "_s", "_kept", "_n", "_r", "_none", "row", "rest", "rest_", "n", "k", "h", "t", "block", "key", "sha", "copies", "stays", "digest", "whole", "none", "kept", "n_removed", "component_id", "doc id"]


def test_stages_keep_columns_of_any_name(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, text), (2, text + " more"), (3, text + " more"), (None, "b c d"), (None, "b c d"), (4, "b c"), (4, "b d"), (5, None)]
    docs = spark.createDataFrame([(i, t, *[f"{n}{j}" for n in NAMES]) for j, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3)
    given = {tuple(r) for r in docs.collect()}
    after = docs
    for stage, left in ((cp.exact, 6), (cp.near, 5), (cp.passages, 5)):
        after = stage(spark, after, "")
        out = {tuple(r) for r in after.collect()}
        assert after.columns == docs.columns and len(out) == left
        assert out <= given
    labels = "/root/testdata/sf0.001"
    assert cp.quality(spark, docs, labels).columns == docs.columns


def test_passages_count_the_characters_of_what_is_left(spark):
    text = " ".join(f"a{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 99), (2, f"x  {text} y", 99), (3, "é  f", 99)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: (r.text, r.n_chars) for r in cp.passages(spark, docs, "").collect()}
    assert out == {1: (text, 99), 2: ("x y", 3), 3: ("é  f", 99)}
