"""Top-k, recall and rerank against their SQL on tables with copies, zero vectors and nulls, by both ways of search."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterloom.operators import retrieval as rt
from rasterloom.plans.queries import ORACLES, QUERIES
from tests.test_oracles import DIR, rows


def changed(kind):
    t = pq.read_table(f"{DIR}/embeddings.parquet")
    v = t.to_pylist()
    two = v[5]["embedding"], v[8]["embedding"]
    for r in v:
        i = r["vec_id"]
        if kind == "copies":  # of a vector at many places in many blocks
            r["embedding"] = two[0] if i % 7 == 0 else two[1] if i % 11 == 0 else r["embedding"]
        elif i in (4, 7, 100):
            r["embedding"] = None if kind == "null" else [0.0] * 64
    if kind == "few":  # fewer plain vectors than k on each side
        v = [r | {"embedding": None if r["vec_id"] in (0, 1, 3, 10, 11) else r["embedding"]} for r in v[:24]]
    return pa.Table.from_pylist(v, schema=t.schema)


@pytest.mark.parametrize("kind", ["copies", "zero", "null", "few"])
@pytest.mark.parametrize("prune_from", [1, 1 << 20])
def test_search_is_that_of_its_sql(spark, monkeypatch, tmp_path, kind, prune_from):
    """F2: copies did not tie, as their scores differed in the last bits; a null or zero vector ended the query."""
    pq.write_table(changed(kind), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    monkeypatch.setattr(rt, "PRUNE_FROM", prune_from)
    for name in ("j3_top_k", "j4_recall_own", "j7_rerank"):
        df = QUERIES[name](spark, str(tmp_path))
        want = duck.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())
