"""The stages one after the other, each against what it must keep of its own input."""

from collections import Counter

import corpus_pipeline as cp
from rasterloom.llm.common import stored, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, DIR), "stage")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(after) == len(rows) and set(after) <= set(before)
        if name != "substring dedup":
            assert all(after[i] == before[i] for i in after)
        if name == "exact dedup":
            assert set(after) == set({r.text: i for i, r in sorted(before.items())}.values())
        if name == "substring dedup":
            assert all(len(after[i].text) == after[i].n_chars for i in after)
            assert all(i in after for i in before if before[i].text == "" or i == min(before))
    out = cp.STAGES[-1][1](spark, docs, DIR).collect()
    size = Counter()
    for r in out:
        size[r.sequence_id] += r.length
    assert set(r.doc_id for r in out) == set(after) and max(size.values()) <= 1024
