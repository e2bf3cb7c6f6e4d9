"""The pipeline's stages against the operators' rules, and the entry points."""

import __spark_entry__ as entry
import corpus_pipeline
from kinweave.llm.op5_quality import quality
from kinweave.llm.store import keep, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_the_rules_keep(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    leak = [r.text for r in table(spark, SF, "benchmark").collect()]
    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert all(rows[d] == t for d, t in now.items()) and set(now) <= kept
        if name == "quality_classifier":
            assert set(now) == {r.doc_id for r in quality(before, table(spark, SF, "labels")).collect() if r.predicted}
        if name == "exact_dedup":
            last = {rows[d].lower() if rows[d].isascii() else rows[d]: d for d in sorted(kept)}
            assert len(now) <= len(last) and all(max(d for d in kept if rows[d] == t) == k for k, t in now.items())
        if name == "decontamination":
            assert set(now) == {d for d in kept if not any(x in rows[d] for x in leak)}
        kept = set(now)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in placed} == kept
    total = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in total.collect()} == kept


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
