"""Registered queries that do the whole of their operator."""

from pipewatch.catalog import all_queries
from pipewatch.operators import models as mm


def test_boosted_trees_have_all_rounds(spark, sf, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    class Recorder:
        def __init__(self, **settings):
            seen.append(settings["maxIter"])
            raise Stop

    monkeypatch.setattr(mm, "GBTClassifier", Recorder)
    try:
        all_queries()["j5_boosted_trees"](spark, sf)
    except Stop:
        pass
    assert seen == [300]


def test_evidence_is_retrieved_for_every_decision(spark, sf):
    rows = all_queries()["c7_incident_evidence"](spark, sf).collect()
    plain = all_queries()["c7_decision_evidence"](spark, sf).collect()
    assert sorted((r.incident_id, r.risk_tier) for r in rows) == sorted((r.incident_id, r.risk_tier) for r in plain)
    assert all(r.sources and r.citations and r.rationale for r in rows)
    assert any(r.n_docs for r in rows) and all(r.context.startswith("- [") for r in rows if r.n_docs)


def test_an_incident_without_a_name_has_no_evidence(spark, tmp_path):
    """A null key joins nothing; every other incident has its evidence once."""
    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    rows = [(key, 3, 4, n, 10.0, 100.0, 0.02, 0.02, None) for key in (None, 1, 2) for n in (1, 2)]
    spark.createDataFrame(rows, lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    texts = [(1, "en", "s1", "Leak and valve"), (2, "en", "s2", "nothing"), (2, "de", "s3", "response")]
    spark.createDataFrame(texts, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.incident_id: r for r in all_queries()["c7_incident_evidence"](spark, str(tmp_path)).collect()}
    assert set(got) == {None, "N1", "N2"}
    assert got[None].risk_tier and not any(got[None][2:])
    for name in ("N1", "N2"):
        assert got[name].fallback and got[name].n_docs == 3
        assert got[name].context.split("\n") == ["- [s1] en-1: Leak and valve", "- [s2] en-2: nothing", "- [s3] de-2: response"]
