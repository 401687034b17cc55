def test_stages(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"] and c.ORACLE_SQL is None
    out = c.run(spark, small)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    # the first stage agrees with the operator's verdicts
    from tidewarden.llm import quality

    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    first = c.STAGES[0][1](spark, docs, small)
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns and ids <= kept


def test_entry_has_all():
    import re

    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1 for n in range(1, 11)) and "pipeline" in names
