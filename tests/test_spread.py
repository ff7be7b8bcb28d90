"""A table's rows are dealt to as many tasks as they need."""

from bidlake.plans import base
from bidlake.sources.tables import spread


def test_tasks_grow_with_the_rows(spark):
    assert spread(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10
    few = spark.range(1000)
    assert spread(few, "id", rows=500).rdd.getNumPartitions() == few.rdd.getNumPartitions()


def test_lines_are_dealt_by_document(spark, sf_dir, monkeypatch):
    plain = {(r.doc_id, r.position, r.part) for r in base.Tables(spark, sf_dir).lines().collect()}
    monkeypatch.setattr(base, "spread", lambda df, *keys: spread(df, *keys, rows=500))
    lines = base.Tables(spark, sf_dir).lines()
    assert lines.rdd.getNumPartitions() == -(-lines.count() // 500) > 4
    assert {(r.doc_id, r.position, r.part) for r in lines.collect()} == plain
