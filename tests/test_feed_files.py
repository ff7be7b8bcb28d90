"""Pages as files: one each, written by as many tasks as they need."""

from pathlib import Path

from pyspark.sql import functions as F

from bidlake.sources import feed


def test_pages_are_written_by_many_tasks(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page"), F.concat(F.lit("[1,\n"), "id", F.lit("]")).alias("body"))
    feed.write_feed_pages(pages, str(tmp_path / "pages"), per_task=10)
    files = [f.name for f in Path(tmp_path / "pages").glob("page=*/part-*.txt")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 1
    got = feed.read_feed_pages(spark, str(tmp_path / "pages")).withColumn("page", F.regexp_extract("page", r"page=(\d+)", 1).cast("long"))
    assert sorted((r.page, r.body.rstrip("\n")) for r in got.collect()) == [(i, f"[1,\n{i}]") for i in range(40)]
