"""Tables in and out."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all
    executors are in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="bidlake-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: a short lineage that survives lost
    executors."""
    path = f"{work_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task sorts or gathers at most; more rows are dealt to more tasks.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of a table that is read or ``written``, dealt by keys to as many tasks as they need,
    so that the memory of a task doesn't grow with the table; small ones stay as they are."""
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def read_table(spark: SparkSession, where: str, schema: StructType | str | None = None, **jdbc) -> DataFrame:
    """Parquet under a path, or, with ``dbtable`` among the options, a JDBC table read in
    parallel by partitionColumn, lowerBound, upperBound and numPartitions."""
    if "dbtable" in jdbc:
        return spark.read.format("jdbc").option("url", where).options(**jdbc).load()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(where)


def merge_by_key(existing: DataFrame, updates: DataFrame, keys: list[str], reset: dict[str, object] | None = None) -> DataFrame:
    """Insert or replace by key: the rows of ``updates`` where they have the key, else the
    existing ones. ``reset`` columns take their value in a replaced row. Of several
    updates of one key the last by (fetched_at, all columns) counts, if that column
    is there."""
    reset = reset or {}
    columns = existing.columns
    order = sorted(updates.columns, key=lambda c: (c != "fetched_at", c))
    last = updates.groupBy(*keys).agg(F.max(F.struct(*order)).alias("u")).select(*[F.col(f"u.{c}").alias(f"__u_{c}") for c in updates.columns], F.lit(True).alias("__new"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__u_{k}")) for k in keys])
    both = existing.withColumn("__old", F.lit(True)).join(last, on, "full_outer")
    out = []
    for c in columns:
        new = F.col(f"__u_{c}") if c in updates.columns else F.col(c)
        if c in reset:
            new = F.when(F.col("__old"), F.lit(reset[c]).cast(existing.schema[c].dataType)).otherwise(new)
        out.append(F.when(F.col("__new"), new).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def write_published(tables: dict[str, DataFrame], folder: str, run: str) -> str:
    """All tables of one run under its own folder, then a marker that names them: a
    reader takes only runs that have the marker, so a run is there whole or not."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run, n) for n in sorted(tables)], "run string, name string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{folder}/_runs")
    return f"{folder}/{run}"


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last run that was written whole: the last to be marked."""
    runs = spark.read.schema("run string, name string, at timestamp").json(f"{folder}/_runs").where(F.col("name") == name)
    run = runs.agg(F.max_by("run", F.struct("at", "run"))).first()[0]
    return spark.read.parquet(f"{folder}/{run}/{name}")
