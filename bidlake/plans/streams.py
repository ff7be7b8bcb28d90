"""Streams over the given tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import work_root
from ..streaming import jobs
from .base import Tables, query


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream gives for the input there is."""
    spark = stream.sparkSession
    at = f"{work_root(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _events(t: Tables) -> DataFrame:
    static = t.raw("events")
    return t.spark.readStream.schema(static.schema).parquet(f"{t.dir}/events.parque[t]")


@query("stream_lifecycle", """WITH ev AS (SELECT event_id AS id, user_id AS entity_id, ['DRAFT', 'SENT', 'APPROVED', 'CANCELLED', 'REJECTED'][CAST(event_id % 5 + 1 AS INT)] AS status, ts FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY ts, id) AS previous FROM ev)
SELECT id, entity_id, status, previous, previous IS NULL OR previous = status OR (previous = 'DRAFT' AND status IN ('SENT', 'EXPIRED', 'CANCELLED')) OR (previous = 'SENT' AND status IN ('APPROVED', 'REJECTED', 'EXPIRED', 'CANCELLED')) OR (previous = 'APPROVED' AND status = 'CANCELLED') AS allowed FROM l""")
def stream_lifecycle(spark, sf):
    names = F.array(*map(F.lit, ["DRAFT", "SENT", "APPROVED", "CANCELLED", "REJECTED"]))
    e = _events(Tables(spark, sf)).select(F.col("event_id").alias("id"), F.lit("quotation").alias("kind"), F.col("user_id").alias("entity_id"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("status"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(jobs.audit_lifecycle(e)).select("id", "entity_id", "status", "previous", "allowed")


@query("stream_daily_usage", "SELECT user_id % 10 AS source_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(CAST(trunc(value) AS INT)) AS requested FROM events GROUP BY ALL")
def stream_daily_usage(spark, sf):
    r = _events(Tables(spark, sf)).select((F.col("user_id") % 10).alias("source_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("value").cast("int").alias("requested"))
    return _drained(jobs.daily_usage(r), "complete").select("source_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "requested")


def _record_sql(batches: int) -> str:
    """The table after each batch, one after the other."""
    fields = "source_id, external_id, payload_hash, status, fetched_at, version"
    steps = ["st0 AS (SELECT NULL::BIGINT AS source_id, NULL::BIGINT AS external_id, NULL::VARCHAR AS payload_hash, NULL::VARCHAR AS status, NULL::TIMESTAMP AS fetched_at, 0::BIGINT AS version WHERE false)"]
    for b in range(batches):
        steps.append(f"""v{b} AS (SELECT n.*, s.version AS v, s.status AS st, CASE WHEN s.fetched_at > n.fetched_at THEN 'LATE' WHEN s.payload_hash = n.payload_hash THEN 'DUPLICATE' WHEN n.error IS NOT NULL THEN 'REJECTED' ELSE 'STAGED' END AS verdict FROM n LEFT JOIN st{b} s USING (source_id, external_id) WHERE b = {b}),
st{b + 1} AS (SELECT source_id, external_id, payload_hash, CASE verdict WHEN 'STAGED' THEN coalesce(resolved, 'NORMALIZED') ELSE verdict END AS status, fetched_at, coalesce(v, 0) + 1 AS version FROM v{b} WHERE verdict IN ('STAGED', 'REJECTED') UNION ALL SELECT {fields} FROM st{b} s WHERE NOT EXISTS (SELECT 1 FROM v{b} WHERE v{b}.source_id = s.source_id AND v{b}.external_id = s.external_id AND verdict IN ('STAGED', 'REJECTED')))""")
    return f"""WITH ev AS (SELECT event_id % {batches} AS b, user_id % 10 AS source_id, user_id AS external_id, ts AS fetched_at, event_type || (event_id % 2) AS payload_hash, CASE WHEN event_id % 11 = 0 THEN 'INVALID' END AS error, CASE WHEN event_id % 3 = 0 THEN 'MATCHED' END AS resolved FROM events),
n AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY b, source_id, external_id ORDER BY fetched_at DESC, payload_hash) AS r FROM ev) WHERE r = 1), {', '.join(steps)}
SELECT source_id, external_id, payload_hash, status, CAST(epoch_us(fetched_at) AS BIGINT) AS fetched_at, version FROM st{batches}"""


@query("stream_ingest", _record_sql(3))
def stream_ingest(spark, sf):
    """The feed in three arrivals, each taken in before the next comes."""
    k = F.col("event_id")
    feed = Tables(spark, sf).raw("events").select(
        k, (F.col("user_id") % 10).alias("source_id"), F.col("user_id").alias("external_id"), F.col("ts").cast("timestamp").alias("fetched_at"), F.concat("event_type", (k % 2).cast("string")).alias("payload_hash"),
        F.when(k % 11 == 0, "INVALID").alias("error"), F.when(k % 3 == 0, "MATCHED").alias("resolved"), F.lit(None).cast("string").alias("settled"),
    )
    at = f"{work_root(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    for b in range(3):
        feed.where(k % 3 == b).drop("event_id").write.mode("append").parquet(f"{at}/in")
        stream = jobs.ingest(spark.readStream.schema(feed.drop("event_id").schema).parquet(f"{at}/in"))
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    table = jobs.record_table(spark.read.schema(stream.schema).parquet(f"{at}/out"))
    return table.withColumn("fetched_at", F.unix_micros("fetched_at"))


@query("stream_claims", """WITH RECURSIVE ev AS (SELECT event_id AS id, user_id AS job_id, ['claim', 'claim', 'claim', 'done', 'fail', 'claim', 'fail'][CAST(event_id % 7 + 1 AS INT)] AS kind, ts AS t_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
st AS (SELECT DISTINCT job_id, 0::BIGINT AS n, 0 AS attempts, NULL::BIGINT AS claim, NULL::TIMESTAMP AS held, false AS finished, NULL::BIGINT AS id, NULL::VARCHAR AS verdict, NULL::TIMESTAMP AS t_at, NULL::BIGINT AS expired, NULL::TIMESTAMP AS expired_at, 0 AS expired_attempts FROM ev
 UNION ALL SELECT job_id, n, CASE WHEN verdict = 'GRANTED' THEN attempts + 1 ELSE attempts END, CASE WHEN verdict = 'GRANTED' THEN id WHEN verdict IN ('DONE', 'FAILED') THEN NULL ELSE claim END, CASE WHEN verdict = 'GRANTED' THEN t_at WHEN verdict IN ('DONE', 'FAILED') THEN NULL ELSE held END, finished OR verdict = 'DONE', id, verdict, t_at, expired, expired_at, attempts
 FROM (SELECT *, CASE WHEN kind = 'claim' THEN CASE WHEN finished THEN 'FINISHED' WHEN held IS NOT NULL THEN 'HELD' WHEN attempts >= 3 THEN 'EXHAUSTED' ELSE 'GRANTED' END WHEN held IS NULL THEN 'STALE' WHEN kind = 'done' THEN 'DONE' ELSE 'FAILED' END AS verdict
  FROM (SELECT st.job_id, ev.n, st.attempts, st.finished, ev.id, ev.t_at, ev.kind, CASE WHEN ev.t_at > st.held + INTERVAL 15 MINUTE THEN st.claim END AS expired, CASE WHEN ev.t_at > st.held + INTERVAL 15 MINUTE THEN st.held + INTERVAL 15 MINUTE END AS expired_at, CASE WHEN ev.t_at <= st.held + INTERVAL 15 MINUTE THEN st.claim END AS claim, CASE WHEN ev.t_at <= st.held + INTERVAL 15 MINUTE THEN st.held END AS held FROM st JOIN ev ON ev.job_id = st.job_id AND ev.n = st.n + 1))),
lasts AS (SELECT job_id, max(n) AS n FROM st GROUP BY job_id)
SELECT job_id, id, verdict, CAST(epoch_us(t_at) AS BIGINT) AS "at", CAST(attempts AS INT) AS attempts FROM st WHERE n > 0
UNION ALL SELECT job_id, expired, 'EXPIRED', CAST(epoch_us(expired_at) AS BIGINT), CAST(expired_attempts AS INT) FROM st WHERE expired IS NOT NULL
UNION ALL SELECT job_id, claim, 'EXPIRED', CAST(epoch_us(held + INTERVAL 15 MINUTE) AS BIGINT), CAST(attempts AS INT) FROM st JOIN lasts USING (job_id, n) WHERE held + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""")
def stream_claims(spark, sf):
    kinds = F.array(*map(F.lit, ["claim", "claim", "claim", "done", "fail", "claim", "fail"]))
    e = _events(Tables(spark, sf)).select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(jobs.claims(e)).withColumn("at", F.unix_micros("at"))


@query("stream_repeats", "SELECT DISTINCT user_id % 10 AS source_id, event_id AS external_id, event_type AS payload_hash, CAST(epoch_us(ts) AS BIGINT) AS fetched_at FROM events")
def stream_repeats(spark, sf):
    """Each event once to three times, in any order; none is later than the watermark allows."""
    e = _events(Tables(spark, sf)).select((F.col("user_id") % 10).alias("source_id"), F.col("event_id").alias("external_id"), F.col("event_type").alias("payload_hash"), F.col("ts").cast("timestamp").alias("fetched_at"), F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)).alias("copy"))
    return _drained(jobs.drop_repeats(e.drop("copy"))).withColumn("fetched_at", F.unix_micros("fetched_at"))
