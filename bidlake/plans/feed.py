"""Feeds: pages, records, verdicts, counters and quotas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import feed as S
from ..sources.tables import merge_by_key, read_published, work_root, write_published
from .base import Tables, query

_K = "p_partkey"


def _payload():
    """Feed payloads of parts; every sixth is wrong in some way."""
    k = F.col(_K)
    maker = F.when(k % 7 > 0, F.concat(F.lit('"manufacturerName":" '), "p_brand", F.lit('",'))).otherwise("")
    name = F.when(k % 6 == 1, '"name":"   "').otherwise(F.concat(F.lit('"name":"  '), "p_name", F.lit('   x ","nameEn":"n"')))
    ids = F.concat(F.lit('"identifiers":[{"identifierType":"gtin_13","value":" '), F.lpad(k.cast("string"), 13, "0"), F.lit(' "},{"identifierType":"GTIN_13","value":"'), F.lpad(k.cast("string"), 13, "0"), F.lit('"},{"identifierType":"mpn","value":" a  b "}]'))
    attrs = F.when(k % 6 == 2, '"attributes":[{"code":"w","dataType":"NUMBER","value":"x"}]').otherwise(F.concat(F.lit('"attributes":[{"code":" w ","dataType":"number","unit":" KGs ","value":'), "p_size", F.lit("},{\"code\":\"W\",\"value\":\"again\"}]")))
    alias = F.when(k % 6 == 3, '"aliases":[{"alias":"a","locale":"xx"}]').otherwise('"aliases":[{"alias":" Al  one ","locale":"english"},{"alias":"al one","locale":"EN"},{"alias":" "}]')
    return F.concat(F.lit("{"), maker, name, F.lit(","), ids, F.lit(","), attrs, F.lit(","), alias, F.lit("}"))


@query("normalize_payloads", """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 1 THEN 'NAME_REQUIRED' WHEN p_partkey % 7 = 0 THEN 'IDENTIFIER_MANUFACTURER_REQUIRED' WHEN p_partkey % 6 = 3 THEN 'ALIAS_LOCALE_UNSUPPORTED' WHEN p_partkey % 6 = 2 THEN 'ATTRIBUTE_VALUE_INVALID' END AS error,
CASE WHEN error IS NULL THEN p_name || ' x' END AS name, CASE WHEN error IS NULL THEN 'GTIN_13=' || lpad(CAST(p_partkey AS VARCHAR), 13, '0') || ',MPN=A B' END AS ids, CASE WHEN error IS NULL THEN 'Al one/EN/SYNONYM' END AS aliases, CASE WHEN error IS NULL THEN 'W/NUMBER/' || p_size || '/kg' END AS attributes FROM part""")
def normalize_payloads(spark, sf):
    p = Tables(spark, sf).raw("part").select(F.col(_K).alias("id"), F.lit("s").alias("source_id"), _payload().alias("payload"))
    n = S.normalize_payload(p)
    join = lambda f, g: F.array_join(F.transform(f, g), ",")
    return n.select("id", "error", "data.name", join("data.identifiers", lambda x: F.concat_ws("=", x["type"], x["value"])).alias("ids"), join("data.aliases", lambda x: F.concat_ws("/", x["alias"], x["locale"], x["type"])).alias("aliases"), join("data.attributes", lambda x: F.concat_ws("/", x["code"], x["dataType"], x["value"], x["unit"])).alias("attributes"))


@query("payload_hashes", """SELECT p_partkey AS id, sha256('{"a":1,"b":{"c":"' || p_name || '","d":' || p_size || '}}') AS hash FROM part""")
def payload_hashes(spark, sf):
    p = Tables(spark, sf).raw("part")
    raw = F.when(F.col(_K) % 2 == 0, F.concat(F.lit('{ "b": {"d": '), "p_size", F.lit(', "c": "'), "p_name", F.lit('"}, "a": 1.0 }'))).otherwise(F.concat(F.lit('{"a":1,"b":{"c":"'), "p_name", F.lit('","d":'), "p_size", F.lit("}}")))
    return p.select(F.col(_K).alias("id"), S.payload_hash(raw).alias("hash"))


_FEED = """WITH p AS (SELECT s_suppkey AS page, s_suppkey % 4 AS kind FROM supplier), r AS (SELECT page, kind, i AS position FROM p, (SELECT unnest([0, 1, 2]) AS i) WHERE kind < 3)
SELECT page, position, CASE WHEN position < 2 THEN 'r' || page || '-' || position END AS external_id, CASE WHEN position = 2 THEN CASE WHEN kind = 0 THEN 'IDENTITY_INVALID' WHEN kind = 1 THEN 'NAME_INVALID' ELSE 'RECORD_INVALID' END END AS error, CASE WHEN kind = 1 THEN 'c' || page END AS next_cursor FROM r
UNION ALL SELECT page, NULL, NULL, 'RECORDS_ARRAY_MISSING', NULL FROM p WHERE kind = 3"""


def _pages(t: Tables):
    k = F.col("s_suppkey")
    row = lambda i: F.concat(F.lit('{"id":" r'), k, F.lit(f'-{i} ","name":"n","junk":1}}'))
    last = F.when(k % 4 == 0, '{"name":"n"}').when(k % 4 == 1, '{"externalId":"e","name":5}').otherwise("7")
    rows = F.concat(F.lit("["), row(0), F.lit(","), row(1), F.lit(","), last, F.lit("]"))
    body = F.when(k % 4 == 3, '{"items":[]}').when(k % 4 == 1, F.concat(F.lit('{"records":'), rows, F.lit(',"nextCursor":"c'), k, F.lit('"}'))).otherwise(rows)
    return t.raw("supplier").select(k.alias("page"), body.alias("body"))


def _envelopes(pages):
    good, bad = S.split_pages(pages)
    return S.to_envelopes(good).select("page", "position", "external_id", "error", "next_cursor").unionByName(bad, allowMissingColumns=True)


@query("feed_records", _FEED)
def feed_records(spark, sf):
    return _envelopes(_pages(Tables(spark, sf)))


@query("feed_files", _FEED)
def feed_files(spark, sf):
    """The pages as files of a folder, one each, read by the file adapter."""
    folder = f"{work_root(spark)}/pages-{uuid.uuid4().hex}"
    S.write_feed_pages(_pages(Tables(spark, sf)), folder)
    read = S.read_feed_pages(spark, folder)
    return _envelopes(read.withColumn("page", F.regexp_extract("page", r"page=(\d+)", 1).cast("long")))


@query("published_tables", "SELECT c_custkey AS id, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def published_tables(spark, sf):
    """Two tables of two runs; a reader has those of the run that was marked last."""
    t, folder = Tables(spark, sf), f"{work_root(spark)}/published-{uuid.uuid4().hex}"
    customers = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    nations = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    write_published({"customers": customers.withColumn("name", F.lit("an earlier run")), "nations": nations}, folder, "a")
    write_published({"customers": customers, "nations": nations}, folder, "b")
    return read_published(spark, folder, "customers").join(read_published(spark, folder, "nations"), "c_nationkey").select("id", "name", "nation")


@query("page_bounds", """SELECT l_suppkey AS page, CASE WHEN count(*) > 600 THEN 'TOO_MANY_RECORDS' WHEN bool_or(l_orderkey % 300 = 0) THEN 'ORIGIN_MISMATCH' WHEN bool_or(l_partkey % 400 = 0) THEN 'NAME_INVALID' END AS error FROM lineitem GROUP BY 1""")
def page_bounds(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    e = li.select(F.col("l_suppkey").alias("page"), F.lit(1).alias("source_id"), F.when(F.col("l_orderkey") % 300 == 0, "https://other.example/a").otherwise("HTTPS://Feed.example:443/a?b").alias("url"), F.when(F.col("l_partkey") % 400 == 0, "NAME_INVALID").alias("error"))
    return S.check_page_bounds(e, spark.createDataFrame([(1, "https://feed.example/list", 600)], "source_id int, url string, max_records_per_run int"))


@query("policy_verdicts", """SELECT s_suppkey AS id, CASE s_suppkey % 9 WHEN 0 THEN 'SOURCE_INACTIVE' WHEN 1 THEN 'SOURCE_NOT_APPROVED' WHEN 2 THEN 'SOURCE_HEALTH_BLOCKED' WHEN 3 THEN 'COMMERCIAL_USE_NOT_ALLOWED' WHEN 4 THEN 'REDISTRIBUTION_NOT_ALLOWED' WHEN 5 THEN 'SOURCE_URL_MISSING' WHEN 6 THEN 'LICENSE_EVIDENCE_MISSING' WHEN 7 THEN 'SOURCE_POLICY_BLOCKED' END AS verdict FROM supplier""")
def policy_verdicts(spark, sf):
    m = F.col("s_suppkey") % 9
    s = Tables(spark, sf).raw("supplier").select(
        F.col("s_suppkey").alias("id"), (m > 0).alias("is_active"), F.when(m == 1, "DRAFT").otherwise("APPROVED").alias("approval_state"), F.when(m == 2, "BLOCKED").otherwise("HEALTHY").alias("health_status"), F.when(m == 3, "UNKNOWN").otherwise("ALLOWED").alias("commercial_use_state"),
        F.when(m == 4, "DISALLOWED").otherwise("ALLOWED").alias("redistribution_state"), F.when(m != 5, "u").alias("url"), F.when(m == 6, " ").otherwise("CC").alias("license_info"), F.lit("u").alias("license_reference_url"), F.when(m.isin(6, 7), "DISALLOWED").otherwise("ALLOWED").alias("robots_policy"),
    )
    return s.select("id", S.policy_verdict().alias("verdict"))


_IN = """i AS (SELECT user_id AS source_id, 'e' || (event_id % 40) AS ext, ts, sha256(event_type) AS h, CASE WHEN event_id % 11 = 0 THEN 'NAME_REQUIRED' END AS error FROM events),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, ext ORDER BY ts DESC, h) AS r FROM i WHERE ts >= TIMESTAMP '2024-01-16') WHERE r = 1), o AS (SELECT *, ['PUBLISHED', 'FAILED', 'NORMALIZED', 'REJECTED'][CAST(source_id % 4 + 1 AS INT)] AS st FROM (SELECT *, row_number() OVER (PARTITION BY source_id, ext ORDER BY ts DESC, h) AS r FROM i WHERE ts < TIMESTAMP '2024-01-16') WHERE r = 1),
v AS (SELECT n.source_id, n.ext, CASE WHEN o.h = n.h AND st <> 'FAILED' THEN 'DUPLICATE' WHEN st = 'PUBLISHED' AND n.error IS NOT NULL THEN 'UNCHANGED' WHEN st = 'PUBLISHED' THEN 'NEEDS_REVIEW' WHEN n.error IS NOT NULL THEN 'REJECTED' ELSE 'STAGED' END AS verdict, st, n.h, o.h IS NULL AS is_new FROM n LEFT JOIN o ON n.source_id = o.source_id AND n.ext = o.ext)"""


def _ingest(t):
    e = t.raw("events").select(F.col("user_id").alias("source_id"), F.concat(F.lit("e"), F.col("event_id") % 40).alias("external_id"), F.col("ts").alias("fetched_at"), F.sha2("event_type", 256).alias("payload_hash"), F.when(F.col("event_id") % 11 == 0, "NAME_REQUIRED").alias("error"))
    cut = F.to_timestamp(F.lit("2024-01-16"))
    stored = S.newest_per_key(e.where(F.col("fetched_at") < cut)).withColumn("status", F.element_at(F.array(*map(F.lit, ["PUBLISHED", "FAILED", "NORMALIZED", "REJECTED"])), (F.col("source_id") % 4 + 1).cast("int"))).drop("error")
    return e.where(F.col("fetched_at") >= cut).withColumn("resolved", F.lit("NORMALIZED")), stored


@query("dedupe_payloads", f"WITH {_IN} SELECT source_id, ext AS external_id, verdict, CASE WHEN verdict IN ('DUPLICATE', 'UNCHANGED') THEN st WHEN verdict = 'STAGED' THEN 'NORMALIZED' ELSE verdict END AS status, is_new FROM v")
def dedupe_payloads(spark, sf):
    return S.ingest_verdicts(*_ingest(Tables(spark, sf))).select("source_id", "external_id", "verdict", "status", "is_new")


@query("ingestion_preview", f"WITH {_IN} SELECT n.source_id, n.ext AS external_id, CASE WHEN o.h IS NULL THEN 'NEW' WHEN o.h = n.h THEN 'DUPLICATE' ELSE 'CHANGED' END AS preview FROM n LEFT JOIN o ON n.source_id = o.source_id AND n.ext = o.ext")
def ingestion_preview(spark, sf):
    incoming, stored = _ingest(Tables(spark, sf))
    return S.preview(S.newest_per_key(incoming), stored).select("source_id", "external_id", "preview")


@query("merge_ingestion", f"WITH {_IN}, c AS (SELECT source_id, ext, h, CASE WHEN verdict = 'STAGED' THEN 'NORMALIZED' ELSE verdict END AS st FROM v WHERE verdict IN ('STAGED', 'REJECTED', 'NEEDS_REVIEW')) SELECT source_id, ext AS external_id, h AS payload_hash, st AS status FROM c UNION ALL SELECT source_id, ext, h, st FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source_id = o.source_id AND c.ext = o.ext)")
def merge_ingestion(spark, sf):
    incoming, stored = _ingest(Tables(spark, sf))
    return S.merge_ingestion(stored, S.ingest_verdicts(incoming, stored)).select("source_id", "external_id", "payload_hash", "status")


@query("merge_by_key", "SELECT coalesce(c_custkey, s_suppkey * 2) AS k, coalesce(s_name, c_name) AS name, CASE WHEN s_name IS NULL THEN c_nationkey ELSE CASE WHEN c_name IS NOT NULL THEN 0 ELSE s_nationkey END END AS n FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2")
def merge_tables(spark, sf):
    t = Tables(spark, sf)
    old = t.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
    return merge_by_key(old, t.raw("supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n")), ["k"], {"n": 0})


@query("ingestion_summary", "SELECT user_id AS batch_id, count(*) AS processed, count(*) FILTER (WHERE event_type = 'click') AS published, count(*) FILTER (WHERE event_type = 'view') AS needs_review, count(*) FILTER (WHERE event_type = 'error') AS rejected, count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'error')) AS failed FROM events GROUP BY 1")
def ingestion_summary(spark, sf):
    s = F.when(F.col("event_type") == "click", "PUBLISHED").when(F.col("event_type") == "view", "NEEDS_REVIEW").when(F.col("event_type") == "error", "REJECTED").otherwise("FAILED")
    return S.ingestion_summary(Tables(spark, sf).raw("events").select(F.col("user_id").alias("batch_id"), s.alias("status")))


@query("run_counters", """SELECT user_id AS run_id, count(*) AS fetched, count(*) FILTER (WHERE event_type <> 'error') AS accepted, count(*) FILTER (WHERE event_id % 3 = 0) AS duplicate, count(*) FILTER (WHERE event_id % 3 = 1) AS changed, CASE WHEN user_id % 2 = 0 THEN 0 ELSE count(*) FILTER (WHERE event_type = 'click') END AS staged,
count(*) FILTER (WHERE event_type = 'view') AS review, count(*) FILTER (WHERE event_type = 'error') AS rejected, CASE WHEN user_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, true AS consistent FROM events GROUP BY user_id""")
def run_counters(spark, sf):
    e = Tables(spark, sf).raw("events")
    k = F.col("event_id") % 3
    o = e.select(F.col("user_id").alias("run_id"), F.when(k == 0, "DUPLICATE").when(k == 1, "CHANGED").otherwise("NEW").alias("preview"), F.when(F.col("event_type") == "error", "REJECTED").when(F.col("event_type") == "click", "STAGED").when(F.col("event_type") == "view", "NEEDS_REVIEW").otherwise("OTHER").alias("verdict"))
    runs = e.select(F.col("user_id").alias("run_id")).distinct().select("run_id", (F.col("run_id") % 2 == 0).alias("dry_run"), (F.col("run_id") % 5 == 0).alias("failed"))
    return S.run_counters(o, runs)


def _runs(t):
    return t.raw("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("source_id"), F.col("ts").alias("created_at"), F.col("value").cast("int").alias("requested"), (F.col("event_id") % 3 + 1).alias("reserved"), F.when(F.col("event_type") == "error", "BLOCKED").otherwise("COMPLETED").alias("status"), (F.col("event_id") % 2 == 0).alias("dry_run"))


@query("quota_verdicts", """WITH r AS (SELECT user_id % 10 AS source_id, ts, CAST(trunc(value) AS INT) AS requested, event_id % 3 + 1 AS reserved, event_type <> 'error' AS live, event_id % 2 = 0 AS dry FROM events),
u AS (SELECT source_id, coalesce(sum(requested) FILTER (WHERE live AND ts >= TIMESTAMP '2024-01-20'), 0) AS d, coalesce(sum(reserved) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 60 SECOND), 0) AS m FROM r GROUP BY 1), t AS (SELECT sum(requested) FILTER (WHERE live AND NOT dry) AS t FROM r)
SELECT c_custkey AS request_id, CASE WHEN d + c_custkey % 100 > 8000 + 500 * source_id THEN 'DAILY_QUOTA_EXCEEDED' WHEN c_custkey % 2 > 0 AND t + c_custkey % 100 > 1000 THEN 'GLOBAL_PILOT_LIMIT' WHEN m + 1 + 2 > 4 + source_id THEN 'RATE_LIMITED' ELSE 'OK' END AS verdict FROM customer JOIN u ON source_id = c_custkey % 10, t""")
def quota_verdicts(spark, sf):
    t, k = Tables(spark, sf), F.col("c_custkey")
    req = t.raw("customer").select(k.alias("request_id"), (k % 10).alias("source_id"), (k % 100).alias("requested"), (k % 2 == 0).alias("dry_run"))
    runs = _runs(t)
    sources = runs.select("source_id").distinct().select("source_id", (F.col("source_id") * 500 + 8000).alias("max_records_per_day"), (F.col("source_id") + 4).alias("max_requests_per_minute"), F.lit(2).alias("max_retries"))
    return S.quota_verdicts(req, runs, sources, F.to_timestamp(F.lit("2024-01-20 12:00:00")))


@query("rate_usage", """SELECT event_id AS id, sum(event_id % 3 + 1) OVER (PARTITION BY user_id % 10 ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS minute_usage, sum(CAST(trunc(value) AS INT)) OVER (PARTITION BY user_id % 10, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS day_usage FROM events""")
def rate_usage(spark, sf):
    return S.rate_usage(_runs(Tables(spark, sf))).select("id", "minute_usage", "day_usage")
