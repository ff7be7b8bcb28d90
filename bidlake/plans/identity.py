"""Identifiers, matching and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_identifier
from ..operators import identity as I
from .base import Tables, over, query


@query("normalize_identifiers", """WITH i AS (SELECT p_partkey AS id, ['GTIN_13', 'MPN', 'EXTERNAL_ID', 'UPC', 'OTHER'][CAST(p_partkey % 5 + 1 AS INT)] AS kind,
 CASE p_partkey % 5 WHEN 0 THEN ' ' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '-' || (p_partkey % 10) || ' ' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '1') ELSE '123' END ELSE '  ' || p_name || '   x ' END AS v, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS maker, CASE WHEN p_partkey % 4 > 0 THEN 's' END AS src FROM part),
e AS (SELECT *, CASE WHEN kind = 'GTIN_13' THEN CASE WHEN length(regexp_replace(v, '[ -]', '', 'g')) <> 13 THEN 'IDENTIFIER_FORMAT_INVALID' END WHEN kind = 'UPC' THEN CASE WHEN length(v) <> 12 THEN 'IDENTIFIER_FORMAT_INVALID' END WHEN kind = 'MPN' THEN CASE WHEN maker IS NULL THEN 'IDENTIFIER_MANUFACTURER_REQUIRED' END WHEN kind = 'EXTERNAL_ID' THEN CASE WHEN src IS NULL THEN 'IDENTIFIER_SOURCE_REQUIRED' END ELSE 'IDENTIFIER_TYPE_UNSUPPORTED' END AS error FROM i)
SELECT id, error, CASE WHEN error IS NULL THEN CASE WHEN kind IN ('GTIN_13', 'UPC') THEN regexp_replace(v, '[ -]', '', 'g') WHEN kind = 'MPN' THEN upper(trim(regexp_replace(v, ' +', ' ', 'g'))) ELSE trim(v) END END AS value FROM e""")
def normalize_identifiers(spark, sf):
    p, k = Tables(spark, sf).raw("part"), F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["GTIN_13", "MPN", "EXTERNAL_ID", "UPC", "OTHER"])), (k % 5 + 1).cast("int"))
    s = k.cast("string")
    v = F.when(k % 5 == 0, F.concat(F.lit(" "), F.lpad(s, 12, "0"), F.lit("-"), k % 10, F.lit(" "))).when(k % 5 == 3, F.when(k % 2 == 0, F.lpad(s, 12, "1")).otherwise("123")).otherwise(F.concat(F.lit("  "), "p_name", F.lit("   x ")))
    n = normalize_identifier(kind, v, F.when(k % 3 > 0, F.col("p_brand")), F.when(k % 4 > 0, F.lit("s")))
    return p.select(k.alias("id"), n.alias("n")).select("id", "n.error", "n.value")


def _feed(t: Tables):
    """Records made of parts, some with other makers, models, names or codes."""
    k = F.col("p_partkey")
    r = t.raw("part")
    gtin = F.when(k % 10 == 0, F.lpad((k % 1500).cast("string"), 13, "0")).when(k % 10 == 2, F.lpad((k + 500000).cast("string"), 13, "9"))
    codes = F.filter(F.array(F.struct(F.lit("GTIN_13").alias("type"), gtin.alias("value")), F.struct(F.lit("MPN").alias("type"), F.when(k % 6 == 0, F.concat(F.lit("MPN-"), k % 700)).alias("value"))), lambda x: x["value"].isNotNull())
    return r.select(
        k.alias("record_id"), (k % 4).alias("source_id"), F.concat(F.lit("x"), k % 800).alias("external_id"), F.when(k % 14 > 0, F.upper("p_brand")).alias("maker_name"), F.col("p_brand").alias("maker_code"),
        F.when(k % 8 == 0, F.concat_ws("-", "p_type", "p_size")).alias("model_number"), F.concat(F.upper("p_name"), F.when(k % 9 == 0, F.concat(F.lit(" "), k)).otherwise("")).alias("name"), codes.alias("identifiers"),
    )


def _library(t: Tables):
    items = t.library()
    ids = items.select("item_id", F.lit("GTIN_14").alias("identifier_type"), F.col("gtin").alias("normalized_value")).unionByName(items.select("item_id", F.lit("MPN").alias("identifier_type"), F.concat(F.lit("mpn-"), F.col("item_id") % 700).alias("normalized_value")))
    earlier = items.where("item_id % 5 = 0").select((F.col("item_id") % 4).alias("source_id"), F.concat(F.lit("x"), F.col("item_id") % 800).alias("external_id"), F.col("item_id").alias("matched_item_id")).groupBy("source_id", "external_id").agg(F.min("matched_item_id").alias("matched_item_id"))
    return I.library_keys(items, ids, earlier)


CASCADE = f"""{over('library')}, act AS (SELECT * FROM library WHERE is_active), r AS (SELECT p_partkey AS record_id, (p_partkey % 4) || '|' || 'x' || (p_partkey % 800) AS src, CASE WHEN p_partkey % 14 > 0 THEN lower(p_brand) END AS maker, lower(p_brand) AS any_maker,
 CASE WHEN p_partkey % 8 = 0 THEN lower(p_type || '-' || p_size) END AS model, lower(p_name) || CASE WHEN p_partkey % 9 = 0 THEN ' ' || p_partkey ELSE '' END AS name,
 CASE p_partkey % 10 WHEN 0 THEN lpad(CAST(p_partkey % 1500 AS VARCHAR), 13, '0') WHEN 2 THEN lpad(CAST(p_partkey + 500000 AS VARCHAR), 13, '9') END AS gtin, CASE WHEN p_partkey % 6 = 0 THEN 'mpn-' || (p_partkey % 700) END AS mpn FROM part),
prev AS (SELECT src, id FROM (SELECT (item_id % 4) || '|' || 'x' || (item_id % 800) AS src, min(item_id) AS id FROM library WHERE item_id % 5 = 0 GROUP BY 1) JOIN act ON act.item_id = id),
ev AS (SELECT record_id, 1 AS rule, item_id FROM r JOIN act USING (gtin) UNION ALL SELECT record_id, 2, item_id FROM r JOIN act a ON mpn = 'mpn-' || (item_id % 700) AND lower(a.maker) = coalesce(r.maker, any_maker)
 UNION ALL SELECT record_id, 3, item_id FROM r JOIN act a ON lower(a.maker) = r.maker AND lower(a.model_number) = r.model UNION ALL SELECT record_id, 4, id FROM r JOIN prev USING (src) UNION ALL SELECT record_id, 5, item_id FROM r JOIN act a ON lower(a.maker) = r.maker AND lower(a.name) = r.name),
w AS (SELECT record_id, {', '.join(f'min(item_id) FILTER (WHERE rule = {i}) AS lo{i}, max(item_id) FILTER (WHERE rule = {i}) AS hi{i}' for i in range(1, 6))} FROM r LEFT JOIN ev USING (record_id) GROUP BY record_id),
v AS (SELECT *, CASE WHEN lo1 IS NOT NULL THEN CASE WHEN lo1 <> hi1 OR coalesce(lo4 <> lo1, false) THEN 0 ELSE 1 END WHEN lo2 IS NOT NULL THEN CASE WHEN lo2 <> hi2 OR coalesce(lo4 <> lo2, false) THEN 0 ELSE 2 END
 WHEN lo3 IS NOT NULL THEN CASE WHEN lo3 <> hi3 OR coalesce(lo4 <> lo3, false) THEN 0 ELSE 3 END WHEN lo4 IS NOT NULL THEN 4 WHEN lo5 IS NOT NULL THEN CASE WHEN lo5 <> hi5 THEN 0 ELSE 5 END ELSE 6 END AS c FROM w)
SELECT record_id, CASE c WHEN 1 THEN lo1 WHEN 2 THEN lo2 WHEN 3 THEN lo3 WHEN 4 THEN lo4 WHEN 5 THEN lo5 END AS matched_item_id, CASE WHEN c = 0 THEN 'AMBIGUOUS_MULTIPLE_MATCHES' WHEN c = 6 THEN 'NO_MATCH' WHEN c < 5 AND lo4 IS NOT NULL THEN 'EXISTING_SOURCE_EXTERNAL_REF'
 WHEN c = 1 THEN 'EXACT_GLOBAL_IDENTIFIER' WHEN c = 2 THEN 'EXACT_MANUFACTURER_MPN' WHEN c = 3 THEN 'EXACT_MANUFACTURER_MODEL' ELSE 'CONSERVATIVE_NAME_MATCH' END AS reason, CASE c WHEN 0 THEN 'NEEDS_REVIEW' WHEN 6 THEN 'NORMALIZED' ELSE 'MATCHED' END AS status FROM v"""


@query("identity_cascade", CASCADE)
def identity_cascade(spark, sf):
    t = Tables(spark, sf)
    return I.resolve_identity(_feed(t), _library(t))


@query("identity_evidence", CASCADE[: CASCADE.index("w AS (")].rstrip().rstrip(",") + " SELECT record_id, rule, min(item_id) AS lo, max(item_id) AS hi FROM ev GROUP BY record_id, rule")
def identity_evidence(spark, sf):
    t = Tables(spark, sf)
    return I.evidence(_feed(t), _library(t))


@query("identifier_lookup", f"""{over('library')}, g AS (SELECT gtin, count(*) AS n, min(item_id) AS item_id FROM library GROUP BY gtin) SELECT c_custkey AS request_id, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS verdict, CASE WHEN n = 1 THEN item_id END AS item_id FROM customer LEFT JOIN g ON gtin = lpad(CAST(c_custkey * 2 AS VARCHAR), 13, '0')""")
def identifier_lookup(spark, sf):
    t = Tables(spark, sf)
    ids = t.library().select("item_id", F.lit("GTIN_13").alias("identifier_type"), F.col("gtin").alias("value"), F.lit("").alias("scope"))
    asked = t.raw("customer").select(F.col("c_custkey").alias("request_id"), F.lit("GTIN_13").alias("identifier_type"), F.lpad((F.col("c_custkey") * 2).cast("string"), 13, "0").alias("value"), F.lit("").alias("scope"))
    return I.lookup_identifiers(asked, ids)


@query("duplicate_keys", f"""{over('library')} SELECT rule, key, count(*) AS n FROM (SELECT 'gtin' AS rule, gtin AS key FROM library UNION ALL SELECT 'maker_model', lower(maker) || '|' || lower(model_number) FROM library) GROUP BY rule, key HAVING count(*) > 1
UNION ALL SELECT 'order_line', l_orderkey || '|' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    t = Tables(spark, sf)
    a = I.duplicate_keys(t.library(), {"gtin": ["gtin"], "maker_model": [F.lower("maker"), F.lower("model_number")]})
    return a.unionByName(I.duplicate_keys(t.raw("lineitem"), {"order_line": ["l_orderkey", "l_linenumber"]}))


@query("batch_clusters")
def batch_clusters(spark, sf):
    """Feed records of one batch, published one after the other; held against a plain
    sequential loop in the tests."""
    t = Tables(spark, sf)
    feed = _feed(t)
    records = feed.select("record_id", (F.col("record_id") % 1000).alias("created_at"))
    keys = I.record_keys(feed).where(F.col("rule") <= I.MODEL).select("record_id", F.col("rule").alias("tier"), "key")
    library = _library(t).where(F.col("rule") <= I.MODEL).select(F.col("rule").alias("tier"), "key", "item_id")
    return I.cluster_batch(records, keys, library)
