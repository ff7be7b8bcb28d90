"""Translations that lack, and sales requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import localize as L
from ..operators import requests as R
from ..sources.tables import spread, written
from ..streaming import jobs
from .base import Tables, over, query


def _docs(t: Tables):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    q = t.raw("orders").select(
        k.alias("doc_id"), F.when(k % 50 == 0, "en").alias("stated_locale"), F.when(k % 3 == 0, F.concat(F.lit("Project "), k)).alias("project_name"), none.alias("project_name_ar"), F.when(k % 6 == 0, F.lit("Project")).alias("project_name_en"),
        F.when(k % 4 == 0, F.lit("ملاحظة")).alias("notes"), none.alias("notes_ar"), none.alias("notes_en"), none.alias("attention_name"), none.alias("attention_name_ar"), none.alias("attention_name_en"), F.when(k % 5 == 0, F.lit(" Subject ")).alias("subject_en"), none.alias("subject_ar"),
        none.alias("brief_ar"), none.alias("brief_en"), none.alias("terms"), none.alias("terms_ar"), none.alias("terms_en"), F.lit("Customer").alias("customer_name"), none.alias("customer_name_ar"), F.when(k % 7 == 0, F.lit("Customer EN")).alias("customer_name_en"),
        F.when(k % 9 == 0, "COMPLETED").alias("localization_status"), F.when(k % 2 == 0, "DRAFT").otherwise("SENT").alias("status"),
    )
    # Lines tell the language and are looked through: they are put in order once.
    lines = written(t.lines().select("doc_id", "position", "item_name", none.alias("item_name_ar"), F.when(F.col("part") % 2 == 0, F.col("item_name")).alias("item_name_en"), *[none.alias(f"{f}{x}") for f in ("description", "unit_name") for x in ("", "_ar", "_en")]), "quotation-lines")
    return q, spread(lines, "doc_id")


def _missing(t: Tables):
    """What lacks in all quotations, written, since it is joined with what is made of it."""
    q, lines = _docs(t)
    return spread(written(L.missing_translations(q, lines, L.source_locale(q, lines)), "missing"), "doc_id")


_BASE = f"""{over('lines')}, d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 50 = 0 THEN 'en' WHEN o_orderkey % 4 = 0 THEN 'ar' ELSE 'en' END AS locale, o_orderkey AS k FROM orders),
m AS (SELECT doc_id, locale, 0 AS field_no, 'customer_name' AS key, CASE WHEN locale = 'en' THEN 'Customer EN' END AS text FROM d WHERE k % 7 = 0
 UNION ALL SELECT doc_id, locale, 1, 'project_name', CASE WHEN locale = 'en' THEN CASE WHEN k % 6 = 0 THEN 'Project' WHEN k % 3 = 0 THEN 'Project ' || k END WHEN k % 6 > 0 AND k % 3 = 0 THEN 'Project ' || k END FROM d
 UNION ALL SELECT doc_id, locale, 3, 'subject', CASE WHEN locale = 'en' AND k % 5 = 0 THEN 'Subject' END FROM d UNION ALL SELECT doc_id, locale, 5, 'notes', CASE WHEN k % 4 = 0 THEN 'ملاحظة' END FROM d
 UNION ALL SELECT d.doc_id, locale, 7 + (position - 1) * 3, 'line_' || (position - 1) || '_item_name', CASE WHEN locale = 'en' OR part % 2 > 0 THEN item_name END FROM lines JOIN d USING (doc_id)),
miss AS (SELECT * FROM m WHERE text IS NOT NULL)"""


@query("missing_translations", f"{_BASE} SELECT doc_id, locale, field_no, key, text FROM miss")
def missing_translations(spark, sf):
    q, lines = _docs(Tables(spark, sf))
    return L.missing_translations(q, lines, L.source_locale(q, lines))


@query("localization_signatures", f"""{_BASE} SELECT doc_id, sha256('{{"sourceLocale":"' || locale || '","items":[' || string_agg('{{"key":"' || key || '","text":"' || text || '"}}', ',' ORDER BY field_no) || ']}}') AS signature FROM miss GROUP BY doc_id, locale""")
def localization_signatures(spark, sf):
    return L.signatures(_missing(Tables(spark, sf)))


_CLASS = f"""{_BASE}, n AS (SELECT doc_id, count(*) AS n FROM miss GROUP BY doc_id), c AS (SELECT doc_id, CASE WHEN k % 9 > 0 THEN CASE WHEN n > 0 THEN 'PENDING' ELSE 'COMPLETED' END END AS new_status, CASE WHEN k % 9 > 0 AND n > 0 THEN locale END AS new_locale, k % 9 = 0 AND coalesce(n, 0) > 0 AS broken, k % 9 = 0 AND coalesce(n, 0) > 0 AND k % 2 = 0 AS repairable FROM d LEFT JOIN n USING (doc_id))"""


@query("backfill_classes", f"{_CLASS} SELECT * FROM c")
def backfill_classes(spark, sf):
    q, lines = _docs(Tables(spark, sf))
    loc = L.source_locale(q, lines)
    return L.backfill_classes(q, loc, L.missing_translations(q, lines, loc))


@query("backfill_summary", f"{_CLASS} SELECT count(*) AS total, count(*) FILTER (WHERE new_status = 'PENDING') AS pending, count(*) FILTER (WHERE new_status = 'COMPLETED') AS completed, count(*) FILTER (WHERE broken) AS broken, count(*) FILTER (WHERE repairable) AS repairable FROM c")
def backfill_summary(spark, sf):
    return L.backfill_summary(backfill_classes(spark, sf))


@query("translation_write_back", f"{_BASE} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'STALE' WHEN bool_or(doc_id % 3 = 0 AND key = 'project_name') THEN 'FAILED' ELSE 'APPLIED' END AS verdict, CASE WHEN doc_id % 10 > 0 AND NOT bool_or(doc_id % 3 = 0 AND key = 'project_name') THEN 3 * count(*) END AS cells FROM miss GROUP BY doc_id")
def translation_write_back(spark, sf):
    missing = _missing(Tables(spark, sf))
    results = missing.select("doc_id", "key", F.when((F.col("doc_id") % 3 == 0) & (F.col("key") == "project_name"), " ").otherwise(F.concat(F.lit("tr "), "text")).alias("translation"))
    now = L.signatures(missing)
    then = now.withColumn("signature", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("signature")))
    return L.write_back(missing, results, then, now).select("doc_id", "verdict", F.when(F.col("values").isNotNull(), F.size("values")).alias("cells"))


_WRITTEN = f"""{_BASE}, v AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'STALE' WHEN bool_or(doc_id % 3 = 0 AND key = 'project_name') THEN 'FAILED' ELSE 'COMPLETED' END AS outcome FROM miss GROUP BY doc_id)"""


@query("recovery_summary", f"{_WRITTEN} SELECT count(*) AS scanned, count(*) FILTER (WHERE outcome = 'COMPLETED') AS completed, count(*) FILTER (WHERE outcome = 'FAILED') AS failed, count(*) FILTER (WHERE outcome = 'STALE') AS stale, count(*) FILTER (WHERE outcome IS NULL) AS no_claim, 0 AS not_found, 0 AS claim_failed FROM orders LEFT JOIN v ON doc_id = o_orderkey")
def recovery_summary(spark, sf):
    """What came of taking up the translation of every order: what was written back, and orders
    that had nothing to translate."""
    done = translation_write_back(spark, sf).select("doc_id", F.when(F.col("verdict") == "APPLIED", "COMPLETED").otherwise(F.col("verdict")).alias("outcome"))
    orders = Tables(spark, sf).raw("orders").select(F.col("o_orderkey").alias("doc_id"))
    return L.recovery_summary(orders.join(done, "doc_id", "left").select(F.coalesce("outcome", F.lit("NO_CLAIM")).alias("outcome")))


@query("translated_texts", f"{_BASE} SELECT doc_id, key, text, locale || ' of ' || length(text) || ': ' || reverse(text) AS translation FROM miss")
def translated_texts(spark, sf):
    """Stands for a translator: the locale, and the text backwards."""
    missing = _missing(Tables(spark, sf))
    return L.translate_texts(missing, lambda locale, text: locale + " of " + text.str.len().astype(str) + ": " + text.str[::-1])


@query("stale_results", f"{_BASE} SELECT doc_id, CASE WHEN bool_or(key = 'notes') THEN 'STALE' ELSE 'CURRENT' END AS verdict FROM miss GROUP BY doc_id HAVING bool_or(key <> 'notes')")
def stale_results(spark, sf):
    """Results made before the notes were there: out of date where an order has notes now."""
    missing = _missing(Tables(spark, sf))
    token = F.concat(F.lit("claim-"), "doc_id").alias("token")
    return jobs.current_results(L.signatures(missing.where("key <> 'notes'")).select("doc_id", "signature", token), L.signatures(missing).select("doc_id", "signature", token)).select("doc_id", "verdict")


def _requests(t: Tables):
    p, k = t.raw("part"), F.col("p_partkey")
    en = F.concat(F.lit("Create a quotation for Customer "), F.char(k % 26 + 65), F.lit(" supply only "), k % 50 + 1, F.lit(" units "), "p_name", F.lit(" at "), F.col("p_size"), F.lit(" KWD; "), k % 7 + 2, F.lit(" pcs "), F.when(k % 3 == 0, "services of ").otherwise("service of "), F.col("p_name"))
    ar = F.concat(F.lit("اعمل عرض سعر لشركة الكويت "), F.lit("5 كاميرات "), F.col("p_name"), F.lit(" بسعر "), F.col("p_size"), F.when(k % 8 == 0, " د.ك مع التركيبات").otherwise(" د.ك مع التركيب"))
    return p.select(k.alias("request_id"), (k % 25).cast("int").alias("company_id"), F.when(k % 4 == 0, "ar").otherwise("en").alias("locale"), F.when(k % 4 == 0, ar).otherwise(en).alias("text"), "p_name")


@query("request_intents", """SELECT p_partkey AS request_id, CASE WHEN p_partkey % 4 = 0 THEN 'الكويت' ELSE 'Customer ' || chr(CAST(p_partkey % 26 + 65 AS INT)) END AS customer_mention, CASE WHEN p_partkey % 4 = 0 THEN 'SUPPLY_AND_INSTALLATION' ELSE 'SUPPLY_ONLY' END AS scope_type, 'KWD' AS currency_code,
CASE WHEN p_partkey % 4 = 0 THEN '5.0' ELSE CAST(CAST(p_partkey % 50 + 1 AS DOUBLE) AS VARCHAR) || '|' || CAST(CAST(p_partkey % 7 + 2 AS DOUBLE) AS VARCHAR) END AS quantities, CAST(p_size AS DOUBLE) AS first_price, CASE WHEN p_partkey % 4 = 0 THEN 'SERVICE' ELSE 'PRODUCT|SERVICE' END AS types FROM part""")
def request_intents(spark, sf):
    i = R.extract_intents(_requests(Tables(spark, sf)))
    join = lambda f: F.array_join(F.transform("lines", f), "|")
    return i.select("request_id", "customer_mention", "scope_type", "currency_code", join(lambda x: x["quantity"].cast("string")).alias("quantities"), F.col("lines")[0]["price"].alias("first_price"), join(lambda x: x["type"]).alias("types"))


@query("resolve_customers", """WITH c AS (SELECT c_custkey AS id, c_nationkey AS company_id, c_name AS name, c_mktsegment AS legal FROM customer WHERE c_custkey % 9 > 0), q AS (SELECT s_suppkey AS request_id, s_nationkey AS company_id, CASE s_suppkey % 3 WHEN 0 THEN 'customer.' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') WHEN 1 THEN 'House' ELSE 'nobody' END AS s FROM supplier),
e AS (SELECT request_id, min(id) AS lo, max(id) AS hi FROM q JOIN c ON q.company_id = c.company_id AND (replace(lower(s), '.', ' ') = replace(lower(name), '#', ' ') OR lower(s) = lower(legal)) GROUP BY 1),
n AS (SELECT request_id, count(*) AS n FROM q JOIN c ON q.company_id = c.company_id AND (contains(lower(name), lower(s)) OR contains(lower(legal), lower(s))) GROUP BY 1)
SELECT request_id, CASE WHEN lo = hi THEN 'MATCHED' WHEN n > 0 OR lo IS NOT NULL THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status, CASE WHEN lo = hi THEN lo END AS id, CASE WHEN NOT coalesce(lo = hi, false) AND n > 0 THEN least(n, 5) END AS shown FROM q LEFT JOIN e USING (request_id) LEFT JOIN n USING (request_id)""")
def resolve_customers(spark, sf):
    t, k, none = Tables(spark, sf), F.col("c_custkey"), F.lit(None).cast("string")
    c = t.raw("customer").select(k.alias("customer_id"), F.col("c_nationkey").alias("company_id"), none.alias("code"), F.regexp_replace("c_name", "#", " ").alias("name"), F.col("c_name").alias("name_ar"), none.alias("name_en"), F.col("c_mktsegment").alias("legal_name"), none.alias("email"), F.when(k % 9 == 0, "BLOCKED").otherwise("ACTIVE").alias("status"), F.timestamp_seconds(k).alias("created_at"))
    s = F.col("s_suppkey")
    m = t.raw("supplier").select(s.alias("request_id"), F.col("s_nationkey").alias("company_id"), F.when(s % 3 == 0, F.concat(F.lit("customer."), F.lpad((s * 3).cast("string"), 9, "0"))).when(s % 3 == 1, "House").otherwise("nobody").alias("mention"), none.alias("email"))
    r = R.resolve_customers(m, c)
    return r.select("request_id", "status", "id", F.when(F.col("candidates").isNotNull(), F.size("candidates").cast("long")).alias("shown"))


@query("resolve_lines", f"""{over('catalog')}, q AS (SELECT p_partkey AS request_id, CAST(p_partkey % 25 AS INT) AS company_id, p_name AS s, CASE WHEN p_partkey % 2 = 0 THEN 'PRODUCT' ELSE 'UNKNOWN' END AS k FROM part),
e AS (SELECT request_id, min(item_id) AS lo, max(item_id) AS hi FROM q JOIN catalog c ON q.company_id = c.company_id AND is_active AND name = s AND (k = 'UNKNOWN' OR type = k) GROUP BY 1), n AS (SELECT request_id, count(*) AS n FROM q JOIN catalog c ON q.company_id = c.company_id AND is_active AND contains(name, s) AND (k = 'UNKNOWN' OR type = k) GROUP BY 1)
SELECT request_id, CASE WHEN lo = hi THEN 'MATCHED' WHEN n > 0 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status, CASE WHEN lo = hi THEN lo END AS id FROM q LEFT JOIN e USING (request_id) LEFT JOIN n USING (request_id)""")
def resolve_lines(spark, sf):
    t, k = Tables(spark, sf), F.col("p_partkey")
    lines = t.raw("part").select(k.alias("request_id"), (k % 25).cast("int").alias("company_id"), F.col("p_name").alias("text"), F.when(k % 2 == 0, "PRODUCT").otherwise("UNKNOWN").alias("type"))
    return R.resolve_lines(lines, t.catalog()).select("request_id", "status", "id")


@query("request_proposals", "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'KWD' END AS currency_code, count(l_orderkey) AS lines, CASE WHEN bool_and(l_linenumber < 6) THEN sum(CAST(l_quantity * l_extendedprice AS DECIMAL(18,3))) END AS subtotal, coalesce(bool_or(l_linenumber > 3) OR NOT bool_and(l_linenumber < 6), true) AS review_required FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def request_proposals(spark, sf):
    t = Tables(spark, sf)
    r = t.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 2 == 0, "USD").alias("currency_code"), F.lit("KWD").alias("company_currency"))
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_linenumber") > 3, "MISSING").otherwise("MATCHED").alias("status"), "l_quantity", F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice")).alias("unit_price"))
    return R.proposals(r, lines)


@query("intent_validation", """SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN 'NOT_AN_OBJECT' WHEN 1 THEN 'UNKNOWN_FIELD' WHEN 2 THEN 'TOO_MANY_LINES' WHEN 3 THEN 'TEXT_INVALID' WHEN 4 THEN 'CURRENCY_INVALID' WHEN 5 THEN CASE WHEN c_custkey % 1000000 = 0 THEN 'LINE_NUMBER_INVALID' END
 WHEN 6 THEN 'LINE_NUMBER_INVALID' WHEN 7 THEN 'LINE_TEXT_MISSING' WHEN 8 THEN 'LINE_TYPE_INVALID' WHEN 9 THEN 'LINE_WARNINGS_INVALID' WHEN 10 THEN 'SCOPE_INVALID' END AS error FROM customer""")
def intent_validation(spark, sf):
    k, name = F.col("c_custkey"), F.col("c_name")
    cases = [
        F.lit("[1]"), F.lit('{"lines": [], "other": 1}'), F.concat(F.lit('{"lines": ['), F.repeat(F.lit('{"text": "a"},'), F.lit(20)), F.lit('{"text": "b"}]}')), F.concat(F.lit('{"lines": [], "subject": "'), F.repeat(name, F.lit(30)), F.lit('"}')),
        F.lit('{"lines": [], "currencyCode": "K1D"}'), F.concat(F.lit('{"lines": [{"text": "a", "quantity": '), k % 1000000, F.lit("}]}")), F.lit('{"lines": [{"text": "a"}, {"text": "b", "requestedPrice": -1}]}'), F.lit('{"lines": [{"text": " "}]}'),
        F.lit('{"lines": [{"text": "a", "typeIntent": "GIFT"}]}'), F.lit('{"lines": [{"text": "a", "warnings": [""]}]}'), F.lit('{"lines": [], "scopeType": "ALL"}'), F.concat(F.lit('{"lines": [{"text": "'), name, F.lit('", "quantity": null, "typeIntent": "SERVICE"}], "sourceLocale": "ar", "customerMention": null}')),
    ]
    raw = F.element_at(F.array(*cases), (k % 12 + 1).cast("int"))
    return R.validate_intents(Tables(spark, sf).raw("customer").select(k.alias("id"), raw.alias("raw"))).select("id", "error")
