"""Orders, numbering, lifecycles and row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import document_totals
from ..functions.text import messaging_phone
from ..operators import documents as D
from .base import Tables, over, query
from .money import AMOUNTS, TOTALS, r3

_DEC = "CAST({} AS DECIMAL(18,3))".format


@query("orders_from_quotations", f"""{over('lines', 'headers')}, {AMOUNTS}, {TOTALS}, q AS (SELECT h.doc_id, number, CASE h.status WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'SENT' ELSE 'DRAFT' END AS st, is_deleted, CASE WHEN h.doc_id % 9 > 0 THEN 'x' END AS appr, currency_code, error, line_count, s, d, t FROM headers h JOIN h3 USING (doc_id)),
b AS (SELECT doc_id, bool_or(quantity - 1 <= 0) AS bad FROM lines GROUP BY doc_id), v AS (SELECT q.*, CASE WHEN is_deleted THEN 'QUOTATION_NOT_FOUND' WHEN doc_id % 8 = 0 THEN 'EXISTING' WHEN st <> 'APPROVED' THEN 'INVALID_QUOTATION_STATUS' WHEN appr IS NULL OR line_count = 0 OR bad THEN 'INVALID_SOURCE_SNAPSHOT' ELSE 'READY' END AS verdict FROM q LEFT JOIN b USING (doc_id))
SELECT doc_id, verdict, CASE WHEN verdict = 'READY' THEN 'SO-' || number END AS order_number, CASE WHEN verdict = 'READY' THEN currency_code END AS currency_code, CASE WHEN verdict = 'READY' AND error IS NULL THEN {_DEC(r3('s - d + t'))} END AS total_amount FROM v""")
def orders_from_quotations(spark, sf):
    t = Tables(spark, sf)
    h, lines = t.headers(), t.lines()
    status = F.when(F.col("status") == "F", "APPROVED").when(F.col("status") == "O", "SENT").otherwise("DRAFT")
    q = h.select("doc_id", "number", status.alias("status"), "is_deleted", F.col("created_at").alias("approved_at"), F.when(F.col("doc_id") % 9 > 0, "x").alias("approved_by_name"), F.lit("owner").alias("approved_by_role"), F.lit("c").alias("customer_name"), "currency_code")
    q = q.join(document_totals(lines, h), "doc_id")
    existing = h.where("doc_id % 8 = 0").select(F.col("doc_id").alias("source_quotation_id"))
    out = D.orders_from_quotations(q, lines.withColumn("quantity", F.col("quantity") - 1), existing)
    return out.select("doc_id", "verdict", "order_number", "currency_code", "total_amount")


@query("milestone_checks", """WITH m AS (SELECT l_orderkey AS contract_id, l_linenumber AS position, CASE WHEN l_suppkey % 4 = 0 THEN 'FIXED' ELSE 'PERCENTAGE' END AS k, l_quantity - CASE WHEN l_suppkey % 7 = 0 THEN 5 ELSE 0 END AS v FROM lineitem),
g AS (SELECT contract_id, bool_or(CASE WHEN k = 'FIXED' THEN v < 0 ELSE v <= 0 OR v > 100 END) AS bad, count(*) AS n, min(position) AS lo, max(position) AS hi, count(DISTINCT position) AS d, bool_and(k = 'PERCENTAGE') AS a, sum(CASE WHEN k = 'PERCENTAGE' THEN v END) AS s FROM m GROUP BY contract_id)
SELECT contract_id, CASE WHEN bad THEN 'AMOUNT_INVALID' WHEN lo <> 1 OR hi <> n OR d <> n THEN 'POSITIONS_INVALID' WHEN a AND s > 100 THEN 'PERCENTAGE_OVER_100' END AS error FROM g""")
def milestone_checks(spark, sf):
    li, fixed = Tables(spark, sf).raw("lineitem"), F.col("l_suppkey") % 4 == 0
    v = F.col("l_quantity") - F.when(F.col("l_suppkey") % 7 == 0, 5).otherwise(0)
    return D.check_milestones(li.select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("position"), F.when(fixed, "FIXED").otherwise("PERCENTAGE").alias("amount_type"), F.when(~fixed, v).alias("percentage"), F.when(fixed, v).alias("fixed_amount")))


@query("allocate_codes", """SELECT c_custkey AS id, 'CUST-' || lpad(CAST(CASE WHEN c_nationkey % 3 = 0 THEN 100 + c_nationkey ELSE 1 END + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS VARCHAR), 6, '0') AS code FROM customer""")
def allocate_codes(spark, sf):
    t = Tables(spark, sf)
    c = t.raw("customer").select(F.col("c_nationkey").alias("company_id"), F.col("c_custkey").alias("id"))
    seq = t.raw("nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("company_id"), (F.lit(100) + F.col("n_nationkey")).alias("next_value"))
    return D.allocate_codes(c, seq, ["company_id"], ["id"], D.customer_code())[0].select("id", "code")


@query("contract_numbers", f"""{over('headers')} SELECT doc_id, 'CN-' || strftime(created_at, '%Y%m') || '-' || lpad(CAST(row_number() OVER (PARTITION BY company_id, strftime(created_at, '%Y%m') ORDER BY doc_id) AS VARCHAR), 4, '0') AS code FROM headers""")
def contract_numbers(spark, sf):
    h = Tables(spark, sf).headers().select("doc_id", "company_id", F.date_format("created_at", "yyyyMM").alias("month"))
    none = h.select("company_id", "month", F.lit(1).alias("next_value")).limit(0)
    return D.allocate_codes(h, none, ["company_id", "month"], ["doc_id"], D.contract_number("month"))[0].select("doc_id", "code")


@query("renumber_lines", "SELECT l_orderkey AS doc_id, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS position FROM lineitem")
def renumber_lines(spark, sf):
    li = Tables(spark, sf).raw("lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return D.renumber_lines(li, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("doc_id", F.col("l_partkey").alias("part"), "position")


@query("line_positions", "SELECT l_orderkey AS doc_id, count(*) = count(DISTINCT l_linenumber) AS is_unique, count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS is_contiguous FROM lineitem GROUP BY 1")
def line_positions(spark, sf):
    li = Tables(spark, sf).raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"))
    return D.check_positions(li).withColumnRenamed("ok", "is_unique").join(D.check_positions(li, "contiguous").withColumnRenamed("ok", "is_contiguous"), "doc_id")


_STATUS = ["DRAFT", "SENT", "APPROVED", "CANCELLED", "REJECTED"]
_EV = "ev AS (SELECT event_id AS id, user_id AS entity_id, ['DRAFT', 'SENT', 'APPROVED', 'CANCELLED', 'REJECTED'][CAST(event_id % 5 + 1 AS INT)] AS status, ts FROM events)"


@query("lifecycle_audit", f"""WITH {_EV}, l AS (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY ts, id) AS previous FROM ev) SELECT id, entity_id, status, previous,
previous IS NULL OR previous = status OR (previous = 'DRAFT' AND status IN ('SENT', 'EXPIRED', 'CANCELLED')) OR (previous = 'SENT' AND status IN ('APPROVED', 'REJECTED', 'EXPIRED', 'CANCELLED')) OR (previous = 'APPROVED' AND status = 'CANCELLED') AS allowed FROM l""")
def lifecycle_audit(spark, sf):
    e = Tables(spark, sf).raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.lit("quotation").alias("kind"), F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % 5 + 1).cast("int")).alias("status"), F.col("ts").alias("at"))
    return D.audit_transitions(e, D.transition_rules(spark, ["quotation"])).select("id", "entity_id", "status", "previous", "allowed")


@query("claim_pending", """SELECT event_id AS id, value AS v, user_id + 1 AS retry_count FROM events WHERE event_id % 4 < 2 OR (event_id % 4 = 2 AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTE) ORDER BY ts, event_id LIMIT 100""")
def claim_pending(spark, sf):
    e = Tables(spark, sf).raw("events")
    status = F.element_at(F.array(*map(F.lit, ["NORMALIZED", "MATCHED", "PROCESSING", "PUBLISHED"])), (F.col("event_id") % 4 + 1).cast("int"))
    r = e.select(F.col("event_id").alias("id"), F.col("value").alias("v"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("processing_started_at"), F.col("user_id").alias("retry_count"))
    return D.claim_pending(r, F.to_timestamp(F.lit("2024-01-15 00:00:00")), 100).select("id", "v", "retry_count")


@query("recoverable_jobs", """SELECT event_id AS id FROM events WHERE event_id % 10 > 0 AND event_id % 7 > 0 AND user_id % 5 < 3 AND (event_id % 2 = 0 OR ts < TIMESTAMP '2024-01-10') AND (event_type = 'click' OR (event_type = 'error' AND event_id % 3 = 0)) ORDER BY CASE WHEN event_id % 4 > 0 THEN ts END NULLS LAST, ts, event_id LIMIT 200""")
def recoverable_jobs(spark, sf):
    k = F.col("event_id")
    q = Tables(spark, sf).raw("events").select(
        k.alias("id"), (k % 10 == 0).alias("is_deleted"), F.when(k % 7 > 0, "s").alias("signature"), (F.col("user_id") % 5).alias("attempts"), F.when(k % 2 > 0, F.col("ts")).alias("lease_until"),
        F.when(F.col("event_type") == "click", "PENDING").when(F.col("event_type") == "error", "FAILED").alias("localization_status"), F.when(k % 3 == 0, "TRANSLATION_TIMEOUT").otherwise("OTHER").alias("error_code"), F.when(k % 4 > 0, F.col("ts")).alias("requested_at"), F.col("ts").alias("updated_at"),
    )
    return D.recoverable_jobs(q, F.to_timestamp(F.lit("2024-01-10")), 200).select("id")


@query("latest_delivery", "SELECT user_id AS quotation_id, event_id AS id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_delivery(spark, sf):
    e = Tables(spark, sf).raw("events").select(F.col("user_id").alias("quotation_id"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return D.latest_delivery(e).select("quotation_id", "id", "status")


@query("delivery_history", "SELECT user_id AS quotation_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events")
def delivery_history(spark, sf):
    e = Tables(spark, sf).raw("events").select(F.col("user_id").alias("quotation_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return D.delivery_history(e).select("quotation_id", "id", "nth")


@query("verify_documents", f"{over('headers')} SELECT 't' || (doc_id * 7) AS token, number, n_name AS company_name, CASE WHEN status = 'P' THEN 'CANCELLED' ELSE 'VALID' END AS verdict FROM headers JOIN nation ON company_id = n_nationkey WHERE NOT is_deleted AND (doc_id * 7) % 5 = 0")
def verify_documents(spark, sf):
    t = Tables(spark, sf)
    q = t.headers().select(F.concat(F.lit("t"), F.col("doc_id") * 7).alias("token"), "company_id", "number", "is_deleted", F.when(F.col("status") == "P", "CANCELLED").otherwise("SENT").alias("status"))
    tokens = t.raw("orders").select((F.col("o_orderkey") * 7).alias("k")).where("k % 5 = 0").select(F.concat(F.lit("t"), "k").alias("token"))
    companies = t.raw("nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("name"), F.lit(" ").alias("name_en"), F.lit(None).cast("string").alias("name_ar"))
    return D.verify_documents(tokens, q, companies)


@query("tenant_overview", f"""{over('headers')}, c AS (SELECT c_nationkey AS company_id, count(*) AS customers FROM customer WHERE c_custkey % 31 > 0 GROUP BY 1), q AS (SELECT company_id, count(*) FILTER (WHERE status <> 'F') AS o, count(*) FILTER (WHERE status = 'F') AS a FROM headers WHERE NOT is_deleted GROUP BY 1)
SELECT coalesce(c.company_id, q.company_id) AS company_id, coalesce(customers, 0) AS customers, coalesce(o, 0) AS open_quotations, coalesce(a, 0) AS approved_deals FROM c FULL JOIN q ON c.company_id = q.company_id""")
def tenant_overview(spark, sf):
    t = Tables(spark, sf)
    c = t.raw("customer").select(F.col("c_nationkey").alias("company_id"), (F.col("c_custkey") % 31 == 0).alias("is_deleted"))
    return D.tenant_overview(c, t.headers().withColumn("status", F.when(F.col("status") == "F", "APPROVED").when(F.col("status") == "O", "SENT").otherwise("DRAFT")))


@query("customer_errors", """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'CODE_INVALID' WHEN c_custkey % 7 = 0 THEN 'NAME_REQUIRED' WHEN c_custkey % 5 = 0 THEN 'EMAIL_INVALID' WHEN c_custkey % 3 = 0 THEN 'COUNTRY_INVALID' WHEN c_acctbal < 0 THEN 'CREDIT_LIMIT_INVALID' WHEN c_custkey % 2 = 0 THEN 'PHONE_INVALID' END AS error FROM customer""")
def customer_errors(spark, sf):
    k = F.col("c_custkey")
    c = Tables(spark, sf).raw("customer").select(
        k.alias("id"), F.when(k % 11 == 0, "-bad").otherwise(F.concat(F.lit(" c-"), k)).alias("code"), F.when(k % 7 > 0, F.col("c_name")).otherwise(" ").alias("name"), F.lit(None).cast("string").alias("name_ar"), F.lit(None).cast("string").alias("name_en"), F.when(k % 5 == 0, "a@b").otherwise("a@b.co").alias("email"),
        F.when(k % 3 == 0, "KWT").otherwise("KW").alias("country"), F.lit("KWD").alias("currency_code"), F.col("c_acctbal").alias("credit_limit"), F.lit(30).alias("payment_terms"), F.when(k % 2 == 0, "12x").otherwise("+965 (2222) 333-4").alias("phone"),
    )
    return c.select("id", D.customer_error().alias("error"))


@query("catalog_errors", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'CODE_INVALID' WHEN p_size % 9 = 0 THEN 'NAME_REQUIRED' WHEN p_retailprice < 950 THEN 'PRICE_INVALID' WHEN p_partkey % 3 = 0 THEN 'SERVICE_TRACKS_STOCK' END AS error FROM part")
def catalog_errors(spark, sf):
    k = F.col("p_partkey")
    p = Tables(spark, sf).raw("part").select(k.alias("id"), F.when(k % 10 == 0, "a b").otherwise("A_1").alias("code"), F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_name")).alias("name"), (F.col("p_retailprice") - 950).alias("sale_price"), F.lit(0).alias("cost_price"), F.when(k % 3 == 0, "SERVICE").otherwise("PRODUCT").alias("type"), F.lit(True).alias("track_stock"))
    return p.select("id", D.catalog_error().alias("error"))


@query("row_rules", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'SOURCE_NOT_ALLOWED' WHEN p_partkey % 3 > 0 AND p_partkey % 2 > 0 THEN 'SOURCE_REQUIRED' WHEN p_partkey % 3 = 2 THEN 'SOURCE_KIND_MISMATCH' END AS provenance,
CASE WHEN p_size % 4 = 0 THEN 'ONE_VALUE_REQUIRED' WHEN p_size % 4 = 1 THEN 'VALUE_TYPE_MISMATCH' WHEN p_size % 4 = 2 AND p_partkey % 2 = 0 THEN 'UNIT_NOT_ALLOWED' END AS attribute, CASE WHEN p_size % 5 = 0 THEN 'HASH_INVALID' WHEN p_size % 5 = 1 THEN 'DATA_MISSING' WHEN p_size % 5 = 2 THEN 'MESSAGE_MISSING' WHEN p_size % 5 = 3 THEN 'START_MISSING' END AS ingestion, CASE WHEN p_size % 2 = 0 THEN 'DATES_OUT_OF_ORDER' END AS dates FROM part""")
def row_rules(spark, sf):
    k, z, none = F.col("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    p = Tables(spark, sf).raw("part").select(
        k.alias("id"), F.when(k % 3 == 0, "DIRECT").otherwise("QUOTATION").alias("kind"), F.when(k % 2 == 0, k).alias("source_id"), F.when(k % 3 == 2, "ORDER").otherwise("QUOTATION").alias("source_kind"),
        F.when(z % 4 == 1, "NUMBER").otherwise("STRING").alias("data_type"), F.when(z % 4 > 0, "v").alias("value_string"), none.alias("value_number"), none.alias("value_boolean"), none.alias("value_json"), F.when((z % 4 == 2) & (k % 2 == 0), "kg").alias("unit"),
        F.lit("x1").alias("external_id"), F.when(z % 5 == 0, "zz").otherwise(F.sha2("p_name", 256)).alias("payload_hash"), F.when(z % 5 == 2, "FAILED").when(z % 5 == 3, "PROCESSING").otherwise("NORMALIZED").alias("status"), F.when(z % 5 != 1, "{}").alias("normalized_data"), none.alias("matched_item_id"), none.alias("processing_started_at"), none.alias("processed_at"), none.alias("error_message"),
        F.lit(5).alias("start"), F.when(z % 2 == 0, 4).otherwise(6).alias("end"),
    )
    return p.select("id", D.provenance_error().alias("provenance"), D.attribute_error().alias("attribute"), D.ingestion_row_error().alias("ingestion"), D.date_order_error("start", "end").alias("dates"))


@query("messaging_phones", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '965' || lpad(CAST(c_custkey AS VARCHAR), 8, '1') WHEN c_custkey % 4 = 1 THEN '4420' || lpad(CAST(c_custkey AS VARCHAR), 6, '7') END AS phone FROM customer")
def messaging_phones(spark, sf):
    k = F.col("c_custkey")
    s = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("+965 "), F.lpad(s, 8, "1"))).when(k % 4 == 1, F.concat(F.lit("0044 (20) "), F.lpad(s, 6, "7"))).when(k % 4 == 2, F.concat(F.lit("0123"), F.lpad(s, 6, "7"))).otherwise("call me")
    return Tables(spark, sf).raw("customer").select(k.alias("id"), messaging_phone(raw).alias("phone"))
