"""Lines, totals, prices, taxes and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import document_totals, line_error, with_line_amounts
from ..functions.text import canonical_unit
from ..operators import pricing as P
from .base import Tables, over, query


def r3(x: str) -> str:
    return f"(floor(({x} + CAST(2.220446049250313e-16 AS DOUBLE)) * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE))"


AMOUNTS = f"""a1 AS (SELECT *, {r3('quantity * unit_price')} AS s FROM lines),
a2 AS (SELECT *, CASE WHEN discount_type IS NULL THEN CAST(0 AS DOUBLE) ELSE {r3('s * (discount_value / CAST(100 AS DOUBLE))')} END AS d FROM a1),
a3 AS (SELECT *, {r3('s - d')} AS b FROM a2), a4 AS (SELECT *, {r3('b * (tax_percentage / CAST(100 AS DOUBLE))')} AS t FROM a3), a5 AS (SELECT *, {r3('b + t')} AS total FROM a4)"""
M = "CAST({} AS DECIMAL(18,3))".format


@query("quotation_line_amounts", f"{over('lines')}, {AMOUNTS} SELECT doc_id, position, {M('s')} AS subtotal, {M('d')} AS discount_amount, {M('t')} AS tax_amount, {M('total')} AS total_amount FROM a5")
def quotation_line_amounts(spark, sf):
    return with_line_amounts(Tables(spark, sf).lines()).select("doc_id", "position", "subtotal", "discount_amount", "tax_amount", "total_amount")


TOTALS = f"""g AS (SELECT doc_id, count(*) AS n, sum({M('s')} - {M('d')}) AS net, sum({M('t')}) AS tax FROM a5 GROUP BY doc_id),
h AS (SELECT headers.doc_id, coalesce(n, 0) AS line_count, discount_type, discount_value, {r3('CAST(net AS DOUBLE)')} AS s, {r3('CAST(tax AS DOUBLE)')} AS before FROM headers LEFT JOIN g USING (doc_id)),
h2 AS (SELECT *, CASE WHEN discount_type IS NULL THEN CAST(0 AS DOUBLE) WHEN discount_type = 'PERCENTAGE' THEN {r3('s * (discount_value / CAST(100 AS DOUBLE))')} ELSE {r3('discount_value')} END AS d,
       CASE WHEN line_count = 0 THEN 'NO_LINES' WHEN discount_type = 'FIXED' AND discount_value > s THEN 'DISCOUNT_EXCEEDS_BASE' END AS error FROM h),
h3 AS (SELECT *, {r3(f"before - d * CASE WHEN s > 0 THEN {r3('before / s')} ELSE CAST(0 AS DOUBLE) END")} AS t FROM h2)"""
_good = lambda x, n: f"CASE WHEN error IS NULL THEN {M(x)} END AS {n}"


@query("quotation_totals", f"{over('lines', 'headers')}, {AMOUNTS}, {TOTALS} SELECT doc_id, line_count, {_good('s', 'subtotal')}, {_good('d', 'discount_amount')}, {_good('t', 'tax_amount')}, {_good(r3('s - d + t'), 'total_amount')}, error FROM h3")
def quotation_totals(spark, sf):
    t = Tables(spark, sf)
    return document_totals(t.lines(), t.headers())


@query("line_errors", """SELECT doc_id, position, error, count(*) AS n FROM (SELECT l_orderkey AS doc_id, l_linenumber AS position, CASE WHEN l_orderkey % 10 = 0 AND l_linenumber < 2 THEN 'POSITION_INVALID' WHEN l_partkey % 50 = 0 THEN 'NAME_REQUIRED' WHEN l_quantity - 3 <= 0 THEN 'QUANTITY_INVALID'
 WHEN l_extendedprice - 2000 < 0 THEN 'PRICE_INVALID' WHEN l_tax * CAST(100 AS DOUBLE) > CAST(7.5 AS DOUBLE) THEN 'TAX_INVALID' END AS error FROM lineitem) WHERE error IS NOT NULL GROUP BY doc_id, position, error""")
def line_errors(spark, sf):
    li = Tables(spark, sf).raw("lineitem")
    bad = line_error(
        quantity=F.col("l_quantity") - 3, price=F.col("l_extendedprice") - 2000, tax=F.when(F.col("l_tax") * 100.0 > 7.5, 101.0).otherwise(5.0),
        position=F.when((F.col("l_orderkey") % 10 == 0) & (F.col("l_linenumber") < 2), 0).otherwise(F.col("l_linenumber")), name=F.when(F.col("l_partkey") % 50 == 0, " ").otherwise(F.lit("x")), kind=F.lit(None).cast("string"), value=F.lit(None).cast("double"),
    )
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), bad.alias("error")).where("error is not null").groupBy("doc_id", "position", "error").agg(F.count("*").alias("n"))


@query("default_price_lists", f"{over('headers', 'price_lists')} SELECT doc_id, min(price_lists.price_list_id) AS price_list_id FROM headers LEFT JOIN price_lists ON headers.company_id = price_lists.company_id AND headers.currency_code = price_lists.currency_code AND is_active AND is_default GROUP BY doc_id")
def default_price_lists(spark, sf):
    t = Tables(spark, sf)
    return P.default_price_list(t.headers().drop("price_list_id"), t.price_lists()).select("doc_id", "price_list_id")


@query("resolve_prices", f"""{over('lines', 'headers', 'price_lists', 'price_list_items', 'catalog')},
l AS (SELECT price_list_items.price_list_id, company_id, catalog_item_id, min(price) AS listed FROM price_list_items JOIN price_lists USING (price_list_id) WHERE is_active GROUP BY ALL)
SELECT lines.doc_id, position, coalesce(listed, sale_price, 0) AS unit_price, CASE WHEN listed IS NOT NULL THEN 'PRICE_LIST' WHEN sale_price IS NOT NULL THEN 'CATALOG' ELSE 'NONE' END AS price_source, coalesce(listed, sale_price, 0) * quantity AS subtotal
FROM lines JOIN headers USING (doc_id) LEFT JOIN l ON l.price_list_id = headers.price_list_id AND l.company_id = headers.company_id AND catalog_item_id = part LEFT JOIN catalog ON catalog.company_id = headers.company_id AND item_id = part""")
def resolve_prices(spark, sf):
    t = Tables(spark, sf)
    asked = t.lines().select("doc_id", "position", F.col("part").alias("catalog_item_id"), "quantity").join(t.headers().select("doc_id", "company_id", "price_list_id"), "doc_id")
    return P.resolve_prices(asked, t.price_lists(), t.price_list_items(), t.catalog()).select("doc_id", "position", F.col("unit_price").cast("double").alias("unit_price"), "price_source", "subtotal")


TAXED = """own AS (SELECT company_id, tax_rate_id, min(percentage) AS p FROM tax_rates WHERE is_active AND company_id IS NOT NULL GROUP BY ALL),
shared AS (SELECT tax_rate_id, min(percentage) AS p FROM tax_rates WHERE is_active AND company_id IS NULL AND is_system GROUP BY ALL)"""


@query("tax_resolution", f"""{over('headers', 'tax_rates')}, {TAXED} SELECT doc_id, CASE WHEN headers.tax_rate_id IS NULL THEN 0 ELSE coalesce(own.p, shared.p) END AS tax_percentage,
CASE WHEN headers.tax_rate_id IS NOT NULL AND coalesce(own.p, shared.p) IS NULL THEN 'TAX_RATE_NOT_FOUND' END AS tax_error
FROM headers LEFT JOIN own ON own.company_id = headers.company_id AND own.tax_rate_id = headers.tax_rate_id LEFT JOIN shared ON shared.tax_rate_id = headers.tax_rate_id""")
def tax_resolution(spark, sf):
    t = Tables(spark, sf)
    return P.resolve_tax(t.headers(), t.tax_rates()).select("doc_id", F.col("tax_percentage").cast("double").alias("tax_percentage"), "tax_error")


@query("visible_tax_rates", f"""{over('tax_rates')} SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY is_system DESC, name, tax_rate_id) AS position FROM (
SELECT n_nationkey AS company_id, tax_rate_id, percentage, is_system, name FROM nation JOIN tax_rates ON company_id = n_nationkey WHERE is_active UNION ALL
SELECT n_nationkey, tax_rate_id, percentage, is_system, name FROM nation, tax_rates WHERE company_id IS NULL AND is_system AND is_active)""")
def visible_tax_rates(spark, sf):
    t = Tables(spark, sf)
    tenants = t.raw("nation").select(F.col("n_nationkey").alias("company_id"))
    return P.visible_tax_rates(tenants, t.tax_rates()).select("company_id", "tax_rate_id", "percentage", "is_system", "name", "position")


@query("unit_fallback", """WITH u AS (SELECT s_suppkey AS unit_id, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS company_id, 'u' || (s_suppkey % 40) AS symbol FROM supplier),
own AS (SELECT company_id, symbol, min(unit_id) AS unit_id FROM u WHERE company_id IS NOT NULL GROUP BY ALL), shared AS (SELECT symbol, min(unit_id) AS unit_id FROM u WHERE company_id IS NULL GROUP BY ALL)
SELECT c_custkey AS request_id, coalesce(own.unit_id, shared.unit_id) AS unit_id FROM customer LEFT JOIN own ON own.company_id = c_nationkey AND own.symbol = 'u' || (c_custkey % 50) LEFT JOIN shared ON shared.symbol = 'u' || (c_custkey % 50)""")
def unit_fallback(spark, sf):
    t = Tables(spark, sf)
    k = F.col("s_suppkey")
    units = t.raw("supplier").select(k.alias("unit_id"), F.when(k % 3 > 0, F.col("s_nationkey")).alias("company_id"), F.concat(F.lit("u"), k % 40).alias("symbol"))
    asked = t.raw("customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("company_id"), F.concat(F.lit("u"), F.col("c_custkey") % 50).alias("symbol"))
    return P.resolve_units(asked, units).select("request_id", "unit_id")


@query("invalid_refs", f"""{over('lines', 'headers', 'price_lists', 'catalog', 'tax_rates')}, {TAXED}, r AS (
SELECT doc_id, CASE WHEN customer_id % 31 = 0 THEN 1 WHEN price_list_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM price_lists p WHERE p.is_active AND p.company_id = headers.company_id AND p.price_list_id = headers.price_list_id) THEN 2 END AS rule FROM headers
UNION ALL SELECT doc_id, CASE WHEN NOT EXISTS (SELECT 1 FROM catalog c WHERE c.is_active AND c.company_id = h.company_id AND c.item_id = lines.part) THEN 3 WHEN h.tax_rate_id IS NOT NULL AND own.p IS NULL AND shared.p IS NULL THEN 4 END
FROM lines JOIN headers h USING (doc_id) LEFT JOIN own ON own.company_id = h.company_id AND own.tax_rate_id = h.tax_rate_id LEFT JOIN shared ON shared.tax_rate_id = h.tax_rate_id)
SELECT doc_id, ['CUSTOMER_NOT_FOUND', 'PRICE_LIST_NOT_FOUND', 'CATALOG_ITEM_NOT_FOUND', 'TAX_RATE_NOT_FOUND'][min(rule)] AS error FROM r WHERE rule IS NOT NULL GROUP BY doc_id""")
def invalid_refs(spark, sf):
    t = Tables(spark, sf)
    customers = t.raw("customer").select(F.col("c_nationkey").alias("company_id"), F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 31 == 0).alias("is_deleted"))
    h = t.headers()
    lines = t.lines().select("doc_id", F.col("part").alias("catalog_item_id")).join(h.select("doc_id", "tax_rate_id"), "doc_id")
    return P.invalid_references(h, lines, customers, t.price_lists(), t.catalog(), t.tax_rates())


@query("customer_snapshots", f"""{over('headers')} SELECT doc_id, c_name AS customer_name, 'c' || customer_id || '@example.com' AS customer_contact, CASE WHEN customer_id % 3 = 0 THEN n_name ELSE 'Street ' || customer_id || ', ' || n_name END || ', KW' AS customer_address
FROM headers JOIN customer ON c_custkey = customer_id JOIN nation ON n_nationkey = c_nationkey WHERE customer_id % 31 > 0""")
def customer_snapshots(spark, sf):
    t = Tables(spark, sf)
    k = F.col("c_custkey")
    c = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_nationkey").alias("company_id"), k.alias("customer_id"), F.col("c_name").alias("name"), F.lit(" ").alias("phone"), F.concat(F.lit("c"), k, F.lit("@example.com")).alias("email"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Street "), k)).alias("street"), F.col("n_name").alias("city"), F.lit("KW").alias("country"), (k % 31 == 0).alias("is_deleted"),
    )
    return P.customer_snapshots(t.headers(), c).select("doc_id", "customer_name", "customer_contact", "customer_address")


@query("available_price_lists", f"{over('headers', 'price_lists')} SELECT doc_id, price_list_id FROM headers h WHERE EXISTS (SELECT 1 FROM price_lists p WHERE p.is_active AND p.company_id = h.company_id AND p.price_list_id = h.price_list_id AND p.currency_code = h.currency_code)")
def available_price_lists(spark, sf):
    t = Tables(spark, sf)
    return P.available_price_lists(t.headers(), t.price_lists()).select("doc_id", "price_list_id")


@query("canonical_lines", f"""{over('lines', 'headers', 'catalog')} SELECT doc_id, position AS line_id, CASE WHEN linked THEN type ELSE 'CUSTOM' END AS type, CASE WHEN linked THEN code END AS item_code, CASE WHEN linked THEN name ELSE item_name END AS item_name, CASE WHEN linked THEN description END AS description,
CASE WHEN linked THEN l.sale_price ELSE unit_price END AS unit_price, CASE WHEN linked THEN unit_id END AS unit_id, CASE WHEN linked THEN tax_rate_id END AS tax_rate_id, CASE WHEN linked AND NOT coalesce(is_active, false) THEN 'CATALOG_ITEM_NOT_AVAILABLE' WHEN linked AND unit_id % 3 = 0 THEN 'UNIT_NOT_AVAILABLE' END AS error
FROM (SELECT lines.*, catalog.* EXCLUDE (company_id), part % 2 = 0 AS linked FROM lines JOIN headers USING (doc_id) LEFT JOIN catalog ON part = item_id AND part % 2 = 0 AND part % 25 = catalog.company_id) l""")
def canonical_lines(spark, sf):
    t = Tables(spark, sf)
    linked = F.col("part") % 2 == 0
    lines = t.lines().join(t.headers().select("doc_id"), "doc_id")
    lines = lines.select("doc_id", F.col("position").alias("line_id"), (F.col("part") % 25).cast("int").alias("company_id"), F.when(linked, F.col("part")).alias("catalog_item_id"), F.lit("CUSTOM").alias("type"), F.lit(None).cast("string").alias("item_code"), "item_name", F.lit("").alias("description"), F.lit(None).cast("long").alias("unit_id"), "unit_price", F.lit(None).cast("long").alias("tax_rate_id"), "part")
    lines = lines.join(t.raw("part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("resolved_price")), "part", "left")
    units = t.raw("region").select(F.col("r_regionkey").cast("long").alias("unit_id"), F.lit(None).cast("int").alias("company_id"), (F.col("r_regionkey") % 3 != 0).alias("is_active"))
    own = t.raw("nation").select(F.lit(5).cast("long").alias("unit_id"), F.col("n_nationkey").alias("company_id"), F.lit(True).alias("is_active"))
    return P.canonical_lines(lines, t.catalog(), units.unionByName(own)).drop("company_id", "catalog_item_id")


EDITS = """e AS (SELECT doc_id, position AS line_id, item_name AS s_en, 'ar ' || part AS s_ar, CASE WHEN part % 3 = 0 THEN item_name || ' new' ELSE item_name END AS e_en, CASE WHEN part % 5 = 0 THEN 'ar new' ELSE 'ar ' || part END AS e_ar, part % 7 > 0 AS g_en, part % 4 > 0 AS g_ar, position > 6 AS is_new FROM lines)"""


@query("line_edit_merge", f"""{over('lines')}, {EDITS}, c AS (SELECT *, NOT is_new AND g_en AND e_en <> s_en AS c_en, NOT is_new AND g_ar AND e_ar <> s_ar AS c_ar FROM e)
SELECT doc_id, line_id, is_new, CASE WHEN is_new THEN e_ar WHEN c_en AND NOT c_ar THEN NULL WHEN g_ar THEN e_ar ELSE s_ar END AS item_name_ar, CASE WHEN is_new THEN e_en WHEN c_ar AND NOT c_en THEN NULL WHEN g_en THEN e_en ELSE s_en END AS item_name_en FROM c""")
def line_edit_merge(spark, sf):
    lines, part, none = Tables(spark, sf).lines(), F.col("part"), F.lit(None).cast("string")
    rest = [none.alias(f"{p}_{x}") for p in P.PAIRS[1:] for x in ("ar", "en")]
    stored = lines.where("position <= 6").select("doc_id", F.col("position").alias("line_id"), F.col("item_name").alias("item_name_en"), F.concat(F.lit("ar "), part).alias("item_name_ar"), *rest)
    present = F.filter(F.array(F.when(part % 7 > 0, "item_name_en"), F.when(part % 4 > 0, "item_name_ar")), lambda x: x.isNotNull())
    edits = lines.select("doc_id", F.col("position").alias("line_id"), F.when(part % 3 == 0, F.concat("item_name", F.lit(" new"))).otherwise(F.col("item_name")).alias("item_name_en"), F.when(part % 5 == 0, F.lit("ar new")).otherwise(F.concat(F.lit("ar "), part)).alias("item_name_ar"), present.alias("present"), *rest)
    return P.merge_line_edits(stored, edits).select("doc_id", "line_id", "is_new", "item_name_ar", "item_name_en")


@query("retax_lines", f"""{over('lines', 'headers', 'tax_rates')}, {TAXED}, e AS (SELECT lines.doc_id, position AS line_id, headers.company_id, CASE WHEN part % 6 > 0 THEN part % 11 END AS tax_rate_id, CASE WHEN part % 6 > 0 AND part % 3 > 0 THEN part % 11 ELSE 1 END AS old, tax_percentage AS stored, part % 4 = 0 AS refresh FROM lines JOIN headers USING (doc_id)),
k AS (SELECT *, tax_rate_id IS NOT NULL AND tax_rate_id = old AND NOT refresh AS kept FROM e)
SELECT doc_id, line_id, coalesce(kept, false) AS kept, CASE WHEN kept THEN stored WHEN k.tax_rate_id IS NULL THEN 0 ELSE coalesce(own.p, shared.p) END AS tax_percentage, CASE WHEN NOT coalesce(kept, false) AND k.tax_rate_id IS NOT NULL AND coalesce(own.p, shared.p) IS NULL THEN 'TAX_RATE_NOT_FOUND' END AS tax_error
FROM k LEFT JOIN own ON own.company_id = k.company_id AND own.tax_rate_id = k.tax_rate_id LEFT JOIN shared ON shared.tax_rate_id = k.tax_rate_id""")
def retax_lines(spark, sf):
    t, part = Tables(spark, sf), F.col("part")
    lines = t.lines().join(t.headers().select("doc_id", "company_id"), "doc_id")
    rate = F.when(part % 6 > 0, part % 11)
    stored = lines.select("doc_id", F.col("position").alias("line_id"), F.when((part % 6 > 0) & (part % 3 > 0), part % 11).otherwise(F.lit(1)).alias("tax_rate_id"), "tax_percentage")
    edits = lines.select("doc_id", F.col("position").alias("line_id"), "company_id", rate.alias("tax_rate_id"), (part % 4 == 0).alias("refresh"))
    return P.retax_lines(stored, edits, t.tax_rates()).select("doc_id", "line_id", "kept", F.col("tax_percentage").cast("double").alias("tax_percentage"), "tax_error")


@query("canonical_units", """SELECT p_partkey AS item_id, CASE p_partkey % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'm' WHEN 2 THEN 'pcs' WHEN 3 THEN 'mm' WHEN 4 THEN 'Box' ELSE p_name END AS unit FROM part""")
def canonical_units(spark, sf):
    p, k = Tables(spark, sf).raw("part"), F.col("p_partkey")
    given = F.element_at(F.array(F.lit(" KGs "), F.lit("METERS"), F.lit("Pieces"), F.lit("mm"), F.lit("Box"), F.col("p_name")), (k % 6 + 1).cast("int"))
    return p.select(k.alias("item_id"), canonical_unit(given).alias("unit"))
