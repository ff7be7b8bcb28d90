"""Prices, price lists, taxes, units and references of document lines.

Dimension tables are joined without a hint: the optimizer broadcasts them while
they are small by its own measure and shuffles them beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def default_price_list(requests: DataFrame, price_lists: DataFrame) -> DataFrame:
    """Adds price_list_id: the active default list of (company_id, currency_code); of
    several the first by id. A request without a currency has none."""
    lists = price_lists.where("is_active and is_default").groupBy("company_id", "currency_code").agg(F.min("price_list_id").alias("price_list_id"))
    return requests.join(lists, ["company_id", "currency_code"], "left")


def resolve_prices(requests: DataFrame, price_lists: DataFrame, entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds unit_price, price_source and subtotal (unrounded): the listed price where
    the request's list is active and the company's own (a listed 0 stands), else
    the item's sale price, else 0."""
    usable = price_lists.where("is_active").select("price_list_id", "company_id")
    listed = entries.join(usable, "price_list_id").groupBy("price_list_id", "company_id", "catalog_item_id").agg(F.min("price").alias("__listed"))
    sale = catalog.groupBy("company_id", F.col("item_id").alias("catalog_item_id")).agg(F.min("sale_price").alias("__sale"))
    out = requests.join(listed, ["price_list_id", "company_id", "catalog_item_id"], "left").join(sale, ["company_id", "catalog_item_id"], "left")
    source = F.when(F.col("__listed").isNotNull(), "PRICE_LIST").when(F.col("__sale").isNotNull(), "CATALOG").otherwise("NONE")
    price = F.coalesce("__listed", "__sale", F.lit(0).cast("decimal(18,3)"))
    out = out.withColumn("unit_price", price).withColumn("price_source", source)
    return out.withColumn("subtotal", F.col("unit_price").cast("double") * F.col("quantity").cast("double")).drop("__listed", "__sale")


def _own_or_shared(requests: DataFrame, rates: DataFrame, key: str, fields: list[str], shared: str = "true") -> DataFrame:
    """Joins the company's own row by (company_id, key), else the shared one by key:
    two equi-joins in the place of a join with OR."""
    own = rates.where("company_id is not null").groupBy("company_id", key).agg(*[F.min_by(f, F.struct(key, *fields)).alias(f"__own_{f}") for f in fields])
    common = rates.where(f"company_id is null and ({shared})").groupBy(key).agg(*[F.min_by(f, F.struct(key, *fields)).alias(f"__all_{f}") for f in fields])
    out = requests.join(own, ["company_id", key], "left").join(common, key, "left")
    mine = F.col(f"__own_{fields[0]}").isNotNull()
    out = out.select("*", *[F.when(mine, F.col(f"__own_{f}")).otherwise(F.col(f"__all_{f}")).alias(f) for f in fields])
    return out.drop(*[f"__{side}_{f}" for side in ("own", "all") for f in fields])


def resolve_tax(lines: DataFrame, tax_rates: DataFrame, active_only: bool = True) -> DataFrame:
    """Adds tax_percentage and tax_error: the rate must be the company's or a shared
    system one; a line without tax_rate_id has 0."""
    rates = tax_rates.where("is_active") if active_only else tax_rates
    out = _own_or_shared(lines, rates.withColumn("__p", F.col("percentage")), "tax_rate_id", ["__p"], "is_system")
    missing = F.col("tax_rate_id").isNotNull() & F.col("__p").isNull()
    return out.withColumn("tax_percentage", F.when(F.col("tax_rate_id").isNull(), F.lit(0).cast("decimal(5,2)")).otherwise(F.col("__p"))).withColumn("tax_error", F.when(missing, "TAX_RATE_NOT_FOUND")).drop("__p")


def resolve_units(requests: DataFrame, units: DataFrame) -> DataFrame:
    """Adds unit_id for symbol: the company's own unit, else the shared one."""
    return _own_or_shared(requests, units, "symbol", ["unit_id"])


def visible_tax_rates(tenants: DataFrame, tax_rates: DataFrame) -> DataFrame:
    """The active rates each company sees, its own and the shared system ones, in
    display order: system first, then by name."""
    active = tax_rates.where("is_active")
    own = tenants.select("company_id").join(active, "company_id")
    # Every company sees every shared rate: by nature a row for each pair, in as many tasks
    # as there are companies dealt by a hash, each with the shared rates once.
    deals = int(tenants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = active.where("company_id is null and is_system").drop("company_id").withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = tenants.select("company_id", F.pmod(F.xxhash64("company_id"), F.lit(deals)).cast("int").alias("__deal"))
    out = own.unionByName(dealt.join(shared, "__deal").select(*own.columns))
    order = Window.partitionBy("company_id").orderBy(F.desc("is_system"), "name", "tax_rate_id")
    return out.withColumn("position", F.row_number().over(order))


def invalid_references(docs: DataFrame, lines: DataFrame, customers: DataFrame, price_lists: DataFrame, catalog: DataFrame, tax_rates: DataFrame) -> DataFrame:
    """(doc_id, error) for documents with a bad reference: the first of customer, price
    list, catalog item, tax rate."""
    flag = lambda df, keys: df.select(*keys).distinct().withColumn("__ok", F.lit(True))
    head = docs.join(flag(customers.where("not is_deleted"), ["company_id", "customer_id"]), ["company_id", "customer_id"], "left")
    head = head.select("doc_id", "company_id", "price_list_id", F.col("customer_id").isNotNull().alias("__has"), F.col("__ok").alias("__customer"))
    head = head.join(flag(price_lists.where("is_active"), ["company_id", "price_list_id"]), ["company_id", "price_list_id"], "left")
    head = head.select("doc_id", F.when(F.col("__has") & F.col("__customer").isNull(), 1).when(F.col("price_list_id").isNotNull() & F.col("__ok").isNull(), 2).alias("rule"))
    of = lines.join(docs.select("doc_id", "company_id"), "doc_id")
    of = of.join(flag(catalog.where("is_active").withColumnRenamed("item_id", "catalog_item_id"), ["company_id", "catalog_item_id"]), ["company_id", "catalog_item_id"], "left").withColumnRenamed("__ok", "__item")
    of = resolve_tax(of.select("doc_id", "company_id", "catalog_item_id", "tax_rate_id", "__item"), tax_rates)
    rule = F.when(F.col("catalog_item_id").isNotNull() & F.col("__item").isNull(), 3).when(F.col("tax_error").isNotNull(), 4)
    worst = head.unionByName(of.select("doc_id", rule.alias("rule"))).where("rule is not null").groupBy("doc_id").agg(F.min("rule").alias("rule"))
    code = F.element_at(F.array(*map(F.lit, ["CUSTOMER_NOT_FOUND", "PRICE_LIST_NOT_FOUND", "CATALOG_ITEM_NOT_FOUND", "TAX_RATE_NOT_FOUND"])), F.col("rule"))
    return worst.select("doc_id", code.alias("error"))


def customer_snapshots(docs: DataFrame, customers: DataFrame) -> DataFrame:
    """Adds customer_name, customer_contact and customer_address (the parts that are
    not empty, joined by ', ') as they stand now."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    address = F.nullif(F.concat_ws(", ", some("street"), some("city"), some("country")), F.lit(""))
    now = customers.where("not is_deleted").select("company_id", "customer_id", F.col("name").alias("customer_name"), F.coalesce(some("phone"), some("email")).alias("customer_contact"), address.alias("customer_address"))
    return docs.join(now, ["company_id", "customer_id"])


def available_price_lists(docs: DataFrame, price_lists: DataFrame) -> DataFrame:
    """The documents whose price list exists for their company and currency, active."""
    return docs.join(price_lists.where("is_active"), ["company_id", "price_list_id", "currency_code"], "left_semi")


def canonical_lines(lines: DataFrame, catalog: DataFrame, units: DataFrame) -> DataFrame:
    """Contract lines in their stored form.  A linked line takes type, code, name and
    unit from its item, the price from ``resolved_price`` (the client's is ignored) and
    the item's tax where it has none; a free line keeps its own."""
    item = catalog.select("company_id", F.col("item_id").alias("catalog_item_id"), F.col("type").alias("__type"), F.col("code").alias("__code"), F.col("name").alias("__name"), F.col("description").alias("__text"), F.col("unit_id").alias("__unit"), F.col("tax_rate_id").alias("__tax"), F.col("is_active").alias("__active"))
    out = lines.join(item, ["company_id", "catalog_item_id"], "left")
    ok = units.where("is_active").select(F.col("unit_id").alias("__unit"), F.col("company_id").alias("__of"))
    own = ok.where("__of is not null").select("__unit", F.col("__of").alias("company_id"), F.lit(True).alias("__mine")).distinct()
    shared = ok.where("__of is null").select("__unit", F.lit(True).alias("__ours")).distinct()
    out = out.join(own, ["company_id", "__unit"], "left").join(shared, "__unit", "left")
    linked = F.col("catalog_item_id").isNotNull()
    error = F.when(linked & ~F.coalesce("__active", F.lit(False)), "CATALOG_ITEM_NOT_AVAILABLE").when(linked & F.coalesce("__mine", "__ours").isNull(), "UNIT_NOT_AVAILABLE")
    pick = lambda from_item, own: F.when(linked, F.col(from_item)).otherwise(F.col(own))
    return out.select(
        "doc_id", "line_id", "company_id", "catalog_item_id", pick("__type", "type").alias("type"), pick("__code", "item_code").alias("item_code"), pick("__name", "item_name").alias("item_name"),
        F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.when(linked, F.col("__text"))).alias("description"), pick("__unit", "unit_id").alias("unit_id"),
        F.when(linked, F.col("resolved_price")).otherwise(F.col("unit_price")).alias("unit_price"), F.coalesce("tax_rate_id", F.when(linked, F.col("__tax"))).alias("tax_rate_id"), error.alias("error"),
    )


#: Text pairs of a line, each in Arabic and English.
PAIRS = ["item_name", "description", "unit_name"]


def merge_line_edits(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited lines over stored ones, by (doc_id, line_id).  ``present`` of an edit names the
    fields it supplies; others keep the stored value.  Where one language of a pair
    changed and the other was not supplied, or not changed, the other goes blank.
    An unknown line is taken as it is."""
    old = stored.select("doc_id", "line_id", F.lit(True).alias("__known"), *[F.col(f"{p}_{x}").alias(f"__{p}_{x}") for p in PAIRS for x in ("ar", "en")])
    both = edits.join(old, ["doc_id", "line_id"], "left")
    given = lambda f: F.array_contains("present", f)
    out = []
    for p in PAIRS:
        changed = {x: given(f"{p}_{x}") & ~F.col(f"{p}_{x}").eqNullSafe(F.col(f"__{p}_{x}")) for x in ("ar", "en")}
        for x, other in (("ar", "en"), ("en", "ar")):
            kept = F.when(given(f"{p}_{x}"), F.col(f"{p}_{x}")).otherwise(F.col(f"__{p}_{x}"))
            value = F.when(changed[other] & ~changed[x], F.lit(None).cast("string")).otherwise(kept)
            out.append(F.when(F.col("__known").isNull(), F.col(f"{p}_{x}")).otherwise(value).alias(f"{p}_{x}"))
    return both.select("doc_id", "line_id", F.col("__known").isNull().alias("is_new"), *out)


def retax_lines(stored: DataFrame, edits: DataFrame, tax_rates: DataFrame) -> DataFrame:
    """Adds tax_percentage, kept and tax_error to edits (doc_id, line_id, company_id,
    tax_rate_id, refresh): the same rate on the same line keeps its percentage unless
    refresh is asked; otherwise the active rate's; none gives 0."""
    old = stored.select("doc_id", "line_id", F.col("tax_rate_id").alias("__rate"), F.col("tax_percentage").alias("__stored"))
    out = resolve_tax(edits, tax_rates).join(old, ["doc_id", "line_id"], "left")
    keep = F.col("tax_rate_id").isNotNull() & F.coalesce(F.col("tax_rate_id") == F.col("__rate"), F.lit(False)) & ~F.col("refresh")
    return out.withColumn("tax_percentage", F.when(keep, F.col("__stored")).otherwise(F.col("tax_percentage"))).withColumn("kept", keep).withColumn("tax_error", F.when(~keep, F.col("tax_error"))).drop("__rate", "__stored")
