"""Adoption of library items into a company's own catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adopt_items(requests: DataFrame, items: DataFrame, adoptions: DataFrame, catalog: DataFrame, units: DataFrame, tax_rates: DataFrame) -> DataFrame:
    """A verdict per request: NEW, EXISTING or the first error, with the catalogue row to
    insert where it is NEW.

    requests: request_id, company_id, universal_item_id, code, sale_price, unit_id,
    tax_rate_id; adoptions: company_id, universal_item_id, catalog_item_id.  Checks in
    order: code pattern, price, item exists, item active, adoption exists, unit, tax, code
    clash.  Of several new requests of a company for one item, or one code, the first by
    request_id is new; the rest find it there.
    """
    code = F.coalesce(F.upper(F.trim("code")), F.concat(F.lit("UCL-"), F.upper(F.col("universal_item_id").cast("string"))))
    r = requests.withColumn("code", code)
    r = r.join(items.select(F.col("item_id").alias("universal_item_id"), F.col("name").alias("__name"), F.col("is_active").alias("__active")), "universal_item_id", "left")
    r = r.join(adoptions.select("company_id", "universal_item_id", F.col("catalog_item_id").alias("__cat")), ["company_id", "universal_item_id"], "left")
    for key, table, extra in (("unit_id", units, "true"), ("tax_rate_id", tax_rates, "is_system")):
        own = table.where("company_id is not null").select("company_id", key, F.lit(True).alias(f"__own_{key}")).distinct()
        shared = table.where(f"company_id is null and ({extra})").select(key, F.lit(True).alias(f"__all_{key}")).distinct()
        r = r.join(own, ["company_id", key], "left").join(shared, key, "left")
    r = r.join(catalog.select("company_id", F.col("code"), F.lit(True).alias("__clash")).distinct(), ["company_id", "code"], "left")
    lost = lambda k: F.col(k).isNotNull() & F.coalesce(f"__own_{k}", f"__all_{k}").isNull()
    first = (
        F.when(~F.col("code").rlike("^[A-Z0-9][A-Z0-9_-]{0,49}$"), "CODE_INVALID").when(F.col("sale_price") < 0, "PRICE_INVALID").when(F.col("__active").isNull(), "ITEM_NOT_FOUND")
        .when(~F.col("__active"), "ITEM_INACTIVE").when(F.col("__cat").isNotNull(), "EXISTING").when(lost("unit_id"), "UNIT_NOT_FOUND").when(lost("tax_rate_id"), "TAX_RATE_NOT_FOUND").when(F.col("__clash"), "CODE_TAKEN").otherwise("NEW")
    )
    r = r.withColumn("verdict", first)
    fresh = r.where("verdict = 'NEW'")
    by_item = fresh.groupBy("company_id", "universal_item_id").agg(F.min("request_id").alias("__item_first"))
    by_code = fresh.groupBy("company_id", "code").agg(F.min("request_id").alias("__code_first"))
    r = r.join(by_item, ["company_id", "universal_item_id"], "left").join(by_code, ["company_id", "code"], "left")
    new = F.col("verdict") == "NEW"
    verdict = F.when(new & (F.col("request_id") != F.col("__item_first")), "EXISTING").when(new & (F.col("request_id") != F.col("__code_first")), "CODE_TAKEN").otherwise(F.col("verdict"))
    r = r.withColumn("verdict", verdict)
    only = lambda c: F.when(F.col("verdict") == "NEW", c)
    return r.select("request_id", "company_id", "universal_item_id", "verdict", only(F.col("code")).alias("code"), only(F.col("__name")).alias("name"), only(F.coalesce("sale_price", F.lit(0).cast("double"))).alias("sale_price"), F.when(F.col("verdict") == "EXISTING", F.col("__cat")).alias("catalog_item_id"))
