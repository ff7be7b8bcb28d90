"""The register, and stand-ins: the given tables seen as commercial ones.

Each stand-in is there twice, as a DataFrame and as a common table expression of the
same name, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


class Tables:
    """Stand-ins over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Quotation lines; positions are counted within the order."""
        li = spread(self.raw("lineitem"), "l_orderkey")
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
        return li.select(
            F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("position"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
            F.concat(F.lit("item "), F.col("l_partkey")).alias("item_name"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.when(F.col("l_discount") > 0, "PERCENTAGE").alias("discount_type"), (F.col("l_discount") * F.lit(100.0)).alias("discount_value"), (F.col("l_tax") * F.lit(100.0)).alias("tax_percentage"),
        )

    def headers(self) -> DataFrame:
        """Quotations; the company is the nation of the customer."""
        o, c = self.raw("orders"), self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("company_id"))
        k = F.col("o_orderkey")
        return o.join(c, "o_custkey", "left").select(
            k.alias("doc_id"), "company_id", F.col("o_custkey").alias("customer_id"), F.concat(F.lit("Q-"), k).alias("number"),
            F.when(k % 4 == 1, "PERCENTAGE").when(k % 4 == 2, "FIXED").alias("discount_type"), F.when(k % 4 == 1, F.lit(5.0)).when(k % 4 == 2, F.lit(100.5)).alias("discount_value"),
            F.element_at(F.array(*map(F.lit, ["KWD", "USD", "EUR"])), (k % 3 + 1).cast("int")).alias("currency_code"), F.when(k % 5 > 0, k % 97).alias("price_list_id"),
            F.when(k % 7 > 0, k % 11).alias("tax_rate_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), (k % 13 == 0).alias("is_deleted"),
        )

    def catalog(self) -> DataFrame:
        """Tenant items: part p belongs to company p % 25."""
        p, k = self.raw("part"), F.col("p_partkey")
        return p.select(
            (k % 25).cast("int").alias("company_id"), k.alias("item_id"), F.concat(F.lit("P-"), k).alias("code"), F.col("p_name").alias("name"), F.concat(F.lit("SKU"), k % 900).alias("sku"), F.lpad((k % 1500).cast("string"), 13, "0").alias("barcode"),
            F.concat_ws(" ", "p_type", "p_name").alias("description"), F.when(k % 3 == 0, "SERVICE").otherwise("PRODUCT").alias("type"), (k % 9).alias("category_id"), (k % 6).alias("unit_id"), (k % 11).alias("tax_rate_id"),
            F.col("p_retailprice").alias("sale_price"), (k % 17 != 0).alias("is_active"), F.timestamp_seconds(F.lit(1700000000) + k * 60).alias("created_at"),
        )

    def library(self) -> DataFrame:
        """Shared items: part as made by its brand."""
        p, k = self.raw("part"), F.col("p_partkey")
        return p.select(
            k.alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("maker"), F.concat_ws("-", "p_type", "p_size").alias("model_number"), F.col("p_type").alias("type_name"),
            F.lpad((k % 1500).cast("string"), 13, "0").alias("gtin"), (k % 19 != 0).alias("is_active"), F.timestamp_seconds(F.lit(1690000000) + k * 60).alias("created_at"),
        )

    def price_lists(self) -> DataFrame:
        s, k = self.raw("supplier"), F.col("s_suppkey")
        return s.select(k.alias("price_list_id"), F.col("s_nationkey").alias("company_id"), F.element_at(F.array(*map(F.lit, ["KWD", "USD", "EUR"])), (k % 3 + 1).cast("int")).alias("currency_code"), (k % 2 == 0).alias("is_default"), (k % 5 != 0).alias("is_active"))

    def price_list_items(self) -> DataFrame:
        """Every list has a price for the parts whose number leaves its remainder by 3."""
        p = self.raw("part").where("p_partkey % 3 = 0").select((F.col("p_partkey") % 97).alias("price_list_id"), F.col("p_partkey").alias("catalog_item_id"), (F.col("p_retailprice") * F.when(F.col("p_partkey") % 21 == 0, 0.0).otherwise(0.9)).alias("price"))
        return p

    def tax_rates(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        own = n.select((k % 11).cast("long").alias("tax_rate_id"), k.alias("company_id"), (F.lit(1.0) * (k % 7)).alias("percentage"), F.lit(False).alias("is_system"), (k % 6 != 0).alias("is_active"), F.col("n_name").alias("name"))
        shared = self.raw("region").select(F.col("r_regionkey").cast("long").alias("tax_rate_id"), F.lit(None).cast("int").alias("company_id"), (F.lit(5.0) + F.col("r_regionkey")).alias("percentage"), (F.col("r_regionkey") % 2 == 0).alias("is_system"), F.lit(True).alias("is_active"), F.col("r_name").alias("name"))
        return own.unionByName(shared)


CTE = {
    "lines": """lines AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS position,
  l_partkey AS part, l_suppkey AS supp, 'item ' || l_partkey AS item_name, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
  CASE WHEN l_discount > 0 THEN 'PERCENTAGE' END AS discount_type, l_discount * CAST(100 AS DOUBLE) AS discount_value, l_tax * CAST(100 AS DOUBLE) AS tax_percentage FROM lineitem)""",
    "headers": """headers AS (SELECT o_orderkey AS doc_id, c_nationkey AS company_id, o_custkey AS customer_id, 'Q-' || o_orderkey AS number,
  CASE o_orderkey % 4 WHEN 1 THEN 'PERCENTAGE' WHEN 2 THEN 'FIXED' END AS discount_type, CASE o_orderkey % 4 WHEN 1 THEN CAST(5 AS DOUBLE) WHEN 2 THEN CAST(100.5 AS DOUBLE) END AS discount_value,
  ['KWD', 'USD', 'EUR'][CAST(o_orderkey % 3 + 1 AS INT)] AS currency_code, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 97 END AS price_list_id,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 11 END AS tax_rate_id, o_orderstatus AS status, o_orderdate AS created_at, o_orderkey % 13 = 0 AS is_deleted
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "catalog": """catalog AS (SELECT CAST(p_partkey % 25 AS INT) AS company_id, p_partkey AS item_id, 'P-' || p_partkey AS code, p_name AS name, 'SKU' || (p_partkey % 900) AS sku, lpad(CAST(p_partkey % 1500 AS VARCHAR), 13, '0') AS barcode,
  p_type || ' ' || p_name AS description, CASE WHEN p_partkey % 3 = 0 THEN 'SERVICE' ELSE 'PRODUCT' END AS type, p_partkey % 9 AS category_id, p_partkey % 6 AS unit_id, p_partkey % 11 AS tax_rate_id,
  p_retailprice AS sale_price, p_partkey % 17 <> 0 AS is_active, make_timestamp((1700000000 + p_partkey * 60) * 1000000) AS created_at FROM part)""",
    "library": """library AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS maker, p_type || '-' || p_size AS model_number, p_type AS type_name,
  lpad(CAST(p_partkey % 1500 AS VARCHAR), 13, '0') AS gtin, p_partkey % 19 <> 0 AS is_active, make_timestamp((1690000000 + p_partkey * 60) * 1000000) AS created_at FROM part)""",
    "price_lists": """price_lists AS (SELECT s_suppkey AS price_list_id, s_nationkey AS company_id, ['KWD', 'USD', 'EUR'][CAST(s_suppkey % 3 + 1 AS INT)] AS currency_code, s_suppkey % 2 = 0 AS is_default, s_suppkey % 5 <> 0 AS is_active FROM supplier)""",
    "price_list_items": """price_list_items AS (SELECT p_partkey % 97 AS price_list_id, p_partkey AS catalog_item_id, p_retailprice * CASE WHEN p_partkey % 21 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS price FROM part WHERE p_partkey % 3 = 0)""",
    "tax_rates": """tax_rates AS (SELECT CAST(n_nationkey % 11 AS BIGINT) AS tax_rate_id, n_nationkey AS company_id, CAST(n_nationkey % 7 AS DOUBLE) AS percentage, false AS is_system, n_nationkey % 6 <> 0 AS is_active, n_name AS name FROM nation
  UNION ALL SELECT CAST(r_regionkey AS BIGINT), NULL, CAST(5 AS DOUBLE) + r_regionkey, r_regionkey % 2 = 0, true, r_name FROM region)""",
}


def over(*names: str) -> str:
    """WITH and the stand-ins of these names; more may follow after a comma."""
    return "WITH " + ", ".join(CTE[n] for n in names)
