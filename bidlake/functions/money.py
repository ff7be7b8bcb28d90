"""Money in three decimals: rounding, line amounts, document totals.

Line arithmetic is in doubles, rounded to three decimals after every step, in a
fixed order; results are decimals at the edge and are summed as such, so sums do
not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,3)"
_EPSILON = 2.0**-52


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round3(v) -> Column:
    """Half up to three decimals, on doubles."""
    return F.floor((_col(v).cast("double") + F.lit(_EPSILON)) * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(1000.0)


def discount_amount(base: Column, kind, value) -> Column:
    """The discount on an amount; an unknown kind gives null (see discount_error)."""
    kind, value = _col(kind), _col(value).cast("double")
    return F.when(kind.isNull(), F.lit(0.0)).when(kind == "PERCENTAGE", round3(base * (value / F.lit(100.0)))).when(kind == "FIXED", round3(value))


def discount_error(base: Column, kind, value) -> Column:
    kind, value = _col(kind), _col(value).cast("double")
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))
    return F.when(kind.isNull(), F.lit(None).cast("string")).when(bad, "DISCOUNT_VALUE_INVALID").when(kind == "PERCENTAGE", F.when(value > 100, "DISCOUNT_PERCENT_TOO_HIGH")).when(
        kind == "FIXED", F.when(value > base, "DISCOUNT_EXCEEDS_BASE")
    ).otherwise("DISCOUNT_TYPE_UNSUPPORTED")


def line_error(quantity="quantity", price="unit_price", tax="tax_percentage", position="position", name="item_name", kind="discount_type", value="discount_value") -> Column:
    """The first rule a line breaks, or null."""
    q, p, t = (_col(c).cast("double") for c in (quantity, price, tax))
    pos = _col(position)
    no = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(
        F.when(pos.isNull() | (pos < 1), "POSITION_INVALID"),
        F.when(F.coalesce(F.trim(_col(name)), F.lit("")) == "", "NAME_REQUIRED"),
        F.when(no(q) | (q <= 0), "QUANTITY_INVALID"),
        F.when(no(p) | (p < 0), "PRICE_INVALID"),
        F.when(t.isNotNull() & (no(t) | (t < 0) | (t > 100)), "TAX_INVALID"),
        discount_error(round3(q * p), kind, value),
    )


def with_line_amounts(lines: DataFrame) -> DataFrame:
    """Adds subtotal, discount_amount, tax_amount, total_amount (decimals)."""
    subtotal = round3(F.col("quantity").cast("double") * F.col("unit_price").cast("double"))
    tax = F.coalesce(F.col("tax_percentage").cast("double"), F.lit(0.0))
    out = lines.withColumn("__s", subtotal).withColumn("__d", discount_amount(F.col("__s"), "discount_type", "discount_value"))
    out = out.withColumn("__b", round3(F.col("__s") - F.col("__d"))).withColumn("__t", round3(F.col("__b") * (tax / F.lit(100.0))))
    out = out.withColumn("__all", round3(F.col("__b") + F.col("__t")))
    named = {"__s": "subtotal", "__d": "discount_amount", "__t": "tax_amount", "__all": "total_amount"}
    return out.select(*lines.columns, *[F.col(c).cast(MONEY).alias(n) for c, n in named.items()])


def document_totals(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Per document (doc_id of headers, with its discount_type and discount_value):
    line_count, subtotal, discount_amount, tax_amount, total_amount, error.

    ``error`` is the document's first: no lines, a repeated position, the first bad
    line by position, or the document discount; amounts are then null.  The tax
    ratio is rounded before it scales the discount.
    """
    checked = with_line_amounts(lines.withColumn("__error", line_error()))
    sums = checked.groupBy("doc_id").agg(
        F.count("*").alias("line_count"), F.size(F.collect_set("position")).alias("__positions"),
        F.min(F.when(F.col("__error").isNotNull(), F.struct("position", F.col("__error").alias("e")))).alias("__first"),
        F.sum(F.col("subtotal") - F.col("discount_amount")).alias("__net"), F.sum("tax_amount").alias("__tax"),
    )
    docs = headers.select("doc_id", "discount_type", "discount_value").join(sums, "doc_id", "left")
    docs = docs.withColumn("__s", round3("__net"))
    docs = docs.withColumn("__d", discount_amount(F.col("__s"), "discount_type", "discount_value")).withColumn("__before", round3("__tax"))
    ratio = F.when(F.col("__s") > 0, round3(F.col("__before") / F.col("__s"))).otherwise(F.lit(0.0))
    docs = docs.withColumn("__t", round3(F.col("__before") - F.col("__d") * ratio)).withColumn("__all", round3(F.col("__s") - F.col("__d") + F.col("__t")))
    error = F.coalesce(
        F.when(F.col("line_count").isNull(), "NO_LINES"), F.when(F.col("__positions") < F.col("line_count"), "DUPLICATE_POSITION"),
        F.col("__first.e"), discount_error(F.col("__s"), "discount_type", "discount_value"),
    )
    docs = docs.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), F.col(c).cast(MONEY))
    return docs.select(
        "doc_id", F.coalesce("line_count", F.lit(0)).alias("line_count"), good("__s").alias("subtotal"), good("__d").alias("discount_amount"),
        good("__t").alias("tax_amount"), good("__all").alias("total_amount"), "error",
    )


def currency_error(currency) -> Column:
    return F.when(~F.coalesce(F.upper(F.trim(_col(currency))).rlike("^[A-Z]{3}$"), F.lit(False)), "CURRENCY_INVALID")
