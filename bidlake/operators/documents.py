"""Documents: conversion, checks, numbering, lifecycles and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import currency_error
from ..functions.text import messaging_phone, trim_u

#: The allowed status changes, by kind of record.
TRANSITIONS = {
    "ingestion": {
        "RECEIVED": ["NORMALIZED", "MATCHED", "NEEDS_REVIEW", "REJECTED", "FAILED"],
        "NORMALIZED": ["PROCESSING", "NEEDS_REVIEW", "REJECTED", "FAILED"],
        "MATCHED": ["PROCESSING", "NEEDS_REVIEW", "REJECTED", "FAILED"],
        "PROCESSING": ["PUBLISHED", "REJECTED", "FAILED"],
        "PUBLISHED": ["NEEDS_REVIEW"],
        "NEEDS_REVIEW": ["NORMALIZED", "MATCHED", "REJECTED"],
        "REJECTED": ["NORMALIZED", "MATCHED", "NEEDS_REVIEW", "REJECTED", "FAILED"],
        "FAILED": ["NORMALIZED", "MATCHED", "NEEDS_REVIEW", "REJECTED", "FAILED"],
    },
    "quotation": {"DRAFT": ["SENT", "EXPIRED", "CANCELLED"], "SENT": ["APPROVED", "REJECTED", "EXPIRED", "CANCELLED"], "APPROVED": ["CANCELLED"]},
    "order": {"DRAFT": ["CONFIRMED", "CANCELLED"], "CONFIRMED": ["CANCELLED"]},
    "delivery": {"PENDING": ["SENT", "FAILED"]},
}


def transition_rules(spark: SparkSession, kinds: list[str] | None = None) -> DataFrame:
    rows = [(k, a, b) for k, froms in TRANSITIONS.items() if kinds is None or k in kinds for a, tos in froms.items() for b in tos]
    return spark.createDataFrame(rows, "kind string, from_status string, to_status string")


def audit_transitions(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds previous and allowed to events (entity_id, kind, status, at, id): the first
    status of a record and a repeated one are allowed, others by rule."""
    w = Window.partitionBy("kind", "entity_id").orderBy("at", "id")
    e = events.withColumn("previous", F.lag("status").over(w))
    r = rules.select("kind", F.col("from_status").alias("previous"), F.col("to_status").alias("status"), F.lit(True).alias("__ok")).distinct()
    e = e.join(r, ["kind", "previous", "status"], "left")
    free = F.col("previous").isNull() | (F.col("previous") == F.col("status"))
    return e.withColumn("allowed", free | F.coalesce("__ok", F.lit(False))).drop("__ok")


def orders_from_quotations(quotations: DataFrame, lines: DataFrame, existing: DataFrame) -> DataFrame:
    """A verdict per quotation, and the order's number where it is READY.

    quotations: doc_id, number, status, is_deleted, approved_at, approved_by_name,
    approved_by_role, customer_name, currency_code, subtotal, discount_amount,
    tax_amount, total_amount; lines: doc_id, position, quantity, unit_price, item_name;
    existing: source_quotation_id.
    """
    blank = lambda c: F.coalesce(trim_u(c), F.lit("")) == ""
    bad_line = (F.col("quantity") <= 0) | (F.col("unit_price") < 0) | blank("item_name")
    per = lines.groupBy("doc_id").agg(F.count("*").alias("__n"), F.min("position").alias("__lo"), F.max("position").alias("__hi"), F.count_distinct("position").alias("__d"), F.bool_or(bad_line).alias("__bad"))
    q = quotations.join(per, "doc_id", "left").join(existing.select(F.col("source_quotation_id").alias("doc_id"), F.lit(True).alias("__order")).distinct(), "doc_id", "left")
    contiguous = (F.col("__lo") == 1) & (F.col("__hi") == F.col("__n")) & (F.col("__d") == F.col("__n"))
    money = [F.col(c) < 0 for c in ("subtotal", "discount_amount", "tax_amount", "total_amount")]
    negative = F.coalesce(money[0] | money[1] | money[2] | money[3], F.lit(False))
    broken = F.col("__n").isNull() | ~contiguous | F.col("__bad") | negative | currency_error("currency_code").isNotNull() | blank("customer_name")
    verdict = (
        F.when(F.col("is_deleted"), "QUOTATION_NOT_FOUND").when(F.col("__order"), "EXISTING").when(F.col("status") != "APPROVED", "INVALID_QUOTATION_STATUS")
        .when(F.col("approved_at").isNull() | blank("approved_by_name") | blank("approved_by_role"), "INVALID_SOURCE_SNAPSHOT").when(broken, "INVALID_SOURCE_SNAPSHOT").otherwise("READY")
    )
    q = q.withColumn("verdict", verdict)
    ready = lambda c: F.when(F.col("verdict") == "READY", c)
    return q.select("doc_id", "verdict", ready(F.concat(F.lit("SO-"), "number")).alias("order_number"), ready(F.lit("DRAFT")).alias("order_status"), ready(F.upper(F.trim("currency_code"))).alias("currency_code"), *[ready(F.col(c)).alias(c) for c in ("subtotal", "discount_amount", "tax_amount", "total_amount")])


def check_milestones(milestones: DataFrame) -> DataFrame:
    """(contract_id, error): the first of bad amounts, positions not 1..n, percentages over
    100 where all are percentages; null if fine."""
    pct, fixed = F.col("amount_type") == "PERCENTAGE", F.col("amount_type") == "FIXED"
    bad = F.coalesce((pct & ((F.col("percentage") <= 0) | (F.col("percentage") > 100))) | (fixed & (F.col("fixed_amount") < 0)), F.lit(False)) | (pct & F.col("percentage").isNull()) | (fixed & F.col("fixed_amount").isNull())
    g = milestones.groupBy("contract_id").agg(F.bool_or(bad).alias("bad"), F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("d"), F.bool_and(pct).alias("all_pct"), F.sum("percentage").alias("sum"))
    run = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))
    return g.select("contract_id", F.when(F.col("bad"), "AMOUNT_INVALID").when(~run, "POSITIONS_INVALID").when(F.col("all_pct") & (F.col("sum") > 100), "PERCENTAGE_OVER_100").alias("error"))


def allocate_codes(df: DataFrame, sequences: DataFrame, keys: list[str], order: list[str], code: Column) -> tuple[DataFrame, DataFrame]:
    """Adds sequence and code per group of keys, from sequences (keys, next_value, 1 where
    absent); and the sequences' new next values. ``code`` is built on column sequence."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start = F.coalesce("next_value", F.lit(1))
    out = df.join(sequences, keys, "left").withColumn("sequence", start + F.row_number().over(w) - 1).drop("next_value").withColumn("code", code)
    used = out.groupBy(*keys).agg((F.max("sequence") + 1).alias("__n"))
    after = sequences.join(used, keys, "full_outer").select(*keys, F.coalesce("__n", "next_value").alias("next_value"))
    return out, after


def customer_code(sequence="sequence") -> Column:
    return F.concat(F.lit("CUST-"), F.lpad(F.col(sequence).cast("string"), 6, "0"))


def contract_number(month: str, sequence="sequence") -> Column:
    """month: yyyyMM."""
    return F.concat(F.lit("CN-"), F.col(month), F.lit("-"), F.lpad(F.col(sequence).cast("string"), 4, "0"))


def renumber_lines(lines: DataFrame, order: list) -> DataFrame:
    """position 1..n per document in the given order."""
    return lines.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def check_positions(lines: DataFrame, mode: str = "unique") -> DataFrame:
    """(doc_id, ok): positions unique, or contiguous from 1."""
    g = lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    ok = F.col("n") == F.col("d")
    return g.select("doc_id", (ok & (F.col("lo") == 1) & (F.col("hi") == F.col("n")) if mode == "contiguous" else ok).alias("ok"))


def claim_pending(records: DataFrame, now: Column, most: int = 50) -> DataFrame:
    """The oldest work, marked: NORMALIZED or MATCHED, or PROCESSING for over 15 minutes;
    status PROCESSING, retry_count one more, processing_started_at now."""
    stale = (F.col("status") == "PROCESSING") & (F.col("processing_started_at") < now - F.expr("interval 15 minutes"))
    free = F.col("status").isin("NORMALIZED", "MATCHED") | F.coalesce(stale, F.lit(False))
    out = records.where(free).orderBy("created_at", "id").limit(min(max(most, 1), 100))
    return out.withColumn("status", F.lit("PROCESSING")).withColumn("retry_count", F.col("retry_count") + 1).withColumn("processing_started_at", now)


def recoverable_jobs(quotations: DataFrame, now: Column, most: int) -> DataFrame:
    """Localization work to take up again, oldest first."""
    idle = F.col("lease_until").isNull() | (F.col("lease_until") < now)
    again = (F.col("localization_status") == "PENDING") | ((F.col("localization_status") == "FAILED") & F.col("error_code").isin("TRANSLATION_TIMEOUT", "TRANSLATION_PROVIDER_ERROR", "TRANSLATION_UNEXPECTED_ERROR"))
    fit = ~F.col("is_deleted") & F.col("signature").isNotNull() & (F.col("attempts") < 3) & idle & again
    return quotations.where(fit).orderBy(F.asc_nulls_last("requested_at"), F.asc_nulls_last("updated_at"), "id").limit(most)


def latest_delivery(deliveries: DataFrame) -> DataFrame:
    """The last attempt per quotation, by created_at and id."""
    best = F.max(F.struct("created_at", "id", *[c for c in deliveries.columns if c not in ("created_at", "id", "quotation_id")]))
    return deliveries.groupBy("quotation_id").agg(best.alias("b")).select("quotation_id", "b.*")


def delivery_history(deliveries: DataFrame) -> DataFrame:
    """Attempts numbered from the newest."""
    return deliveries.withColumn("nth", F.row_number().over(Window.partitionBy("quotation_id").orderBy(F.desc("created_at"), F.desc("id"))))


def verify_documents(tokens: DataFrame, quotations: DataFrame, companies: DataFrame) -> DataFrame:
    """(token, number, company_name, verdict) for tokens of documents that are not deleted."""
    q = quotations.where("not is_deleted").join(tokens.select("token"), "token")
    name = F.coalesce(F.nullif(F.trim("name_en"), F.lit("")), F.col("name"), F.col("name_ar"))
    return q.join(companies.select("company_id", name.alias("company_name")), "company_id").select("token", "number", "company_name", F.when(F.col("status") == "CANCELLED", "CANCELLED").otherwise("VALID").alias("verdict"))


def tenant_overview(customers: DataFrame, quotations: DataFrame) -> DataFrame:
    """(company_id, customers, open_quotations, approved_deals)."""
    c = customers.where("not is_deleted").groupBy("company_id").agg(F.count("*").alias("customers"))
    q = quotations.where("not is_deleted").groupBy("company_id").agg(F.count_if(F.col("status").isin("DRAFT", "SENT")).alias("open_quotations"), F.count_if(F.col("status") == "APPROVED").alias("approved_deals"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return c.join(q, "company_id", "full_outer").select("company_id", zero("customers"), zero("open_quotations"), zero("approved_deals"))


def customer_error() -> Column:
    """The first rule a customer row breaks."""
    some = lambda c: F.coalesce(trim_u(c), F.lit("")) != ""
    given = lambda c, p: some(c) & ~trim_u(c).rlike(p)
    return F.coalesce(
        F.when(~F.coalesce(F.upper(F.trim("code")).rlike("^[A-Z0-9][A-Z0-9_-]{0,49}$"), F.lit(False)), "CODE_INVALID"),
        F.when(~(some("name") | some("name_ar") | some("name_en")), "NAME_REQUIRED"),
        F.when(given("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "EMAIL_INVALID"), F.when(given("country", "^[A-Za-z]{2}$"), "COUNTRY_INVALID"), F.when(given("currency_code", "^[A-Za-z]{3}$"), "CURRENCY_INVALID"),
        F.when(F.col("credit_limit") < 0, "CREDIT_LIMIT_INVALID"), F.when(F.col("payment_terms") < 0, "PAYMENT_TERMS_INVALID"), F.when(some("phone") & messaging_phone("phone").isNull(), "PHONE_INVALID"),
    )


def catalog_error() -> Column:
    return F.coalesce(
        F.when(~F.coalesce(F.upper(F.trim("code")).rlike("^[A-Z0-9][A-Z0-9_-]{0,49}$"), F.lit(False)), "CODE_INVALID"), F.when(F.coalesce(trim_u("name"), F.lit("")) == "", "NAME_REQUIRED"),
        F.when((F.col("sale_price") < 0) | (F.col("cost_price") < 0), "PRICE_INVALID"), F.when((F.col("type") == "SERVICE") & F.col("track_stock"), "SERVICE_TRACKS_STOCK"),
    )


def provenance_error() -> Column:
    """kind, source_id, source_kind: DIRECT has no source; others need one of their kind."""
    direct = F.col("kind") == "DIRECT"
    return F.when(direct & F.col("source_id").isNotNull(), "SOURCE_NOT_ALLOWED").when(~direct & F.col("source_id").isNull(), "SOURCE_REQUIRED").when(~direct & F.coalesce(F.col("source_kind") != F.col("kind"), F.lit(False)), "SOURCE_KIND_MISMATCH")


def ingestion_row_error() -> Column:
    """What an ingestion record row must hold by its status."""
    s = F.col("status")
    return F.coalesce(
        F.when(F.coalesce(trim_u("external_id"), F.lit("")) != F.coalesce("external_id", F.lit("?")), "EXTERNAL_ID_INVALID"), F.when(F.coalesce("external_id", F.lit("")) == "", "EXTERNAL_ID_INVALID"),
        F.when(~F.coalesce(F.col("payload_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "HASH_INVALID"),
        F.when(s.isin("NORMALIZED", "MATCHED", "PROCESSING", "NEEDS_REVIEW", "PUBLISHED") & F.col("normalized_data").isNull(), "DATA_MISSING"),
        F.when(s.isin("MATCHED", "PUBLISHED") & F.col("matched_item_id").isNull(), "MATCH_MISSING"), F.when((s == "PROCESSING") & F.col("processing_started_at").isNull(), "START_MISSING"),
        F.when((s == "PUBLISHED") & F.col("processed_at").isNull(), "END_MISSING"), F.when(s.isin("REJECTED", "FAILED") & (F.coalesce(F.trim("error_message"), F.lit("")) == ""), "MESSAGE_MISSING"),
    )


def attribute_error() -> Column:
    """Exactly one value, of the column for its data type; a unit only with numbers."""
    values = {"string": ["STRING", "SELECT"], "number": ["NUMBER", "DECIMAL"], "boolean": ["BOOLEAN"], "json": ["JSON"]}
    there = F.size(F.filter(F.array(*[F.col(f"value_{v}").isNotNull() for v in values]), lambda x: x))
    right = F.coalesce(*[F.when(F.col("data_type").isin(*kinds), F.col(f"value_{v}").isNotNull()) for v, kinds in values.items()], F.lit(False))
    return F.when(there != 1, "ONE_VALUE_REQUIRED").when(~right, "VALUE_TYPE_MISMATCH").when(F.col("unit").isNotNull() & ~F.col("data_type").isin("NUMBER", "DECIMAL"), "UNIT_NOT_ALLOWED")


def date_order_error(start: str, end: str) -> Column:
    return F.when(F.col(end) < F.col(start), "DATES_OUT_OF_ORDER")
