"""Which texts of a quotation lack their other language, and writing them back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_arabic, trim_u

#: Header fields in order: key, and whether there is a plain column besides _ar and _en.
HEADER = [("project_name", True), ("attention_name", True), ("subject", False), ("brief", False), ("notes", True), ("terms", True)]
LINE = ["item_name", "description", "unit_name"]
#: What tells the language: these, the customer's name, and each line's plain texts.
TELLING = ["project_name", "attention_name", "notes", "terms", "subject_ar", "subject_en", "brief_ar", "brief_en", "customer_name"]


def _text(c) -> Column:
    return F.nullif(trim_u(c), F.lit(""))


def source_locale(quotations: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, locale): the stated one, else ar if a telling text has Arabic, else en."""
    any_line = lines.groupBy("doc_id").agg(F.bool_or(contains_arabic("item_name") | contains_arabic("description") | contains_arabic("unit_name")).alias("__ar"))
    q = quotations.join(any_line, "doc_id", "left")
    arabic = F.coalesce("__ar", F.lit(False))
    for c in TELLING:
        arabic = arabic | contains_arabic(c)
    stated = F.when(F.col("stated_locale").isin("ar", "en"), F.col("stated_locale"))
    return q.select("doc_id", F.coalesce(stated, F.when(arabic, "ar").otherwise("en")).alias("locale"))


def _needed(locale: Column, field: str, plain: bool) -> Column:
    """The text to translate, or null: the source language's, else the plain one, where
    the other language is empty."""
    ar, en = _text(f"{field}_ar"), _text(f"{field}_en")
    own, other = F.when(locale == "ar", ar).otherwise(en), F.when(locale == "ar", en).otherwise(ar)
    return F.when(other.isNull(), F.coalesce(own, _text(field)) if plain else own)


def missing_translations(quotations: DataFrame, lines: DataFrame, locales: DataFrame) -> DataFrame:
    """(doc_id, locale, field_no, key, text) in a fixed order of fields; lines are counted
    from 0 by position. quotations need customer_name with _ar and _en, and HEADER."""
    q = quotations.join(locales, "doc_id")
    loc = F.col("locale")
    named = _text("customer_name_ar").isNotNull() | _text("customer_name_en").isNotNull()
    fields = [F.struct(F.lit(0).alias("field_no"), F.lit("customer_name").alias("key"), F.when(named, _needed(loc, "customer_name", True)).alias("text"))]
    fields += [F.struct(F.lit(i).alias("field_no"), F.lit(f).alias("key"), _needed(loc, f, plain).alias("text")) for i, (f, plain) in enumerate(HEADER, 1)]
    head = q.select("doc_id", "locale", F.inline(F.array(*fields))).where("text is not null")
    of = lines.join(locales, "doc_id").withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1)
    base = len(HEADER) + 1
    cells = [F.struct((F.lit(base + i) + F.col("__n") * len(LINE)).alias("field_no"), F.concat(F.lit("line_"), F.col("__n"), F.lit(f"_{f}")).alias("key"), _needed(loc, f, True).alias("text")) for i, f in enumerate(LINE)]
    return head.unionByName(of.select("doc_id", "locale", F.inline(F.array(*cells))).where("text is not null"))


def signatures(missing: DataFrame) -> DataFrame:
    """(doc_id, signature): SHA-256 of the locale and the texts in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("field_no", "key", "text"))), lambda x: F.struct(x["key"].alias("key"), x["text"].alias("text")))
    g = missing.groupBy("doc_id", "locale").agg(items.alias("items"))
    return g.select("doc_id", F.sha2(F.to_json(F.struct(F.col("locale").alias("sourceLocale"), "items")), 256).alias("signature"))


def backfill_classes(quotations: DataFrame, locales: DataFrame, missing: DataFrame) -> DataFrame:
    """(doc_id, new_status, new_locale, broken, repairable): new only where none is set."""
    n = missing.groupBy("doc_id").agg(F.count("*").alias("__n"))
    q = quotations.join(locales, "doc_id").join(n, "doc_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    unset, some = F.col("localization_status").isNull(), F.col("__n") > 0
    broken = F.coalesce(F.col("localization_status") == "COMPLETED", F.lit(False)) & some
    return q.select("doc_id", F.when(unset, F.when(some, "PENDING").otherwise("COMPLETED")).alias("new_status"), F.when(unset & some, F.col("locale")).alias("new_locale"), broken.alias("broken"), (broken & (F.col("status") == "DRAFT")).alias("repairable"))


def backfill_summary(classes: DataFrame) -> DataFrame:
    return classes.agg(F.count("*").alias("total"), F.count_if(F.col("new_status") == "PENDING").alias("pending"), F.count_if(F.col("new_status") == "COMPLETED").alias("completed"), F.count_if("broken").alias("broken"), F.count_if("repairable").alias("repairable"))


def recovery_summary(outcomes: DataFrame) -> DataFrame:
    """How the recovered jobs (outcome each) ended: scanned, and the six outcomes; one that
    is none of the others is a claim that failed."""
    known = ["COMPLETED", "FAILED", "STALE", "NO_CLAIM", "NOT_FOUND"]
    other = ~F.coalesce(F.col("outcome").isin(*known), F.lit(False))
    return outcomes.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("outcome") == k).alias(k.lower()) for k in known], F.count_if(other).alias("claim_failed"))


def translate_texts(missing: DataFrame, translate_fn: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """(doc_id, key, text, translation): each distinct (locale, text) is translated once."""
    @F.pandas_udf("string")
    def run(locale: pd.Series, text: pd.Series) -> pd.Series:
        return translate_fn(locale, text)

    once = missing.select("locale", "text").distinct().withColumn("translation", run("locale", "text"))
    return missing.join(once, ["locale", "text"]).select("doc_id", "key", "text", "translation")


def write_back(missing: DataFrame, results: DataFrame, signed: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, verdict, values): APPLIED with a map of columns to write; FAILED if a needed
    key came back blank; STALE if the texts changed meanwhile. signed: the signature
    the results were made for; current: today's."""
    j = missing.join(results.select("doc_id", "key", "translation"), ["doc_id", "key"], "left")
    filled = _text("translation")
    other = F.when(F.col("locale") == "ar", "en").otherwise("ar")
    entry = lambda name, value: F.struct(name.alias("key"), value.alias("value"))
    cell = F.array(entry(F.concat_ws("_", "key", "locale"), F.col("text")), entry(F.concat_ws("_", F.col("key"), other), filled), entry(F.concat_ws("_", F.col("key")), F.col("text")))
    g = j.groupBy("doc_id").agg(F.bool_and(filled.isNotNull()).alias("ok"), F.collect_list(F.when(filled.isNotNull(), cell)).alias("cells"))
    g = g.join(signed.withColumnRenamed("signature", "__then"), "doc_id", "left").join(current.withColumnRenamed("signature", "__now"), "doc_id", "left")
    fresh = F.coalesce(F.col("__then") == F.col("__now"), F.lit(False))
    verdict = F.when(~fresh, "STALE").when(~F.col("ok"), "FAILED").otherwise("APPLIED")
    return g.select("doc_id", verdict.alias("verdict"), F.when(verdict == "APPLIED", F.map_from_entries(F.flatten("cells"))).alias("values"))
