"""Text: cleaning, codes, units, identifiers, phone numbers, match keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfc_all(texts: pd.Series) -> pd.Series:
    """Canonical composition of all texts of an array, in one call."""
    return texts.map(lambda a: [x if x is None else unicodedata.normalize("NFC", x) for x in a], na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def trim_u(c) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def squeeze(c) -> Column:
    """Runs of Unicode white space to one blank, trimmed, '' to null."""
    return F.nullif(trim_u(F.regexp_replace(_col(c), r"(?U)[\s﻿]+", " ")), F.lit(""))


def clean_text(c) -> Column:
    """NFC, then squeeze. The helper runs only for values beyond ASCII."""
    c = _col(c)
    return squeeze(F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(nfc(c)))


def composed(texts: Column) -> Column:
    """An array of texts in NFC; the helper sees only arrays with a text beyond ASCII."""
    plain = F.forall(texts, lambda x: x.isNull() | x.rlike(r"^\p{ASCII}*$"))
    return F.when(plain, texts).otherwise(nfc_all(F.when(~plain, texts)))


def clean_code(c) -> Column:
    return F.upper(clean_text(c))


def match_key(c) -> Column:
    """NFKC, lower case, runs of blanks and . _ , - / \\ to one blank, trimmed."""
    c = _col(c)
    folded = F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(nfkc(c))
    return trim_u(F.regexp_replace(F.lower(trim_u(folded)), r"(?U)[\s﻿._,\-/\\]+", " "))


#: The spellings of each unit.
UNITS = {
    "kg": ["kg", "kgs", "kilogram", "kilograms"],
    "g": ["g", "gram", "grams"],
    "m": ["m", "meter", "meters"],
    "cm": ["cm", "centimeter", "centimeters"],
    "mm": ["mm", "millimeter", "millimeters"],
    "pcs": ["pcs", "pc", "piece", "pieces"],
}


def canonical_unit(c) -> Column:
    c = trim_u(c)
    spelt = F.create_map(*[F.lit(x) for unit, names in UNITS.items() for name in names for x in (name, unit)])
    return F.coalesce(F.get(F.array(F.element_at(spelt, F.lower(c))), F.lit(0)), c)


#: Global code types and their lengths.
GLOBAL_LENGTHS = {"GTIN": [8, 12, 13, 14], "EAN": [8, 13], "UPC": [12], "GTIN_8": [8], "GTIN_12": [12], "GTIN_13": [13], "GTIN_14": [14]}
MAKER_TYPES = ["MPN", "MODEL_NO"]


def normalize_identifier(kind, value, maker, source) -> Column:
    """struct(value, error): global codes without blanks and hyphens, digits of a right
    length; MPN and MODEL_NO need a maker and are squeezed and upper-cased;
    EXTERNAL_ID needs a source and is trimmed."""
    kind, value, maker, source = map(_col, (kind, value, maker, source))
    bare = F.regexp_replace(value, r"(?U)[\s﻿\-]+", "")
    lengths = F.create_map(*[x for k, n in GLOBAL_LENGTHS.items() for x in (F.lit(k), F.array(*map(F.lit, n)))])
    fits = bare.rlike("^[0-9]+$") & F.array_contains(F.element_at(lengths, kind), F.length(bare))
    blank = lambda c: F.coalesce(trim_u(c), F.lit("")) == ""
    is_global, is_maker = kind.isin(*GLOBAL_LENGTHS), kind.isin(*MAKER_TYPES)
    error = (
        F.when(blank(value), "IDENTIFIER_VALUE_REQUIRED")
        .when(is_global, F.when(~F.coalesce(fits, F.lit(False)), "IDENTIFIER_FORMAT_INVALID"))
        .when(is_maker, F.when(blank(maker), "IDENTIFIER_MANUFACTURER_REQUIRED"))
        .when(kind == "EXTERNAL_ID", F.when(blank(source), "IDENTIFIER_SOURCE_REQUIRED"))
        .otherwise("IDENTIFIER_TYPE_UNSUPPORTED")
    )
    good = F.when(is_global, bare).when(is_maker, F.upper(squeeze(value))).when(kind == "EXTERNAL_ID", trim_u(value))
    return F.struct(F.when(error.isNull(), good).alias("value"), error.alias("error"))


def query_forms(c) -> Column:
    """The forms under which a query may equal an identifier: as is, without blanks
    and hyphens, and upper-cased."""
    q = F.lower(squeeze(c))
    return F.array_distinct(F.array(q, F.regexp_replace(q, r"(?U)[\s﻿\-]+", ""), F.upper(q)))


def messaging_phone(c) -> Column:
    """Digits for a messaging link, or null: only + digits blanks ( ) -, a leading 00
    dropped, 8 to 15 digits, none of them a leading 0."""
    c = trim_u(c)
    digits = F.regexp_replace(F.regexp_replace(c, r"[^0-9]", ""), "^00", "")
    return F.when(c.rlike(r"^\+?[0-9\s()\-]+$") & digits.rlike("^[1-9][0-9]{7,14}$"), digits)


def contains_arabic(c) -> Column:
    return F.coalesce(_col(c).rlike("[\\u0600-\\u06FF]"), F.lit(False))


def localized_name(locale, name, name_ar, name_en) -> Column:
    """The name in the locale where it is not blank, else the plain one."""
    locale, name = _col(locale), _col(name)
    own = F.when(locale == "ar", F.nullif(trim_u(name_ar), F.lit(""))).when(locale == "en", F.nullif(trim_u(name_en), F.lit("")))
    return F.coalesce(own, name)


def customer_display_name(locale, name, name_ar, name_en) -> Column:
    some = lambda c: F.nullif(trim_u(c), F.lit(""))
    return F.when(_col(locale) == "ar", F.coalesce(some(name_ar), some(name), some(name_en))).otherwise(F.coalesce(some(name_en), some(name), some(name_ar)))
