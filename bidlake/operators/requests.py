"""Sales requests in words: what they ask for, and which customer and items they mean.

A request is cut into segments and these into words; each word is of a kind that has a
letter.  A mention begins behind a word that opens one and ends before the nearest that
closes it, both found by their places.  The scope follows from a few facts about the
whole request: which works it names, and which of them stand side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key, trim_u
from .search import contains_shared

MAX_LINES, MAX_SHOWN, MAX_TEXT, MAX_MENTION = 20, 5, 500, 300

# The words, in English and Arabic, by which a request is read.
KINDS = {
    "V": "please create prepare make a اعمل أنشئ جهز",  # before the request
    "Q": "quotation quote عرض",
    "F": "for للعميل",
    "K": "customer client لشركة العميل",
    "D": "needs need requests request",
    "P": "at price cost بسعر سعر بمبلغ",
    "U": "unit units pc pcs piece pieces item items قطعة قطع حبة حبات جهاز أجهزة وحدة وحدات",
    "T": "كاميرات كاميرا",  # a unit that names the item too
    "C": "kwd usd eur sar aed د.ك",
    "S": "supply",
    "s": "توريد",
    "I": "installation",
    "i": "تركيب",
    "M": "maintenance صيانة",
    "G": "consultation استشارة",
    "R": "service خدمة",
    "O": "only فقط",
    "H": "with مع",
    "A": "and",
    "E": ": = -",
}
#: Works that are named by any word which holds the stem: plurals and compounds.
STEMS = {"S": "supply", "I": "installation", "M": "maintenance صيانة", "G": "consultation استشارة", "R": "service خدمة", "s": "وريد", "i": "ركيب"}
SERVICES, ENDS = "IiMR", "SsIiMRE"


def _kind(word: Column) -> Column:
    """The letter of a word: N for a number, W for any word that tells nothing."""
    known = F.create_map(*[F.lit(x) for letter, words in KINDS.items() for w in words.split() for x in (w, letter)])
    bare = F.regexp_replace(word, "^و?(?:ال|لل)?", "")
    held = [F.when(F.contains(word, F.lit(stem)), letter) for letter, stems in STEMS.items() for stem in stems.split()]
    return F.when(word.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), "N").otherwise(F.coalesce(F.try_element_at(known, word), F.try_element_at(known, bare), *held, F.lit("W")))


def _segments(requests: DataFrame) -> DataFrame:
    """Adds no, segment, words, kinds and their array: a row per segment, one without for a
    request that has none."""
    parts = F.filter(F.transform(F.split(trim_u("text"), r"[\n;,،]+"), trim_u), lambda s: s != "")
    rows = requests.select("*", F.posexplode_outer(F.slice(parts, 1, MAX_LINES)).alias("no", "segment"))
    glued = "|".join(w for letter in "UC" for w in KINDS[letter].split() if w.isascii())
    spaced = F.regexp_replace("segment", r"د\s*\.?\s*ك(?!\p{L})|دينار\s+كويتي", "د.ك")
    spaced = F.regexp_replace(spaced, rf"(?i)(?<=[0-9])(?=(?:{glued})\b)|(?<=\S)(?=[:=](?:\s|$))", " ")
    rows = rows.withColumn("words", F.coalesce(F.split(spaced, r"(?U)\s+"), F.array().cast("array<string>")))
    plain = F.transform("words", lambda w: F.lower(F.regexp_replace(w, r"(?<=.)[.!?:=]+$", "")))
    return rows.withColumn("plain", plain).withColumn("each", F.transform("plain", _kind)).withColumn("kinds", F.array_join("each", ""))


def _found(kinds: str, before: str, inside: str, after: str = "") -> tuple[Column, Column]:
    """(place, length) of the first such kinds between those before and after, place null if
    there are none; places are counted from 0."""
    whole = f"^(.*?{before})({inside}){after}"
    size = F.length(F.regexp_extract(kinds, whole, 2))
    return F.when(size > 0, F.length(F.regexp_extract(kinds, whole, 1))), size


def _is(i: Column, kinds: str) -> Column:
    return F.coalesce(F.get(F.col("each"), i).isin(*kinds), F.lit(False))


def _between(s: DataFrame, name: str, opens, closes) -> DataFrame:
    """Adds <name>_at and <name>: where the words behind the first that opens begin, and how many
    they are up to the nearest that closes, at least one; null and 0 if there are none."""
    n = F.size("each")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at, end = f"{name}_at", F.col(f"{name}_at")
    s = s.withColumn(at, F.array_min(F.filter(places, lambda i: (i + 1 < n) & opens(i))) + 1)
    return s.withColumn(name, F.when(end.isNotNull(), F.coalesce(F.array_min(F.filter(places, lambda i: (i > end) & closes(i))), n) - end).otherwise(0))


def _scope(each: str) -> Column:
    """The scope by what the request names: works together before one of them only, that before
    works of other kinds, and these before installation and supply alone."""
    row = F.col(each)
    beside = F.zip_with(row, F.slice(row, 2, F.size(row)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    named = lambda kinds: F.arrays_overlap(row, F.array(*map(F.lit, kinds)))
    side = lambda *pairs: F.arrays_overlap(beside, F.array(*map(F.lit, pairs)))
    linked = F.exists(F.zip_with(beside, F.slice(row, 3, F.size(row)), lambda ab, c: (ab == "SA") & (c == "I")), lambda x: x)
    facts = {
        "SUPPLY_AND_INSTALLATION": [(4, linked | side("HI", "Hi") | (named("s") & named("i")))], "SUPPLY_ONLY": [(3.5, side("SO", "sO")), (0.5, named("Ss"))],
        "INSTALLATION_ONLY": [(3, side("IO")), (1, named("Ii"))], "MAINTENANCE": [(2.5, named("M"))], "CONSULTATION": [(2, named("G"))], "SERVICE": [(1.5, named("R"))],
    }
    claims = F.array(*[F.when(F.coalesce(fact, F.lit(False)), F.struct(F.lit(float(weight)).alias("weight"), F.lit(scope).alias("scope"))) for scope, some in facts.items() for weight, fact in some])
    return F.array_max(claims)["scope"]


def _said(at: Column, size: Column) -> Column:
    words = F.array_join(F.slice("words", F.coalesce(at, F.lit(0)) + 1, size), " ")
    return F.when(at.isNotNull() & (F.length(words) <= MAX_MENTION), words)


def _inside(i: Column, at: str, size: str) -> Column:
    return F.coalesce((i >= F.col(at)) & (i < F.col(at) + F.col(size)), F.lit(False))


def extract_intents(requests: DataFrame) -> DataFrame:
    """requests: request_id (one row each), text, locale.  Adds customer_mention,
    customer_email, subject, scope_type, currency_code and lines: array of (text, quantity,
    unit_text, price, type)."""
    s = _segments(requests.select("request_id", "locale", "text"))
    arabic = F.col("locale") == "ar"
    # Whom it is for: behind "quotation for" first, behind "customer" where that says nothing.
    quoted = lambda i: _is(i - 1, "Q") | (_is(i - 1, "P") & _is(i - 2, "Q"))
    opens = lambda i: (_is(i, "F") & quoted(i)) | (arabic & _is(i, "K"))
    closes = lambda i: _is(i, ENDS) | (_is(i, "N") & (arabic | _is(i + 1, "U")))
    s = _between(s, "m1", opens, closes)
    s = _between(s, "m2", lambda i: ~arabic & _is(i, "K"), lambda i: _is(i, "DNE"))
    s = s.withColumn("mention1", _said(F.col("m1_at"), F.col("m1"))).withColumn("mention2", _said(F.col("m2_at"), F.col("m2")))
    of = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("no", c))).alias(c)
    # Segments in order, with a stop behind each, so that words of two aren't side by side.
    asked = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "each"))), lambda x: F.concat(x["each"], F.array(F.lit("|")))))
    money = F.get(F.col("plain"), F.length(F.regexp_extract("kinds", "^(.*?)C", 1)))
    s = s.withColumn("money", F.when(F.contains("kinds", F.lit("C")), F.when(money == "د.ك", "KWD").otherwise(F.upper(money))))
    # How many, and for how much: a number behind a price word is a price.
    price, many = _found("kinds", "PE?", "N"), _found("kinds", "(?<!P)(?<!PE)", "N")
    s = s.withColumns({"p_at": price[0], "p_from": F.length(F.regexp_extract("kinds", "^(.*?)PE?N", 1)), "p": F.length(F.regexp_extract("kinds", "^.*?(PE?NC?)", 1)), "q_at": many[0]})
    s = s.withColumn("unit", F.substring(F.col("kinds"), F.col("q_at") + 2, F.lit(1))).withColumn("lead", F.length(F.regexp_extract("kinds", "^(V*QP?[FK]?)", 1)))
    number = lambda at: F.get(F.col("plain"), F.col(at)).try_cast("double")
    per = F.struct("no", "segment", "words", "kinds", "lead", "m1_at", "m1", "m2_at", "m2", "p_from", F.when(F.col("p_at").isNotNull(), F.col("p")).alias("p"), "q_at", "unit", number("q_at").alias("quantity"), number("p_at").alias("price"), F.when(F.col("unit").isin("U", "T"), F.get(F.col("words"), F.col("q_at") + 1)).alias("unit_text"))
    g = s.groupBy("request_id", "locale").agg(of("mention1"), of("mention2"), asked.alias("asked"), of("money"), F.collect_list(F.when(F.col("segment").isNotNull(), per)).alias("per"))
    g = g.withColumn("customer_mention", F.coalesce("mention1.mention1", "mention2.mention2")).withColumn("m_no", F.coalesce("mention1.no", "mention2.no"))
    scope = _scope("asked")

    # The text of a line: the words that are not the request, the mention, the price, or a
    # number the line begins with.
    line = g.select("request_id", "locale", "m_no", F.col("mention1").isNotNull().alias("by1"), F.inline("per"))
    here = F.col("no") == F.col("m_no")
    line = line.withColumn("m_at", F.when(here, F.when(F.col("by1"), F.col("m1_at")).otherwise(F.col("m2_at")))).withColumn("m", F.when(F.col("by1"), F.col("m1")).otherwise(F.col("m2")))
    begins = (F.col("q_at") == 0) | (F.col("q_at") == F.col("lead")) | F.coalesce(F.col("q_at") == F.col("m_at") + F.col("m"), F.lit(False))
    line = line.withColumn("q", F.when(begins, F.when(F.col("unit") == "U", 2).otherwise(1)))
    left = lambda x, i: (i >= F.col("lead")) & ~_inside(i, "m_at", "m") & ~_inside(i, "p_from", "p") & ~_inside(i, "q_at", "q")
    cleaned = F.nullif(F.array_join(F.filter("words", left), " "), F.lit(""))
    line = line.withColumn("of", F.array_join(F.filter(F.split("kinds", ""), left), "")).withColumn("text", F.coalesce(F.substring(cleaned, 1, MAX_TEXT), trim_u(F.substring("segment", 1, MAX_TEXT))))
    kind = F.when(F.col("of").rlike(f"[{SERVICES}]"), "SERVICE").when((F.col("locale") == "en") | F.contains("of", F.lit("s")), "PRODUCT").otherwise("UNKNOWN")
    lines = line.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("no", "text", "quantity", "unit_text", "price", kind.alias("type")))).alias("l"))
    lines = lines.select("request_id", F.transform("l", lambda x: x.dropFields("no")).alias("lines"))
    found = g.select("request_id", "customer_mention", scope.alias("scope_type"), F.col("money.money").alias("currency_code")).join(lines, "request_id", "left")
    subject = F.when(F.col("customer_mention").isNotNull(), F.concat(F.when(arabic, "عرض سعر - ").otherwise("Quotation - "), "customer_mention"))
    email = F.nullif(F.regexp_extract(F.col("text"), r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0), F.lit(""))
    out = requests.join(found, "request_id", "left").withColumn("customer_email", email).withColumn("subject", subject)
    none = F.array().cast(lines.schema["lines"].dataType)
    return out.select(*requests.columns, "customer_mention", "customer_email", "subject", "scope_type", "currency_code", F.coalesce("lines", none).alias("lines"))


# The fields of an intent and of its lines, the longest text of each, the
# bounds of numbers, and the names allowed.
INTENT_TEXTS = {
    "customerMention": 300, "customerEmail": 320, "customerPhone": 80, "projectName": 300, "subject": 300, "attentionName": 200, "brief": 2000,
    "scopeOfWork": 2000, "warranty": 1000, "paymentTerms": 1000, "currencyCode": 3, "notes": 2000, "uncertainty": 500,
}
LINE_TEXTS = {"text": 500, "description": 1000, "requestedUnitText": 80, "uncertainty": 500}
LINE_NUMBERS = {"quantity": (0.001, 1_000_000.0), "requestedPrice": (0.0, 1_000_000_000.0)}
LINE_TYPES = ["PRODUCT", "SERVICE", "CUSTOM", "UNKNOWN"]
SCOPE_TYPES = ["SUPPLY_ONLY", "SUPPLY_AND_INSTALLATION", "INSTALLATION_ONLY", "SERVICE", "MAINTENANCE", "CONSULTATION"]
MAX_WARNINGS, WARNING_TEXT = 10, 240
INTENT_FIELDS = [*INTENT_TEXTS, "sourceLocale", "scopeType", "lines", "warnings"]
LINE_FIELDS = [*LINE_TEXTS, *LINE_NUMBERS, "typeIntent", "warnings"]


def _at(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _type(v: Column) -> Column:
    """null where there is no value; VOID for JSON's null."""
    return F.schema_of_variant(v)


def _text_wrong(v: Column, most: int) -> Column:
    """A value that is neither absent nor null nor a text within the bound."""
    text = trim_u(F.try_variant_get(v, "$", "string"))
    return F.coalesce((_type(v) != "VOID") & ((_type(v) != "STRING") | (F.length(text) > most)), F.lit(False))


def _warnings_wrong(v: Column) -> Column:
    listed = F.try_variant_get(v, "$", "array<variant>")
    bad = lambda w: (_type(w) != "STRING") | ~F.coalesce(F.length(trim_u(F.try_variant_get(w, "$", "string"))).between(1, WARNING_TEXT), F.lit(False))
    return F.coalesce(~_type(v).startswith("ARRAY") | (F.size(listed) > MAX_WARNINGS) | F.exists(listed, bad), F.lit(False))


def _number_wrong(v: Column, low: float, high: float) -> Column:
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce((_type(v) != "VOID") & (~_type(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | ~F.coalesce(number.between(low, high), F.lit(False))), F.lit(False))


def _keys_wrong(v: Column, allowed: list[str]) -> Column:
    return F.exists(F.json_object_keys(F.to_json(v)), lambda k: ~k.isin(*allowed))


def line_error(v: Column) -> Column:
    """The first thing wrong with a line of an intent (a variant), or null."""
    text, kind = _at(v, "text"), _at(v, "typeIntent")
    texts = reduce(lambda a, b: a | b, [_text_wrong(_at(v, f), n) for f, n in LINE_TEXTS.items()])
    return (
        F.when(~F.coalesce(_type(v).startswith("OBJECT"), F.lit(False)), "LINE_NOT_AN_OBJECT").when(_keys_wrong(v, LINE_FIELDS), "LINE_UNKNOWN_FIELD")
        .when(F.coalesce(trim_u(F.try_variant_get(text, "$", "string")), F.lit("")) == "", "LINE_TEXT_MISSING").when(texts, "LINE_TEXT_INVALID")
        .when(F.coalesce(~F.coalesce(F.try_variant_get(kind, "$", "string").isin(*LINE_TYPES), F.lit(False)) & _type(kind).isNotNull(), F.lit(False)), "LINE_TYPE_INVALID")
        .when(reduce(lambda a, b: a | b, [_number_wrong(_at(v, f), *b) for f, b in LINE_NUMBERS.items()]), "LINE_NUMBER_INVALID").when(_warnings_wrong(_at(v, "warnings")), "LINE_WARNINGS_INVALID")
    )


def validate_intents(intents: DataFrame, raw: str = "raw", most_lines: int = MAX_LINES) -> DataFrame:
    """Adds error: the first thing wrong with an intent given as JSON text, or null: of its
    own fields first, then of its lines in order."""
    v = F.try_parse_json(raw)
    lines, locale, scope, currency = (_at(v, f) for f in ("lines", "sourceLocale", "scopeType", "currencyCode"))
    listed = F.try_variant_get(v, "$.lines", "array<variant>")
    word = lambda c, f, allowed: F.coalesce(~F.coalesce(F.try_variant_get(c, "$", "string").isin(*allowed), F.lit(False)) & f(c), F.lit(False))
    texts = reduce(lambda a, b: a | b, [_text_wrong(_at(v, f), n) for f, n in INTENT_TEXTS.items()])
    code = trim_u(F.try_variant_get(currency, "$", "string"))
    own = (
        F.when(~F.coalesce(_type(v).startswith("OBJECT"), F.lit(False)), "NOT_AN_OBJECT").when(_keys_wrong(v, INTENT_FIELDS), "UNKNOWN_FIELD")
        .when(~F.coalesce(_type(lines).startswith("ARRAY"), F.lit(False)), "LINES_MISSING").when(F.size(listed) > most_lines, "TOO_MANY_LINES").when(texts, "TEXT_INVALID")
        .when(word(locale, lambda c: _type(c).isNotNull(), ["ar", "en"]), "LOCALE_INVALID").when(word(scope, lambda c: _type(c) != "VOID", SCOPE_TYPES), "SCOPE_INVALID")
        .when(F.coalesce((code != "") & ~code.rlike("^[A-Za-z]{3}$"), F.lit(False)), "CURRENCY_INVALID").when(_warnings_wrong(_at(v, "warnings")), "WARNINGS_INVALID")
    )
    of = F.get(F.filter(F.transform(listed, line_error), lambda e: e.isNotNull()), F.lit(0))
    return intents.withColumn("error", F.coalesce(own, of))


def _resolve(asked: DataFrame, rows: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """(request_id, status, id, candidates): MATCHED if exactly one row of the company has
    a field equal by match key; else AMBIGUOUS with the ids of the newest rows that
    contain the text (5 at most), or MISSING. Equality is tested over all rows."""
    each = rows.select("company_id", F.col(id_column).alias("id"), "created_at", F.explode(F.array(*fields)).alias("text")).where("text is not null")
    # What many requests ask of one company is looked up once; a key that many rows have is one row.
    askers = asked.select("request_id", F.struct("company_id", "search").alias("ask"))
    asks = askers.select("ask", "ask.*").distinct()
    keyed = asks.withColumn("key", match_key("search")).where("key <> ''")
    keys = each.groupBy("company_id", match_key("text").alias("key")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    one = keyed.join(keys, ["company_id", "key"]).select("ask", "lo", "hi")
    near = contains_shared(asks.select(F.col("ask").alias("query_id"), "company_id", F.col("search").alias("query")), each.select("company_id", F.col("id").alias("text_id"), "text"), ["company_id"])
    near = near.select(F.col("query_id").alias("ask"), F.col("text_id").alias("id")).distinct().join(rows.select(F.col(id_column).alias("id"), "created_at"), "id")
    few = near.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("created_at"), "id"))).where(F.col("n") <= MAX_SHOWN)
    shown = few.groupBy("ask").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("candidates"))
    out = askers.join(one, "ask", "left").join(shown, "ask", "left")
    match = F.col("lo") == F.col("hi")
    return out.select(
        "request_id", F.when(match, "MATCHED").when(F.col("candidates").isNotNull() | F.col("lo").isNotNull(), "AMBIGUOUS").otherwise("MISSING").alias("status"), F.when(match, F.col("lo")).alias("id"),
        F.when(~F.coalesce(match, F.lit(False)), F.col("candidates")).alias("candidates"),
    )


def resolve_customers(mentions: DataFrame, customers: DataFrame) -> DataFrame:
    """mentions: request_id, company_id, mention, email; the e-mail address goes before."""
    search = F.coalesce(F.nullif(trim_u("email"), F.lit("")), F.nullif(trim_u("mention"), F.lit("")))
    usable = customers.where("status in ('ACTIVE', 'LEAD')").dropDuplicates(["customer_id"])
    return _resolve(mentions.select("request_id", "company_id", search.alias("search")), usable, "customer_id", ["code", "name", "name_ar", "name_en", "legal_name", "email"])


def resolve_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """lines: request_id, company_id, text, type; items must be active and of the type where
    the line states one (a CUSTOM line is not looked up)."""
    out = None
    for kind in ("PRODUCT", "SERVICE", None):
        asked = lines.where(F.col("type") == kind) if kind else lines.where("type not in ('PRODUCT', 'SERVICE', 'CUSTOM')")
        items = catalog.where("is_active") if kind is None else catalog.where(F.col("is_active") & (F.col("type") == kind))
        part = _resolve(asked.select("request_id", "company_id", F.col("text").alias("search")), items, "item_id", ["code", "name", "sku", "barcode"])
        out = part if out is None else out.unionByName(part)
    return out


def proposals(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """(request_id, currency_code, lines, subtotal, review_required): the total only where
    every line has a quantity and a price. lines: request_id, status, quantity, unit_price."""
    known = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull()
    g = lines.groupBy("request_id").agg(F.count("*").alias("lines"), F.bool_and(known).alias("all"), F.sum((F.col("quantity") * F.col("unit_price")).cast("decimal(18,3)")).alias("s"), F.bool_or(F.col("status") != "MATCHED").alias("open"))
    r = requests.join(g, "request_id", "left")
    return r.select("request_id", F.coalesce("currency_code", "company_currency").alias("currency_code"), F.coalesce("lines", F.lit(0)).alias("lines"), F.when(F.col("all"), F.col("s")).alias("subtotal"), F.coalesce(F.col("open") | ~F.col("all"), F.lit(True)).alias("review_required"))
