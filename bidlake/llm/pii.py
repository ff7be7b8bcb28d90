"""Personal data: patterns, and terms that give away what the patterns protect.

E-mail addresses, IP addresses, card and telephone numbers are found by pattern and
checked (parts, digits, Luhn).  Each distinct value is a protected entity.  A term is a
word of three letters or more; it is near a mention if both lie in one line and at most
``REACH`` characters apart.  Over the whole corpus, with n documents, n_t of them with the
term, n_c with the entity and n_tc with the term near the entity,

    PMI = log(n_tc (1 - 1 / m^2) n / (n_t n_c))    IC = log(n / n_c)

where m is the number of different texts among the n_tc: what a term tells of an
entity is judged by the texts besides the one at hand, so one text alone, however often
it is copied, proves nothing.  A term with PMI >= ``DISCLOSURE`` * IC gives the entity
away; near a mention of it the term becomes a span of kind ``term``, or a placeholder in
``sanitise``.  Documents without an entity are never touched.

Only DataFrame functions are used.  Positions are code points, end exclusive.

Defined results: a null text is an empty one; repeated rows each get their row (near an
entity they count as one document); rows of one id and different texts are kept apart; a
null id stays; an empty table gives no rows; texts are searched whole, and the time for a
text grows with its length, not with its square: patterns don't backtrack, places
are summed in blocks and near words are found by a join on places.  Of the input only
doc_id and text are read, so extra columns can't clash (``sanitise`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted, written

KINDS = ["email", "ip", "card", "phone", "term"]
DISCLOSURE, REACH = 0.9, 200
#: Candidate terms up to which they are broadcast to the corpus count.
MAX_BROADCAST_ROWS = 500_000

#: The contract's patterns, without backtracking: a match can only start where a run
#: of its first class starts, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't have a span of the kind.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
TERM = r"\p{L}{3,}+"
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    figures = F.reverse(F.filter(F.split(m, ""), lambda c: c.between("0", "9")))
    doubled = F.transform(figures, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.when(F.length(F.regexp_replace(p, "^0+", "")) == 0, 0).otherwise(999))
        return F.forall(F.split(m, r"\."), lambda p: part(p) <= 255)
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(m)).otherwise(False)
    return F.length(_digits(m)).between(10, 15)


def _value(kind: str, m: Column) -> Column:
    """What mentions of the same entity have in common."""
    plain = {"email": F.lower(m), "ip": m}.get(kind)
    return F.concat(F.lit(f"{kind}:"), _digits(m) if plain is None else plain)


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Numbers that are summed up as one block.
SUMMED = 256


def starts_of(sizes: Column) -> Column:
    """The sum of the sizes before each one, at least one of them, in blocks."""

    def running(values: Column, at: Column, size) -> Column:
        step = lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(values, F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step, lambda a: a["out"])

    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SUMMED).cast("int")), lambda c: F.slice(v, c * SUMMED + 1, SUMMED))
    blocks = lambda b: F.flatten(F.zip_with(b, running(b, F.lit(0), total), lambda c, at: running(c, at, lambda x: x)))
    return let(sizes, lambda v: let(cut(v), blocks))


def located(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order: array of (start, m).  The pieces between the
    matches give their places."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s, m: F.struct(F.length(s).alias("n"), m.alias("m")))

    def placed(p: Column) -> Column:
        at = starts_of(F.transform(p, lambda x: x["n"] + F.coalesce(F.length(x["m"]), F.lit(0))))
        every = F.zip_with(p, at, lambda x, a: F.struct((a + x["n"]).alias("start"), x["m"].alias("m")))
        return F.filter(every, lambda x: x["m"].isNotNull())

    return let(both, placed)


def _valid_span(kind: str):
    return lambda x: _valid(kind, x["m"])


def _as_span(kind: str, number: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), (x["start"] + F.length(x["m"])).alias("stop"), _value(kind, x["m"]).alias("value"))


def spans_of(text: Column) -> Column:
    """The base spans by start, then kind: array of (start, kind, stop, value)."""
    none = F.expr(f"cast(array() as {_SPAN})")
    found = []
    for number, kind in enumerate(KINDS[:4]):
        good = F.filter(located(text, PATTERNS[kind]), _valid_span(kind))
        spans = F.transform(good, _as_span(kind, number))
        found.append(F.when(_HINTS[kind](text), spans).otherwise(none))
    return F.sort_array(F.concat(*found))


def _based(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lines: array of (at, line, spans)), written: the lines with a span;
    key tells texts of one id apart.  No match holds a line's end, so lines are
    searched one by one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    hint = _HINTS["email"](F.col("text")) | _HINTS["ip"](F.col("text")) | _HINTS["card"](F.col("text")) | _HINTS["phone"](F.col("text"))

    def spanned(lines: Column) -> Column:
        at = starts_of(F.transform(lines, lambda x: F.length(x) + 1))
        every = F.zip_with(lines, at, lambda x, a: F.struct(a.alias("at"), x.alias("line"), spans_of(x).alias("spans")))
        return F.filter(every, lambda x: F.size(x["spans"]) > 0)

    lines = F.when(hint, let(F.split("text", "\n", -1), spanned))
    return written(base.select("doc_id", "key", lines.alias("lines")), "pii-base")


#: Characters to a place in the join of mentions and words.
PLACE = 256


def _contexts(base: DataFrame, reach: int) -> DataFrame:
    """(doc_id, key, value, term, start, stop): the terms near each mention that lie in
    no span."""
    # Rows that are equal have the same contexts: one of them speaks for all.
    one = base.where("size(lines) > 0").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.inline("lines"))
    places = lambda a, b: F.sequence(F.floor(a / PLACE), F.floor(b / PLACE))
    s = one.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("at").alias("__at"), F.explode("spans").alias("s"))
    s = s.select("__id", "__key", "__at", (F.col("s.start") + F.col("__at")).alias("a"), (F.col("s.stop") + F.col("__at")).alias("b"), F.col("s.value").alias("value"))
    s = s.withColumn("__place", F.explode(places(F.col("a") - reach, F.col("b") + reach)))
    w = one.select("doc_id", "key", "at", F.explode(located(F.col("line"), TERM)).alias("w"))
    w = w.select("doc_id", "key", "at", F.lower("w.m").alias("term"), (F.col("w.start") + F.col("at")).alias("start"), (F.col("w.start") + F.col("at") + F.length("w.m")).alias("stop"))
    w = w.withColumn("place", F.explode(places(F.col("start"), F.col("stop"))))
    j = w.join(s, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")) & (F.col("at") == F.col("__at")) & (F.col("place") == F.col("__place")))
    near = (F.col("start") <= F.col("b") + reach) & (F.col("stop") >= F.col("a") - reach)
    inside = F.bool_or((F.col("a") < F.col("stop")) & (F.col("start") < F.col("b"))).alias("inside")
    g = j.groupBy("doc_id", "key", "term", "start", "stop").agg(inside, F.collect_set(F.when(near, F.col("value"))).alias("values"))
    return g.where(~F.col("inside")).select("doc_id", "key", F.explode("values").alias("value"), "term", "start", "stop")


def disclosing(docs: DataFrame, base: DataFrame, contexts: DataFrame, disclosure: float = DISCLOSURE, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(value, term, n): the term gives the entity away, and how many contexts have both;
    counts over all documents."""
    total = base.count()
    per = contexts.groupBy("value", "term", "doc_id", "key").agg(F.count("*").alias("times"))
    pairs = per.groupBy("value", "term").agg(F.count("*").alias("n_tc"), F.count_distinct("key").alias("m"), F.sum("times").alias("n")).where("m > 1")
    pairs = written(pairs, "pii-pairs")
    values = base.where("size(lines) > 0").select("doc_id", "key", F.explode(F.array_distinct(F.flatten(F.transform("lines", lambda x: F.transform(x["spans"], lambda s: s["value"]))))).alias("value"))
    holding = values.distinct().groupBy("value").agg(F.count("*").alias("n_c"))
    asked = written(pairs.select("term").distinct(), "pii-terms")
    terms = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TERM), F.lit(0))
    words = docs.select(F.explode(F.array_distinct(F.transform(terms, F.lower))).alias("term"))
    if asked.limit(most + 1).count() <= most:
        words = words.join(F.broadcast(asked), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    known = pairs.join(counts, "term").join(holding, "value")
    n = F.lit(float(total))
    pmi = F.log(F.col("n_tc") * (1 - 1 / (F.col("m") * F.col("m"))) * n / (F.col("n_t") * F.col("n_c")))
    return known.where(pmi >= disclosure * F.log(n / F.col("n_c"))).select("value", "term", "n")


def find(docs: DataFrame, disclosure: float = DISCLOSURE, reach: int = REACH, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A row per document: doc_id, key, base (array of spans), every (base and term
    spans): (start, kind, stop), by start, then kind."""
    base = _based(docs)
    contexts = written(_contexts(base, reach), "pii-contexts")
    told = written(disclosing(docs, base, contexts, disclosure, most), "pii-told")
    hit = salted(contexts, told.drop("n"), told, ["value", "term"], contexts.count(), by=["doc_id", "key", "start"])
    terms = hit.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set(F.struct(F.col("start"), F.lit(4).alias("kind"), F.col("stop"))).alias("terms_found"))
    joined = base.join(terms, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    moved = lambda at, s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["stop"] + at).alias("stop"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    slim = F.coalesce(F.flatten(F.transform("lines", lambda x: F.transform(x["spans"], lambda s: moved(x["at"], s)))), none)
    return joined.select("doc_id", "key", slim.alias("base"), F.sort_array(F.concat(slim, F.coalesce("terms_found", none))).alias("every"))


def said(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """The columns of docs with [EMAIL], [IP], [CARD], [PHONE] or [TERM] in the place of
    each span; of overlapping spans the first stands for all."""
    found = find(docs, **parameters).where(F.size("every") > 0).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "every").dropDuplicates(["__id", "__key"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("__of"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    joined = rows.join(found, F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key")), "left")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    built = F.aggregate(
        "every", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["stop"].alias("at"), F.concat(a["out"], F.array(F.substr(F.col("__text"), a["at"] + 1, s["start"] - a["at"]), F.get(marks, s["kind"]))).alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("__text"), a["at"] + 1)),
    )
    new = F.when(F.col("every").isNotNull(), built).otherwise(F.col("__row.text"))
    return joined.select(*[(new if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("every")).alias("spans"))


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(generate_series(1, length({digits})), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr({digits}, length({digits}) - j + 1, 1) AS INT) ELSE 2 * CAST(substr({digits}, length({digits}) - j + 1, 1) AS INT) - CASE WHEN CAST(substr({digits}, length({digits}) - j + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    valid = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda x: TRY_CAST(x AS BIGINT) IS NULL OR TRY_CAST(x AS BIGINT) > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END", "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    value = {"email": "lower(m)", "ip": "m"}

    def places(source: str, text: str, pattern: str, keep: str) -> str:
        at = "CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
        cut = f"SELECT *, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS ps FROM {source} WHERE regexp_matches({text}, '{pattern}')"
        return f"SELECT {keep}, m, {at} AS start FROM (SELECT *, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS i FROM ({cut}))"

    spans = " UNION ALL ".join(f"SELECT doc_id, {n} AS no, '{k}' AS kind, start, start + length(m) AS stop, '{k}:' || {value.get(k, digits)} AS value FROM ({places('d', 't', plain[k], 'doc_id')}) WHERE {valid[k]}" for n, k in enumerate(KINDS[:4]))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), sp AS MATERIALIZED ({spans}),
ln AS (SELECT doc_id, l AS line, CAST(coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS pos FROM (SELECT doc_id, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS i, ls FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d WHERE doc_id IN (SELECT doc_id FROM sp)))),
el AS (SELECT DISTINCT ln.* FROM ln JOIN sp ON sp.doc_id = ln.doc_id AND sp.start >= pos AND sp.start < pos + length(line)),
w AS (SELECT doc_id, line, pos, lower(m) AS term, pos + start AS a, pos + start + length(m) AS b FROM ({places('el', 'line', chr(92) + 'p{L}{3,}', 'doc_id, line, pos')})),
free AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = w.doc_id AND sp.start < w.b AND w.a < sp.stop AND sp.start >= w.pos AND sp.start < w.pos + length(w.line))),
ctx AS (SELECT DISTINCT free.doc_id, line, value, term, a, b FROM free JOIN sp ON sp.doc_id = free.doc_id AND sp.start >= pos AND sp.start < pos + length(line) AND a <= sp.stop + {REACH} AND b >= sp.start - {REACH}),
pairs AS (SELECT value, term, count(DISTINCT doc_id) AS n_tc, count(DISTINCT t) AS m FROM ctx JOIN d USING (doc_id) GROUP BY value, term HAVING m > 1),
holding AS (SELECT value, count(DISTINCT doc_id) AS n_c FROM sp GROUP BY value), n AS (SELECT count(*) AS n FROM d),
nt AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(t, '\p{{L}}{{3,}}'))) AS term FROM d) GROUP BY term),
told AS (SELECT value, term FROM pairs JOIN nt USING (term) JOIN holding USING (value), n WHERE ln(n_tc * (1 - 1.0 / (m * m)) * CAST(n AS DOUBLE) / (n_t * n_c)) >= {DISCLOSURE} * ln(CAST(n AS DOUBLE) / n_c)),
every AS (SELECT doc_id, no, kind, start, stop FROM sp UNION ALL SELECT DISTINCT doc_id, 4, 'term', a, b FROM ctx JOIN told USING (value, term)),
out AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE no = {n}) AS n_{k}" for n, k in enumerate(KINDS[:4]))}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) FILTER (WHERE no < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN out USING (doc_id)
"""


ORACLE = _oracle()
