"""Supplier feeds: pages, records, fingerprints, normal form, and what happens to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_unit, composed, normalize_identifier, squeeze, trim_u
from .tables import merge_by_key

#: The fields kept of a record, and the allowed names.
FIELDS = ["name", "nameAr", "nameEn", "type", "description", "descriptionAr", "descriptionEn", "modelNumber", "manufacturerName", "brandName", "categoryName", "aliases", "identifiers", "attributes"]
ITEM_TYPES = ["PRODUCT", "SERVICE", "SHIPPING", "LABOR", "DISCOUNT", "CUSTOM"]
ALIAS_TYPES = ["MONIKER", "SEARCH", "SYNONYM", "MPN", "HISTORICAL", "TRANSLITERATION"]
DATA_TYPES = ["STRING", "NUMBER", "BOOLEAN", "DECIMAL", "SELECT", "JSON"]
FIELD_BYTES, MAX_ENTRIES = 64_000, 100


#: Files one task writes.
PAGES_PER_TASK = 200


def write_feed_pages(pages: DataFrame, folder: str, per_task: int = PAGES_PER_TASK) -> None:
    """pages: (page, body), one file each in a folder page=<page>. Making a file takes longer than
    its bytes do, so tasks go by the number of pages, and put their files in place themselves."""
    n = max(1, -(-pages.count() // per_task))
    dealt = pages.repartition(n, "page").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    dealt.partitionBy("page").text(folder)


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, body): each file under the path is one page; folders are listed in parallel and
    their names are no columns."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("page"), F.col("value").alias("body"))


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages: (page, body, ...).  Records (page columns, position, record: JSON, next_cursor)
    of pages whose root is an array or an object with an array ``records``; and the
    other pages with an error."""
    v = F.try_parse_json("body")
    root = F.schema_of_variant(v)
    listed = F.coalesce(F.when(root.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.when(root.startswith("OBJECT"), F.try_variant_get(v, "$.records", "array<variant>")))
    cursor = F.when(root.startswith("OBJECT"), F.try_variant_get(v, "$.nextCursor", "string"))
    p = pages.withColumn("__list", listed).withColumn("next_cursor", F.when(F.length(cursor) <= 500, cursor))
    keep = [c for c in pages.columns if c != "body"]
    good = p.where("__list is not null").select(*keep, "next_cursor", F.posexplode("__list").alias("position", "r")).withColumn("record", F.to_json("r")).drop("r")
    return good, p.where("__list is null").select(*keep, F.lit("RECORDS_ARRAY_MISSING").alias("error"))


def to_envelopes(records: DataFrame) -> DataFrame:
    """Adds external_id, payload (JSON of the kept fields) and error.  A field over 64,000
    bytes is dropped; a record needs an id of 1 to 500 characters and such a name."""
    v = F.try_parse_json("record")
    text = lambda f: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.try_variant_get(v, f"$.{f}", "string"))
    ident = trim_u(F.coalesce(text("id"), text("externalId")))
    parts = []
    for f in FIELDS:
        part = F.to_json(F.try_variant_get(v, f"$.{f}", "variant"))
        parts.append(F.when(part.isNotNull() & (F.octet_length(part) <= FIELD_BYTES), F.concat(F.lit(f'"{f}":'), part)))
    payload = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    name = F.when(F.octet_length(F.to_json(F.try_variant_get(v, "$.name", "variant"))) <= FIELD_BYTES, text("name"))
    error = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "RECORD_INVALID").when(~F.coalesce(F.length(ident).between(1, 500), F.lit(False)), "IDENTITY_INVALID").when(~F.coalesce((trim_u(name) != "") & (F.length(name) <= 500), F.lit(False)), "NAME_INVALID")
    return records.select("*", F.when(error.isNull(), ident).alias("external_id"), F.when(error.isNull(), payload).alias("payload"), error.alias("error"))


def origin(url: Column) -> Column:
    """Scheme and authority, lower case, without a default port."""
    o = F.lower(F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY"))))
    return F.regexp_replace(F.regexp_replace(o, "^(http://[^/]*):80$", "$1"), "^(https://[^/]*):443$", "$1")


def check_page_bounds(envelopes: DataFrame, sources: DataFrame, strict: bool = True) -> DataFrame:
    """(page, error): too many records, a record from another origin, or, if strict, a
    bad record; null if the page stands. envelopes: page, source_id, url, error;
    sources: source_id, url, max_records_per_run."""
    s = sources.select("source_id", F.col("url").alias("__url"), F.col("max_records_per_run").alias("__most"))
    e = envelopes.join(s, "source_id", "left")
    foreign = ~F.coalesce(origin(F.col("url")) == origin(F.col("__url")), F.lit(False))
    g = e.groupBy("page").agg(F.count("*").alias("n"), F.max("__most").alias("most"), F.bool_or(foreign).alias("foreign"), F.min("error").alias("bad"))
    return g.select("page", F.when(F.col("n") > F.col("most"), "TOO_MANY_RECORDS").when(F.col("foreign"), "ORIGIN_MISMATCH").when(F.lit(strict), F.col("bad")).alias("error"))


def policy_verdict() -> Column:
    """The first of eight rules that a source breaks, or null."""
    blank = lambda c: F.coalesce(trim_u(c), F.lit("")) == ""
    is_not = lambda c, v: ~F.coalesce(F.col(c) == v, F.lit(False))
    rules = [
        (~F.coalesce("is_active", F.lit(False)), "SOURCE_INACTIVE"), (is_not("approval_state", "APPROVED"), "SOURCE_NOT_APPROVED"), (F.col("health_status") == "BLOCKED", "SOURCE_HEALTH_BLOCKED"), (is_not("commercial_use_state", "ALLOWED"), "COMMERCIAL_USE_NOT_ALLOWED"),
        (is_not("redistribution_state", "ALLOWED"), "REDISTRIBUTION_NOT_ALLOWED"), (F.coalesce("url", F.lit("")) == "", "SOURCE_URL_MISSING"), (blank("license_info") | blank("license_reference_url"), "LICENSE_EVIDENCE_MISSING"), (F.col("robots_policy") == "DISALLOWED", "SOURCE_POLICY_BLOCKED"),
    ]
    return F.coalesce(*[F.when(c, code) for c, code in rules])


def payload_hash(raw) -> Column:
    """SHA-256 of the JSON with sorted keys; the order of keys and blanks don't matter."""
    return F.sha2(F.to_json(F.try_parse_json(raw)), 256)


_RAW = """struct<name:string,nameAr:string,nameEn:string,description:string,descriptionAr:string,descriptionEn:string,type:string,categoryCode:string,categoryName:string,manufacturerName:string,manufacturerCode:string,brandName:string,brandCode:string,
familyName:string,familyCode:string,modelNumber:string,variantName:string,identifiers:array<struct<identifierType:string,value:string>>,aliases:array<struct<alias:string,locale:string,aliasType:string>>,attributes:array<struct<code:string,name:string,dataType:string,unit:string,value:variant>>>"""


def _first_by(items: str, keys: str) -> Column:
    """The items whose key has not come before, in order; both are array columns."""
    return F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


_TEXTS = ("name", "nameAr", "nameEn", "description", "descriptionAr", "descriptionEn", "categoryName", "manufacturerName", "brandName", "familyName", "modelNumber", "variantName")
_CODES = ("categoryCode", "manufacturerCode", "brandCode", "familyCode")


def normalize_payload(records: DataFrame) -> DataFrame:
    """records: source_id, payload (JSON), ...  Adds data (struct) and error: the first of
    name, type, identifiers, aliases, attributes that is wrong; data is null then.

    Each step is a projection of its own: all texts are composed in one call, entries of the
    arrays are folded once before rules ask for them, and so are the keys that tell repeats."""
    r = F.from_json("payload", _RAW)
    d = records.withColumn("__r", r)
    g = lambda f: F.col(f"__r.{f}")
    d = d.withColumn("__c", composed(F.array(*[g(f) for f in (*_TEXTS, *_CODES)])))
    cleaned = {f: squeeze(F.get("__c", F.lit(i))) for i, f in enumerate((*_TEXTS, *_CODES))}
    d = d.withColumn("__t", F.struct(*[(F.upper(v) if f in _CODES else v).alias(f) for f, v in cleaned.items()]))
    t = lambda f: F.col(f"__t.{f}")
    upper = lambda c: F.upper(trim_u(c))
    name = F.coalesce(t("name"), t("nameEn"), t("nameAr"))
    kind = F.when(F.coalesce(g("type"), F.lit("")) == "", "PRODUCT").otherwise(upper(g("type")))
    maker = F.coalesce(t("manufacturerCode"), t("manufacturerName"))
    listed = lambda f, kinds: F.coalesce(g(f), F.expr("array()").cast(f"array<struct<{kinds}>>"))

    folded = F.transform(listed("identifiers", "identifierType:string,value:string"), lambda x: F.struct(upper(x["identifierType"]).alias("type"), x["value"].alias("value"), trim_u(x["value"]).alias("raw")))

    def identifier(x):
        n = normalize_identifier(x["type"], x["value"], maker, F.col("source_id").cast("string"))
        return F.struct(x["type"].alias("type"), x["raw"].alias("raw"), n.alias("n"))

    ids = F.transform(F.transform(folded, identifier), lambda x: F.struct(x["type"].alias("type"), x["raw"].alias("raw"), x["n"]["value"].alias("value"), x["n"]["error"].alias("error")))
    typed = lambda x, default, known: F.when(F.coalesce(x, F.lit("")) == "", default).when(upper(x).isin(*known), upper(x)).otherwise("?")
    named = F.transform(listed("aliases", "alias:string,locale:string,aliasType:string"), lambda x: F.struct(squeeze(x["alias"]).alias("alias"), upper(x["locale"]).alias("locale"), typed(x["aliasType"], "SYNONYM", ALIAS_TYPES).alias("type")))
    locale = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit(None)).when(x.isin("EN", "ENGLISH"), "EN").when(x.isin("AR", "ARABIC"), "AR").otherwise("?")
    al = F.transform(F.filter(named, lambda x: x["alias"].isNotNull()), lambda x: F.struct(x["alias"].alias("alias"), locale(x["locale"]).alias("locale"), x["type"].alias("type")))

    coded = F.transform(
        listed("attributes", "code:string,name:string,dataType:string,unit:string,value:variant"),
        lambda x: F.struct(F.upper(squeeze(x["code"])).alias("code"), squeeze(x["name"]).alias("name"), typed(x["dataType"], "STRING", DATA_TYPES).alias("dataType"), F.coalesce(F.schema_of_variant(x["value"]), F.lit("VOID")).alias("holds"), F.to_json(x["value"]).alias("value"), squeeze(x["unit"]).alias("unit")),
    )

    def attribute(x):
        kind, v = x["dataType"], x["holds"]
        number = v.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        fits = F.when(kind.isin("NUMBER", "DECIMAL"), number).when(kind == "BOOLEAN", v == "BOOLEAN").when(kind.isin("STRING", "SELECT"), v == "STRING").when(kind == "JSON", v.startswith("OBJECT")).otherwise(False)
        return F.struct(x["code"].alias("code"), x["name"].alias("name"), kind.alias("dataType"), x["value"].alias("value"), canonical_unit(x["unit"]).alias("unit"), fits.alias("fits"))

    at = F.transform(F.filter(coded, lambda x: x["code"].isNotNull()), attribute)
    d = d.withColumns({"__i": ids, "__a": al, "__w": at})
    d = d.withColumns({
        "__ik": F.transform("__i", lambda x: F.concat_ws(":", x["type"], x["value"])), "__ak": F.transform("__a", lambda x: F.concat_ws(":", F.lower(x["alias"]), F.coalesce(x["locale"], F.lit("ALL")), x["type"])),
        "__wk": F.transform("__w", lambda x: x["code"]),
    })
    d = d.withColumn("__v", _first_by("__w", "__wk"))
    many = lambda f: F.size(F.coalesce(g(f), F.array())) > MAX_ENTRIES
    bad_id = F.get(F.filter("__i", lambda x: x["error"].isNotNull() | x["raw"].isNull()), F.lit(0))
    bad_alias = F.get(F.filter("__a", lambda x: (F.coalesce(x["locale"], F.lit("")) == "?") | (x["type"] == "?")), F.lit(0))
    bad_attr = F.get(F.filter("__v", lambda x: (x["dataType"] == "?") | ~x["fits"]), F.lit(0))
    error = F.coalesce(
        F.when(F.col("__r").isNull(), "PAYLOAD_INVALID"), F.when(name.isNull(), "NAME_REQUIRED"), F.when(~kind.isin(*ITEM_TYPES), "ITEM_TYPE_UNSUPPORTED"), F.when(many("identifiers"), "TOO_MANY_IDENTIFIERS"),
        F.when(bad_id.isNotNull(), F.coalesce(bad_id["error"], F.lit("IDENTIFIER_MALFORMED"))), F.when(many("aliases"), "TOO_MANY_ALIASES"), F.when(bad_alias.isNotNull(), F.when(bad_alias["locale"] == "?", "ALIAS_LOCALE_UNSUPPORTED").otherwise("ALIAS_TYPE_UNSUPPORTED")),
        F.when(many("attributes"), "TOO_MANY_ATTRIBUTES"), F.when(bad_attr.isNotNull(), F.when(bad_attr["dataType"] == "?", "DATA_TYPE_UNSUPPORTED").otherwise("ATTRIBUTE_VALUE_INVALID")),
    )
    slim = F.transform(_first_by("__i", "__ik"), lambda x: F.struct(x["type"].alias("type"), x["raw"].alias("raw"), x["value"].alias("value")))
    aliases = _first_by("__a", "__ak")
    attributes = F.transform("__v", lambda x: F.struct(*[x[c].alias(c) for c in ("code", "name", "dataType", "value", "unit")]))
    data = F.struct(name.alias("name"), kind.alias("type"), *[t(f).alias(f) for f in (*_TEXTS, *_CODES) if f != "name"], F.upper(t("modelNumber")).alias("normalizedModelNumber"), slim.alias("identifiers"), aliases.alias("aliases"), attributes.alias("attributes"))
    d = d.withColumn("error", error).withColumn("data", data)
    return d.select(*records.columns, F.when(F.col("error").isNull(), F.col("data")).alias("data"), "error")


_KEY = ["source_id", "external_id"]


def newest_per_key(records: DataFrame) -> DataFrame:
    """One record per (source_id, external_id): the last fetched."""
    w = Window.partitionBy(*_KEY).orderBy(F.desc("fetched_at"), "payload_hash")
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ingest_verdicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds verdict and status to the newest record of each key.

    incoming: source_id, external_id, fetched_at, payload_hash, error (of its normal form),
    resolved (status of its identity, null if not resolved yet); stored: source_id,
    external_id, payload_hash, status, fetched_at.  LATE if the stored one is newer;
    DUPLICATE for the same payload unless it FAILED; of a PUBLISHED one NEEDS_REVIEW, or
    UNCHANGED if the new payload is invalid; else REJECTED if invalid, or STAGED.
    """
    s = stored.select(*_KEY, F.col("payload_hash").alias("__h"), F.col("status").alias("__s"), F.col("fetched_at").alias("__f"))
    j = newest_per_key(incoming).join(s, _KEY, "left")
    same = (F.col("__h") == F.col("payload_hash")) & (F.col("__s") != "FAILED")
    verdict = (
        F.when(F.col("__f") > F.col("fetched_at"), "LATE").when(same, "DUPLICATE").when((F.col("__s") == "PUBLISHED") & F.col("error").isNotNull(), "UNCHANGED").when(F.col("__s") == "PUBLISHED", "NEEDS_REVIEW")
        .when(F.col("error").isNotNull(), "REJECTED").otherwise("STAGED")
    )
    status = F.when(verdict.isin("LATE", "DUPLICATE", "UNCHANGED"), F.col("__s")).when(verdict == "STAGED", F.coalesce("resolved", F.lit("NORMALIZED"))).otherwise(verdict)
    return j.withColumn("verdict", verdict).withColumn("status", status).withColumn("is_new", F.col("__h").isNull()).drop("__h", "__s", "__f")


def preview(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds preview: NEW, DUPLICATE or CHANGED, by hash alone."""
    j = incoming.join(stored.select(*_KEY, F.col("payload_hash").alias("__h")), _KEY, "left")
    return j.withColumn("preview", F.when(F.col("__h").isNull(), "NEW").when(F.col("__h") == F.col("payload_hash"), "DUPLICATE").otherwise("CHANGED")).drop("__h")


def merge_ingestion(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The record table after the verdicts; a replaced row starts anew."""
    changed = verdicts.where(F.col("verdict").isin("STAGED", "REJECTED", "NEEDS_REVIEW")).select(*_KEY, "payload_hash", "status", "fetched_at")
    reset = {c: v for c, v in {"retry_count": 0, "processing_started_at": None, "processed_at": None}.items() if c in stored.columns}
    return merge_by_key(stored, changed, _KEY, reset)


def ingestion_summary(records: DataFrame) -> DataFrame:
    """Per batch_id: processed, and how many of each end."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return records.groupBy("batch_id").agg(F.count("*").alias("processed"), n("PUBLISHED"), n("NEEDS_REVIEW"), n("REJECTED"), n("FAILED"))


def run_counters(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run_id: fetched, accepted, duplicate, changed, staged, review, rejected, status
    and consistent. outcomes: run_id, preview, verdict (REJECTED is not accepted);
    runs: run_id, dry_run, failed. A dry run stages nothing."""
    n = lambda c: F.count_if(c)
    rejected = F.col("verdict") == "REJECTED"
    g = outcomes.groupBy("run_id").agg(F.count("*").alias("fetched"), n(~rejected).alias("accepted"), n(F.col("preview") == "DUPLICATE").alias("duplicate"), n(F.col("preview") == "CHANGED").alias("changed"), n(F.col("verdict") == "STAGED").alias("__staged"), n(F.col("verdict") == "NEEDS_REVIEW").alias("review"), n(rejected).alias("rejected"))
    j = runs.join(g, "run_id", "left").na.fill(0, ["fetched", "accepted", "duplicate", "changed", "__staged", "review", "rejected"])
    j = j.withColumn("staged", F.when(F.col("dry_run"), 0).otherwise(F.col("__staged")))
    return j.select("run_id", "fetched", "accepted", "duplicate", "changed", "staged", "review", "rejected", F.when(F.col("failed"), "FAILED").otherwise("COMPLETED").alias("status"), ((F.col("accepted") + F.col("rejected") <= F.col("fetched")) & (F.col("staged") <= F.col("accepted"))).alias("consistent"))


GLOBAL_LIMIT = 1000


def quota_verdicts(requests: DataFrame, runs: DataFrame, sources: DataFrame, now: Column, global_limit: int = GLOBAL_LIMIT) -> DataFrame:
    """(request_id, verdict): DAILY_QUOTA_EXCEEDED, GLOBAL_PILOT_LIMIT, RATE_LIMITED or OK.
    requests: request_id, source_id, requested, dry_run; runs: source_id, created_at,
    status, dry_run, requested, reserved; sources: source_id, max_records_per_day,
    max_requests_per_minute, max_retries."""
    live = ~F.col("status").isin("BLOCKED", "CANCELLED")
    today = F.date_trunc("day", now)
    use = runs.groupBy("source_id").agg(F.sum(F.when(live & (F.col("created_at") >= today), F.col("requested"))).alias("__day"), F.sum(F.when(F.col("created_at") >= now - F.expr("interval 60 seconds"), F.col("reserved"))).alias("__minute"))
    total = runs.agg(F.sum(F.when(live & ~F.col("dry_run"), F.col("requested")))).first()[0] or 0
    j = requests.join(use, "source_id", "left").join(sources, "source_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    verdict = (
        F.when(zero("__day") + F.col("requested") > F.col("max_records_per_day"), "DAILY_QUOTA_EXCEEDED").when(~F.col("dry_run") & (F.lit(total) + F.col("requested") > global_limit), "GLOBAL_PILOT_LIMIT")
        .when(zero("__minute") + 1 + F.col("max_retries") > F.col("max_requests_per_minute"), "RATE_LIMITED").otherwise("OK")
    )
    return j.select("request_id", verdict.alias("verdict"))


def rate_usage(runs: DataFrame) -> DataFrame:
    """Adds minute_usage (reserved in the 60 seconds up to the run) and day_usage (requested
    since UTC midnight up to it). runs: id, source_id, created_at, requested, reserved.

    A source's runs are dealt by minute, so a source with most of the runs is many groups.  A
    run counts for its own minute and the next; of the day's earlier minutes only their
    sums are needed, a row per minute.
    """
    at = F.col("created_at").cast("timestamp")
    rows = runs.withColumns({"__us": F.unix_micros(at), "__minute": F.floor(F.unix_micros(at) / 60_000_000), "__day": F.to_date("created_at"), "__own": F.lit(True)})
    later = rows.where("__minute is not null").withColumns({"__minute": F.col("__minute") + 1, "__own": F.lit(False)})
    group = Window.partitionBy("source_id", "__minute")
    minute = group.orderBy("__us").rangeBetween(-60_000_000, 0)
    own = group.orderBy(F.desc("__own"), "created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(later).withColumn("minute_usage", F.sum("reserved").over(minute)).withColumn("__within", F.sum("requested").over(own)).where("__own")
    before = Window.partitionBy("source_id", "__day").orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_id", "__day", "__minute").agg(F.sum("requested").alias("__sum")).select(F.col("source_id").alias("__source"), F.col("__minute").alias("__at"), F.sum("__sum").over(before).alias("__before"))
    found = both.join(sums, F.col("source_id").eqNullSafe(F.col("__source")) & F.col("__minute").eqNullSafe(F.col("__at")), "left")
    total = F.when(F.col("__within").isNotNull() | F.col("__before").isNotNull(), F.coalesce("__within", F.lit(0)) + F.coalesce("__before", F.lit(0)))
    return found.select(*runs.columns, "minute_usage", total.alias("day_usage"))
