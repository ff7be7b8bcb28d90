"""Which library item a feed record is.

All evidence is one table of (rule, key): global codes, maker with part number, maker
with model, earlier reference of the source, maker with name.  The library side is
reduced to the smallest and largest item per key before the join, so a placeholder
code that thousands of items hold is one row, and "more than one item" stays known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import GLOBAL_LENGTHS
from ..sources.tables import written

SEP = "\x1f"
GLOBAL, MPN, MODEL, SOURCE, NAME = 1, 2, 3, 4, 5


def pair(a, b) -> Column:
    """A key of two parts, both without regard to case; null if one is."""
    low = lambda c: F.lower(F.col(c) if isinstance(c, str) else c)
    return F.concat(low(a), F.lit(SEP), low(b))


def record_keys(records: DataFrame) -> DataFrame:
    """(record_id, rule, key). records: record_id, source_id, external_id, maker_name,
    maker_code, model_number, name, identifiers array<struct<type,value>> (normalized)."""
    maker = F.coalesce("maker_name", "maker_code")
    codes = records.select("record_id", maker.alias("maker"), F.explode("identifiers").alias("i"))
    parts = [
        codes.where(F.col("i.type").isin(*GLOBAL_LENGTHS)).select("record_id", F.lit(GLOBAL).alias("rule"), F.col("i.value").alias("key")),
        codes.where("i.type = 'MPN'").select("record_id", F.lit(MPN).alias("rule"), pair("maker", F.col("i.value")).alias("key")),
        records.select("record_id", F.lit(MODEL).alias("rule"), pair("maker_name", "model_number").alias("key")),
        records.select("record_id", F.lit(SOURCE).alias("rule"), F.concat_ws(SEP, "source_id", "external_id").alias("key")),
        records.select("record_id", F.lit(NAME).alias("rule"), pair("maker_name", "name").alias("key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key is not null").distinct()


def library_keys(items: DataFrame, identifiers: DataFrame, earlier: DataFrame) -> DataFrame:
    """(rule, key, item_id) of active items. items: item_id, name, maker, model_number,
    is_active; identifiers: item_id, identifier_type, normalized_value; earlier:
    source_id, external_id, matched_item_id."""
    active = items.where("is_active")
    of = identifiers.join(active.select("item_id", "maker"), "item_id")
    parts = [
        of.where(F.col("identifier_type").isin(*GLOBAL_LENGTHS)).select(F.lit(GLOBAL).alias("rule"), F.col("normalized_value").alias("key"), "item_id"),
        of.where("identifier_type = 'MPN'").select(F.lit(MPN).alias("rule"), pair("maker", "normalized_value").alias("key"), "item_id"),
        active.select(F.lit(MODEL).alias("rule"), pair("maker", "model_number").alias("key"), "item_id"),
        active.select(F.lit(NAME).alias("rule"), pair("maker", "name").alias("key"), "item_id"),
        earlier.select(F.concat_ws(SEP, "source_id", "external_id").alias("key"), F.col("matched_item_id").alias("item_id")).join(active.select("item_id"), "item_id").select(F.lit(SOURCE).alias("rule"), "key", "item_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key is not null")


def evidence(records: DataFrame, library: DataFrame) -> DataFrame:
    """(record_id, rule, lo, hi): the smallest and largest matching item of each rule;
    equal means exactly one. library: the rows of library_keys."""
    bounds = library.groupBy("rule", "key").agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
    return record_keys(records).join(bounds, ["rule", "key"]).groupBy("record_id", "rule").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def resolve_identity(records: DataFrame, library: DataFrame) -> DataFrame:
    """(record_id, matched_item_id, reason, status) for every record: global codes, then
    maker and part number, maker and model, source reference, maker and name.
    Two items for a rule, or one other than the source reference's, go to review.
    Distinct items count, not identifier rows."""
    wide = evidence(records, library).groupBy("record_id").agg(
        *[F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{c}{r}") for r in (GLOBAL, MPN, MODEL, SOURCE, NAME) for c in ("lo", "hi")]
    )
    out = records.select("record_id").join(wide, "record_id", "left")
    src = F.col(f"lo{SOURCE}")

    def found(rule: int, reason: str) -> Column:
        lo, hi = F.col(f"lo{rule}"), F.col(f"hi{rule}")
        clash = (lo != hi) | F.coalesce(src != lo, F.lit(False))
        good = F.struct(lo.alias("id"), F.when(src.isNotNull(), "EXISTING_SOURCE_EXTERNAL_REF").otherwise(reason).alias("reason"), F.lit("MATCHED").alias("status"))
        return F.when(lo.isNotNull(), F.when(clash, review).otherwise(good))

    none = F.lit(None).cast(library.schema["item_id"].dataType)
    review = F.struct(none.alias("id"), F.lit("AMBIGUOUS_MULTIPLE_MATCHES").alias("reason"), F.lit("NEEDS_REVIEW").alias("status"))
    by_source = F.when(src.isNotNull(), F.struct(src.alias("id"), F.lit("EXISTING_SOURCE_EXTERNAL_REF").alias("reason"), F.lit("MATCHED").alias("status")))
    lo, hi = F.col(f"lo{NAME}"), F.col(f"hi{NAME}")
    by_name = F.when(lo.isNotNull(), F.when(lo != hi, review).otherwise(F.struct(lo.alias("id"), F.lit("CONSERVATIVE_NAME_MATCH").alias("reason"), F.lit("MATCHED").alias("status"))))
    new = F.struct(none.alias("id"), F.lit("NO_MATCH").alias("reason"), F.lit("NORMALIZED").alias("status"))
    v = F.coalesce(found(GLOBAL, "EXACT_GLOBAL_IDENTIFIER"), found(MPN, "EXACT_MANUFACTURER_MPN"), found(MODEL, "EXACT_MANUFACTURER_MODEL"), by_source, by_name, new)
    return out.select("record_id", v.alias("v")).select("record_id", F.col("v.id").alias("matched_item_id"), "v.reason", "v.status")


def lookup_identifiers(requests: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(request_id, verdict, item_id): FOUND, NOT_FOUND, or AMBIGUOUS where two rows or
    more have the type, value and scope. Both sides: identifier_type, value, scope."""
    rows = identifiers.groupBy("identifier_type", "value", "scope").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
    out = requests.join(rows, ["identifier_type", "value", "scope"], "left")
    verdict = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS").otherwise("FOUND")
    return out.select("request_id", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("item_id")).alias("item_id"))


def duplicate_keys(df: DataFrame, keys: dict[str, list]) -> DataFrame:
    """(rule, key, n) for keys that occur twice or more; a null part is no key."""
    out = None
    for rule, columns in keys.items():
        parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
        one = df.select(F.lit(rule).alias("rule"), F.when(~_any_null(parts), F.concat_ws("|", *parts)).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out.where("key is not null").groupBy("rule", "key").agg(F.count("*").alias("n")).where("n > 1")


def _any_null(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p.isNull()
    return out


def cluster_batch(records: DataFrame, keys: DataFrame, library: DataFrame) -> DataFrame:
    """(record_id, item_id, verdict): CREATED, JOINED or FAILED, as if the records were published
    one after the other by (created_at, record_id).

    records: record_id, created_at; keys: record_id, tier (1 global, 2 part number, 3
    model), key; library: tier, key, item_id.  A record follows the items its keys
    already have, of the first tier that has any; two items fail it, and then its
    keys pass to the next holder.

    Each pass takes some records as failed (none at first), lets every record follow the
    earliest standing holder of a key, and finds whom all follow in the end by pointer jumping:
    the links of a chain are few rounds, and records that have arrived leave the rounds.  Then
    the holders of all keys of a record are compared, which tells who fails.  Where that
    is not as taken, the records that share a key with a changed one, and those that follow the
    same items, go through another pass, and all others are done.  A record depends on earlier
    ones only, so the state that no pass changes is that of one after the other.
    """
    order = F.struct("created_at", "record_id")
    own = F.concat(F.lit("new-"), F.col("record_id").cast("string"))
    owned = library.groupBy("tier", "key").agg(F.min(F.col("item_id").cast("string")).alias("lib_lo"), F.max(F.col("item_id").cast("string")).alias("lib_hi"))
    held = keys.select("record_id", "tier", "key").distinct().join(records.select("record_id", order.alias("at")), "record_id")
    held = written(held.join(owned, ["tier", "key"], "left"), "cluster-keys")
    state = records.select("record_id", F.lit(None).cast("string").alias("item_id"), F.lit("CREATED").alias("verdict"))
    active = records.select("record_id").distinct()
    first = True
    while True:
        mine = held if first else held.join(active, "record_id", "left_semi")
        near = held if first else held.join(mine.select("tier", "key").distinct(), ["tier", "key"], "left_semi")
        standing = near if first else near.join(state.where("verdict = 'FAILED'"), "record_id", "left_anti")
        holder = standing.groupBy("tier", "key").agg(F.min("at").alias("f"))
        seen = mine.join(holder, ["tier", "key"], "left")
        earlier = F.when(F.col("lib_lo").isNull() & (F.col("f") < F.col("at")), F.col("f.record_id"))
        tiers = seen.select("record_id", "tier", "lib_lo", "lib_hi", earlier.alias("of")).where("lib_lo is not null or of is not null")
        tiers = tiers.groupBy("record_id", "tier").agg(F.min("lib_lo").alias("lo"), F.max("lib_hi").alias("hi"), F.array_sort(F.collect_set("of")).alias("of"))
        best = tiers.groupBy("record_id").agg(F.min(F.struct("tier", "lo", "hi", "of")).alias("b")).select("record_id", "b.lo", "b.hi", "b.of")
        links = active.join(best, "record_id", "left")
        item = F.when(F.col("lo").isNotNull(), F.col("lo")).when(F.coalesce(F.size("of"), F.lit(0)) < 1, own)
        links = written(links.withColumn("item_id", item).withColumn("up", F.when(F.col("item_id").isNull(), F.element_at("of", 1))), "cluster-links")
        settled = state if first else state.join(active, "record_id", "left_anti")
        items = _arrive(links, None if first else settled)
        # Who follows two: records with one source need no look.
        several = links.where("size(of) + if(lo is null, 0, 1) > 1").select("record_id", F.explode("of").alias("__of"))
        others = items if first else items.unionByName(settled.select("record_id", "item_id"))
        met = several.join(others.select(F.col("record_id").alias("__of"), F.col("item_id").alias("met")), "__of").groupBy("record_id").agg(F.min("met").alias("least"), F.max("met").alias("most"))
        new = links.select("record_id", "lo", "hi", "of").join(items, "record_id").join(met, "record_id", "left")
        clash = (F.coalesce(F.least("lo", "least"), F.col("item_id")) != F.coalesce(F.greatest("hi", "most"), F.col("item_id")))
        verdict = F.when(F.coalesce(F.col("lo").isNull() & (F.size("of") < 1), F.lit(True)), "CREATED").when(clash, "FAILED").otherwise("JOINED")
        new = new.select("record_id", F.when(verdict != "FAILED", F.col("item_id")).alias("item_id"), verdict.alias("verdict"))
        was = state.select("record_id", F.col("item_id").alias("__item"), F.col("verdict").alias("__verdict"))
        fell = (F.col("verdict") == "FAILED") != (F.col("__verdict") == "FAILED")
        changed = fell if first else fell | ~F.col("item_id").eqNullSafe(F.col("__item"))
        new = new.join(was, "record_id").withColumn("changed", changed).select("record_id", "item_id", "verdict", "changed", "__item")
        now = new if first else new.unionByName(settled.select("record_id", "item_id", "verdict", F.lit(False).alias("changed"), F.col("item_id").alias("__item")))
        now = written(now, "cluster-state")
        state = now.select("record_id", "item_id", "verdict")
        moved = now.where("changed")
        if moved.isEmpty():
            return state
        shared = held.join(moved.select("record_id"), "record_id", "left_semi").select("tier", "key").distinct()
        touched = held.join(shared, ["tier", "key"], "left_semi").select("record_id").distinct()
        trees = now.join(touched, "record_id", "left_semi").select(F.explode(F.array("item_id", "__item")).alias("item_id")).where("item_id is not null").distinct()
        active = written(touched.unionByName(state.join(trees, "item_id", "left_semi").select("record_id")).distinct(), "cluster-active")
        first = False


def _arrive(links: DataFrame, settled: DataFrame | None) -> DataFrame:
    """(record_id, item_id): the item at the end of each record's chain of ``up``.  A round
    follows two links of the round before, so links grow threefold; what has an item
    leaves the rounds."""
    if settled is not None:
        known = settled.select(F.col("record_id").alias("up"), F.col("item_id").alias("known"))
        links = written(links.join(known, "up", "left").withColumn("item_id", F.coalesce("item_id", "known")), "cluster-links")
    there = [links.where("item_id is not null").select("record_id", "item_id")]
    open_ = links.where("item_id is null").select("record_id", "item_id", "up")
    base = there[0]
    while not open_.isEmpty():
        step = base.select(F.col("record_id").alias("__at"), F.col("item_id").alias("__item"), F.lit(None).cast(open_.schema["up"].dataType).alias("__up"))
        step = step.unionByName(open_.select(F.col("record_id").alias("__at"), F.col("item_id").alias("__item"), F.col("up").alias("__up")))
        for _ in range(2):
            open_ = open_.join(step, F.col("up") == F.col("__at"), "left").select("record_id", F.coalesce("item_id", "__item").alias("item_id"), F.when(F.coalesce("item_id", "__item").isNull(), F.col("__up")).alias("up"))
        # Where it stands now may have had an item already; after this, all open ones point to
        # records that were open too, and the next round needs only those that arrive in this.
        ends = base.select(F.col("record_id").alias("__at"), F.col("item_id").alias("__item"))
        open_ = open_.join(ends, F.col("up") == F.col("__at"), "left").select("record_id", F.coalesce("item_id", "__item").alias("item_id"), "up")
        moved = written(open_, "cluster-jumps")
        base = moved.where("item_id is not null").select("record_id", "item_id")
        there.append(base)
        open_ = moved.where("item_id is null")
    return reduce(DataFrame.unionByName, there)
