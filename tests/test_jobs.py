"""The rules that jobs must keep, on literal rows and against plain Python."""

import math
import random
import uuid

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidlake.functions import money, text
from bidlake.operators import documents, identity, localize, requests, search, vectors
from bidlake.sources import feed, tables


def py_round3(v):
    return math.floor((v + 2**-52) * 1000 + 0.5) / 1000


def py_line(q, p, kind, value, tax):
    s = py_round3(q * p)
    d = 0.0 if kind is None else py_round3(s * (value / 100)) if kind == "PERCENTAGE" else py_round3(value)
    b = py_round3(s - d)
    t = py_round3(b * (tax / 100))
    return s, d, t, py_round3(b + t)


def test_line_amounts_against_python(spark):
    r = random.Random(1)
    rows = [(i, 1, "x", r.choice([1.0, 0.333, 7.5, 1000.001]), round(r.uniform(0, 999), 3), r.choice([None, "PERCENTAGE", "FIXED"]), round(r.uniform(0, 9), 2), r.choice([0.0, 5.0, 17.25])) for i in range(300)]
    rows += [(1000, 1, "x", 1.0, 1.0005, None, 0.0, 0.0), (1001, 1, "x", 3.0, 1.005, "PERCENTAGE", 33.333, 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, position int, item_name string, quantity double, unit_price double, discount_type string, discount_value double, tax_percentage double")
    got = {r["doc_id"]: r for r in money.with_line_amounts(df).collect()}
    for i, _, _, q, p, k, v, t in rows:
        want = py_line(q, p, k, v, t)
        assert tuple(float(got[i][c]) for c in ("subtotal", "discount_amount", "tax_amount", "total_amount")) == pytest.approx(want, abs=1e-9)


def test_document_totals_and_errors(spark):
    line = "doc_id long, position int, item_name string, quantity double, unit_price double, discount_type string, discount_value double, tax_percentage double"
    lines = spark.createDataFrame([
        (1, 1, "a", 10.0, 100.0, None, None, 0.0), (2, 1, "a", 3.0, 33.333, "PERCENTAGE", 10.0, 5.0), (2, 2, "b", 1.0, 10.0, "FIXED", 1.0, 15.0), (3, 1, "a", 1.0, 1.0, None, None, 0.0), (3, 1, "b", 1.0, 1.0, None, None, 0.0),
        (4, 2, "a", 0.0, 1.0, None, None, 0.0), (4, 1, " ", 0.0, 1.0, None, None, 0.0), (5, 1, "a", 1.0, 5.0, "FIXED", 6.0, 0.0), (6, 1, "a", 1.0, 5.0, None, None, 0.0), (7, 1, "a", 1.0, 5.0, "OTHER", 1.0, 0.0),
    ], line)
    heads = spark.createDataFrame([(i, "PERCENTAGE" if i == 2 else "FIXED" if i == 6 else None, 5.0 if i == 2 else 9.0 if i == 6 else None) for i in range(1, 9)], "doc_id long, discount_type string, discount_value double")
    got = {r["doc_id"]: r for r in money.document_totals(lines, heads).collect()}
    assert float(got[1]["total_amount"]) == 1000.0
    a, b = py_line(3.0, 33.333, "PERCENTAGE", 10.0, 5.0), py_line(1.0, 10.0, "FIXED", 1.0, 15.0)
    s = py_round3(a[0] - a[1] + b[0] - b[1])
    d = py_round3(s * 0.05)
    before = py_round3(a[2] + b[2])
    t = py_round3(before - d * py_round3(before / s))
    assert float(got[2]["total_amount"]) == pytest.approx(py_round3(s - d + t))
    assert {i: got[i]["error"] for i in range(3, 9)} == {3: "DUPLICATE_POSITION", 4: "NAME_REQUIRED", 5: "DISCOUNT_EXCEEDS_BASE", 6: "DISCOUNT_EXCEEDS_BASE", 7: "DISCOUNT_TYPE_UNSUPPORTED", 8: "NO_LINES"}


def test_text_rules(spark):
    one = spark.createDataFrame([("  Hikvision   DS x  Å  ",)], "t string")
    assert one.select(text.clean_text("t")).first()[0] == "Hikvision DS x Å"
    units = spark.createDataFrame([(" KGs ",), ("METERS",), ("Box",), ("metres",)], "u string").select(text.canonical_unit("u")).collect()
    assert [r[0] for r in units] == ["kg", "m", "Box", "metres"]
    ids = spark.createDataFrame([("GTIN_13", " 694-1218201234 ", None, None), ("GTIN_13", "ABC", None, None), ("UPC", "123", None, None), ("MPN", "  ds-2cd   2143  ", "m", None), ("MPN", "x", None, None), ("EXTERNAL_ID", " AbC-123 ", None, "v"), ("EXTERNAL_ID", "x", None, None), ("UNKNOWN", "x", None, None)], "k string, v string, m string, s string")
    got = [tuple(r[0]) for r in ids.select(text.normalize_identifier("k", "v", "m", "s")).collect()]
    assert got == [("6941218201234", None), (None, "IDENTIFIER_FORMAT_INVALID"), (None, "IDENTIFIER_FORMAT_INVALID"), ("DS-2CD 2143", None), (None, "IDENTIFIER_MANUFACTURER_REQUIRED"), ("AbC-123", None), (None, "IDENTIFIER_SOURCE_REQUIRED"), (None, "IDENTIFIER_TYPE_UNSUPPORTED")]
    keys = spark.createDataFrame([("  Ｋ-100_a/b ",), ("k 100 A,B",)], "t string").select(text.match_key("t")).collect()
    assert keys[0][0] == keys[1][0] == "k 100 a b"


def sequential(records, keys, library):
    """Records published one after the other."""
    owner = dict(library)
    out = {}
    for _, rid in sorted(records):
        mine = sorted(keys.get(rid, []))
        best = None
        for tier in (1, 2, 3):
            found = {owner[k] for k in mine if k[0] == tier and k in owner}
            if found:
                best = found
                break
        if best is None:
            out[rid] = (f"new-{rid}", "CREATED")
        elif len(best) > 1:
            out[rid] = (None, "FAILED")
            continue
        else:
            out[rid] = (next(iter(best)), "JOINED")
        for k in mine:
            owner.setdefault(k, out[rid][0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_clusters_against_a_loop(spark, seed):
    r = random.Random(seed)
    records = [(r.randrange(50), i) for i in range(80)]
    keys = {i: {(t, f"k{t}-{r.randrange(25)}") for t in (1, 2, 3) if r.random() < 0.5} for _, i in records}
    library = {(1, f"k1-{i}"): f"lib{i}" for i in range(4)}
    got = identity.cluster_batch(
        spark.createDataFrame([(i, c) for c, i in records], "record_id long, created_at long"), spark.createDataFrame([(i, t, k) for i, ks in keys.items() for t, k in ks], "record_id long, tier int, key string"),
        spark.createDataFrame([(t, k, v) for (t, k), v in library.items()], "tier int, key string, item_id string"),
    )
    assert {x["record_id"]: (x["item_id"], x["verdict"]) for x in got.collect()} == sequential(records, keys, library)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab é", max_size=5), max_size=5), st.lists(st.text("ab éC", max_size=12), max_size=8))
def test_contains_join_against_python(spark, queries, texts):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    got = {(r[0], r[1]) for r in search.contains_join(q, t).collect()}
    assert got == {(i, j) for i, a in enumerate(queries) if a for j, b in enumerate(texts) if a.lower() in b.lower()}


def test_scores_and_ranking(spark):
    base = {"query_id": 1, "q_type": None, "q_category_id": None, "q_manufacturer_id": None, "q_brand_id": None, "sku": None, "model_number": None, "name_ar": None, "name_en": None, "description": None, "description_ar": None, "description_en": None, "type": "PRODUCT", "category_id": "c", "manufacturer_id": None, "brand_id": None}
    cat = base | {"origin": "COMPANY_CATALOG", "item_id": "cat-1", "code": "CAM-01", "barcode": "12345678", "display_name": "Standard Security Camera", "identifiers": [], "aliases": []}
    lib = base | {"origin": "UNIVERSAL_LIBRARY", "item_id": "ucl-1", "code": None, "barcode": None, "display_name": "Global CCTV Camera X", "identifiers": ["6941218201234"], "aliases": ["Hikvision Camera 4MP"]}
    schema = ", ".join(f"{c} {'int' if c == 'query_id' else 'array<string>' if c in ('identifiers', 'aliases') else 'string'}" for c in [*cat, "query"]) + ", sim double"

    def ask(q, sim=None):
        df = spark.createDataFrame([tuple(x.values()) + (q, sim) for x in (cat, lib)], schema)
        return {r["item_id"]: r for r in search.rank_candidates(search.scored(df, "sim")).collect()}

    assert ask("CAM-01")["cat-1"]["match_reasons"] == ["EXACT_CODE", "COMPANY_CATALOG_PRIORITY"] and ask("CAM-01")["cat-1"]["rank"] == 1
    a = ask("6941218201234")
    assert (a["ucl-1"]["score"], a["cat-1"]["score"]) == (9000, 100)
    assert ask("694-1218-201234")["ucl-1"]["match_reasons"] == ["EXACT_IDENTIFIER"]
    assert ask("Hikvision Camera 4MP")["ucl-1"]["match_reasons"] == ["ALIAS_MATCH"]
    assert ask(None)["ucl-1"]["score"] == 1000 and ask(None)["cat-1"]["score"] == 1100
    assert ask("camera x", 1.0)["ucl-1"]["score"] == 5000 and ask("CAM-01", 1.0)["cat-1"]["score"] == 10100


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])]
    top = vectors.vector_topk(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>"), spark.createDataFrame(rows, "item_id long, vector array<float>"), 3)
    assert [(r["item_id"], round(r["similarity"], 3)) for r in top.orderBy("rank").collect()] == [(1, 1.0), (2, 0.6), (3, 0.0)]
    items = spark.createDataFrame([(1, "ab", True), (2, "bad", True)], "item_id long, t string, is_active boolean")
    e = vectors.embed(items, "t", 2, lambda s: [[1.0, 2.0] if len(x) == 2 else [1.0] for x in s])
    assert tuple(vectors.index_summary(e).first()) == (1, 1)
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first()[0] == 0.0


def test_only_changed_texts_are_embedded(spark, tmp_path):
    def model(texts):
        (tmp_path / f"{abs(hash(tuple(texts)))}").write_text("|".join(texts))
        return [[1.0, 2.0] if t != "bad" else [1.0] for t in texts]

    items = spark.createDataFrame([(1, True, "one"), (2, True, "two"), (3, False, "three"), (4, True, "bad"), (5, True, None)], "item_id long, is_active boolean, text string")
    empty = spark.createDataFrame([], "item_id long, text_hash string, embedding array<float>")
    first = vectors.refresh_index(items, empty, 2, model)
    assert {(x["item_id"], x["state"]) for x in first.collect()} == {(1, "NEW"), (2, "NEW"), (4, "FAILED"), (5, "NEW")}
    kept = spark.createDataFrame(first.collect(), first.schema)
    for f in tmp_path.iterdir():
        f.unlink()
    again = items.withColumn("text", F.when(F.col("item_id") == 2, "deux").otherwise(F.col("text"))).where("item_id <> 1")
    second = vectors.refresh_index(again, kept, 2, model)
    assert {(x["item_id"], x["state"]) for x in second.collect()} == {(1, "REMOVED"), (2, "CHANGED"), (4, "FAILED"), (5, "KEPT")}
    assert sorted(t for f in tmp_path.iterdir() for t in f.read_text().split("|")) == ["bad", "deux"]
    assert vectors.refresh_summary(second).first().asDict() == {"indexed": 2, "failed": 1, "new": 0, "changed": 1, "kept": 1, "removed": 1}


def test_tables_over_jdbc(spark):
    """Two tables read in parallel from a database, filters and columns in its scan."""
    from bidlake.sources.tables import read_table

    url = "jdbc:derby:memory:bidlake;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    items = spark.range(1000).selectExpr("id AS ITEM_ID", "concat('item ', id) AS NAME", "id % 7 AS MAKER_ID")
    makers = spark.range(7).selectExpr("id AS MAKER_ID", "concat('maker ', id) AS MAKER")
    for name, df in (("ITEMS", items), ("MAKERS", makers)):
        df.write.format("jdbc").options(url=url, dbtable=name, **driver).mode("overwrite").save()
    got = read_table(spark, url, dbtable="ITEMS", partitionColumn="ITEM_ID", lowerBound="0", upperBound="1000", numPartitions="4", **driver)
    assert got.rdd.getNumPartitions() == 4
    some = got.where("MAKER_ID = 3 AND ITEM_ID < 500").select("NAME", "MAKER_ID")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(MAKER_ID,3)" in plan and "LessThan(ITEM_ID,500)" in plan
    joined = some.join(read_table(spark, url, dbtable="MAKERS", **driver), "MAKER_ID").collect()
    assert {(x["NAME"], x["MAKER"]) for x in joined} == {(f"item {i}", "maker 3") for i in range(500) if i % 7 == 3}


def test_feed_rules(spark):
    rows = [("s", '{"name":"  A  ","identifiers":[{"identifierType":"GTIN_13","value":" 0123456789012 "},{"identifierType":"MPN","value":"  ds-2cd2143g0-i  "},{"identifierType":"GTIN_13","value":"0123456789012"}],"manufacturerName":"H"}'), ("s", '{"name":"   "}'), ("s", '{"name":"x","identifiers":[{"identifierType":"MPN","value":"1"}]}'), ("s", '{"name":"x","type":"gift"}'), ("s", "[]")]
    got = feed.normalize_payload(spark.createDataFrame(rows, "source_id string, payload string")).collect()
    assert [(i["type"], i["value"]) for i in got[0]["data"]["identifiers"]] == [("GTIN_13", "0123456789012"), ("MPN", "DS-2CD2143G0-I")]
    assert [r["error"] for r in got] == [None, "NAME_REQUIRED", "IDENTIFIER_MANUFACTURER_REQUIRED", "ITEM_TYPE_UNSUPPORTED", "NAME_REQUIRED"]
    h = spark.createDataFrame([('{"a":1,"b":[1,2]}',), ('{ "b" : [1,2], "a": 1.0 }',), ("nonsense",)], "r string").select(feed.payload_hash("r")).collect()
    assert h[0][0] == h[1][0] and h[2][0] is None


RECORD = "source_id long, external_id string, fetched_at timestamp, payload_hash string, error string, resolved string, settled string"


def moment(n):
    return pd.Timestamp(1_700_000_000 + n, unit="s").to_pydatetime()


def run_ingest(spark, tmp_path, batches, **options):
    """The changes of one run over batches of rows, a file each, and its progress."""
    from bidlake.streaming import jobs

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03d}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    s = spark.readStream.schema(RECORD).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.ingest(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out"), q.recentProgress


def test_ingest_by_state(spark, tmp_path):
    """Batches against the rules of one batch after the other; a second run of the stream
    finds nothing new."""
    from bidlake.streaming import jobs

    r = random.Random(3)
    row = lambda i: (r.randrange(3), f"e{r.randrange(6)}", moment(i + r.randrange(-20, 20)), f"h{r.randrange(3)}", None if r.random() < 0.8 else "BAD", r.choice(["MATCHED", None]), r.choice([None] * 7 + ["PUBLISHED", "FAILED"]))
    batches = [[row(40 * k + i) for i in range(40)] for k in range(4)]
    changes, _ = run_ingest(spark, tmp_path, batches)
    table, verdicts = {}, []
    for batch in batches:
        for key in {x[:2] for x in batch}:
            mine = [x for x in batch if x[:2] == key]
            for x in sorted((x for x in mine if x[6]), key=lambda x: x[2]):
                if key in table:
                    table[key] = (table[key][0], x[6], table[key][2])
            fed = sorted((x for x in mine if not x[6]), key=lambda x: (-x[2].timestamp(), x[3]))
            if fed:
                incoming = spark.createDataFrame([fed[0][:6]], RECORD.removesuffix(", settled string"))
                stored = spark.createDataFrame([(*key, *table[key])] if key in table else [], "source_id long, external_id string, payload_hash string, status string, fetched_at timestamp")
                v = feed.ingest_verdicts(incoming, stored).first()
                verdicts.append((*key, v["verdict"]))
                if v["verdict"] in ("STAGED", "REJECTED", "NEEDS_REVIEW"):
                    table[key] = (v["payload_hash"], v["status"], v["fetched_at"])
    assert sorted((x["source_id"], x["external_id"], x["verdict"]) for x in changes.collect() if x["verdict"] != "SETTLED") == sorted(verdicts)
    assert {(x["source_id"], x["external_id"]): (x["payload_hash"], x["status"], x["fetched_at"]) for x in jobs.record_table(changes).collect()} == table
    n = changes.count()
    assert run_ingest(spark, tmp_path, [])[0].count() == n


def test_ingest_reads_no_history(spark, tmp_path):
    """Over 50 batches, rows read and state asked for stay as they were at first."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        batches = [[(1, f"e{k}-{i}", moment(k), "h", None, None, None) for i in range(5)] for k in range(50)]
        _, progress = run_ingest(spark, tmp_path, batches)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    some = [p for p in progress if p["numInputRows"]]
    gets = [p["stateOperators"][0]["customMetrics"]["rocksdbGetCount"] for p in some]
    assert len(some) == 50 and {p["numInputRows"] for p in some} == {5}
    assert max(gets[-10:]) <= max(gets[:10]) + 5


def test_claims_expire(spark, tmp_path):
    """Claims, expiry by event and by timer, another claim, and a fourth one refused."""
    from bidlake.streaming import jobs

    minute = 60
    events = [(1, 7, "claim", moment(0)), (2, 7, "claim", moment(5 * minute)), (3, 7, "claim", moment(16 * minute)), (4, 7, "fail", moment(17 * minute)), (5, 7, "claim", moment(18 * minute)), (6, 7, "done", moment(40 * minute)), (7, 7, "claim", moment(41 * minute)), (8, 8, "claim", moment(0)), (9, 8, "done", moment(minute)), (10, 8, "claim", moment(2 * minute)), (11, 9, "claim", moment(3 * minute))]
    schema = "id long, job_id long, kind string, at timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    for k, some in enumerate((events[:4] + events[7:], events[4:7])):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.claims(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((x["job_id"], x["at"], x["id"], x["verdict"]) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [(i, v) for j, _, i, v in got if j == 7] == [(1, "GRANTED"), (2, "HELD"), (1, "EXPIRED"), (3, "GRANTED"), (4, "FAILED"), (5, "GRANTED"), (5, "EXPIRED"), (6, "STALE"), (7, "EXHAUSTED")]
    assert [(i, v) for j, _, i, v in got if j == 8] == [(8, "GRANTED"), (9, "DONE"), (10, "FINISHED")]
    assert [(i, v) for j, _, i, v in got if j == 9] == [(11, "GRANTED"), (11, "EXPIRED")]


def test_merge_and_publish(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "n", 7)], "k long, v string, retries int")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d"), (None, "N")], "k long, v string")
    got = sorted(map(tuple, tables.merge_by_key(old, new, ["k"], {"retries": 0}).collect()), key=str)
    assert got == sorted([(1, "a", 5), (2, "B", 0), (3, "d", None), (None, "N", 0)], key=str)
    run = uuid.uuid4().hex
    tables.write_published({"items": old, "aliases": new}, str(tmp_path), run)
    assert tables.read_published(spark, str(tmp_path), "items").count() == 3
    tables.write_published({"items": new}, str(tmp_path), "0 sorts first")
    assert tables.read_published(spark, str(tmp_path), "items").count() == 4 and tables.read_published(spark, str(tmp_path), "aliases").count() == 4


def test_requests(spark):
    rows = [(1, "en", "Create a quotation for Gulf Tech Solution supply only 10 units NVR 16 Channels at 120 KWD"), (2, "ar", "اعمل عرض سعر لشركة الكويت الوطنية للاتصالات 5 كاميرات IP بدقة 4K بسعر 45 د.ك مع التركيب والبرمجة"), (3, "en", None), (4, "en", "")]
    got = {r["request_id"]: r for r in requests.extract_intents(spark.createDataFrame(rows, "request_id int, locale string, text string")).collect()}
    assert "Gulf Tech Solution" in got[1]["customer_mention"] and got[1]["scope_type"] == "SUPPLY_ONLY" and (got[1]["lines"][0]["quantity"], got[1]["lines"][0]["price"]) == (10, 120)
    assert "الكويت الوطنية للاتصالات" in got[2]["customer_mention"] and got[2]["scope_type"] == "SUPPLY_AND_INSTALLATION" and (got[2]["lines"][0]["quantity"], got[2]["lines"][0]["price"]) == (5, 45)
    assert got[2]["currency_code"] == "KWD" and not got[4]["lines"]


def test_orders_and_milestones(spark):
    m = spark.createDataFrame([(1, 1, "PERCENTAGE", 50.0, None), (1, 2, "PERCENTAGE", 50.0, None), (2, 1, "PERCENTAGE", 60.0, None), (2, 2, "PERCENTAGE", 50.0, None), (3, 2, "FIXED", None, 5.0)], "contract_id int, position int, amount_type string, percentage double, fixed_amount double")
    assert {r[0]: r[1] for r in documents.check_milestones(m).collect()} == {1: None, 2: "PERCENTAGE_OVER_100", 3: "POSITIONS_INVALID"}


def test_locale_of_a_quotation(spark):
    names = [*localize.TELLING, "stated_locale"]
    q = spark.createDataFrame([(1, *[None] * len(names)), (2, *[None] * len(names)), (3, *[None] * (len(names) - 1), "en")], "doc_id int, " + ", ".join(f"{n} string" for n in names))
    lines = spark.createDataFrame([(1, "كاميرا", None, None), (2, "Camera", None, None), (3, "كاميرا", None, None)], "doc_id int, item_name string, description string, unit_name string")
    assert {r[0]: r[1] for r in localize.source_locale(q, lines).collect()} == {1: "ar", 2: "en", 3: "en"}


def test_reading_and_pages(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k long, v string")
    df.write.parquet(f"{tmp_path}/t")
    assert tables.read_table(spark, f"{tmp_path}/t").count() == 20 and tables.read_table(spark, f"{tmp_path}/t", "k long").columns == ["k"]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.json").write_text('{"records": [{"id": "1", "name": "x"},\n {"id": "2", "name": "y"}], "nextCursor": "c"}')
    (tmp_path / "pages" / "b.json").write_text("[1]")
    (tmp_path / "pages" / "c.json").write_text("{}")
    good, bad = feed.split_pages(feed.read_feed_pages(spark, f"{tmp_path}/pages"))
    assert good.count() == 3 and bad.count() == 1 and feed.to_envelopes(good).where("error is null").count() == 2


def test_streams_of_repeats_and_rates(spark, tmp_path):
    from bidlake.streaming import jobs

    at = lambda n: pd.Timestamp(1_700_000_000 + n, unit="s").to_pydatetime()
    events = spark.createDataFrame([(1, "a", "h", at(0)), (1, "a", "h", at(5)), (1, "a", "i", at(6)), (2, "a", "h", at(7))], "source_id long, external_id string, payload_hash string, fetched_at timestamp")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = jobs.drop_repeats(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == 3
    # Later than the watermark of the batch before allows: the stream lets go of it.
    for k, rows in enumerate(([(3, "z", "h", at(10_000))], [(3, "z", "h", at(10_001))], [(3, "y", "h", at(100)), (3, "z", "h", at(10_002))])):
        spark.createDataFrame(rows, events.schema).coalesce(1).write.parquet(f"{tmp_path}/late/b{k}")
    late = jobs.drop_repeats(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/late"))
    late.writeStream.format("parquet").option("path", f"{tmp_path}/o2").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert [r["external_id"] for r in spark.read.parquet(f"{tmp_path}/o2").collect()] == ["z"]
    runs = spark.createDataFrame([(1, at(0), 3), (1, at(30), 4), (1, at(300), 5)], "source_id long, created_at timestamp, reserved int")
    rates = jobs.request_rates(runs).collect()
    assert max(x["reserved"] for x in rates) == 7 and sum(x["reserved"] == 5 for x in rates) == 6


def test_texts_are_translated_once(spark):
    missing = spark.createDataFrame([(1, "en", "a", "x"), (2, "en", "b", "x"), (3, "ar", "c", "x")], "doc_id int, locale string, key string, text string")
    got = localize.translate_texts(missing, lambda locale, text: locale + ":" + text)
    assert sorted((x["doc_id"], x["translation"]) for x in got.collect()) == [(1, "en:x"), (2, "en:x"), (3, "ar:x")]
    ends = spark.createDataFrame([(x,) for x in ("COMPLETED", "STALE", "STALE", None, "CLAIM_FAILED")], "outcome string")
    assert localize.recovery_summary(ends).first().asDict() == {"scanned": 5, "completed": 1, "failed": 0, "stale": 2, "no_claim": 0, "not_found": 0, "claim_failed": 2}


def test_vector_filters_and_blocks(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, [r.gauss(0, 1) for _ in range(4)], r.choice("ab")) for i in range(60)]
    asked = [(i, [r.gauss(0, 1) for _ in range(4)], r.choice(["a", None])) for i in range(9)]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 16)
    got = vectors.vector_topk(spark.createDataFrame(asked, "query_id long, vector array<double>, type string"), spark.createDataFrame(items, "item_id long, vector array<double>, type string"), 5, ["type"])
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(i, n + 1): j for i, v, t in asked for n, (_, j) in enumerate(sorted((-cos(v, w), j) for j, w, u in items if t in (None, u))[:5])}
    assert {(x["query_id"], x["rank"]): x["item_id"] for x in got.collect()} == want


def test_request_readings(spark):
    rows = [
        (1, "en", "Please make a quote for Blue Star: 3pcs NVR at 45.5 USD, 2 items cable; maintenance"), (2, "en", "client Acme needs 12 cameras with installation"), (3, "ar", "لشركة النور 7 أجهزة بمبلغ 20 دينار كويتي"),
        (4, "en", "price: 99 for one, 4 units"), (5, "en", "a@b.co " + "x; " * 30), (6, "en", "consultation"),
    ]
    got = {r["request_id"]: r for r in requests.extract_intents(spark.createDataFrame(rows, "request_id int, locale string, text string")).collect()}
    a = got[1]
    assert a["customer_mention"] == "Blue Star" and a["scope_type"] == "MAINTENANCE" and a["currency_code"] == "USD" and a["subject"] == "Quotation - Blue Star"
    assert [(x["quantity"], x["unit_text"], x["price"], x["type"]) for x in a["lines"]] == [(3, "pcs", 45.5, "PRODUCT"), (2, "items", None, "PRODUCT"), (None, None, None, "SERVICE")] and a["lines"][1]["text"] == "cable"
    assert got[2]["customer_mention"] == "Acme" and got[2]["scope_type"] == "SUPPLY_AND_INSTALLATION" and got[2]["lines"][0]["quantity"] == 12
    assert got[3]["customer_mention"] == "النور" and got[3]["currency_code"] == "KWD" and (got[3]["lines"][0]["quantity"], got[3]["lines"][0]["price"]) == (7, 20)
    assert got[4]["lines"][0]["price"] == 99 and got[4]["lines"][0]["quantity"] is None and got[4]["lines"][1]["quantity"] == 4
    assert got[5]["customer_email"] == "a@b.co" and len(got[5]["lines"]) == 20 and got[6]["scope_type"] == "CONSULTATION"


def test_works_in_plural_and_compounds(spark):
    """(text, scope, types): works named by any form of their words; what stands in two segments is
    not side by side."""
    asked = [
        ("en", "cleaning services", "SERVICE", ["SERVICE"]), ("en", "3 installations of cameras", "INSTALLATION_ONLY", ["SERVICE"]), ("en", "reinstallation only", "INSTALLATION_ONLY", ["SERVICE"]),
        ("en", "supply and installation of 2 units doors", "SUPPLY_AND_INSTALLATION", ["SERVICE"]), ("en", "supply; installation", "INSTALLATION_ONLY", ["PRODUCT", "SERVICE"]), ("en", "supply only; services", "SUPPLY_ONLY", ["PRODUCT", "SERVICE"]),
        ("en", "maintenances, consultations", "MAINTENANCE", ["SERVICE", "PRODUCT"]), ("ar", "توريدات وتركيبات", "SUPPLY_AND_INSTALLATION", ["SERVICE"]), ("en", "ten doors", None, ["PRODUCT"]), ("en", None, None, []),
    ]
    rows = [(i, *a[:2]) for i, a in enumerate(asked)] + [(100, "en", "Quotation price for Blue Sky services; 4 doors"), (101, "en", "customer"), (102, "en", "quote for")]
    got = {r["request_id"]: r for r in requests.extract_intents(spark.createDataFrame(rows, "request_id int, locale string, text string")).collect()}
    for i, (_, _, scope, types) in enumerate(asked):
        assert (got[i]["scope_type"], [x["type"] for x in got[i]["lines"]]) == (scope, types), asked[i]
    assert got[100]["customer_mention"] == "Blue Sky" and got[101]["customer_mention"] is None and got[102]["customer_mention"] is None
