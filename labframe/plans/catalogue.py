"""The registered queries over the driver's tables and their SQL twins.

A query applies an operator to whole tables. Amounts leave as doubles rounded by decimal storage, times as they are.
Durations of the access folds are scaled to the events at hand (two days for a lock); defaults are the real ones.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labframe.functions import text as fn
from labframe.operators import access, lookup, mutate, orders, results, search, textindex, validate
from labframe.plans.tables import derived, table, with_tables
from labframe.sources import commit, io
from labframe.sources.schema import SPECS, TableSpec
from labframe.streaming import processors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
DAY = 24 * 60
#: What the properties of an event may hold; others are dropped.
PROPS = T.StructType().add("k", T.LongType()).add("absent", T.StringType())


#: The driver of the database that comes with Spark.
DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
#: The declared schema that scan_table binds to the table of parts.
PART = TableSpec("part", "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE", key="p_partkey")


class Tables:
    """t.patients is the derived table or the driver's of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, *names: str):
    """Registers a function of Tables under its name, with the SQL that gives the same rows over the named derived tables."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _ORACLES[f.__name__] = with_tables(sql, *names)
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def money(c: str | Column) -> Column:
    return fn.money(F.col(c) if isinstance(c, str) else c).cast("double")


def sql_money(x: str) -> str:
    """Half away from zero in DuckDB, as a double."""
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(10,2)) AS DOUBLE)"


# ---- sources and sinks


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS size, count(DISTINCT p_brand) AS brands FROM part")
def scan_table(t: Tables) -> DataFrame:
    return io.read_table(t.spark, f"{t.sf_dir}/part.parquet", PART).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_present, json_extract_string(props, '$.absent') AS absent FROM events")
def ingest_json(t: Tables) -> DataFrame:
    rows = io.parsed(t.events, "props", PROPS)
    return rows.select("event_id", F.col("record.k").try_cast("bigint").alias("k"), F.size("present").cast("bigint").alias("n_present"), F.col("record.absent").alias("absent"))


@query("""SELECT page_id, CASE WHEN m IS NULL THEN 'MISSING' WHEN m NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'TYPE' WHEN n > 2097152 THEN 'SIZE' END AS fault FROM (
 SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'text/html' WHEN 2 THEN 'image/png' ELSE 'image/webp' END AS m, strlen(html) * 2000 AS n FROM pages)""")
def file_manifest_check(t: Tables) -> DataFrame:
    mime = F.when(F.col("page_id") % 5 == 0, None).when(F.col("page_id") % 5 == 1, "text/html").when(F.col("page_id") % 5 == 2, "image/png").otherwise("image/webp")
    return t.pages.select("page_id", io.file_fault(mime, F.octet_length("html").cast("bigint") * 2000).alias("fault"))


@query("SELECT p_size AS size, count(*) AS n, sum(p_retailprice) AS price FROM part WHERE p_size < 20 GROUP BY 1")
def scan_database(t: Tables) -> DataFrame:
    """The table of parts written to a database of this session and read from it in ranges of its key. One process alone has that database open, so the query fails where executors are processes of their own."""
    url = f"jdbc:derby:{io.scratch(t.spark, 'database').removeprefix('file:').replace('//', '/')};create=true"
    io.write_jdbc(io.read_table(t.spark, f"{t.sf_dir}/part.parquet", PART), url, PART, "p_name VARCHAR(100), p_brand VARCHAR(20), p_type VARCHAR(50)", driver=DERBY)
    rows = io.read_jdbc(t.spark, url, PART, 4, driver=DERBY).where("p_size < 20")
    return rows.groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("price"))


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 6 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'SIZE' WHEN 3 THEN 'CONTENT' END AS fault, CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 2 THEN 3000001 ELSE 9 + strlen(n_name) END AS length FROM nation""")
def file_manifest(t: Tables) -> DataFrame:
    """Files written for all nations, listed and held against their stated types: missing, of another type, too large, with other bytes than stated."""
    folder, kind = io.scratch(t.spark, "files"), F.col("n_nationkey") % 6
    png, jpeg = "unhex('89504E470D0A1A0A')", "unhex('FFD8FFE000104A46')"
    body = F.when(kind == 2, F.concat(F.expr(png), F.repeat(F.lit("x"), 3_000_000 - 8).cast("binary"))).when(kind == 3, F.concat(F.expr(jpeg), F.col("n_name").cast("binary"))).otherwise(F.concat(F.expr(png), F.col("n_name").cast("binary")))
    t.nation.where(kind != 0).select("n_nationkey", body.cast("string").alias("value")).write.partitionBy("n_nationkey").text(folder)
    listed = io.read_manifest(t.spark, folder).withColumn("id", F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("bigint")).drop("path").withColumnRenamed("id", "path")
    stated = t.nation.select(F.col("n_nationkey").cast("bigint").alias("path"), F.when(kind == 1, "text/html").otherwise("image/png").alias("mime"))
    return io.manifest_faults(stated, listed).select(F.col("path").alias("id"), "fault", "length")


@query("""SELECT 'orders' AS "table", count(*) AS n, sum(id)::BIGINT AS ids FROM service_orders UNION ALL SELECT 'items', count(*), sum(serviceOrderId)::BIGINT FROM items UNION ALL SELECT 'orders before', count(*), sum(id)::BIGINT FROM service_orders WHERE id % 2 = 0""", "service_orders", "items")
def commit_tables(t: Tables) -> DataFrame:
    """Orders and items in two commits; one is run again, and one that breaks off between its tables leaves nothing."""
    root = io.scratch(t.spark, "tables")
    batch = lambda k: {"orders": t.service_orders.where(f"id % 2 = {k}"), "items": t.items.where(f"serviceOrderId % 2 = {k}")}
    commit.committed(t.spark, root, "even", batch(0))
    for _ in range(2):
        commit.committed(t.spark, root, "odd", batch(1))
    with contextlib.suppress(InterruptedError):
        commit.committed(t.spark, root, "broken", batch(0), before_publishing=_broken)
    sums = lambda name, df, key: df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.sum(key).alias("ids"))
    read = lambda name, version=None: commit.read_published(t.spark, root, name, version)
    return sums("orders", read("orders"), "id").unionByName(sums("items", read("items"), "serviceOrderId")).unionByName(sums("orders before", read("orders", 0), "id"))


def _broken() -> None:
    raise InterruptedError


@query("""SELECT CASE WHEN event_id % 10 = 3 THEN 'rejected' ELSE 'events' END AS "table", event_id % 4 AS part, count(*) AS n, sum(CASE WHEN event_id % 10 <> 3 THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1, 2""")
def feed_commits(t: Tables) -> DataFrame:
    """Events as lines of JSON, some of them cut short, in a feed that is stopped and started again: each line once, in its table or among the rejected."""
    root, source, checkpoint = (io.scratch(t.spark, n) for n in ("tables", "source", "checkpoint"))
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    lines = t.events.select(F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 15)).otherwise(line).alias("value"), (F.col("event_id") % 4).alias("part"))
    record = T.StructType.fromDDL("event_id BIGINT, user_id BIGINT, event_type STRING")

    def tables(df: DataFrame) -> dict[str, DataFrame]:
        good, bad = io.json_split(df, "value", record)
        return {"events": good, "rejected": bad}

    for turn in range(2):
        lines.where(f"part div 2 = {turn}").write.mode("append").partitionBy("part").text(source)
        feed = t.spark.readStream.schema("value STRING, part INT").option("maxFilesPerTrigger", 1).text(source)
        commit.commit_sink(feed, root, "events", checkpoint, tables).trigger(availableNow=True).start().awaitTermination()
    events = commit.read_published(t.spark, root, "events").select(F.lit("events").alias("table"), "part", "event_id")
    rejected = commit.read_published(t.spark, root, "rejected").select(F.lit("rejected").alias("table"), "part", F.lit(None).cast("bigint").alias("event_id"))
    return events.unionByName(rejected).groupBy("table", F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'other' ELSE coalesce(NULL, 'study') END AS type, 60 AS durationMinutes, 'active' AS status, true AS isActive, TIMESTAMP '2024-01-01 00:00:00' AS createdAt FROM studies""", "studies")
def insert_defaults(t: Tables) -> DataFrame:
    batch = t.studies.select("id", "name", "code", F.when(F.col("id") % 3 == 0, "other").alias("type"))
    out = io.with_defaults(batch, SPECS["studies"], F.lit("2024-01-01").cast("timestamp_ntz"))
    return out.select("id", "type", "durationMinutes", "status", "isActive", "createdAt")


@query("""SELECT o.id, count(i.studyId) AS n_lines, coalesce(max(i.position), -1) AS last_position, sum(i.quantity) AS quantity FROM service_orders o LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY serviceOrderId ORDER BY lineNo, studyId, supplier, quantity, extended) - 1 AS position FROM items) i ON i.serviceOrderId = o.id GROUP BY o.id""", "service_orders", "items")
def order_header_and_lines(t: Tables) -> DataFrame:
    nested = search.expanded(t.service_orders, t.items, "serviceOrderId", "items", ["lineNo", "studyId", "supplier", "quantity", "extended"])
    headers, lines = io.header_and_lines(nested, "items", parent="parent")
    sums = lines.groupBy(F.col("parent").alias("id")).agg(F.count("studyId").alias("n_lines"), F.max("position").alias("last_position"), F.sum("quantity").alias("quantity"))
    return headers.select("id").join(sums, "id", "left").select("id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("last_position", F.lit(-1)).cast("bigint").alias("last_position"), "quantity")


def _part_rules() -> list:
    return [validate.text("name", 3, 12), validate.one_of("type", ["STANDARD", "PROMO", "ECONOMY"]), validate.number("normalPrice", 900, 950), validate.integer("size"), validate.matching("code", r"^Brand#[1-3][0-9]*-[0-9]+\z")]


def _parts(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey AS id", "p_name AS name", "p_type AS type", "p_retailprice AS normalPrice", "p_size AS size", "concat(p_brand, '-', p_partkey) AS code")


_BROKEN = """SELECT id, list_filter([CASE WHEN NOT (length(name) BETWEEN 3 AND 12) THEN 'name' END, CASE WHEN type NOT IN ('STANDARD', 'PROMO', 'ECONOMY') THEN 'type' END, CASE WHEN NOT (price BETWEEN 900 AND 950) THEN 'normalPrice' END, CASE WHEN NOT regexp_full_match(code, 'Brand#[1-3][0-9]*-[0-9]+') THEN 'code' END], lambda x: x IS NOT NULL) AS e FROM (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_retailprice AS price, concat(p_brand, '-', p_partkey) AS code FROM part)"""


@query(f"SELECT id, len(e) AS n_errors, array_to_string(e, ',') AS fields FROM ({_BROKEN})")
def validate_flat(t: Tables) -> DataFrame:
    out = validate.validated(_parts(t), _part_rules())
    return out.select("id", F.size("errors").cast("bigint").alias("n_errors"), F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"))


@query(f"SELECT len(e) = 0 AS accepted, count(*) AS n, sum(len(e))::BIGINT AS n_errors FROM ({_BROKEN}) GROUP BY 1")
def reject_split(t: Tables) -> DataFrame:
    good, bad = validate.split(validate.validated(_parts(t), _part_rules()))
    rows = good.select(F.lit(True).alias("accepted"), F.lit(0).alias("e")).unionByName(bad.select(F.lit(False).alias("accepted"), F.size("errors").alias("e")))
    return rows.groupBy("accepted").agg(F.count("*").alias("n"), F.sum("e").alias("n_errors"))


@query(f"SELECT id, array_to_string(e, ',') AS fields FROM ({_BROKEN}) WHERE len(e) > 0")
def reject_quarantine(t: Tables) -> DataFrame:
    folder = io.scratch(t.spark, "quarantine")
    validate.routed(validate.validated(_parts(t), _part_rules()), folder, "1")
    return t.spark.read.parquet(f"{folder}/rejected").select("id", F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"))


@query("""WITH lines AS (SELECT *, row_number() OVER (PARTITION BY serviceOrderId ORDER BY lineNo, studyId, supplier, quantity, extended) - 1 AS i FROM items)
SELECT o.id, count(f) AS n_errors, coalesce(min(f), '') AS first_field FROM service_orders o LEFT JOIN (
 SELECT serviceOrderId, 'items.' || i || '.' || unnest(list_filter([CASE WHEN quantity < 2 THEN 'quantity' END, CASE WHEN priceType NOT IN ('normal', 'dif', 'special') THEN 'priceType' END, CASE WHEN discountPercent > 9.5e0 THEN 'discountPercent' END], lambda x: x IS NOT NULL)) AS f FROM lines
 UNION ALL SELECT id, 'items' FROM service_orders WHERE id NOT IN (SELECT serviceOrderId FROM items)) e ON e.serviceOrderId = o.id GROUP BY o.id""", "service_orders", "items")
def validate_nested(t: Tables) -> DataFrame:
    nested = search.expanded(t.service_orders, t.items, "serviceOrderId", "items", ["lineNo", "studyId", "supplier", "quantity", "extended"])
    each = validate.Each("items", (validate.number("quantity", 2), validate.one_of("priceType", ["normal", "dif", "special"]), validate.number("discountPercent", None, 9.5)), least=1)
    fields = F.transform("errors", lambda e: e["field"])
    return validate.validated(nested, [each]).select("id", F.size("errors").cast("bigint").alias("n_errors"), F.coalesce(F.array_min(fields), F.lit("")).alias("first_field"))


_TEXTS = {
    "mail": "CASE c_custkey % 5 WHEN 0 THEN concat('c', c_custkey, '@lab.example') WHEN 1 THEN concat('c', c_custkey, '@lab') WHEN 2 THEN 'a@@lab.example' WHEN 3 THEN 'a b@lab.example' END",
    "day": "CASE c_custkey % 4 WHEN 0 THEN concat('2024-02-', 10 + c_custkey % 20) WHEN 1 THEN concat('2024-13-', 10 + c_custkey % 20) WHEN 2 THEN '2024' END",
    "flag": "CASE c_custkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'maybe' WHEN 3 THEN '' END",
    "plain": "CASE c_custkey % 3 WHEN 0 THEN concat('<', c_name, '>') ELSE c_name END",
    "code": "CASE c_custkey % 4 WHEN 0 THEN '123456' WHEN 1 THEN '12345' WHEN 2 THEN concat('123456', chr(10)) ELSE 'abcdef' END",
    "ref": "CASE c_custkey % 4 WHEN 0 THEN concat('', c_custkey) WHEN 1 THEN concat('-', c_custkey) WHEN 2 THEN concat(c_custkey, '.5') END",
    "name": "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END",
}
_TEXT_ROWS = "SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in _TEXTS.items()) + " FROM customer"
_BROKEN_TEXTS = {
    "mail": "NOT regexp_full_match(mail, '[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?([.][A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+')",
    "day": "TRY_CAST(day AS DATE) IS NULL OR length(day) <> 10",
    "flag": "flag NOT IN ('true', 'false')",
    "plain": "contains(plain, '<') OR contains(plain, '>')",
    "code": "NOT regexp_full_match(code, '[0-9]{6}')",
    "ref": "NOT regexp_full_match(ref, '-?[0-9]+')",
}


def _faults_sql(broken: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {k} IS NOT NULL AND ({v}) THEN '{k}' END" if k != "name" else f"CASE WHEN {v} THEN 'name' END" for k, v in broken.items())
    return f"SELECT c_custkey, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS fields FROM ({_TEXT_ROWS})"


def _text_rules() -> list:
    return [validate.email("mail"), validate.iso_date("day"), validate.boolean("flag"), validate.no_brackets("plain"), validate.code6("code"), validate.identifier("ref"), validate.required("name")]


def _faulty(t: Tables, rules: list) -> DataFrame:
    rows = t.customer.select("c_custkey", *(F.expr(v).alias(k) for k, v in _TEXTS.items()))
    return validate.validated(rows, rules).select("c_custkey", F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"))


@query(_faults_sql(_BROKEN_TEXTS | {"name": "coalesce(name, '') = ''"}))
def validate_formats(t: Tables) -> DataFrame:
    return _faulty(t, _text_rules())


@query(_faults_sql(_BROKEN_TEXTS | {"name": "name = ''"}))
def validate_partial(t: Tables) -> DataFrame:
    return _faulty(t, validate.partial(_text_rules()))


@query("""SELECT id, array_to_string(list_filter([CASE WHEN name IS NULL OR name = '' THEN 'name' END, CASE WHEN code IS NULL OR code = '' THEN 'code' END, CASE WHEN length(name) > 200 THEN 'name' END, CASE WHEN length(code) > 50 THEN 'code' END, CASE WHEN type NOT IN ('study', 'package', 'other') THEN 'type' END, CASE WHEN price >= 99999999.995 THEN 'normalPrice' END], lambda x: x IS NOT NULL), ',') AS fields
FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('n', 201) WHEN 2 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 3 > 0 THEN repeat('c', 30 + p_partkey % 40) END AS code, CASE p_partkey % 4 WHEN 0 THEN 'study' WHEN 1 THEN 'kit' WHEN 2 THEN 'other' END AS type, CASE WHEN p_partkey % 6 = 0 THEN 1e8 ELSE p_retailprice END AS price FROM part)""")
def validate_storage(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('n', 201) WHEN 2 THEN NULL ELSE p_name END AS name", "CASE WHEN p_partkey % 3 > 0 THEN repeat('c', CAST(30 + p_partkey % 40 AS INT)) END AS code", "CASE p_partkey % 4 WHEN 0 THEN 'study' WHEN 1 THEN 'kit' WHEN 2 THEN 'other' END AS type", "CASE WHEN p_partkey % 6 = 0 THEN 1e8 ELSE p_retailprice END AS normalPrice")
    rules = [r for r in validate.storage_rules(SPECS["studies"]) if r.field in rows.columns]
    return validate.validated(rows, rules).select("id", F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"))


# ---- searching


@query("SELECT id, firstName, documentType FROM patients WHERE isActive AND (firstName LIKE '%0007%' OR documentType LIKE '%0007%') ORDER BY firstName NULLS LAST, id LIMIT 10 OFFSET 10", "patients")
def patient_search(t: Tables) -> DataFrame:
    found = search.active(t.patients).where(search.contains("0007", ["firstName", "documentType"]))
    return search.page(found, search.keys("firstName"), 2, 10).select("id", "firstName", "documentType")


@query("SELECT id, firstName, licenseNumber FROM doctors WHERE isActive AND firstName LIKE '%#0%1%' ORDER BY firstName NULLS LAST, id LIMIT 10", "doctors")
def doctor_search(t: Tables) -> DataFrame:
    return search.page(search.active(t.doctors).where(search.contains("#0%1", ["firstName"])), search.keys("firstName")).select("id", "firstName", "licenseNumber")


@query("SELECT id, name, code, type FROM studies WHERE isActive AND type = (SELECT min(type) FROM studies) AND (name LIKE '%1%' OR code LIKE '%1%') ORDER BY name NULLS LAST, id LIMIT 20 OFFSET 20", "studies")
def study_search(t: Tables) -> DataFrame:
    least = t.studies.agg(F.min("type").alias("type"))
    found = search.active(t.studies).join(least, "type", "left_semi").where(search.contains("1", ["name", "code"])).where(search.equal_to(status=None))
    return search.page(found, search.keys("name"), 2, 20).select("id", "name", "code", "type")


_ORDER_PAGE = """SELECT o.*, p.firstName AS patientName FROM service_orders o LEFT JOIN patients p ON p.id = o.patientId WHERE o.isActive"""


@query(f"""WITH page AS ({_ORDER_PAGE} AND (folio LIKE '%1%' OR p.firstName LIKE '%1%') AND status = 'F' ORDER BY createdAt DESC NULLS FIRST, o.id LIMIT 10)
SELECT page.id, folio, patientName, createdAt, d.firstName AS doctorName, (SELECT count(*) FROM items i WHERE i.serviceOrderId = page.id) AS n_items, (SELECT min(lineNo) FROM items i WHERE i.serviceOrderId = page.id) AS first_line FROM page LEFT JOIN doctors d ON d.id = page.doctorId""", "service_orders", "patients", "doctors", "items")
def order_search(t: Tables) -> DataFrame:
    page = search.order_search(t.service_orders, t.patients, t.doctors, t.items, q="1", status="F")
    return page.select("id", "folio", "patientName", "createdAt", F.col("doctor.firstName").alias("doctorName"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.array_min(F.transform("items", lambda i: i["lineNo"])).alias("first_line"))


@query(f"""SELECT id, folio, patientName, createdAt FROM ({_ORDER_PAGE}) WHERE createdAt BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' ORDER BY createdAt DESC NULLS FIRST, id LIMIT 10 OFFSET 20""", "service_orders", "patients")
def order_search_range(t: Tables) -> DataFrame:
    found = search.order_matches(t.service_orders, t.patients, low="1995-01-01", high="1996-12-31")
    return search.page(found, search.keys("-createdAt"), 3).select("id", "folio", "patientName", "createdAt")


@query(f"SELECT count(DISTINCT id) AS total FROM ({_ORDER_PAGE} AND (folio LIKE '%12%' OR p.firstName LIKE '%12%'))", "service_orders", "patients")
def search_total(t: Tables) -> DataFrame:
    return search.total(search.order_matches(t.service_orders, t.patients, "12"))


@query("SELECT id, createdAt FROM service_orders WHERE isActive ORDER BY createdAt DESC NULLS FIRST, id LIMIT 10 OFFSET 40", "service_orders")
def order_page(t: Tables) -> DataFrame:
    return search.page(search.active(t.service_orders), search.keys("-createdAt"), 5).select("id", "createdAt")


@query("SELECT id, place, CAST(floor(place / 10) AS BIGINT) + 1 AS page FROM (SELECT id, row_number() OVER (ORDER BY createdAt DESC NULLS FIRST, id) - 1 AS place FROM service_orders WHERE isActive)", "service_orders")
def page_all(t: Tables) -> DataFrame:
    return search.all_pages(search.active(t.service_orders), search.keys("-createdAt"), 10).select("id", "place", "page")


_TERMS = [(1, "1"), (2, "Brand#2"), (3, "9_"), (4, "nothing like it")]


@query("SELECT term_id, id, place FROM (SELECT term_id, id, row_number() OVER (PARTITION BY term_id ORDER BY name NULLS LAST, id) AS place FROM studies JOIN (VALUES (1, '1'), (2, 'Brand#2'), (3, '9_'), (4, 'nothing like it')) v(term_id, q) ON name LIKE '%' || q || '%' OR code LIKE '%' || q || '%' WHERE isActive) WHERE place <= 5", "studies")
def multi_term_topk(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame(_TERMS, "term_id int, q string")
    return search.top_of_terms(search.active(t.studies), terms, ["name", "code"], search.keys("name"), 5).select("term_id", "id", F.col("place").cast("bigint").alias("place"))


#: Wildcards, ends, a backslash, terms of two characters and none, two stretches, a term that is nowhere, overlapping grams.
_PATTERNS = [(1, "al#0"), (2, "l#0%9"), (3, "#__0%12"), (4, "r#%%00"), (5, "99"), (6, "a\\b"), (7, "zzz"), (8, "0000"), (9, "12_"), (10, ""), (11, "Customer#000000007"), (12, "_"), (13, "MACH%RY"), (14, "er#%er")]


@query(f"""SELECT term_id, count(*) AS n, sum(id)::BIGINT AS ids FROM patients JOIN (VALUES {", ".join(f"({i}, '{q}')" for i, q in _PATTERNS)}) v(term_id, q) ON contains_like(firstName, q) OR contains_like(documentType, q) GROUP BY 1""".replace("contains_like(firstName, q)", "firstName LIKE '%' || q || '%'").replace("contains_like(documentType, q)", "documentType LIKE '%' || q || '%'"), "patients")
def indexed_search(t: Tables) -> DataFrame:
    """Fourteen terms at once by the index of trigrams."""
    columns = ["firstName", "documentType"]
    index = io.stored(textindex.text_index(t.patients, columns), "index")
    found = textindex.matches(t.patients, index, t.spark.createDataFrame(_PATTERNS, "term_id int, q string"), columns)
    return found.groupBy("term_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT k.documentType, min(p.id) AS id FROM (SELECT DISTINCT documentType FROM patients) k LEFT JOIN patients p ON p.documentType = k.documentType GROUP BY 1", "patients")
def find_by_key(t: Tables) -> DataFrame:
    return search.first_by_key(t.patients.select("documentType").distinct(), t.patients, ["documentType"]).select("documentType", "id")


@query("SELECT id, email, createdAt FROM users WHERE confirmed AND rol = 'recepcionista'", "users")
def users_by_role(t: Tables) -> DataFrame:
    return search.users_by_role(t.users).select("id", "email", "createdAt")


@query("SELECT id, email, createdAt FROM users WHERE confirmed", "users")
def users_confirmed(t: Tables) -> DataFrame:
    return search.users_by_role(t.users, None).select("id", "email", "createdAt")


@query("SELECT id, email, createdAt FROM users WHERE confirmed AND rol = 'unassigned'", "users")
def users_confirmed_unassigned(t: Tables) -> DataFrame:
    return search.users_by_role(t.users, ("unassigned",)).select("id", "email", "createdAt")


@query("SELECT id, documentType, firstName FROM patients WHERE isActive ORDER BY documentType NULLS LAST, firstName NULLS LAST, id LIMIT 25 OFFSET 50", "patients")
def patient_list_sorted(t: Tables) -> DataFrame:
    return search.page(search.active(t.patients), search.keys("documentType", "firstName"), 3, 25).select("id", "documentType", "firstName")


@query("SELECT id, rol FROM users", "users")
def role_lookup(t: Tables) -> DataFrame:
    return t.users.select("id", "rol")


@query("SELECT o.id, o.folio, p.firstName AS patientName, count(i.lineNo) AS n_items, min(i.lineNo) AS first_line, max(i.lineNo) AS last_line FROM service_orders o LEFT JOIN patients p ON p.id = o.patientId LEFT JOIN items i ON i.serviceOrderId = o.id WHERE o.isActive GROUP BY ALL", "service_orders", "patients", "items")
def order_expand(t: Tables) -> DataFrame:
    rows = search.expanded(search.active(t.service_orders), t.items, "serviceOrderId", "items", ["lineNo"])
    rows = rows.join(t.patients.select(F.col("id").alias("patientId"), F.col("firstName").alias("patientName")), "patientId", "left")
    line = F.transform("items", lambda i: i["lineNo"])
    return rows.select("id", "folio", "patientName", F.size("items").cast("bigint").alias("n_items"), F.get(line, F.lit(0)).alias("first_line"), F.element_at(F.when(F.size(line) > 0, line), -1).alias("last_line"))


@query("SELECT s.id, count(d.id) AS n_values, coalesce(string_agg(d.id::VARCHAR, ',' ORDER BY d.sortOrder, d.id), '') AS labels FROM studies s LEFT JOIN study_details d ON d.studyId = s.id GROUP BY s.id", "studies", "study_details")
def result_expand(t: Tables) -> DataFrame:
    rows = search.expanded(t.studies.select("id"), t.study_details.select("id", "studyId", "sortOrder"), "studyId", "details", ["sortOrder", "id"])
    return rows.select("id", F.size("details").cast("bigint").alias("n_values"), F.array_join(F.transform("details", lambda d: d["id"].cast("string")), ",").alias("labels"))


@query("SELECT d.studyId, d.id, d.sortOrder FROM study_details d JOIN studies s ON s.id = d.studyId WHERE d.isActive AND s.isActive", "study_details", "studies")
def study_details_list(t: Tables) -> DataFrame:
    return search.study_details(t.study_details, t.studies).select("studyId", "id", "sortOrder")


@query("""WITH routes AS (SELECT * FROM (VALUES ('click', 1), ('error', 2), ('view', 0)) v(route, kind))
SELECT event_id, event_type AS route, rol, CASE WHEN kind IS NULL OR kind = 0 THEN true WHEN rol IS NULL THEN false WHEN kind = 1 THEN rol = 'admin' ELSE rol IN ('admin', 'recepcionista') END AS allowed FROM (SELECT event_id, event_type, CASE WHEN known THEN rol END AS rol FROM access) LEFT JOIN routes ON route = event_type""", "access")
def access_audit(t: Tables) -> DataFrame:
    routes = t.spark.createDataFrame([("click", ["admin"]), ("error", ["admin", "recepcionista"]), ("view", [])], "route string, roles array<string>")
    requests = t.access.select("event_id", F.col("event_type").alias("route"), F.when(F.col("known"), F.col("rol")).alias("rol"))
    return access.authorized(requests, routes).select("event_id", "route", "rol", "allowed")


# ---- references and keys


@query("SELECT serviceOrderId, lineNo, studyId FROM items WHERE studyId % 1900 IN (SELECT id FROM studies)", "items", "studies")
def lines_known_study(t: Tables) -> DataFrame:
    rows = t.items.withColumn("wanted", F.col("studyId") % 1900)
    return lookup.known(rows, t.studies, "wanted").select("serviceOrderId", "lineNo", "studyId")


@query("""SELECT o.id, CASE WHEN o.patientId NOT IN (SELECT id FROM patients WHERE isActive) THEN 'PATIENT' WHEN o.doctorId IS NOT NULL AND o.doctorId NOT IN (SELECT id FROM doctors WHERE isActive) THEN 'DOCTOR' WHEN o.id NOT IN (SELECT serviceOrderId FROM items) THEN 'NO_ITEMS' END AS fault FROM service_orders o""", "service_orders", "patients", "doctors", "items")
def orders_valid_refs(t: Tables) -> DataFrame:
    return lookup.reference_faults(t.service_orders, t.patients, t.doctors, t.items).select("id", "fault")


@query("SELECT serviceOrderId, count(*) AS sent, count(DISTINCT s.id) AS found, count(*) = count(DISTINCT s.id) AS ok FROM items LEFT JOIN studies s ON s.id = studyId GROUP BY 1", "items", "studies")
def orders_study_cardinality(t: Tables) -> DataFrame:
    return lookup.study_cardinality(t.items, t.studies)


@query("SELECT c_custkey, k, s.id, s.id IS NOT NULL AS \"exists\" FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS k FROM customer) LEFT JOIN (SELECT licenseNumber, min(id) AS id FROM doctors WHERE isActive GROUP BY 1) s ON s.licenseNumber = k", "doctors")
def exists_by_key(t: Tables) -> DataFrame:
    wanted = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey")).alias("k"))
    return lookup.exists_by_key(wanted, t.doctors.withColumnRenamed("licenseNumber", "k"), ["k"]).select("c_custkey", "k", "id", "exists")


_BATCH = "SELECT c_custkey AS batch_seq, CASE WHEN c_custkey % 13 > 0 THEN concat('Brand#', c_custkey % 55, '-', c_custkey % 1000) END AS code FROM customer"


def _batch(t: Tables) -> DataFrame:
    code = F.when(F.col("c_custkey") % 13 > 0, F.concat(F.lit("Brand#"), F.col("c_custkey") % 55, F.lit("-"), F.col("c_custkey") % 1000))
    return t.customer.select(F.col("c_custkey").alias("batch_seq"), code.alias("code"))


@query(f"SELECT batch_seq, code, CASE WHEN code IN (SELECT code FROM studies) THEN 'TAKEN' WHEN batch_seq > min(batch_seq) OVER (PARTITION BY code) AND code IS NOT NULL THEN 'REPEATED' END AS fault FROM ({_BATCH})", "studies")
def insert_unique(t: Tables) -> DataFrame:
    return lookup.unique_batch(_batch(t), t.studies, ["code"]).select("batch_seq", "code", "fault")


@query(f"SELECT batch_seq, code, CASE WHEN code IN (SELECT code FROM studies) THEN 'TAKEN' WHEN batch_seq > min(batch_seq) OVER (PARTITION BY code) AND code IS NOT NULL THEN 'REPEATED' END AS fault FROM ({_BATCH})", "studies")
def insert_unique_bucketed(t: Tables) -> DataFrame:
    """The same against a key table in buckets, of which a half came with an earlier batch."""
    name = f"study_keys_{uuid.uuid4().hex}"
    lookup.key_table(t.studies.where("id % 2 = 0"), ["code"], name, 8)
    keys = lookup.key_table_grown(t.studies.where("id % 2 = 1"), ["code"], name, 8)
    out = io.stored(lookup.unique_batch(_batch(t), keys, ["code"]).select("batch_seq", "code", "fault"), "unique")
    t.spark.sql(f"DROP TABLE {name}")
    return out


@query("SELECT c.id, c.licenseNumber, min(d.id) AS other FROM (SELECT id, CAST(id % 25 AS INTEGER) AS licenseNumber FROM doctors) c JOIN doctors d ON d.licenseNumber = c.licenseNumber AND d.id <> c.id GROUP BY 1, 2", "doctors")
def conflict_on_update(t: Tables) -> DataFrame:
    changes = t.doctors.select("id", (F.col("id") % 25).cast("int").alias("licenseNumber"))
    return lookup.conflicts(changes, t.doctors, ["licenseNumber"])


@query("SELECT d.id, d.parentId FROM study_details d JOIN study_details p ON p.id = d.parentId AND p.studyId = d.studyId WHERE p.isActive", "study_details")
def parent_in_study(t: Tables) -> DataFrame:
    return lookup.same_parent(t.study_details.select("id", "parentId", "studyId"), t.study_details, "parentId", "studyId").select("id", "parentId")


@query("SELECT r.id AS wanted, r.o AS serviceOrderId FROM (SELECT id, CASE WHEN id % 6 = 0 THEN serviceOrderId + 1 ELSE serviceOrderId END AS o FROM sheet_items) r JOIN sheet_items i ON i.id = r.id AND i.serviceOrderId = r.o", "sheet_items")
def item_in_order(t: Tables) -> DataFrame:
    rows = t.sheet_items.select(F.col("id").alias("wanted"), F.when(F.col("id") % 6 == 0, F.col("serviceOrderId") + 1).otherwise(F.col("serviceOrderId")).alias("serviceOrderId"))
    return lookup.same_parent(rows, t.sheet_items, "wanted", "serviceOrderId").select("wanted", "serviceOrderId")


# ---- pricing

_LINE = "unitPrice * quantity * (1e0 - discountPercent / 100e0)"
_PRICED = "SELECT i.*, s.name AS studyNameSnapshot, CASE priceType WHEN 'dif' THEN difPrice WHEN 'special' THEN specialPrice WHEN 'hospital' THEN hospitalPrice WHEN 'other' THEN otherPrice ELSE normalPrice END AS unitPrice FROM items i JOIN studies s ON s.id = i.studyId"


@query(f"SELECT serviceOrderId, lineNo, studyId, supplier, quantity, studyNameSnapshot, unitPrice, {sql_money(_LINE)} AS subtotalAmount FROM ({_PRICED})", "items", "studies")
def price_lines(t: Tables) -> DataFrame:
    return orders.priced_lines(t.items, t.studies).select("serviceOrderId", "lineNo", "studyId", "supplier", "quantity", "studyNameSnapshot", "unitPrice", money("subtotalAmount").alias("subtotalAmount"))


@query(f"""WITH s AS (SELECT serviceOrderId AS id, list_reduce(list({_LINE} ORDER BY lineNo, studyId, supplier, quantity, extended), lambda a, x: a + x) AS s FROM ({_PRICED}) GROUP BY 1)
SELECT s.id, {sql_money("s")} AS subtotalAmount, {sql_money("s * (courtesyPercent / 100e0)")} AS discountAmount, {sql_money("s - s * (courtesyPercent / 100e0)")} AS totalAmount FROM s JOIN service_orders o ON o.id = s.id""", "items", "studies", "service_orders")
def order_totals(t: Tables) -> DataFrame:
    out = orders.order_amounts(orders.priced_lines(t.items, t.studies), t.service_orders, ["lineNo", "studyId", "supplier", "quantity", "extended"])
    return out.select("id", *(money(c).alias(c) for c in ("subtotalAmount", "discountAmount", "totalAmount")))


@query(f"""SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id % 40 AS DOUBLE) ELSE courtesyPercent END AS courtesyPercent, CASE WHEN id % 3 = 0 THEN {sql_money("subtotalAmount * (CAST(id % 40 AS DOUBLE) / 100e0)")} ELSE 0 END AS discountAmount, CASE WHEN id % 3 = 0 THEN {sql_money("subtotalAmount - subtotalAmount * (CAST(id % 40 AS DOUBLE) / 100e0)")} ELSE {sql_money("subtotalAmount")} END AS totalAmount FROM service_orders""", "service_orders")
def courtesy_recalc(t: Tables) -> DataFrame:
    rows = t.service_orders.withColumns({"discountAmount": fn.money(F.lit(0.0)), "totalAmount": fn.money(F.col("subtotalAmount"))})
    patches = t.service_orders.where("id % 3 = 0").select("id", (F.col("id") % 40).alias("courtesyPercent"))
    return orders.with_courtesy(rows, patches).select("id", F.col("courtesyPercent").cast("double").alias("courtesyPercent"), money("discountAmount").alias("discountAmount"), money("totalAmount").alias("totalAmount"))


_STATUS = "CASE WHEN id % 2 = 0 THEN 'completed' END"
_SAMPLE = "CASE id % 3 WHEN 0 THEN createdAt WHEN 1 THEN date_trunc('day', createdAt) END"


@query(f"""WITH b AS (SELECT id, coalesce({_STATUS}, 'pending') AS status, coalesce(CASE WHEN id % 5 > 0 THEN courtesyPercent END, 0e0) AS c, {_SAMPLE} AS sampleAt, CASE WHEN patientId NOT IN (SELECT id FROM patients WHERE isActive) THEN 'PATIENT' WHEN doctorId IS NOT NULL AND doctorId NOT IN (SELECT id FROM doctors WHERE isActive) THEN 'DOCTOR' WHEN id NOT IN (SELECT serviceOrderId FROM items) THEN 'NO_ITEMS' END AS refused FROM service_orders),
s AS (SELECT serviceOrderId AS id, count(*) <> count(DISTINCT studyId) AS twice, list_reduce(list({_LINE} ORDER BY lineNo, studyId, supplier, quantity, extended), lambda a, x: a + x) AS s FROM ({_PRICED}) GROUP BY 1)
SELECT b.id, status, c AS courtesyPercent, sampleAt, {sql_money("s")} AS subtotalAmount, {sql_money("s * (c / 100e0)")} AS discountAmount, {sql_money("s - s * (c / 100e0)")} AS totalAmount, coalesce(refused, CASE WHEN twice THEN 'STUDY' END) AS fault FROM b LEFT JOIN s ON s.id = b.id""", "service_orders", "items", "studies", "patients", "doctors")
def order_create(t: Tables) -> DataFrame:
    iso = F.expr("CASE id % 3 WHEN 0 THEN date_format(createdAt, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 1 THEN date_format(createdAt, 'yyyy-MM-dd') ELSE 'soon' END")
    batch = t.service_orders.select("id", "patientId", "doctorId", F.expr(_STATUS).alias("status"), F.when(F.col("id") % 5 > 0, F.col("courtesyPercent")).alias("courtesyPercent"), iso.alias("sampleAt"), F.lit(None).cast("string").alias("deliveryAt"))
    out = orders.created(batch, t.items, t.patients, t.doctors, t.studies, ["lineNo", "studyId", "supplier", "quantity", "extended"])
    return out.select("id", "status", "courtesyPercent", "sampleAt", *(money(c).alias(c) for c in ("subtotalAmount", "discountAmount", "totalAmount")), "fault")


def _order_patches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders with amounts, and patches of every third: a new patient or doctor, a status, a courtesy that may be null."""
    rows = t.service_orders.withColumns({"subtotalAmount": fn.money(F.col("subtotalAmount")), "discountAmount": fn.money(F.lit(0.0)), "totalAmount": fn.money(F.col("subtotalAmount"))})
    fields = F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, ("patientId", "status", "courtesyPercent")))).otherwise(F.array(F.lit("doctorId"), F.lit("patientId")))
    patches = t.service_orders.where("id % 3 = 0").selectExpr("id", "CASE WHEN id % 2 = 0 THEN patientId + 1 ELSE patientId END AS patientId", "CASE WHEN id % 2 = 1 THEN id % 90 END AS doctorId", "CASE WHEN id % 4 = 0 THEN 'X' END AS status", "CASE WHEN id % 8 > 0 THEN id % 40 * 1e0 END AS courtesyPercent")
    return rows, patches.withColumn("fields", fields)


_PATCHED = """WITH p AS (SELECT id, patientId + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS np, CASE WHEN id % 2 = 1 THEN id % 90 END AS nd, CASE WHEN id % 4 = 0 THEN 'X' END AS ns, CASE WHEN id % 8 > 0 AND id % 2 = 0 THEN id % 40 * 1e0 END AS nc FROM service_orders WHERE id % 3 = 0),
f AS (SELECT p.*, CASE WHEN NOT o.isActive THEN 'MISSING' WHEN np <> o.patientId AND np NOT IN (SELECT id FROM patients WHERE isActive) THEN 'PATIENT' WHEN nd IS NOT NULL AND nd IS DISTINCT FROM o.doctorId AND nd NOT IN (SELECT id FROM doctors WHERE isActive) THEN 'DOCTOR' END AS fault FROM p JOIN service_orders o ON o.id = p.id)"""


@query(f"""{_PATCHED}, n AS (SELECT o.id, coalesce(f.np, o.patientId) AS patientId, coalesce(f.nd, o.doctorId) AS doctorId, coalesce(f.ns, o.status) AS status, coalesce(f.nc, o.courtesyPercent) AS c, f.id IS NOT NULL AND o.id % 2 = 0 AS again, CAST({sql_money("o.subtotalAmount")} AS DOUBLE) AS s FROM service_orders o LEFT JOIN f ON f.id = o.id AND f.fault IS NULL)
SELECT id, patientId, doctorId, status, c AS courtesyPercent, CASE WHEN again THEN {sql_money("s * (c / 100e0)")} ELSE 0 END AS discountAmount, CASE WHEN again THEN {sql_money("s - s * (c / 100e0)")} ELSE s END AS totalAmount FROM n""", "service_orders", "patients", "doctors")
def order_patch(t: Tables) -> DataFrame:
    rows, patches = _order_patches(t)
    out = mutate.orders_patched(rows, patches, t.patients, t.doctors)[0]
    return out.select("id", "patientId", "doctorId", "status", "courtesyPercent", money("discountAmount").alias("discountAmount"), money("totalAmount").alias("totalAmount"))


@query(f"{_PATCHED} SELECT id, fault FROM f", "service_orders", "patients", "doctors")
def order_patch_faults(t: Tables) -> DataFrame:
    return mutate.orders_patched(*_order_patches(t), t.patients, t.doctors)[1].select("id", "fault")


# ---- result sheets


def _results(t: Tables) -> DataFrame:
    return t.sheet_items.where("id % 4 = 0").select(F.col("id").alias("serviceOrderItemId"), (F.col("id") % 8 == 0).alias("isActive"))


@query("""SELECT i.id AS serviceOrderItemId, i.serviceOrderId, o.sampleAt, count(d.id) AS n_values, coalesce(string_agg(d.id::VARCHAR, ',' ORDER BY d.sortOrder, d.id), '') AS detail_ids FROM sheet_items i JOIN service_orders o ON o.id = i.serviceOrderId AND o.isActive LEFT JOIN study_details d ON d.studyId = i.studyId AND d.isActive WHERE i.id % 8 <> 0 GROUP BY 1, 2, 3""", "sheet_items", "service_orders", "study_details")
def draft_results(t: Tables) -> DataFrame:
    out = results.drafts(t.sheet_items, t.service_orders, _results(t), t.study_details)
    return out.select("serviceOrderItemId", "serviceOrderId", "sampleAt", F.size("values").cast("bigint").alias("n_values"), F.array_join(F.transform("values", lambda v: v["studyDetailId"].cast("string")), ",").alias("detail_ids"))


@query("SELECT i.id, CASE WHEN d.id IS NOT NULL THEN d.name ELSE 'own' END AS label, CASE WHEN d.id IS NOT NULL THEN CASE WHEN d.id % 2 = 0 THEN d.unit END ELSE 'mg' END AS unit, CASE WHEN d.id IS NOT NULL THEN d.referenceValue END AS referenceValue FROM sheet_items i LEFT JOIN study_details d ON d.id = i.studyId + 100", "sheet_items", "study_details")
def snapshot_values(t: Tables) -> DataFrame:
    values = t.sheet_items.select("id", (F.col("studyId") + 100).alias("studyDetailId"), F.lit("own").alias("label"), F.lit("mg").alias("unit"), F.lit(None).cast("string").alias("referenceValue"))
    details = t.study_details.withColumn("unit", F.when(F.col("id") % 2 == 0, F.col("unit")))
    return results.snapshot(values, details).select("id", "label", "unit", "referenceValue")


@query("""SELECT b.id, CASE WHEN o.id IS NULL THEN 'ORDER' WHEN i.id IS NULL THEN 'ITEM' WHEN b.id % 8 = 0 THEN 'EXISTS' END AS fault, o.sampleAt FROM (SELECT id, CASE WHEN id % 7 = 0 THEN serviceOrderId + 1 ELSE serviceOrderId END AS so FROM sheet_items) b LEFT JOIN service_orders o ON o.id = b.so AND o.isActive LEFT JOIN sheet_items i ON i.id = b.id AND i.serviceOrderId = b.so""", "sheet_items", "service_orders")
def result_create(t: Tables) -> DataFrame:
    so = F.when(F.col("id") % 7 == 0, F.col("serviceOrderId") + 1).otherwise(F.col("serviceOrderId"))
    batch = t.sheet_items.select(F.col("id").alias("batch_seq"), F.col("id").alias("serviceOrderItemId"), so.alias("serviceOrderId"), F.lit(None).cast("timestamp_ntz").alias("sampleAt"), F.lit(None).cast("boolean").alias("isDraft"))
    return results.created(batch, t.service_orders, t.sheet_items, _results(t)).select(F.col("serviceOrderItemId").alias("id"), "fault", "sampleAt")


def _sheets(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Results with one value each, patches of every third, and the values that half of them bring."""
    items = io.stored(t.sheet_items.select("id", "serviceOrderId", "studyId"), "sheets")  # grouped once for all that is made of it
    rows = items.selectExpr("id", "serviceOrderId", "id AS serviceOrderItemId", "CAST(NULL AS TIMESTAMP_NTZ) AS sampleAt", "CAST(NULL AS TIMESTAMP_NTZ) AS reportedAt", "'by hand' AS method", "'seen' AS observations", "true AS isDraft", "id % 8 <> 0 AS isActive")
    values = items.selectExpr("id AS studyResultId", "CAST(NULL AS BIGINT) AS studyDetailId", "'old' AS label", "'mg' AS unit", "'1-2' AS referenceValue", "'7' AS value", "1 AS sortOrder")
    patches = items.where("id % 3 = 0").selectExpr("id", "CASE WHEN id % 7 = 0 THEN serviceOrderId + 1 END AS serviceOrderId", "CASE WHEN id % 5 = 0 THEN id + 1 ELSE id END AS serviceOrderItemId", "CASE WHEN id % 2 = 0 THEN TIMESTAMP_NTZ'2024-01-02 03:04:05' END AS sampleAt", "CAST(NULL AS TIMESTAMP_NTZ) AS reportedAt", "CAST(NULL AS STRING) AS method", "'new' AS observations", "false AS isDraft")
    patches = patches.withColumn("fields", F.array(*map(F.lit, ("sampleAt", "reportedAt", "method", "isDraft"))))
    return rows, values, patches, items.where("id % 6 = 0").selectExpr("id AS studyResultId", "studyId + 100 AS studyDetailId", "'own' AS label", "'g' AS unit", "CAST(NULL AS STRING) AS referenceValue", "'9' AS value", "2 AS sortOrder")


_SHEETS = """WITH f AS (SELECT id, studyId, CASE WHEN id % 8 = 0 THEN 'MISSING' WHEN id % 7 = 0 THEN 'ORDER' WHEN id % 5 = 0 THEN 'ITEM' END AS fault FROM sheet_items WHERE id % 3 = 0)"""


@query(f"{_SHEETS} SELECT i.id, i.serviceOrderId, CASE WHEN f.id IS NOT NULL AND i.id % 2 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS sampleAt, CASE WHEN f.id IS NULL THEN 'by hand' END AS method, 'seen' AS observations, f.id IS NULL AS isDraft FROM sheet_items i LEFT JOIN f ON f.id = i.id AND f.fault IS NULL", "sheet_items")
def result_patch(t: Tables) -> DataFrame:
    return results.results_patched(*_sheets(t), t.study_details)[0].select("id", "serviceOrderId", "sampleAt", "method", "observations", "isDraft")


@query(f"{_SHEETS} SELECT i.id AS studyResultId, CASE WHEN n THEN coalesce(d.name, 'own') ELSE 'old' END AS label, CASE WHEN NOT n THEN 'mg' WHEN d.id IS NULL THEN 'g' ELSE d.unit END AS unit, CASE WHEN n THEN '9' ELSE '7' END AS value FROM (SELECT i.*, f.id IS NOT NULL AND i.id % 6 = 0 AS n FROM sheet_items i LEFT JOIN f ON f.id = i.id AND f.fault IS NULL) i LEFT JOIN study_details d ON d.id = i.studyId + 100", "sheet_items", "study_details")
def result_patch_values(t: Tables) -> DataFrame:
    return results.results_patched(*_sheets(t), t.study_details)[1].select("studyResultId", "label", "unit", "value")


@query(f"{_SHEETS} SELECT id, fault FROM f", "sheet_items")
def result_patch_faults(t: Tables) -> DataFrame:
    return results.results_patched(*_sheets(t), t.study_details)[2].select("id", "fault")


# ---- text and time


@query(r"SELECT doc_id, regexp_replace(regexp_replace(trim(lower(strip_accents(text)), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\t\n\x0B\f\r ]+', ' ', 'g'), '[^A-Za-z0-9_ -]', '', 'g') AS key FROM documents")
def normalize_name(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.name_key(F.col("text")).alias("key"))


@query(r"""SELECT page_id, nullif(regexp_replace(regexp_replace(nullif(split_part(u, '/upload/', 2), ''), '^v[0-9]+/', ''), '\.[^/.]+$', ''), '') AS asset FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url ELSE url || '/upload/v' || page_id || '/img' || page_id || '.png' END AS u FROM pages)""")
def url_public_id(t: Tables) -> DataFrame:
    page = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/upload/v"), page, F.lit("/img"), page, F.lit(".png")))
    return t.pages.select("page_id", fn.url_asset_id(url).alias("asset"))


@query("SELECT c_custkey, c_acctbal AS back, TRY_CAST(c_name AS DOUBLE) AS not_a_number FROM customer")
def decimal_roundtrip(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", fn.text_number(fn.number_text(F.col("c_acctbal"))).alias("back"), fn.text_number(F.col("c_name")).alias("not_a_number"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN o_orderdate END AS parsed FROM orders")
def parse_iso(t: Tables) -> DataFrame:
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 2 THEN date_format(o_orderdate, 'yyyy') ELSE 'soon' END")
    return t.orders.select("o_orderkey", fn.iso_time(text).alias("parsed"))


# ---- access


def _micros(c: str) -> str:
    return f"epoch_us({c})"


_ACCESS = f"""WITH RECURSIVE e AS (SELECT *, {_micros("ts")} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM access WHERE kind IN ('login', 'mfa')),
f AS (
 SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, ''::VARCHAR AS kind, ''::VARCHAR AS outcome, 0::BIGINT AS n, NULL::BIGINT AS lk, NULL::BIGINT AS code, 0::BIGINT AS attempts FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL
 SELECT user_id, k, event_id, kind, o, CASE WHEN o IN ('BAD_PASSWORD', 'LOCKED_NOW') THEN n + 1 WHEN kind = 'login' AND o = 'SUCCESS' THEN 0 ELSE n END, CASE WHEN o = 'LOCKED_NOW' THEN t + 172800000000 WHEN kind = 'login' AND o = 'SUCCESS' THEN NULL ELSE lk END,
  CASE WHEN o = 'MFA_SENT' THEN t + 172800000000 WHEN o IN ('EXPIRED', 'TOO_MANY') OR (kind = 'mfa' AND o = 'SUCCESS') THEN NULL ELSE code END, CASE WHEN o = 'MFA_SENT' THEN 0 WHEN o = 'WRONG' THEN attempts + 1 ELSE attempts END
 FROM (SELECT e.user_id, e.k, e.event_id, e.kind, e.t, f.n, f.lk, f.code, f.attempts, CASE WHEN e.kind = 'login' THEN
   CASE WHEN NOT known THEN 'UNKNOWN' WHEN f.lk > t THEN 'LOCKED' WHEN NOT confirmed THEN 'UNCONFIRMED' WHEN NOT ok THEN CASE WHEN f.n + 1 >= 3 THEN 'LOCKED_NOW' ELSE 'BAD_PASSWORD' END WHEN rol = 'unassigned' THEN 'UNASSIGNED' WHEN rol = 'admin' THEN 'MFA_SENT' ELSE 'SUCCESS' END
   ELSE CASE WHEN NOT known OR rol <> 'admin' THEN 'INVALID' WHEN f.code IS NULL THEN 'NO_PENDING' WHEN f.code < t THEN 'EXPIRED' WHEN f.attempts >= 3 THEN 'TOO_MANY' WHEN NOT ok THEN 'WRONG' ELSE 'SUCCESS' END END AS o
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))"""


def _outcomes(t: Tables) -> DataFrame:
    return access.access_outcomes(t.access.where("kind IN ('login', 'mfa')"), "user_id", lock=2 * DAY, mfa=2 * DAY)


@query(f"{_ACCESS} SELECT user_id, event_id, outcome FROM f WHERE kind = 'login'", "access")
def login_lockout(t: Tables) -> DataFrame:
    return _outcomes(t).join(t.access.where("kind = 'login'").select("event_id"), "event_id", "left_semi").select("user_id", "event_id", "outcome")


@query(f"{_ACCESS} SELECT user_id, event_id, outcome FROM f WHERE kind = 'mfa'", "access")
def mfa_attempts(t: Tables) -> DataFrame:
    return _outcomes(t).join(t.access.where("kind = 'mfa'").select("event_id"), "event_id", "left_semi").select("user_id", "event_id", "outcome")


@query(f"{_ACCESS} SELECT event_id, CASE WHEN outcome = 'SUCCESS' THEN user_id END AS userId, CASE WHEN outcome <> 'SUCCESS' THEN concat('u', user_id, '@lab.example') END AS emailIntent, outcome = 'SUCCESS' AS success FROM f WHERE k > 0 AND outcome <> 'MFA_SENT'", "access")
def login_log_rows(t: Tables) -> DataFrame:
    rows = _outcomes(t).withColumn("email", F.concat(F.lit("u"), "user_id", F.lit("@lab.example")))
    return access.login_log(rows)


@query(f"""WITH RECURSIVE e AS (SELECT *, {_micros("ts")} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT event_id, ts, user_id, known, CASE WHEN event_id % 20 = 0 THEN 'reset_done' ELSE kind END AS kind FROM access WHERE kind = 'reset_request')),
f AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, ''::VARCHAR AS outcome, 0::BIGINT AS n, NULL::BIGINT AS st FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL
 SELECT user_id, k, event_id, o, CASE WHEN o = 'UNKNOWN' THEN n WHEN o = 'DONE' THEN 0 WHEN o = 'SENT' THEN c + 1 ELSE c END, CASE WHEN o = 'UNKNOWN' THEN st WHEN o = 'DONE' THEN NULL WHEN fresh THEN t ELSE st END
 FROM (SELECT *, CASE WHEN NOT known THEN 'UNKNOWN' WHEN kind = 'reset_done' THEN 'DONE' WHEN c < 3 THEN 'SENT' ELSE 'THROTTLED' END AS o FROM (SELECT e.user_id, e.k, e.event_id, e.kind, e.known, e.t, f.n, f.st, f.st IS NULL OR e.t - f.st > 432000000000 AS fresh, CASE WHEN f.st IS NULL OR e.t - f.st > 432000000000 THEN 0 ELSE f.n END AS c FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
SELECT user_id, event_id, outcome FROM f WHERE k > 0""", "access")
def reset_rate_limit(t: Tables) -> DataFrame:
    rows = t.access.where("kind = 'reset_request'").withColumn("kind", F.when(F.col("event_id") % 20 == 0, "reset_done").otherwise(F.col("kind")))
    return access.reset_outcomes(rows, "user_id", window=5 * DAY)


def _streamed(t: Tables, kinds: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The outcomes that a stream over the table of events appends to a log in the shared folder."""
    source = io.read_stream(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema)
    folder = io.scratch(t.spark, "stream")
    log = processors.log_sink(make(derived(source, "access").where(F.col("kind").isin(*kinds))), f"{folder}/out", f"{folder}/checkpoint")
    log.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


def _streamed_from(t: Tables, feed: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same over a stored table of events."""
    source, folder = io.read_stream(t.spark, io.folder_of(feed), feed.schema), io.scratch(t.spark, "stream")
    processors.log_sink(make(source), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


@query(f"{_ACCESS} SELECT user_id, event_id, outcome FROM f WHERE k > 0", "access")
def stream_access(t: Tables) -> DataFrame:
    return _streamed(t, ["login", "mfa"], lambda events: processors.access_stream(events, "user_id", 2 * DAY, 2 * DAY)).select("user_id", "event_id", "outcome")


_TOKENS = "SELECT user_id, ts, concat('t', event_id) AS token, ts + INTERVAL 2 DAY AS expires_at FROM access WHERE kind = 'reset_request'"


@query(f"""WITH i AS ({_TOKENS}), u AS (SELECT event_id, user_id, ts, (SELECT arg_max(i.token, i.ts) FROM i WHERE i.user_id = a.user_id AND i.ts <= a.ts) AS have, (SELECT max(i.ts) FROM i WHERE i.user_id = a.user_id AND i.ts <= a.ts) + INTERVAL 2 DAY AS expires FROM access a WHERE kind = 'mfa')
SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN false ELSE have IS NOT NULL END AND expires >= ts, false) AS valid FROM u""", "access")
def reset_token_check(t: Tables) -> DataFrame:
    issues = t.access.where("kind = 'reset_request'").select("user_id", "ts", F.concat(F.lit("t"), "event_id").alias("token"), (F.col("ts") + F.expr("INTERVAL '2' DAY")).alias("expires_at"))
    uses = t.access.where("kind = 'mfa'").select("event_id", "user_id", "ts")
    uses = access.latest_token(uses, issues).withColumn("token", F.when(F.col("event_id") % 5 == 0, "wrong").otherwise(F.col("last.token"))).drop("last")
    return access.reset_token_check(uses, issues).select("event_id", "valid")


def _flow(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Requests, and uses that show the token of the user's latest request: two of five only ask, one of five shows a wrong one."""
    requests = t.access.where("kind = 'reset_request'").select("event_id", "user_id", "ts", "known", F.concat(F.lit("t"), "event_id").alias("token"))
    uses = access.nearest(t.access.where("kind = 'mfa'").select("event_id", "user_id", "ts", "known"), requests.select("user_id", "ts", F.col("token").alias("value")), "user_id", "token")
    return requests, uses.withColumns({"token": F.when(F.col("event_id") % 5 == 0, "wrong").otherwise(F.col("token")), "kind": F.when(F.col("event_id") % 5 > 2, "reset_check").otherwise("reset_use")})


_FLOW = f"""WITH RECURSIVE r AS (SELECT *, {_micros("ts")} AS t FROM access WHERE kind = 'reset_request'),
b AS (SELECT user_id, event_id, t, known, 'reset_request' AS kind, concat('t', event_id) AS token FROM r UNION ALL SELECT user_id, event_id, {_micros("ts")}, known, CASE WHEN event_id % 5 > 2 THEN 'reset_check' ELSE 'reset_use' END, CASE WHEN event_id % 5 = 0 THEN 'wrong' ELSE (SELECT concat('t', arg_max(r.event_id, r.t)) FROM r WHERE r.user_id = a.user_id AND r.t <= {_micros("a.ts")}) END FROM access a WHERE kind = 'mfa'),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM b),
f AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, ''::VARCHAR AS outcome, 0::BIGINT AS n, NULL::BIGINT AS st, NULL::VARCHAR AS have, NULL::BIGINT AS life FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, k, event_id, o, CASE o WHEN 'SENT' THEN c + 1 WHEN 'THROTTLED' THEN c WHEN 'DONE' THEN 0 ELSE n END, CASE WHEN o = 'DONE' THEN NULL WHEN o IN ('SENT', 'THROTTLED') AND fresh THEN t ELSE st END, CASE o WHEN 'SENT' THEN token WHEN 'DONE' THEN NULL ELSE have END, CASE o WHEN 'SENT' THEN t + 172800000000 WHEN 'DONE' THEN NULL ELSE life END
 FROM (SELECT *, CASE WHEN kind = 'reset_request' THEN CASE WHEN NOT known THEN 'UNKNOWN' WHEN c < 3 THEN 'SENT' ELSE 'THROTTLED' END WHEN known AND have = token AND life >= t THEN CASE kind WHEN 'reset_use' THEN 'DONE' ELSE 'VALID' END ELSE 'INVALID' END AS o
  FROM (SELECT e.*, f.n, f.st, f.have, f.life, f.st IS NULL OR e.t - f.st > 432000000000 AS fresh, CASE WHEN f.st IS NULL OR e.t - f.st > 432000000000 THEN 0 ELSE f.n END AS c FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
SELECT user_id, event_id, outcome FROM f WHERE k > 0"""


@query(_FLOW, "access")
def reset_flow(t: Tables) -> DataFrame:
    """Reset tokens that serve once: requests and uses in one fold."""
    return access.flow_outcomes(*_flow(t), "user_id", window=5 * DAY, life=2 * DAY)


@query(_FLOW, "access")
def reset_flow_stream(t: Tables) -> DataFrame:
    requests, uses = _flow(t)
    feed = io.stored(requests.withColumn("kind", F.lit("reset_request")).unionByName(uses), "feed")
    return _streamed_from(t, feed, lambda events: processors.flow_stream(events, "user_id", 5 * DAY, 2 * DAY, "400 days")).select("user_id", "event_id", "outcome")


@query(f"{_ACCESS} SELECT user_id, event_id, outcome FROM f WHERE k > 0", "access")
def access_in_blocks(t: Tables) -> DataFrame:
    """Every key as if it had too many events for a task."""
    return access.access_outcomes(t.access.where("kind IN ('login', 'mfa')"), "user_id", lock=2 * DAY, mfa=2 * DAY, hot=40)


_SESSIONS = """s AS (SELECT o.*, o.ts + INTERVAL 1 DAY AS expires_at, (SELECT min(l.ts) FROM access l WHERE l.event_type = 'purchase' AND l.user_id = o.user_id AND l.event_id % 3 = 0 AND l.ts >= o.ts) AS revoked_at FROM (SELECT concat('s', event_id) AS jti, user_id, ts FROM access WHERE event_type = 'signup' AND known) o)"""


def _sessions(t: Tables) -> DataFrame:
    opens = t.access.where("event_type = 'signup' AND known").select(F.concat(F.lit("s"), "event_id").alias("jti"), "user_id", "ts")
    logouts = opens.where(F.lit(False)).select("jti", "ts")
    every = t.access.where("event_type = 'purchase' AND event_id % 3 = 0").select("user_id", "ts")
    return access.sessions(opens, logouts, every, DAY)


@query(f"WITH {_SESSIONS} SELECT jti, user_id, ts AS opened_at, expires_at, revoked_at FROM s", "access")
def session_open(t: Tables) -> DataFrame:
    return _sessions(t)


@query(f"WITH {_SESSIONS} SELECT jti, user_id FROM s WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND expires_at >= TIMESTAMP '2024-01-15 12:00:00' AND (revoked_at IS NULL OR revoked_at > TIMESTAMP '2024-01-15 12:00:00')", "access")
def sessions_active_at(t: Tables) -> DataFrame:
    return access.active_at(_sessions(t), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("jti", "user_id")


@query(f"""WITH {_SESSIONS}, r AS (SELECT a.event_id, a.ts, CASE WHEN a.event_id % 9 = 0 THEN NULL ELSE concat('s', (SELECT max(o.event_id) FROM access o WHERE o.user_id = a.user_id AND o.event_type = 'signup')) END AS jti FROM access a WHERE a.event_type = 'view')
SELECT r.event_id, r.jti, CASE WHEN r.jti IS NULL THEN 'NO_JTI' WHEN s.user_id IS NULL OR s.ts > r.ts THEN 'NOT_FOUND' WHEN s.revoked_at <= r.ts THEN 'REVOKED' WHEN s.expires_at < r.ts THEN 'EXPIRED' ELSE 'OK' END AS verdict FROM r LEFT JOIN s ON s.jti = r.jti""", "access")
def session_check(t: Tables) -> DataFrame:
    last = t.access.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    requests = t.access.where("event_type = 'view'").join(last, "user_id", "left")
    requests = requests.select("event_id", "ts", F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("s"), F.coalesce(F.col("last").cast("string"), F.lit("")))).alias("jti"))
    return access.session_check(requests, _sessions(t)).select("event_id", "jti", "verdict")


def _feed(t: Tables) -> DataFrame:
    """Opens, logouts of the user's latest session, logouts from everywhere, and requests for the latest or, now and then, the user's last session of all."""
    opens = t.access.where("event_type = 'signup' AND known").select("event_id", "user_id", "ts", F.concat(F.lit("s"), "event_id").alias("jti"))
    last = opens.groupBy("user_id").agg(F.concat(F.lit("s"), F.max("event_id")).alias("final"))
    asks = t.access.where("event_type = 'view' OR (event_type = 'error' AND event_id % 2 = 0)").select("event_id", "user_id", "ts", "event_type")
    asks = access.nearest(asks, opens.select("user_id", "ts", F.col("jti").alias("value")), "user_id", "jti").join(last, "user_id", "left")
    jti = F.when((F.col("event_type") == "error") | (F.col("event_id") % 9 > 1), F.col("jti")).when(F.col("event_id") % 9 == 1, F.col("final"))
    asks = asks.select("event_id", "user_id", "ts", jti.alias("jti"), F.when(F.col("event_type") == "error", "logout").otherwise("request").alias("kind"))
    every = t.access.where("event_type = 'purchase' AND event_id % 3 = 0").select("event_id", "user_id", "ts", F.lit(None).cast("string").alias("jti"), F.lit("logout_all").alias("kind"))
    return opens.withColumn("kind", F.lit("open")).unionByName(asks).unionByName(every)


_FEED = """WITH o AS (SELECT event_id, user_id, ts FROM access WHERE event_type = 'signup' AND known),
q AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'error' OR event_id % 9 > 1 THEN (SELECT arg_max(o.event_id, (o.ts, o.event_id)) FROM o WHERE o.user_id = a.user_id AND o.ts <= a.ts) WHEN event_id % 9 = 1 THEN (SELECT max(o.event_id) FROM o WHERE o.user_id = a.user_id) END AS jti FROM access a WHERE event_type = 'view' OR (event_type = 'error' AND event_id % 2 = 0)),
s AS (SELECT o.*, o.ts + INTERVAL 1 DAY AS expires, least((SELECT min(q.ts) FROM q WHERE q.event_type = 'error' AND q.jti = o.event_id AND q.ts >= o.ts), (SELECT min(l.ts) FROM access l WHERE l.event_type = 'purchase' AND l.event_id % 3 = 0 AND l.user_id = o.user_id AND l.ts >= o.ts)) AS revoked FROM o)
SELECT q.event_id, CASE WHEN q.jti IS NULL THEN 'NO_JTI' WHEN s.event_id IS NULL OR s.ts > q.ts THEN 'NOT_FOUND' WHEN s.revoked <= q.ts THEN 'REVOKED' WHEN s.expires < q.ts THEN 'EXPIRED' ELSE 'OK' END AS verdict FROM q LEFT JOIN s ON s.event_id = q.jti WHERE q.event_type = 'view'"""


@query(_FEED, "access")
def session_check_logouts(t: Tables) -> DataFrame:
    """Requests against sessions that single logouts and logouts from everywhere end."""
    of = {k: _feed(t).where(F.col("kind") == k).drop("kind") for k in ("open", "logout", "logout_all", "request")}
    found = access.sessions(of["open"].drop("event_id"), of["logout"].select("jti", "ts").where("jti IS NOT NULL"), of["logout_all"].select("user_id", "ts"), DAY)
    return access.session_check(of["request"].drop("user_id"), found).select("event_id", "verdict")


@query(_FEED, "access")
def session_feed(t: Tables) -> DataFrame:
    """The same from one stream of opens, logouts and requests, without a table of sessions."""
    feed = io.stored(_feed(t), "feed")
    asked = io.stored(feed.where("kind = 'request'").select("event_id"), "asked")
    out = _streamed_from(t, feed, lambda events: processors.session_feed(events, DAY, "400 days", 10**6))
    return out.join(asked, "event_id", "left_semi").select("event_id", F.col("outcome").alias("verdict"))


@query("""SELECT email, id, CASE WHEN id IS NULL THEN 'CREATE' WHEN NOT confirmed THEN 'CONFIRM' ELSE 'KEEP' END AS action, coalesce(rol, 'unassigned') AS rol FROM (SELECT DISTINCT concat('u', c_custkey % 300, '@lab.example') AS email FROM customer) LEFT JOIN users USING (email)""", "users")
def external_user_upsert(t: Tables) -> DataFrame:
    logins = t.customer.select(F.concat(F.lit("u"), F.col("c_custkey") % 300, F.lit("@lab.example")).alias("email"))
    return mutate.external_users(t.users, logins)


@query("""SELECT email, id, CASE WHEN id IS NULL THEN 'CREATE' WHEN NOT confirmed THEN 'CONFIRM' WHEN rol = 'unassigned' THEN 'PROMOTE' ELSE 'KEEP' END AS action, CASE WHEN rol IS NULL OR rol = 'unassigned' THEN 'admin' ELSE rol END AS rol FROM (SELECT DISTINCT concat('u', c_custkey % 300, '@lab.example') AS email FROM customer) LEFT JOIN users USING (email)""", "users")
def external_user_promote(t: Tables) -> DataFrame:
    logins = t.customer.select(F.concat(F.lit("u"), F.col("c_custkey") % 300, F.lit("@lab.example")).alias("email"))
    return mutate.external_users(t.users, logins, promote=True)


# ---- changes


@query("SELECT id, CASE WHEN isActive AND id % 5 = 0 THEN 'renamed' ELSE firstName END AS firstName, CASE WHEN isActive AND id % 5 = 0 AND id % 2 = 0 THEN NULL ELSE documentType END AS documentType FROM patients", "patients")
def patch_merge(t: Tables) -> DataFrame:
    fields = F.when(F.col("id") % 2 == 0, F.array(F.lit("firstName"), F.lit("documentType"))).otherwise(F.array(F.lit("firstName")))
    patches = t.patients.where("id % 5 = 0").select("id", fields.alias("fields"), F.lit("renamed").alias("firstName"), F.lit(None).cast("string").alias("documentType"))
    return mutate.patched(t.patients, patches, ["firstName", "documentType"]).select("id", "firstName", "documentType")


@query("SELECT id, CASE WHEN isActive AND id % 5 = 0 AND id % 2 = 0 THEN 'renamed' ELSE firstName END AS firstName, documentType FROM patients", "patients")
def patch_coalesce(t: Tables) -> DataFrame:
    name = F.when(F.col("id") % 2 == 0, "renamed")
    patches = t.patients.where("id % 5 = 0").select("id", F.array(F.lit("firstName"), F.lit("documentType")).alias("fields"), name.alias("firstName"), F.lit(None).cast("string").alias("documentType"))
    return mutate.patched(t.patients, patches, ["firstName", "documentType"], nullable=False).select("id", "firstName", "documentType")


def _turns(df: DataFrame, *each: tuple[str, ...]) -> DataFrame:
    """Several patches for each row of df, numbered in turn: expressions of their columns, the last one of their fields."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.selectExpr("id", f"{i} AS batch_seq", *e) for i, e in enumerate(each)])


@query("SELECT id, CASE WHEN isActive AND id % 5 = 0 THEN CASE WHEN id % 3 > 0 THEN concat('n', id) END ELSE firstName END AS firstName, CASE WHEN isActive AND id % 5 = 0 AND id % 2 = 0 THEN NULL ELSE documentType END AS documentType FROM patients", "patients")
def patch_in_turn(t: Tables) -> DataFrame:
    patches = _turns(t.patients.where("id % 5 = 0"), ("'first' AS firstName", "array('firstName') AS fields"), ("CAST(NULL AS STRING) AS documentType", "CASE WHEN id % 2 = 0 THEN array('documentType') ELSE array() END AS fields"), ("CASE WHEN id % 3 > 0 THEN concat('n', id) END AS firstName", "array('firstName') AS fields"))
    return mutate.patched(t.patients, patches, ["firstName", "documentType"]).select("id", "firstName", "documentType")


@query("SELECT id, CASE WHEN isActive AND id % 5 = 0 THEN CASE WHEN id % 3 > 0 THEN concat('n', id) ELSE 'first' END ELSE firstName END AS firstName FROM patients", "patients")
def patch_coalesce_in_turn(t: Tables) -> DataFrame:
    patches = _turns(t.patients.where("id % 5 = 0"), ("'first' AS firstName", "array('firstName') AS fields"), ("CASE WHEN id % 3 > 0 THEN concat('n', id) END AS firstName", "array('firstName') AS fields"))
    return mutate.patched(t.patients, patches, ["firstName"], nullable=False).select("id", "firstName")


def _order_turns(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders, and four patches for every third: another patient, another doctor, the patient as it was, a courtesy."""
    rows = t.service_orders.withColumns({"discountAmount": fn.money(F.lit(0)), "totalAmount": fn.money(F.col("subtotalAmount")), "subtotalAmount": fn.money(F.col("subtotalAmount"))})
    every = t.service_orders.where("id % 3 = 0")
    return rows, _turns(every, ("patientId + 1 AS patientId", "array('patientId') AS fields"), ("patientId", "id % 90 AS doctorId", "array('patientId', 'doctorId') AS fields"), ("patientId", "array('patientId') AS fields"), ("id % 40 * 1e0 AS courtesyPercent", "doctorId", "array('courtesyPercent', 'doctorId') AS fields"))


_ORDER_TURNS = f"""WITH RECURSIVE b AS (SELECT id, s, CASE s WHEN 0 THEN patientId + 1 WHEN 3 THEN NULL ELSE patientId END AS np, CASE s WHEN 1 THEN id % 90 WHEN 3 THEN doctorId END AS nd, CASE s WHEN 3 THEN id % 40 * 1e0 END AS nc FROM service_orders, range(4) r(s) WHERE id % 3 = 0),
f AS (SELECT id, -1::BIGINT AS s, isActive, patientId AS p, doctorId AS d, courtesyPercent AS c, NULL::VARCHAR AS fault FROM service_orders
 UNION ALL SELECT id, s, isActive, CASE WHEN fault IS NULL THEN coalesce(np, p) ELSE p END, CASE WHEN fault IS NULL THEN coalesce(nd, d) ELSE d END, CASE WHEN fault IS NULL THEN coalesce(nc, c) ELSE c END, fault FROM (
  SELECT f.id, b.s, f.isActive, f.p, f.d, f.c, np, nd, nc, CASE WHEN NOT f.isActive THEN 'MISSING' WHEN np <> p AND np NOT IN (SELECT id FROM patients WHERE isActive) THEN 'PATIENT' WHEN nd IS NOT NULL AND nd IS DISTINCT FROM d AND nd NOT IN (SELECT id FROM doctors WHERE isActive) THEN 'DOCTOR' END AS fault FROM f JOIN b ON b.id = f.id AND b.s = f.s + 1))"""


@query(f"""{_ORDER_TURNS}, n AS (SELECT f.id, p, d, c, o.id IS NOT NULL AS again, CAST({sql_money("subtotalAmount")} AS DOUBLE) AS s FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1) f JOIN service_orders USING (id) LEFT JOIN (SELECT id FROM f WHERE s = 3 AND fault IS NULL) o ON o.id = f.id)
SELECT id, p AS patientId, d AS doctorId, c AS courtesyPercent, CASE WHEN again THEN {sql_money("s - s * (c / 100e0)")} ELSE s END AS totalAmount FROM n""", "service_orders", "patients", "doctors")
def order_patch_in_turn(t: Tables) -> DataFrame:
    out = mutate.orders_patched(*_order_turns(t), t.patients, t.doctors)[0]
    return out.select("id", "patientId", "doctorId", "courtesyPercent", money("totalAmount").alias("totalAmount"))


@query(f"{_ORDER_TURNS} SELECT id, s AS batch_seq, fault FROM f WHERE s >= 0", "service_orders", "patients", "doctors")
def order_patch_in_turn_faults(t: Tables) -> DataFrame:
    return mutate.orders_patched(*_order_turns(t), t.patients, t.doctors)[1].select("id", F.col("batch_seq").cast("bigint").alias("batch_seq"), "fault")


@query("SELECT id, CASE WHEN isActive AND id % 6 = 0 THEN CASE WHEN id % 4 = 0 THEN 'Y' ELSE 'X' END ELSE status END AS status FROM service_orders", "service_orders")
def status_in_turn(t: Tables) -> DataFrame:
    return mutate.with_status(t.service_orders, _turns(t.service_orders.where("id % 6 = 0"), ("'X' AS status",), ("CASE WHEN id % 4 = 0 THEN 'Y' END AS status",))).select("id", "status")


@query("SELECT id, CASE WHEN confirmed AND id % 2 = 0 THEN CASE WHEN id % 3 = 0 THEN 'admin' ELSE 'recepcionista' END ELSE rol END AS rol FROM users", "users")
def role_in_turn(t: Tables) -> DataFrame:
    return mutate.roles_assigned(t.users, _turns(t.users.where("id % 2 = 0"), ("'recepcionista' AS rol",), ("CASE WHEN id % 3 = 0 THEN 'admin' END AS rol",)))[0].select("id", "rol")


@query("""WITH f AS (SELECT id, studyId, id % 8 = 0 AS missing FROM sheet_items WHERE id % 3 = 0)
SELECT i.id AS studyResultId, r.k, CASE WHEN f.id IS NULL OR f.missing THEN 'old' WHEN i.id % 5 = 0 THEN 'first' ELSE 'second' END AS label, CASE WHEN f.id IS NULL OR f.missing THEN 'by hand' WHEN i.id % 5 = 0 THEN 'a' END AS method FROM sheet_items i LEFT JOIN f ON f.id = i.id, range(2) r(k) WHERE r.k = 0 OR (f.id IS NOT NULL AND NOT f.missing AND i.id % 5 <> 0)""", "sheet_items")
def result_patch_in_turn(t: Tables) -> DataFrame:
    """Two patches a result, the second of which is refused for every fifth: its two values take the place of the first one's."""
    rows, values, _, _ = _sheets(t)
    each = rows.where("id % 3 = 0").select("id", "serviceOrderId")
    patches = _turns(each, ("'a' AS method", "serviceOrderId", "id AS serviceOrderItemId", "array('method') AS fields"), ("CAST(NULL AS STRING) AS method", "CASE WHEN id % 5 = 0 THEN serviceOrderId + 1 ELSE serviceOrderId END AS serviceOrderId", "id AS serviceOrderItemId", "array('method') AS fields"))
    empty = {c: F.lit(None).cast(k) for c, k in (("sampleAt", "timestamp_ntz"), ("reportedAt", "timestamp_ntz"), ("observations", "string"), ("isDraft", "boolean"))}
    first = each.selectExpr("id AS studyResultId", "0 AS batch_seq", "CAST(NULL AS BIGINT) AS studyDetailId", "'first' AS label", "'g' AS unit", "CAST(NULL AS STRING) AS referenceValue", "'1' AS value", "0 AS sortOrder")
    second = first.withColumns({"batch_seq": F.lit(1), "label": F.lit("second")})
    new = first.unionByName(second).unionByName(second.withColumn("sortOrder", F.lit(1)))
    out, kept, _ = results.results_patched(rows, values.withColumn("sortOrder", F.lit(0)), patches.withColumns(empty), new, t.study_details)
    return kept.join(out.select(F.col("id").alias("studyResultId"), "method").hint("merge"), "studyResultId").select("studyResultId", F.col("sortOrder").cast("bigint").alias("k"), "label", "method")


@query("SELECT id, code, CASE WHEN NOT isActive THEN 'MISSING' WHEN id % 4 <> 1 AND changed IN (SELECT code FROM studies) AND changed <> code THEN 'TAKEN' END AS fault FROM (SELECT id, isActive, CASE id % 4 WHEN 0 THEN code WHEN 1 THEN code ELSE concat('Brand#', id % 55, '-', id) END AS changed, code FROM studies)", "studies")
def patch_conflicts(t: Tables) -> DataFrame:
    code = F.when(F.col("id") % 4 < 2, F.col("code")).otherwise(F.concat(F.lit("Brand#"), F.col("id") % 55, F.lit("-"), "id"))
    patches = t.studies.select("id", F.array(F.lit("code")).alias("fields"), code.alias("code"))
    out = mutate.patch_faults(patches, t.studies, ["code"])
    return out.select("id", "fault").join(t.studies.select("id", "code"), "id")


@query("""SELECT id, CASE WHEN studyId NOT IN (SELECT id FROM studies WHERE isActive) THEN 'STUDY' WHEN parentId IS NOT NULL AND NOT EXISTS (SELECT 1 FROM study_details p WHERE p.id = b.parentId AND p.studyId = b.studyId AND p.isActive) THEN 'PARENT' END AS fault FROM (SELECT id + 1 + (SELECT max(id) FROM study_details) AS id, CASE WHEN id % 5 = 0 THEN studyId + 1 ELSE studyId END AS studyId, CASE WHEN id % 3 > 0 THEN id END AS parentId FROM study_details) b""", "study_details", "studies")
def detail_insert_faults(t: Tables) -> DataFrame:
    return mutate.details_added(t.study_details, _new_details(t), t.studies)[1].select("id", "fault")


@query("""WITH b AS (SELECT id + 1 + (SELECT max(id) FROM study_details) AS id, CASE WHEN id % 5 = 0 THEN studyId + 1 ELSE studyId END AS studyId, CASE WHEN id % 3 > 0 THEN id END AS parentId, 'new' AS name FROM study_details)
SELECT id, studyId, name, isActive FROM study_details UNION ALL SELECT id, studyId, name, true FROM b WHERE studyId IN (SELECT id FROM studies WHERE isActive) AND (parentId IS NULL OR EXISTS (SELECT 1 FROM study_details p WHERE p.id = b.parentId AND p.studyId = b.studyId AND p.isActive))""", "study_details", "studies")
def detail_insert(t: Tables) -> DataFrame:
    return mutate.details_added(t.study_details, _new_details(t), t.studies)[0].select("id", "studyId", "name", "isActive")


def _beyond(details: DataFrame) -> DataFrame:
    """The details with `top`, their greatest id: ids of a batch lie beyond it, however many are stored."""
    return details.crossJoin(details.agg(F.max("id").alias("top")))


def _new_details(t: Tables) -> DataFrame:
    return _beyond(t.study_details).selectExpr("id + 1 + top AS id", "CASE WHEN id % 5 = 0 THEN studyId + 1 ELSE studyId END AS studyId", "CASE WHEN id % 3 > 0 THEN id END AS parentId", "'new' AS name", "1 AS sortOrder")


@query("""WITH RECURSIVE b AS (SELECT id, CASE WHEN id % 17 = 7 THEN id % 40 + 1 ELSE id % 40 END AS studyId, CASE WHEN id % 29 = 3 THEN id + 40 WHEN id >= 40 THEN id - 40 END AS parentId FROM study_details), a AS (SELECT * FROM b WHERE studyId IN (SELECT id FROM studies WHERE isActive)),
g AS (SELECT id, studyId FROM a WHERE parentId IS NULL UNION SELECT a.id, a.studyId FROM a JOIN g ON a.parentId = g.id AND a.studyId = g.studyId AND a.id > g.id)
SELECT b.id + 1 + (SELECT max(id) FROM study_details) AS id, CASE WHEN a.id IS NULL THEN 'STUDY' WHEN g.id IS NULL THEN 'PARENT' END AS fault FROM b LEFT JOIN a ON a.id = b.id LEFT JOIN g ON g.id = b.id""", "study_details", "studies")
def detail_insert_chains(t: Tables) -> DataFrame:
    """A batch in which rows hang below earlier rows of the batch."""
    rows = _beyond(t.study_details).selectExpr("id + 1 + top AS id", "CASE WHEN id % 17 = 7 THEN id % 40 + 1 ELSE id % 40 END AS studyId", "1 + top + CASE WHEN id % 29 = 3 THEN id + 40 WHEN id >= 40 THEN id - 40 END AS parentId", "'new' AS name", "1 AS sortOrder")
    return mutate.details_added(t.study_details, rows, t.studies)[1].select("id", "fault")


@query("SELECT id, CASE WHEN isActive AND id % 6 = 0 THEN 'X' ELSE status END AS status FROM service_orders", "service_orders")
def status_update(t: Tables) -> DataFrame:
    return mutate.with_status(t.service_orders, t.service_orders.where("id % 6 = 0").select("id", F.lit("X").alias("status"))).select("id", "status")


@query("SELECT serviceOrderId, lineNo, quantity FROM items WHERE serviceOrderId % 5 <> 0 UNION ALL SELECT id, 1, 7e0 FROM service_orders WHERE id % 5 = 0 AND id % 2 = 0 UNION ALL SELECT serviceOrderId, lineNo, quantity FROM items WHERE serviceOrderId % 5 = 0 AND serviceOrderId % 2 <> 0", "items", "service_orders")
def replace_children(t: Tables) -> DataFrame:
    new = t.service_orders.where("id % 5 = 0 AND id % 2 = 0").select(F.col("id").alias("serviceOrderId"), F.lit(1).alias("lineNo"), F.lit(7.0).alias("quantity"))
    return mutate.replaced_children(t.items.select("serviceOrderId", "lineNo", "quantity"), new, "serviceOrderId")


@query("SELECT id, isActive AND id % 8 <> 0 AS isActive FROM patients", "patients")
def soft_delete(t: Tables) -> DataFrame:
    return mutate.soft_deleted(t.patients, t.patients.where("id % 8 = 0").select("id")).select("id", "isActive")


@query("SELECT w.id, p.id IS NOT NULL AS found FROM (SELECT id + 100 AS id FROM patients) w LEFT JOIN patients p ON p.id = w.id", "patients")
def hard_delete(t: Tables) -> DataFrame:
    return lookup.affected(t.patients.select((F.col("id") + 100).alias("id")), t.patients).select("id", "found")


@query("SELECT id, firstName FROM patients WHERE id NOT IN (SELECT id + 100 FROM patients)", "patients")
def hard_delete_rows(t: Tables) -> DataFrame:
    return mutate.hard_deleted(t.patients, t.patients.select((F.col("id") + 100).alias("id"))).select("id", "firstName")


@query("""WITH gone AS (SELECT id FROM patients WHERE id % 3 = 0 AND id NOT IN (SELECT patientId FROM service_orders))
SELECT 'patients' AS "table", count(*) AS n, sum(id)::BIGINT AS ids FROM patients WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'service_orders', count(*), sum(id)::BIGINT FROM service_orders WHERE id % 3 <> 0 UNION ALL SELECT 'service_order_items', count(*), sum(id)::BIGINT FROM sheet_items WHERE serviceOrderId % 3 <> 0""", "patients", "service_orders", "sheet_items")
def cascade_delete(t: Tables) -> DataFrame:
    tables = {"patients": t.patients, "service_orders": t.service_orders, "service_order_items": t.sheet_items}
    after = mutate.cascaded(tables, "patients", t.patients.where("id % 3 = 0"))[0]
    after |= {k: v for k, v in mutate.cascaded(tables, "service_orders", t.service_orders.where("id % 3 = 0"))[0].items() if k != "patients"}
    out = None
    for name in tables:
        one = after[name].agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH RECURSIVE s AS (SELECT id FROM study_details WHERE id % 97 = 0 UNION SELECT d.id FROM study_details d JOIN s ON d.parentId = s.id) SELECT id FROM s", "study_details")
def detail_subtree(t: Tables) -> DataFrame:
    return mutate.subtree(t.study_details, t.study_details.where("id % 97 = 0"))


@query("""WITH RECURSIVE d AS (SELECT id, CASE WHEN id >= 60 AND id % 7 <> 0 THEN id - 60 END AS parentId FROM study_details), w AS (SELECT id AS root, id FROM d WHERE id % 9 = 0 UNION SELECT w.root, d.id FROM w JOIN d ON d.parentId = w.id),
r AS (SELECT DISTINCT root FROM w WHERE id % 31 = 5), gone AS (SELECT DISTINCT id FROM w WHERE root NOT IN (SELECT root FROM r))
SELECT id, CASE WHEN id IN (SELECT root FROM r) THEN 'refused' WHEN id IN (SELECT id FROM gone) THEN 'gone' ELSE 'stays' END AS state FROM d""", "study_details")
def cascade_below_restrict(t: Tables) -> DataFrame:
    """Details with all that hang below them, unless a result's value refers to one of these."""
    details = t.study_details.selectExpr("id", "CASE WHEN id >= 60 AND id % 7 <> 0 THEN id - 60 END AS parentId")
    values = details.where("id % 31 = 5").select("id", F.col("id").alias("studyDetailId"))
    after, refused = mutate.cascaded({"study_details": details, "study_result_values": values}, "study_details", details.where("id % 9 = 0"))
    state = lookup.flagged(lookup.flagged(details, refused, "id", "refused"), after["study_details"], "id", "there")
    return state.select("id", F.when(F.col("refused"), "refused").when(F.col("there"), "stays").otherwise("gone").alias("state"))


@query("SELECT id, CASE WHEN confirmed AND id % 2 = 0 THEN 'recepcionista' ELSE rol END AS rol FROM users", "users")
def role_assign(t: Tables) -> DataFrame:
    return mutate.roles_assigned(t.users, t.users.where("id % 2 = 0").select("id", F.lit("recepcionista").alias("rol")))[0].select("id", "rol")


@query("SELECT id, rol FROM users WHERE id % 3 <> 0 OR rol = 'admin'", "users")
def delete_users(t: Tables) -> DataFrame:
    return mutate.users_deleted(t.users, t.users.where("id % 3 = 0")).select("id", "rol")


@query("""WITH gone AS (SELECT id FROM users WHERE id % 3 = 0 AND rol <> 'admin')
SELECT 'users' AS "table", count(*) AS n, sum(id)::BIGINT AS ids FROM users WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'user_sessions', count(*), sum(event_id)::BIGINT FROM access WHERE event_type = 'signup' AND user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'user_login_logs', count(*), sum(CASE WHEN user_id NOT IN (SELECT id FROM gone) THEN user_id END)::BIGINT FROM access WHERE kind = 'login'""", "users", "access")
def delete_users_cascade(t: Tables) -> DataFrame:
    opened = t.access.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("userId"))
    logs = t.access.where("kind = 'login'").select(F.col("event_id").alias("id"), F.col("user_id").alias("userId"))
    after = mutate.users_removed({"users": t.users, "user_sessions": opened, "user_login_logs": logs}, t.users.where("id % 3 = 0"))
    out = [after[n].agg(F.lit(n).alias("table"), F.count("*").alias("n"), F.sum("userId" if n == "user_login_logs" else "id").alias("ids")) for n in after]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("WITH tok AS (SELECT *, concat('k', id % 40) AS token FROM users), f AS (SELECT token, min(id) AS id FROM tok WHERE token IN (SELECT concat('k', n_nationkey) FROM nation) GROUP BY 1) SELECT id, confirmed OR id IN (SELECT id FROM f) AS confirmed, CASE WHEN id NOT IN (SELECT id FROM f) THEN token END AS token FROM tok", "users")
def confirm_accounts(t: Tables) -> DataFrame:
    users = t.users.withColumn("token", F.concat(F.lit("k"), F.col("id") % 40))
    tokens = t.nation.select(F.concat(F.lit("k"), "n_nationkey").alias("token"))
    return mutate.accounts_confirmed(users, tokens).select("id", "confirmed", "token")
