"""Lab tables derived from the driver's tables; the same expressions feed Spark and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (driver table, expressions that both engines read alike).
DERIVED: dict[str, tuple[str, str]] = {
    "patients": ("customer", "c_custkey AS id, c_name AS firstName, c_mktsegment AS documentType, c_custkey AS documentNumber, c_nationkey AS nation, c_acctbal AS balance, c_custkey % 10 <> 0 AS isActive"),
    "doctors": ("supplier", "s_suppkey AS id, s_name AS firstName, s_nationkey AS licenseNumber, s_suppkey % 7 <> 0 AS isActive"),
    "studies": ("part", "p_partkey AS id, p_name AS name, p_type AS type, concat(p_brand, '-', p_partkey) AS code, p_retailprice AS normalPrice, p_retailprice * 0.9e0 AS difPrice, p_retailprice * 0.8e0 AS specialPrice, p_retailprice * 0.7e0 AS hospitalPrice, p_retailprice * 0.5e0 AS otherPrice, p_size <> 50 AS isActive"),
    "study_details": ("part", "p_partkey AS id, p_partkey % 200 AS studyId, CASE WHEN p_partkey > 200 THEN p_partkey - 200 END AS parentId, p_name AS name, p_size AS sortOrder, p_brand AS unit, p_type AS referenceValue, p_partkey % 11 <> 0 AS isActive"),
    "service_orders": ("orders", "o_orderkey AS id, concat('F-', o_orderkey) AS folio, o_custkey AS patientId, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 120 END AS doctorId, o_orderstatus AS status, o_orderdate AS createdAt, o_orderdate AS sampleAt, CAST(substr(o_orderpriority, 1, 1) AS INT) * 5e0 AS courtesyPercent, o_totalprice AS subtotalAmount, o_orderkey % 9 <> 0 AS isActive"),
    "items": ("lineitem", "l_orderkey AS serviceOrderId, l_partkey AS studyId, l_linenumber AS lineNo, l_suppkey AS supplier, l_quantity AS quantity, l_discount * 100e0 AS discountPercent, l_extendedprice AS extended, CASE l_linenumber % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'dif' WHEN 2 THEN 'special' WHEN 3 THEN 'hospital' ELSE 'other' END AS priceType"),
    "sheet_items": ("lineitem", "l_orderkey * 10 + l_linenumber AS id, min(l_orderkey) AS serviceOrderId, min(l_partkey) AS studyId, min(l_quantity) AS quantity"),
    "users": ("events", "user_id AS id, concat('u', user_id, '@lab.example') AS email, user_id % 7 <> 0 AS confirmed, CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'unassigned' ELSE 'recepcionista' END AS rol, min(ts) AS createdAt"),
    "access": ("events", "event_id, ts, user_id, user_id % 11 <> 0 AS known, user_id % 7 <> 0 AS confirmed, CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'unassigned' ELSE 'recepcionista' END AS rol, CASE WHEN event_type IN ('error', 'signup') THEN 'login' WHEN event_type = 'click' THEN 'mfa' WHEN event_type = 'purchase' THEN 'reset_request' ELSE 'request' END AS kind, CASE WHEN event_type = 'click' THEN event_id % 3 = 0 ELSE event_type = 'signup' END AS ok, event_type"),
}
GROUPED = {"sheet_items": "l_orderkey * 10 + l_linenumber", "users": "user_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return derived(spark.read.parquet(f"{sf_dir}/{DERIVED[name][0]}.parquet"), name)


def derived(df: DataFrame, name: str) -> DataFrame:
    """The derived table of that name from the rows of the driver's, which may be a stream."""
    exprs = split(DERIVED[name][1])
    if name in GROUPED:
        aggregates = [e for e in exprs if e.startswith("min(")]
        df = df.groupBy(F.expr(GROUPED[name]).alias("group_")).agg(*map(F.expr, aggregates)) if name != "users" else df.groupBy("user_id").agg(*map(F.expr, aggregates))
        rest = [e for e in exprs if not e.startswith("min(")]
        names = [e.rpartition(" AS ")[2] for e in aggregates]
        return df.selectExpr(*(("group_ AS id",) if name != "users" else rest), *names)
    return df.selectExpr(*exprs)


def split(text: str) -> list[str]:
    """Expressions at commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def with_tables(sql: str, *names: str) -> str:
    """The SQL with the named derived tables in front."""
    parts = [f"{n} AS (SELECT {DERIVED[n][1]} FROM {DERIVED[n][0]}" + (f" GROUP BY {GROUPED[n]}" if n in GROUPED else "") + ")" for n in names]
    recursive, body = sql.lstrip().startswith("WITH RECURSIVE"), sql.lstrip()
    if body.startswith("WITH"):
        body = body.removeprefix("WITH RECURSIVE" if recursive else "WITH").lstrip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}, {body}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
