"""Small hand-made tables: one test for each rule that is easy to get wrong."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labframe.functions import text as fn
from labframe.operators import access, lookup, mutate, orders, results, search, validate
from labframe.sources import io
from labframe.sources.schema import SPECS


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def studies(spark):
    return spark.createDataFrame([(1, "A", 100.0, 90.0, 80.0, 70.0, 60.0, True), (2, "B", 0.125, 1.0, 1.0, 1.0, 1.0, False)], "id bigint, name string, normalPrice double, difPrice double, specialPrice double, hospitalPrice double, otherPrice double, isActive boolean")


def test_price_tiers_and_unlimited_discount(spark, studies):
    items = spark.createDataFrame([(1, 1, "dif", 2.0, 0.0), (1, 1, "odd", 1.0, None), (1, 1, "normal", 1.0, 150.0)], "serviceOrderId bigint, studyId bigint, priceType string, quantity double, discountPercent double")
    got = sorted(float(r.subtotalAmount) for r in orders.priced_lines(items, studies).collect())
    assert got == [-50.0, 100.0, 180.0]


def test_subtotal_adds_unrounded_lines(spark, studies):
    items = spark.createDataFrame([(1, 2, 1, "normal", 1.0, 0.0), (1, 2, 2, "normal", 1.0, 0.0)], "serviceOrderId bigint, studyId bigint, no int, priceType string, quantity double, discountPercent double")
    head = spark.createDataFrame([(1, 0.0)], "id bigint, courtesyPercent double")
    lines = orders.priced_lines(items, studies)
    assert [float(r.subtotalAmount) for r in lines.collect()] == [0.13, 0.13]
    assert float(orders.order_amounts(lines, head, ["no"]).first().subtotalAmount) == 0.25


def test_amounts_that_do_not_fit_are_flagged(spark):
    lines = spark.createDataFrame([(1, 1, 1e8)], "serviceOrderId bigint, no int, line double")
    head = spark.createDataFrame([(1, 0.0)], "id bigint, courtesyPercent double")
    assert orders.order_amounts(lines, head, ["no"]).first().fits is False


def test_courtesy_uses_the_stored_subtotal(spark):
    row = spark.createDataFrame([(1, 10.01, 0.0, 0.0, 10.01), (2, 5.0, 0.0, 0.0, 5.0)], "id bigint, subtotalAmount double, courtesyPercent double, discountAmount double, totalAmount double")
    row = row.withColumns({c: fn.money(F.col(c)) for c in ("discountAmount", "totalAmount", "subtotalAmount")}).withColumn("courtesyPercent", fn.money(F.col("courtesyPercent"), 5))
    patch = spark.createDataFrame([(1, 50.0)], "id bigint, courtesyPercent double")
    assert [(float(r.discountAmount), float(r.totalAmount)) for r in orders.with_courtesy(row, patch).orderBy("id").collect()] == [(5.01, 5.01), (0.0, 5.0)]


def test_an_order_that_lists_a_study_twice_is_refused(spark, studies):
    items = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, 9)], "serviceOrderId bigint, studyId bigint")
    assert values(lookup.study_cardinality(items, studies), "serviceOrderId", "ok") == [(1, False), (2, True), (3, False)]


def test_first_reference_fault(spark):
    people = spark.createDataFrame([(1, True), (2, False)], "id bigint, isActive boolean")
    head = spark.createDataFrame([(1, 1, None), (2, 2, 1), (3, 1, 2), (4, 1, 7), (5, 1, 1)], "id bigint, patientId bigint, doctorId bigint")
    lines = spark.createDataFrame([(1,), (2,), (3,), (4,)], "serviceOrderId bigint")
    got = values(lookup.reference_faults(head, people, people, lines), "id", "fault")
    assert got == [(1, None), (2, "PATIENT"), (3, "DOCTOR"), (4, "DOCTOR"), (5, "NO_ITEMS")]


def test_inactive_rows_hold_their_key_and_null_keys_never_conflict(spark):
    table = spark.createDataFrame([(1, "a", False)], "id bigint, code string, isActive boolean")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None)], "batch_seq bigint, code string")
    assert values(lookup.unique_batch(batch, table, ["code"]), "batch_seq", "fault") == [(1, "TAKEN"), (2, None), (3, "REPEATED"), (4, None), (5, None)]


def test_search_wildcards_backslash_case_and_empty(spark):
    df = spark.createDataFrame([(1, "a%b"), (2, "axb"), (3, "a\\b"), (4, "AxB")], "id bigint, name string")
    ids = lambda q: [i for (i,) in values(df.where(search.contains(q, ["name"])), "id")]
    assert ids("a%b") == [1, 2, 3] and ids("a_b") == [1, 2, 3] and ids("\\") == [3] and ids("") == [1, 2, 3, 4]


def test_range_needs_both_ends_and_includes_the_last_midnight(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (2, dt.datetime(2024, 1, 2, 0, 0, 1))], "id bigint, createdAt timestamp_ntz")
    assert values(df.where(search.between("createdAt", "2024-01-01", "2024-01-02")), "id") == [(1,)]
    assert df.where(search.between("createdAt", "2024-01-03", None)).count() == 2


def test_pages_concatenate_to_the_sorted_table(spark):
    df = spark.range(57).withColumn("name", (F.col("id") % 5).cast("string"))
    whole = [r.id for r in df.orderBy(*search.keys("name")).collect()]
    assert [r.id for n in range(1, 8) for r in search.page(df, search.keys("name"), n, 9).collect()] == whole
    assert [r.id for r in search.all_pages(df, search.keys("name"), 9, 4).orderBy("place").collect()] == whole
    with pytest.raises(ValueError):
        search.page(df, search.keys("name"), -1)
    plan = search.page(df, search.keys("name"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_staff_listing_shows_receptionists_only(spark):
    users = spark.createDataFrame([(1, True, "admin"), (2, True, "recepcionista"), (3, False, "recepcionista")], "id bigint, confirmed boolean, rol string").withColumn("createdAt", F.lit(None).cast("timestamp_ntz"))
    assert values(search.users_by_role(users), "id") == [(2,)]
    assert values(search.users_by_role(users, ("admin", "recepcionista")), "id") == [(1,), (2,)]


def test_a_found_detail_overrides_even_with_null(spark):
    details = spark.createDataFrame([(1, "Glucose", None, "70-100")], "id bigint, name string, unit string, referenceValue string")
    rows = spark.createDataFrame([(1, "own", "mg", None), (9, "own", "mg", "x"), (None, "own", "mg", "y")], "studyDetailId bigint, label string, unit string, referenceValue string")
    assert values(results.snapshot(rows, details), "label", "unit", "referenceValue") == [("Glucose", None, "70-100"), ("own", "mg", "x"), ("own", "mg", "y")]


def test_drafts(spark):
    items = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 1, 1)], "id bigint, serviceOrderId bigint, studyId bigint")
    head = spark.createDataFrame([(1, True), (2, False)], "id bigint, isActive boolean").withColumn("sampleAt", F.lit(None).cast("timestamp_ntz"))
    sheets = spark.createDataFrame([(4, True), (1, False)], "serviceOrderItemId bigint, isActive boolean")
    details = spark.createDataFrame([(1, 1, "b", 2, True), (2, 1, "a", 1, True), (3, 1, "c", 0, False)], "id bigint, studyId bigint, name string, sortOrder int, isActive boolean").withColumns({"unit": F.lit("u"), "referenceValue": F.lit("r")})
    got = {r.serviceOrderItemId: [v.label for v in r["values"]] for r in results.drafts(items, head, sheets, details).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_patches_tell_null_from_absent_and_skip_inactive_rows(spark):
    table = spark.createDataFrame([(1, "a", "x", True), (2, "b", "y", True), (3, "c", "z", False)], "id bigint, name string, note string, isActive boolean")
    patch = spark.createDataFrame([(1, ["note"], None, None), (2, ["name"], "n", None), (3, ["name"], "n", None)], "id bigint, fields array<string>, name string, note string")
    assert values(mutate.patched(table, patch, ["name", "note"]), "id", "name", "note") == [(1, "a", None), (2, "n", "y"), (3, "c", "z")]
    assert values(mutate.patched(table, patch, ["name", "note"], nullable=False), "id", "note") == [(1, "x"), (2, "y"), (3, "z")]
    assert values(mutate.patch_faults(spark.createDataFrame([(1, ["name"], "c", None), (3, ["name"], "q", None), (2, ["name"], "b", None)], patch.schema), table, ["name"]), "id", "fault") == [(1, "TAKEN"), (2, None), (3, "MISSING")]


def test_an_empty_list_of_children_keeps_the_old_ones(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "parent bigint, v string")
    new = spark.createDataFrame([(1, "n")], "parent bigint, v string")
    assert values(mutate.replaced_children(old, new, "parent"), "parent", "v") == [(1, "n"), (2, "b")]


def test_subtrees_end_at_cycles_and_self_parents(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 6), (6, 5), (7, 3)], "id bigint, parentId bigint")
    assert values(mutate.subtree(tree, spark.createDataFrame([(1,), (4,), (5,)], "id bigint")), "id") == [(i,) for i in range(1, 8)]


def test_deletes_cascade_restrict_and_set_null(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "patients": frame([(1,), (2,)], "id bigint"),
        "service_orders": frame([(10, 1, None), (11, 1, None)], "id bigint, patientId bigint, doctorId bigint"),
        "service_order_items": frame([(20, 10), (21, 11)], "id bigint, serviceOrderId bigint"),
        "study_results": frame([(30, 10, 20)], "id bigint, serviceOrderId bigint, serviceOrderItemId bigint"),
        "study_result_values": frame([(40, 30, None)], "id bigint, studyResultId bigint, studyDetailId bigint"),
        "users": frame([(1,), (2,)], "id bigint"),
        "user_sessions": frame([("s", 1)], "id string, userId bigint"),
        "user_login_logs": frame([(1, 1), (2, 2)], "id bigint, userId bigint"),
    }
    after, refused = mutate.cascaded(tables, "patients", frame([(1,), (2,)], "id bigint"))
    assert values(after["patients"], "id") == [(1,)] and values(refused, "id") == [(1,)]
    after, _ = mutate.cascaded(tables, "service_orders", frame([(10,)], "id bigint"))
    assert [values(after[t], "id") for t in ("service_orders", "service_order_items", "study_results", "study_result_values")] == [[(11,)], [(21,)], [], []]
    after, _ = mutate.cascaded(tables, "users", frame([(1,)], "id bigint"))
    assert values(after["user_sessions"], "id") == [] and values(after["user_login_logs"], "id", "userId") == [(1, None), (2, 2)]


MIN = dt.timedelta(minutes=1)
T0 = dt.datetime(2024, 1, 1)


def logins(spark, *rows):
    return spark.createDataFrame([(i, T0 + at * MIN, "u", kind, True, True, rol, ok) for i, (at, kind, rol, ok) in enumerate(rows)], "event_id bigint, ts timestamp_ntz, email string, kind string, known boolean, confirmed boolean, rol string, ok boolean")


def outcomes(df):
    return [r.outcome for r in df.orderBy("event_id").collect()]


CASES = [
    ([(0, "login", "r", False), (1, "login", "r", False), (2, "login", "r", False), (3, "login", "r", True), (17, "login", "r", False), (40, "login", "r", True), (41, "login", "r", False)], ["BAD_PASSWORD", "BAD_PASSWORD", "LOCKED_NOW", "LOCKED", "LOCKED_NOW", "SUCCESS", "BAD_PASSWORD"]),
    ([(0, "login", "admin", False), (1, "login", "admin", False), (2, "login", "admin", True), (3, "login", "admin", False)], ["BAD_PASSWORD", "BAD_PASSWORD", "MFA_SENT", "LOCKED_NOW"]),
    ([(0, "mfa", "admin", True), (1, "login", "admin", True), (2, "mfa", "admin", False), (3, "mfa", "admin", False), (4, "mfa", "admin", False), (5, "mfa", "admin", True), (6, "mfa", "admin", True)], ["NO_PENDING", "MFA_SENT", "WRONG", "WRONG", "WRONG", "TOO_MANY", "NO_PENDING"]),
    ([(0, "login", "admin", True), (6, "mfa", "admin", True), (7, "login", "admin", True), (12, "mfa", "admin", True), (13, "mfa", "r", True)], ["MFA_SENT", "EXPIRED", "MFA_SENT", "SUCCESS", "INVALID"]),
]


@pytest.mark.parametrize(("rows", "want"), CASES)
def test_access_fold(spark, rows, want):
    assert outcomes(access.access_outcomes(logins(spark, *rows))) == want


def test_reset_window_is_anchored_at_the_first_request(spark):
    df = spark.createDataFrame([(i, T0 + at * MIN, "u", kind, True) for i, (at, kind) in enumerate([(0, "reset_request"), (10, "reset_request"), (20, "reset_request"), (60, "reset_request"), (61, "reset_request"), (62, "reset_done"), (63, "reset_request")])], "event_id bigint, ts timestamp_ntz, email string, kind string, known boolean")
    assert outcomes(access.reset_outcomes(df)) == ["SENT", "SENT", "SENT", "THROTTLED", "SENT", "DONE", "SENT"]


def test_sessions_are_good_at_their_very_expiry(spark):
    opens = spark.createDataFrame([("a", 1, T0), ("b", 1, T0)], "jti string, user_id bigint, ts timestamp_ntz")
    outs = spark.createDataFrame([("b", T0 + 5 * MIN)], "jti string, ts timestamp_ntz")
    none = spark.createDataFrame([], "user_id bigint, ts timestamp_ntz")
    found = access.sessions(opens, outs, none)
    asks = spark.createDataFrame([(1, "a", T0 + 15 * MIN), (2, "a", T0 + 16 * MIN), (3, "b", T0 + 4 * MIN), (4, "b", T0 + 5 * MIN), (5, None, T0), (6, "x", T0)], "event_id bigint, jti string, ts timestamp_ntz")
    assert values(access.session_check(asks, found), "event_id", "verdict") == [(1, "OK"), (2, "EXPIRED"), (3, "OK"), (4, "REVOKED"), (5, "NO_JTI"), (6, "NOT_FOUND")]


def test_names_and_urls(spark):
    df = spark.createDataFrame([("a & b",), (" Ácido\t Úrico ",), (None,), ("x y",)], "s string")
    assert [r[0] for r in df.select(fn.name_key(F.col("s"))).collect()] == ["a  b", "acido urico", "", "x y"]
    urls = spark.createDataFrame([("h/upload/v12/dir/a.b.png",), ("h/upload/x",), ("h/upload/",), ("h/other",), ("h/upload/a.png/upload/b",)], "s string")
    assert [r[0] for r in urls.select(fn.url_asset_id(F.col("s"))).collect()] == ["dir/a.b", "x", None, None, "a"]
    assert spark.range(1).select(fn.iso_time(F.lit("2025"))).first()[0] is None


def test_validation_collects_all_faults_with_paths(spark):
    df = spark.createDataFrame([("ab", "x", [("0", None), ("2", "no")]), ("abc", "1", None)], "name string, n string, items array<struct<quantity:string,priceType:string>>")
    rules = [validate.text("name", 3), validate.integer("n"), validate.required("name"), validate.Each("items", (validate.number("quantity", 1), validate.one_of("priceType", ["normal"])), least=1)]
    got = [[e.field for e in r.errors] for r in validate.validated(df, rules).collect()]
    assert got == [["name", "n", "items.0.quantity", "items.1.priceType"], ["items"]]
    good, bad = validate.split(validate.validated(df, validate.partial(rules)))
    assert good.count() == 1 and bad.count() == 1
    assert validate.validated(spark.createDataFrame([("123456\n",)], "c string"), [validate.code6("c")]).first().errors
    assert [r.field for r in validate.storage_rules(SPECS["patients"])][:2] == ["firstName", "lastName"]


def test_json_keeps_explicit_nulls_apart(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([('{"a": null, "z": 1}',), ('{"a": "x"}',), ("{}",)], "j string")
    got = io.parsed(df, "j", T.StructType.fromDDL("a INT")).collect()
    assert [(r.record.a, r.present) for r in got] == [(None, ["a", "z"]), ("x", ["a"]), (None, [])]


def test_tables_batches_and_defaults(spark, tmp_path):
    batch = spark.createDataFrame([(1, "n", "c", None)], "id bigint, name string, code string, type string")
    row = io.with_defaults(batch, SPECS["studies"], F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert (row.type, row.durationMinutes, row.isActive) == ("study", 60, True)
    io.appended(batch, str(tmp_path / "t"), "1")
    io.appended(batch, str(tmp_path / "t"), "1")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert lookup.numbered(spark.range(5).withColumnRenamed("id", "k"), 10, [F.col("k")], 2).agg(F.min("id"), F.max("id")).first() == (11, 15)


def test_courtesy_divides_the_percentage_first(spark):
    row = spark.createDataFrame([(0.70, 5.0)], "s double, c double").select(fn.money(orders.courtesy(F.col("s"), F.col("c"))).cast("double").alias("d")).first()
    assert row.d == 0.03


def test_a_user_with_very_many_events_is_folded_in_one_pass(spark):
    n = 200_000
    events = spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS ts", "'u' AS email", "'login' AS kind", "true AS known", "true AS confirmed", "'r' AS rol", "id % 4 = 0 AS ok")
    got = {r.outcome: r["count"] for r in access.access_outcomes(events).groupBy("outcome").count().collect()}
    # an event a minute: each 48 of them are a success, three failures of which the last locks, and two locks that end at a failure
    want = ["SUCCESS", "BAD_PASSWORD", "BAD_PASSWORD", "LOCKED_NOW", *["LOCKED"] * 14, "LOCKED_NOW", *["LOCKED"] * 14, "LOCKED_NOW", *["LOCKED"] * 14]
    assert got == Counter(want[i % 48] for i in range(n))
    asks = events.select("event_id", F.col("email").alias("user_id"), "ts")
    values = asks.where("event_id % 1000 = 7").select("user_id", "ts", F.col("event_id").alias("value"))
    last = access.nearest(asks, values, "user_id", "last", block=10 * 60 * 1_000_000)
    assert last.where("NOT (last <=> CASE WHEN event_id >= 7 THEN (event_id - 7) div 1000 * 1000 + 7 END)").count() == 0
    later = access.nearest(asks, values, "user_id", "next", later=True, block=10 * 60 * 1_000_000)
    assert later.where(f"NOT (next <=> CASE WHEN event_id <= {n - 993} THEN (event_id + 992) div 1000 * 1000 + 7 END)").count() == 0


def test_only_the_least_other_holder_conflicts(spark):
    table = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id bigint, k string")
    changes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (9, "b"), (9, "c")], "id bigint, k string")
    assert values(lookup.conflicts(changes, table, ["k"]), "id", "k", "other") == [(1, "a", 2), (2, "a", 1), (3, "a", 1), (9, "b", 4)]
