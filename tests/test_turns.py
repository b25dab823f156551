"""Batches with several rows for one id against plain loops that take one after the other; trees against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from labframe.operators import mutate, orders, tree
from labframe.operators.mutate import ORDER_FIELDS
from labframe.sources import io


def test_order_patches_one_after_the_other(spark):
    r = random.Random(5)
    active = {i: i % 2 == 0 for i in range(6)}
    rows = [(i, r.randrange(6), r.choice([None, *range(6)]), i % 9 > 0) for i in range(300)]
    patches = [(s, i, r.choice([None, *range(6)]), r.choice([None, None, *range(6)])) for i in range(300) for s in range(r.randrange(6))]
    state, faults = {i: [p, d] for i, p, d, _ in rows}, {}
    there = {i: on for i, _, _, on in rows}
    for s, i, p, d in sorted(patches):
        now = state[i]
        fault = "MISSING" if not there[i] else "PATIENT" if p is not None and p != now[0] and not active[p] else "DOCTOR" if d is not None and d != now[1] and not active[d] else None
        if not fault:
            state[i] = [now[0] if p is None else p, now[1] if d is None else d]
        faults[i, s] = fault
    ddl = ", ".join(f"{c} string" for c in ORDER_FIELDS if c not in ("patientId", "doctorId", "courtesyPercent"))
    table = spark.createDataFrame([(*x, *[None] * 6, 10.0, 0.0) for x in rows], f"id bigint, patientId bigint, doctorId bigint, isActive boolean, {ddl}, subtotalAmount double, courtesyPercent double").withColumns({c: F.lit(0.0) for c in ("discountAmount", "totalAmount")})
    batch = spark.createDataFrame([(*x, ["patientId", "doctorId"]) for x in patches], "batch_seq int, id bigint, patientId bigint, doctorId bigint, fields array<string>")
    people = spark.createDataFrame(list(active.items()), "id bigint, isActive boolean")
    out, judged = mutate.orders_patched(table, batch, people, people)
    assert {(x.id, x.batch_seq): x.fault for x in judged.collect()} == faults and {"PATIENT", "DOCTOR", None} <= set(faults.values())
    assert {x.id: [x.patientId, x.doctorId] for x in out.collect()} == state


def test_a_batch_without_an_order_has_one_patch_an_id(spark):
    table = spark.createDataFrame([(1, "a", True)], "id bigint, name string, isActive boolean")
    twice = spark.createDataFrame([(1, ["name"], "b"), (1, ["name"], "c")], "id bigint, fields array<string>, name string")
    with pytest.raises(Exception, match="batch_seq"):
        mutate.patched(table, twice, ["name"]).collect()
    turns = twice.withColumn("batch_seq", F.when(F.col("name") == "b", 2).otherwise(1))
    assert [(x.id, x.name) for x in mutate.patched(table, turns, ["name"]).collect()] == [(1, "b")]
    money = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 10.0)], "id bigint, subtotalAmount double, courtesyPercent double, discountAmount double, totalAmount double").withColumns({c: F.col(c).cast("decimal(10,2)") for c in ("discountAmount", "totalAmount", "courtesyPercent")})
    courtesies = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (1, None, 3)], "id bigint, courtesyPercent double, batch_seq int")
    assert [float(x.totalAmount) for x in orders.with_courtesy(money, courtesies).collect()] == [8.0]


def test_a_key_that_two_patches_set(spark):
    table = spark.createDataFrame([(i, f"k{i}", True) for i in range(4)], "id bigint, code string, isActive boolean")
    batch = spark.createDataFrame([(2, 0, "new"), (1, 1, "new"), (3, 2, "k3"), (4, 3, None)], "batch_seq int, id bigint, code string").withColumn("fields", F.array(F.lit("code")))
    assert {x.id: x.fault for x in mutate.patch_faults(batch, table, ["code"]).collect()} == {0: "REPEATED", 1: None, 2: "TAKEN", 3: None}


def walk(links, marks, up):
    parents, out = dict(links), set()
    for node in parents:
        path, at = [], node
        while at is not None and at in parents and at not in path:
            path.append(at)
            at = parents[at]
        for i, x in enumerate(path):
            if x in marks:
                out |= set(path[i:]) if up else set(path[: i + 1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rows_above_and_below(spark, seed):
    r = random.Random(seed)
    links = [(i, r.choice([None, r.randrange(80), i, 999])) for i in range(80)]  # cycles, self-parents, parents that are not there
    marks = {i for i in range(80) if r.random() < 0.05} | {500}
    table, marked = spark.createDataFrame(links, "id bigint, parentId bigint"), spark.createDataFrame([(m,) for m in marks], "id bigint")
    for up, f in ((False, tree.below), (True, tree.above)):
        assert sorted(x.id for x in f(table, marked).collect()) == sorted(walk(links, marks, up))
    assert tree.below(table.where("false"), marked).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(tree, "stored", lambda df, name: rounds.append(name) or io.stored(df, name))
    chain = spark.range(10_000).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parentId")
    last, first = chain.where("id = 9999"), chain.where("id = 0")
    assert tree.below(chain, first).count() == 10_000 and len(rounds) < 20
    assert tree.above(chain, last).count() == 10_000 and len(rounds) < 40
    assert tree.below(chain, last).count() == 1


def test_a_restricted_descendant_refuses_the_root_alone(spark):
    frame = spark.createDataFrame
    tables = {"study_details": frame([(1, None), (2, 1), (3, 2), (4, 1), (5, None)], "id bigint, parentId bigint"), "study_result_values": frame([(9, 3)], "id bigint, studyDetailId bigint")}
    after, refused = mutate.cascaded(tables, "study_details", frame([(1,), (4,), (5,)], "id bigint"))
    assert [x.id for x in refused.collect()] == [1] and sorted(x.id for x in after["study_details"].collect()) == [1, 2, 3]
    assert after["study_result_values"].count() == 1
    # through a cascading table above: a study goes with its details, unless one of these is referred to
    tables |= {"studies": frame([(7,), (8,)], "id bigint"), "study_details": tables["study_details"].withColumn("studyId", F.when(F.col("id") == 5, 8).otherwise(7))}
    after, refused = mutate.cascaded(tables, "studies", frame([(7,), (8,)], "id bigint"))
    assert [x.id for x in refused.collect()] == [7] and [x.id for x in after["studies"].collect()] == [7] and after["study_details"].count() == 4


def test_a_batch_meets_a_bucketed_key_table_where_it_lies(spark):
    """Only the batch is dealt out, whatever Spark would broadcast."""
    from labframe.operators import lookup

    table, name = spark.range(1000).selectExpr("id", "concat('k', id) AS code"), "keys_of_a_test"
    keys = lookup.key_table(table, ["code"], name, 4)
    keys = lookup.key_table_grown(spark.createDataFrame([("x",), ("k5",)], "code string"), ["code"], name, 4)
    batch = spark.createDataFrame([(1, "k7"), (2, "new"), (3, "new"), (4, None), (5, "x"), (6, "k5")], "batch_seq bigint, code string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup.unique_batch(batch, keys, ["code"])
        assert {r.batch_seq: r.fault for r in out.collect()} == {1: "TAKEN", 2: None, 3: "REPEATED", 4: None, 5: "TAKEN", 6: "TAKEN"}
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scan = next(i for i, line in enumerate(plan.split("\n")) if "Scan parquet" in line)
        above = plan.split("\n")[:scan]
        depth = len(plan.split("\n")[scan]) - len(plan.split("\n")[scan].lstrip(" :+-*("))
        parents = []
        for line in reversed(above):
            at = len(line) - len(line.lstrip(" :+-*("))
            if at < depth:
                parents.append(line)
                depth = at
        join = next(i for i, line in enumerate(parents) if "Join" in line)
        assert not [line for line in parents[:join] if "Exchange" in line], plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_patches_of_results_are_judged_once_and_not_sent_to_the_driver(spark, sf_dir, monkeypatch):
    """However many of the three tables are read, the sheets are not grouped again; sides with many rows are merged."""
    from labframe.operators import results
    from labframe.plans import catalogue

    monkeypatch.setattr(results, "MANY_ROWS", 0)
    for name in ("result_patch_values", "result_patch_in_turn"):
        plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" not in plan and "BroadcastHashJoin" not in plan


def test_values_without_a_detail_are_dealt_to_all_tasks(spark, monkeypatch):
    """A merge by the detail alone would bring them all into one task, as null is their only key."""
    from labframe.operators import results

    monkeypatch.setattr(results, "MANY_ROWS", 0)
    details = spark.range(20).selectExpr("id", "concat('d', id) AS name", "CAST(NULL AS STRING) AS unit", "'1-2' AS referenceValue")
    rows = spark.range(4000).selectExpr("id AS studyResultId", "CASE WHEN id % 10 = 0 THEN id % 40 END AS studyDetailId", "'own' AS label", "'g' AS unit", "CAST(NULL AS STRING) AS referenceValue")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        out = results.snapshot(rows, details)
        tasks = [r["count"] for r in out.where("studyDetailId IS NULL").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 3600 and len(tasks) == 4 and max(tasks) < 1200
        found = lambda i: i % 10 == 0 and i % 40 < 20
        want = {(i, i % 40 if i % 10 == 0 else None, f"d{i % 40}" if found(i) else "own", None if found(i) else "g", "1-2" if found(i) else None) for i in range(4000)}
        got = out.select("studyResultId", "studyDetailId", "label", "unit", "referenceValue").collect()
        assert len(got) == 4000 and set(map(tuple, got)) == want
    finally:
        spark.conf.set(setting, before)
