"""A stream of events, whole or in micro-batches, gives the outcomes of the batch folds."""

import pytest
from pyspark.sql import functions as F

from labframe.operators import access
from labframe.plans.tables import table
from labframe.sources import io
from labframe.streaming import processors


def run(spark, events, make, folder, parts):
    for i in range(parts):
        events.where(F.col("part") == i).drop("part").write.parquet(f"{folder}/in", mode="append")
    source = io.read_stream(spark, f"{folder}/in", events.drop("part").schema, maxFilesPerTrigger="100" if parts == 1 else "1")
    query = processors.log_sink(make(source), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.event_id, r.outcome) for r in spark.read.parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("kind", ["access", "reset"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, kind, parts):
    wanted = ["login", "mfa"] if kind == "access" else ["reset_request"]
    events = table(spark, sf_dir, "access").where(F.col("kind").isin(*wanted) & (F.col("user_id") < 12))
    bounds = events.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).agg(F.min("s"), F.max("s") + 1).first()
    part = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - bounds[0]) * parts / (bounds[1] - bounds[0])).cast("int")
    events = events.withColumn("part", part).coalesce(1)
    day = 24 * 60
    if kind == "access":
        batch = access.access_outcomes(events, "user_id", 2 * day, 2 * day)
        got = run(spark, events, lambda s: processors.access_stream(s, "user_id", 2 * day, 2 * day), str(tmp_path), parts)
    else:
        batch = access.reset_outcomes(events, "user_id", 5 * day)
        got = run(spark, events, lambda s: processors.reset_stream(s, "user_id", 5 * day), str(tmp_path), parts)
    assert got == sorted((r.event_id, r.outcome) for r in batch.collect()) and len(got) > 20


def test_repeated_and_late_events(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, "u", "reset_request", True, 0), (1, t0, "u", "reset_request", True, 0), (3, t0 + dt.timedelta(minutes=9), "u", "reset_request", True, 0), (2, t0 + dt.timedelta(minutes=5), "u", "reset_request", True, 1)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, email string, kind string, known boolean, part int").coalesce(1)
    assert run(spark, events, processors.reset_stream, str(tmp_path), 2) == [(1, "SENT"), (2, "LATE"), (3, "SENT")]


def test_a_stream_of_requests_is_checked_against_the_table_of_sessions(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    opens = spark.createDataFrame([("a", 1, t0)], "jti string, user_id bigint, ts timestamp_ntz")
    found = access.sessions(opens, opens.select("jti", "ts").where("false"), opens.select("user_id", "ts").where("false"))
    asks = spark.createDataFrame([(i, "a", t0 + dt.timedelta(minutes=m), i % 2) for i, m in enumerate((5, 15, 16, -1))], "event_id bigint, jti string, ts timestamp_ntz, part int")
    got = run(spark, asks, lambda s: processors.session_stream(s, found).select("event_id", F.col("verdict").alias("outcome")), str(tmp_path), 2)
    assert got == [(0, "OK"), (1, "OK"), (2, "EXPIRED"), (3, "NOT_FOUND")]


def feed(spark, rows):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(minutes=m), "u", kind, jti, part) for i, (m, kind, jti, part) in enumerate(rows)], "event_id bigint, ts timestamp_ntz, user_id string, kind string, jti string, part int").coalesce(1)


def test_a_feed_of_sessions_needs_no_table(spark, tmp_path):
    rows = [(0, "open", "a", 0), (1, "open", "b", 0), (2, "request", "a", 0), (3, "logout", "a", 1), (4, "request", "a", 1), (4, "request", "b", 1), (15, "request", "b", 1), (16, "request", "b", 1), (17, "request", "b", 2)]
    rows += [(18, "open", "c", 2), (18, "request", "c", 2), (19, "logout_all", None, 2), (19, "request", "c", 2), (20, "request", None, 2), (20, "request", "x", 2), (21, "logout", "never", 2), (19, "open", "d", 2), (22, "request", "d", 2)]
    got = dict(run(spark, feed(spark, rows), processors.session_feed, str(tmp_path), 3))
    want = ["OPENED", "OPENED", "OK", "LOGGED_OUT", "REVOKED", "OK", "OK", "OK", "EXPIRED", "OPENED", "OK", "LOGGED_OUT", "REVOKED", "NO_JTI", "NOT_FOUND", "LOGGED_OUT", "OPENED", "REVOKED"]
    assert [got[i] for i in range(len(rows))] == want


def test_late_events_are_put_where_they_belong_and_old_sessions_forgotten(spark, tmp_path):
    late = [(5, "logout", "a", 0), (6, "logout_all", None, 0), (1, "open", "a", 1), (4, "request", "a", 1), (5, "request", "a", 1), (2, "open", "b", 1), (5, "request", "b", 1), (7, "request", "b", 1)]
    got = dict(run(spark, feed(spark, late), processors.session_feed, str(tmp_path / "late"), 2))
    assert [got[i] for i in range(8)] == ["LOGGED_OUT", "LOGGED_OUT", "OPENED", "OK", "REVOKED", "OPENED", "OK", "REVOKED"]
    old = [(0, "open", "a", 0), (60, "request", "a", 0), (5000, "open", "b", 1), (5001, "request", "a", 2), (5002, "request", "b", 2)]
    got = dict(run(spark, feed(spark, old), lambda s: processors.session_feed(s, delay="1 minute", keep=600), str(tmp_path / "old"), 3))
    assert [got[i] for i in range(5)] == ["OPENED", "EXPIRED", "OPENED", "NOT_FOUND", "OK"]


def test_a_stream_lets_a_token_serve_once(spark, tmp_path):
    rows = [(0, "reset_request", "A", 0), (1, "reset_use", "A", 0), (2, "reset_use", "A", 1), (3, "reset_request", "B", 1), (4, "reset_check", "B", 1), (5, "reset_use", "A", 2), (6, "reset_use", "B", 2), (7, "reset_use", "B", 2)]
    events = feed(spark, rows).withColumnsRenamed({"jti": "token", "user_id": "email"}).withColumn("known", F.lit(True))
    got = dict(run(spark, events, processors.flow_stream, str(tmp_path), 3))
    assert [got[i] for i in range(8)] == ["SENT", "DONE", "INVALID", "SENT", "VALID", "INVALID", "DONE", "INVALID"]


def test_feed_takes_events_of_one_time_in_turn(spark, tmp_path):
    """Opened, ended and then asked for, whatever the order of the rows; ids decide last."""
    rows = [(4, 60, "request", "a"), (3, 60, "logout", "a"), (9, 60, "open", "a"), (2, 30, "request", None), (1, 30, "request", "a"), (7, 59, "open", "b"), (8, 60, "request", "b")]
    events = spark.createDataFrame(rows, "event_id bigint, s bigint, kind string, jti string").select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("user_id"), "kind", "jti", F.lit(0).alias("part"))
    got = dict(run(spark, events, lambda e: processors.session_feed(e, 15), tmp_path, 1))
    assert got == {1: "NOT_FOUND", 2: "NO_JTI", 7: "OPENED", 9: "OPENED", 3: "LOGGED_OUT", 4: "REVOKED", 8: "OK"}
