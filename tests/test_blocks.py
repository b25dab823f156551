"""Folds by blocks against plain loops over a key's events, for any cuts and any state at the cuts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from labframe.operators import access, blocks
from labframe.operators.access import MINUTE, TRIES

T0 = dt.datetime(2024, 1, 1)


def looped(rows, begin, step):
    state, out = begin, []
    for row in rows:
        state, outcome = step(state, *row)
        out.append(outcome)
    return state, out


def cut(rows, r):
    at = sorted({0, len(rows), *(r.randrange(len(rows) + 1) for _ in range(6))})
    return [rows[a:b] for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("seed", range(60))
def test_sums_of_logins_and_codes_give_the_state_of_the_loop(seed):
    r = random.Random(seed)
    lock, life, gap = r.choice([3, 10, 40]), r.choice([2, 8]), r.choice([1, 3, 12])
    t, rows = 0, []
    for _ in range(120):
        t += r.randrange(gap)
        rows.append((t, r.choice(["login", "login", "mfa"]), r.random() < 0.9, r.random() < 0.9, r.choice(["r", "admin", "unassigned"]), r.random() < r.choice([0.2, 0.6])))
    step = lambda s, *e: access.access_step(s, *e, lock, life)
    login, code, whole = (0, None), (None, 0), (0, None, None, 0)
    for part in cut(rows, r):
        counts = [(x[0], not x[5]) for x in part if x[1] == "login" and x[2] and x[3] and (not x[5] or x[4] == "r")]
        got = blocks.login_sum([x for x, _ in counts], [b for _, b in counts], lock, TRIES)
        state, outcomes = looped(part, (*login, None, 0), step)
        sent = [x[0] for x, o in zip(part, outcomes, strict=True) if o == "MFA_SENT"]
        first = outcomes.index("MFA_SENT") if sent else len(part)
        tried = [(x[0], x[5]) for x in part[:first] if x[1] == "mfa" and x[2] and x[4] == "admin"]
        codes = blocks.code_sum(sent, tried, state[2:], TRIES)
        _, mine = looped(part, (*login, *code), step)
        whole, want = looped(part, whole, step)
        assert mine == want
        login, code = blocks.login_applied(got, login), blocks.code_applied(codes, code, TRIES)
        assert min(login[0], TRIES - 1) == min(whole[0], TRIES - 1) and code[0] == whole[2] and (code[0] is None or code[1] == whole[3])


@pytest.mark.parametrize("seed", range(60))
def test_sums_of_request_windows_give_the_state_of_the_loop(seed):
    r = random.Random(seed)
    window, gap = r.choice([2, 9, 50]), r.choice([1, 3, 12])
    t, rows = 0, []
    for _ in range(100):
        t += r.randrange(gap)
        rows.append((t, "reset_done" if r.random() < 0.15 else "reset_request", True))
    step = lambda s, *e: access.reset_step(s, *e, window)
    state = whole = (0, None)
    for part in cut(rows, r):
        got = blocks.window_sum([x[0] for x in part], [x[1] == "reset_done" for x in part], window, TRIES)
        whole, _ = looped(part, whole, step)
        state = tuple(blocks.window_applied(got, state, window, TRIES))
        assert state == whole


def many(spark, n, key="'u'"):
    return spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 7 % 13 + id * 20) AS ts", f"{key} AS email", "CASE WHEN id % 11 = 3 THEN 'mfa' ELSE 'login' END AS kind", "id % 17 > 0 AS known", "id % 19 > 0 AS confirmed", "CASE id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'unassigned' ELSE 'r' END AS rol", "id % 3 = 0 AS ok")


def test_a_million_events_of_one_user_are_folded_by_many_tasks(spark):
    """The same rows as by one task, from blocks that are all small."""
    events = many(spark, 1_000_000)
    dealt = blocks.dealt(access._timed(events, "email", access.ACCESS_FIELDS), "email")
    sizes = [x["count"] for x in dealt.groupBy("block").count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 2 * blocks.BLOCK_EVENTS
    one, parts = access.access_outcomes(events, hot=10**9), access.access_outcomes(events)
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("event_id", "outcome").cast("decimal(20,0)"))).first()
    assert total(one) == total(parts)


def test_small_blocks_need_no_more_tasks(spark):
    """Blocks keep their bound and follow the order of the events, cut from a few sorted partitions."""
    events = many(spark, 20_000, "concat('u', id % 3)")
    dealt = blocks.dealt(access._timed(events, "email", access.ACCESS_FIELDS), "email", 40, 5000)
    assert dealt.select(F.input_file_name()).distinct().count() <= 4
    found = dealt.groupBy("block").agg(F.count("*").alias("n"), F.min(F.struct("email", "t", "event_id")).alias("low"), F.max(F.struct("email", "t", "event_id")).alias("high")).orderBy("block").collect()
    assert max(x.n for x in found) == 40 and sum(x.n for x in found) == 20_000
    assert all(tuple(a.high) < tuple(b.low) for a, b in zip(found, found[1:], strict=False))


def test_keys_with_few_and_many_events_and_none(spark):
    events = many(spark, 3000, "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN concat('u', id % 50) END")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(access.access_outcomes(events, hot=200)) == rows(access.access_outcomes(events))
    resets = events.withColumn("kind", F.when(F.col("kind") == "mfa", "reset_done").otherwise("reset_request"))
    assert rows(access.reset_outcomes(resets, hot=200)) == rows(access.reset_outcomes(resets))
    assert access.access_outcomes(events.where("false"), hot=1).count() == 0


def test_a_token_serves_once(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    requests = spark.createDataFrame([(1, at(0), "u", True, "A"), (2, at(5), "u", True, "B"), (3, at(30), "u", True, "C"), (4, at(31), "u", True, "D"), (5, at(32), "u", True, "E"), (6, at(33), "u", True, "F")], "event_id bigint, ts timestamp_ntz, email string, known boolean, token string")
    shown = [(11, 1, "A", "use"), (12, 6, "A", "use"), (13, 10, "B", "check"), (14, 12, "B", "use"), (15, 20, "B", "use"), (16, 30, "C", "check"), (17, 34, "E", "use"), (18, 35, "F", "use")]
    uses = spark.createDataFrame([(i, at(m), "u", True, tok, f"reset_{kind}") for i, m, tok, kind in shown] + [(19, at(99), "u", True, None, "reset_use"), (20, at(99), "v", False, "A", "reset_use")], "event_id bigint, ts timestamp_ntz, email string, known boolean, token string, kind string")
    got = {x.event_id: x.outcome for x in access.flow_outcomes(requests, uses).collect()}
    # A is used, then gone; B is looked at and used once; after a use the window is new, so C, D and E are sent and F is not, and E stays good
    assert [got[i] for i in range(1, 7)] == ["SENT", "SENT", "SENT", "SENT", "SENT", "THROTTLED"]
    assert [got[i] for i in range(11, 21)] == ["DONE", "INVALID", "VALID", "DONE", "INVALID", "VALID", "DONE", "INVALID", "INVALID", "INVALID"]
    late = spark.createDataFrame([(1, at(0), "u", True, "A")], requests.schema)
    asks = spark.createDataFrame([(2, at(60), "u", True, "A", "reset_check"), (3, at(61), "u", True, "A", "reset_use")], uses.schema)
    assert {x.event_id: x.outcome for x in access.flow_outcomes(late, asks).collect()} == {1: "SENT", 2: "VALID", 3: "INVALID"}
