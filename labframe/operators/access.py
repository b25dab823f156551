"""Access events: login lockout, second factor, reset requests, sessions. Batch folds over each key's events in order.

Whether an event counts depends on what earlier ones left behind, so the first three are folds and not windows. Events
are dealt out by key and sorted by (key, time, event id), which spills; one pass then steps a state of a few numbers,
so a key with any number of events costs no memory. Keys with very many events are folded in blocks of time by many
tasks. streaming.processors take the same steps. Times are those of the
events. Sessions and reset tokens need the nearest event of another kind, which are windows over blocks of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labframe.operators import blocks
from labframe.sources.io import stored

#: Real durations in minutes, and attempts.
LOCK, MFA, SESSION, RESET_WINDOW, RESET_TOKEN = 15, 5, 15, 60, 60
TRIES = 3
MINUTE = 60_000_000
#: Blocks of time in which a key's events are looked at together, in microseconds.
BLOCK = 24 * 60 * MINUTE
#: Events of a key from which many tasks fold it.
HOT_EVENTS = blocks.BLOCK_EVENTS


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


#: What the steps read of an event, besides its time.
ACCESS_FIELDS, RESET_FIELDS, FLOW_FIELDS = ("kind", "known", "confirmed", "rol", "ok"), ("kind", "known"), ("kind", "known", "token")


def access_step(state: tuple, t: int, kind: str, known: bool, confirmed: bool, rol: str, ok: bool, lock: int, mfa: int) -> tuple[tuple, str]:
    """One login or mfa event of a user; state: failures, end of the lock, expiry of a pending code, attempts at it."""
    n, until, code, attempts = state
    if kind == "login":
        if not known:
            return state, "UNKNOWN"
        if until is not None and until > t:
            return state, "LOCKED"
        if not confirmed:
            return state, "UNCONFIRMED"
        if not ok:
            return ((n + 1, t + lock, code, attempts), "LOCKED_NOW") if n + 1 >= TRIES else ((n + 1, until, code, attempts), "BAD_PASSWORD")
        if rol == "unassigned":
            return state, "UNASSIGNED"
        return ((n, until, t + mfa, 0), "MFA_SENT") if rol == "admin" else ((0, None, code, attempts), "SUCCESS")
    if not known or rol != "admin":
        return state, "INVALID"
    if code is None:
        return state, "NO_PENDING"
    if code < t:
        return (n, until, None, attempts), "EXPIRED"
    if attempts >= TRIES:
        return (n, until, None, attempts), "TOO_MANY"
    return ((n, until, None, attempts), "SUCCESS") if ok else ((n, until, code, attempts + 1), "WRONG")


def reset_step(state: tuple, t: int, kind: str, known: bool, window: int) -> tuple[tuple, str]:
    """One reset_request or reset_done event of a user; state: requests and start of the window, which the first request opens."""
    n, start = state
    if not known:
        return state, "UNKNOWN"
    if kind == "reset_done":
        return (0, None), "DONE"
    if start is None or t - start > window:
        n, start = 0, t
    return ((n + 1, start), "SENT") if n < TRIES else ((n, start), "THROTTLED")


def flow_step(state: tuple, t: int, kind: str, known: bool, token: str, window: int, life: int) -> tuple[tuple, str]:
    """One reset_request (with the token to send), reset_check or reset_use (with the token shown) of a user.

    State: requests, start of the window, token, its expiry. A request that is sent puts its token in the place of the
    one before; one that is not leaves that alone. A check changes nothing. A valid use takes the token away and opens
    the window anew, so each token serves once.
    """
    n, start, have, until = state
    if kind == "reset_request":
        (n, start), outcome = reset_step((n, start), t, kind, known, window)
        return ((n, start, token, t + life) if outcome == "SENT" else (n, start, have, until)), outcome
    if not known or token is None or have != token or until < t:
        return state, "INVALID"
    return ((0, None, None, None), "DONE") if kind == "reset_use" else (state, "VALID")


def _timed(events: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    return events.select(key, "event_id", micros(F.col("ts")).alias("t"), *fields)


def _folded(rows: DataFrame, key: str, fields: Sequence[str], begin: tuple, step: Callable[..., tuple[tuple, str]]) -> DataFrame:
    """(key, event_id, outcome) of a fold; step(state, t, *fields) gives the new state and the outcome."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, "event_id")}
    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, "t", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, begin
        for batch in batches:
            out = []
            for of, *event in zip(*(batch.column(c).to_pylist() for c in (key, "t", *fields)), strict=True):
                if of != at:
                    at, state = of, begin
                state, outcome = step(state, *event)
                out.append(outcome)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("event_id"), pa.array(out, pa.string())], [key, "event_id", "outcome"])

    return dealt.mapInArrow(fold, f"`{key}` {kinds[key]}, event_id {kinds['event_id']}, outcome string")


def _parted(rows: DataFrame, key: str, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most `hot` events, those of others or None). There are at most one in `hot` rows of such keys."""
    many = stored(rows.groupBy(key).count().where((F.col("count") > hot) & F.col(key).isNotNull()).select(key), "hot_keys")
    if not many.limit(1).count():
        return rows, None
    return rows.join(many, key, "left_anti"), rows.join(many, key, "left_semi")


def access_outcomes(events: DataFrame, key: str = "email", lock: int = LOCK, mfa: int = MFA, hot: int = HOT_EVENTS) -> DataFrame:
    """(key, event_id, outcome) for login and mfa events (event_id, ts, kind, known, confirmed, rol, ok). Expired locks do not reset the count, nor do administrators' logins.

    A key with more than `hot` events is folded by many tasks, see blocks.
    """
    wait, life = lock * MINUTE, mfa * MINUTE
    few, many = _parted(_timed(events, key, ACCESS_FIELDS), key, hot)
    out = _folded(few, key, ACCESS_FIELDS, (0, None, None, 0), lambda s, *e: access_step(s, *e, wait, life))
    if many is None:
        return out

    def rows(c: dict[str, list]) -> list[tuple]:
        return list(zip(*(c[f] for f in ("t", *ACCESS_FIELDS)), strict=True))

    def logins(c: dict[str, list], entries: list) -> dict:
        counts = [(t, not ok) for t, kind, known, confirmed, rol, ok in rows(c) if kind == "login" and known and confirmed and (not ok or rol not in ("admin", "unassigned"))]
        return blocks.login_sum([t for t, _ in counts], [bad for _, bad in counts], wait, TRIES)

    def codes(c: dict[str, list], entries: list) -> dict:
        state, sent, tried = (*entries[0], None, 0), [], []
        for t, kind, known, confirmed, rol, ok in rows(c):
            state, outcome = access_step(state, t, kind, known, confirmed, rol, ok, wait, life)
            if outcome == "MFA_SENT":
                sent.append(t)
            elif kind != "login" and known and rol == "admin" and not sent:
                tried.append((t, ok))
        return blocks.code_sum(sent, tried, state[2:], TRIES)

    def outcomes(c: dict[str, list], entries: list) -> list[str]:
        return _run(rows(c), (*entries[0], *entries[1]), lambda s, *e: access_step(s, *e, wait, life))

    phases = [((0, None), logins, blocks.login_applied), ((None, 0), codes, lambda got, state: blocks.code_applied(got, state, TRIES))]
    return out.unionByName(blocks.in_blocks(blocks.dealt(many, key, hot), key, ACCESS_FIELDS, phases, outcomes))


def _run(events: list[tuple], state: tuple, step: Callable[..., tuple[tuple, str]]) -> list[str]:
    out = []
    for event in events:
        state, outcome = step(state, *event)
        out.append(outcome)
    return out


def reset_outcomes(events: DataFrame, key: str = "email", window: int = RESET_WINDOW, hot: int = HOT_EVENTS) -> DataFrame:
    """(key, event_id, outcome) for reset_request and reset_done events (event_id, ts, kind, known), keys with more than `hot` of them by many tasks."""
    span = window * MINUTE
    few, many = _parted(_timed(events, key, RESET_FIELDS), key, hot)
    out = _folded(few, key, RESET_FIELDS, (0, None), lambda s, *e: reset_step(s, *e, span))
    if many is None:
        return out

    def summed(c: dict[str, list], entries: list) -> dict:
        seen = [(t, kind == "reset_done") for t, kind, known in zip(c["t"], c["kind"], c["known"], strict=True) if known]
        return blocks.window_sum([t for t, _ in seen], [d for _, d in seen], span, TRIES)

    def outcomes(c: dict[str, list], entries: list) -> list[str]:
        return _run(list(zip(c["t"], c["kind"], c["known"], strict=True)), tuple(entries[0]), lambda s, *e: reset_step(s, *e, span))

    phase = ((0, None), summed, lambda got, state: blocks.window_applied(got, state, span, TRIES))
    return out.unionByName(blocks.in_blocks(blocks.dealt(many, key, hot), key, RESET_FIELDS, [phase], outcomes))


def flow_outcomes(requests: DataFrame, uses: DataFrame, key: str = "email", window: int = RESET_WINDOW, life: int = RESET_TOKEN) -> DataFrame:
    """(key, event_id, outcome) of requests (event_id, ts, known, token to send) and uses (event_id, ts, known, token shown, kind: reset_check or reset_use), folded together.

    Whether a request is sent depends on the uses before it and the other way round, so a user's two kinds of events
    are one sequence, by time and event id.
    """
    both = requests.select(key, "event_id", "ts", "known", "token", F.lit("reset_request").alias("kind")).unionByName(uses.select(key, "event_id", "ts", "known", "token", "kind"))
    rows = _timed(both, key, FLOW_FIELDS)
    span, good = window * MINUTE, life * MINUTE
    return _folded(rows, key, FLOW_FIELDS, (0, None, None, None), lambda s, *e: flow_step(s, *e, span, good))


def nearest(asks: DataFrame, values: DataFrame, by: str, to: str, later: bool = False, block: int = BLOCK) -> DataFrame:
    """asks (by, ts, ...) with `to`: the value of the last row of values (by, ts, value) at or before, or of the first at or after if `later`.

    Rows of both meet in blocks of time, so a key with very many events is no single task; what no row of the block
    answers comes from the blocks before, of which only the last value is known.
    """
    sign = -1 if later else 1
    clock = lambda df: df.withColumn("clock_", sign * micros(F.col("ts"))).withColumn("block_", F.floor(F.col("clock_") / block))
    right = clock(values.select(by, "ts", "value")).withColumn("side_", F.lit(0))
    rows = clock(asks).withColumn("side_", F.lit(1)).unionByName(right, allowMissingColumns=True)
    inside = Window.partitionBy(by, "block_").orderBy("clock_", "side_", "value")
    rows = rows.withColumn("own_", F.last("value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("side_ = 1")
    ends = right.groupBy(by, "block_").agg(F.max_by("value", F.struct("clock_", "value")).alias("last_")).unionByName(clock(asks).select(by, "block_").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(by, "block_").agg(F.max("last_").alias("last_"))
    before = Window.partitionBy(by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried_", F.last("last_", ignorenulls=True).over(before)).select(F.col(by).alias("by_"), F.col("block_").alias("at_"), "carried_")
    out = rows.join(ends, F.col(by).eqNullSafe(F.col("by_")) & (F.col("block_") == F.col("at_")))
    return out.select(*asks.columns, F.coalesce("own_", "carried_").alias(to))


def login_log(outcomes: DataFrame) -> DataFrame:
    """Log rows: a refusal names the address, an opened session the user; a sent code and a refused outside login leave none."""
    success = F.col("outcome") == "SUCCESS"
    return outcomes.where("outcome <> 'MFA_SENT'").select("event_id", F.when(success, F.col("user_id")).alias("userId"), F.when(~success, F.col("email")).alias("emailIntent"), success.alias("success"))


def sessions(opens: DataFrame, logouts: DataFrame, all_logouts: DataFrame, minutes: int = SESSION) -> DataFrame:
    """opens (jti, user_id, ts) with expires_at and revoked_at: the first logout of the session or of all the user's sessions since it was opened."""
    since = logouts.select("jti", F.col("ts").alias("out_")).join(opens.select("jti", "ts"), "jti").where("out_ >= ts")
    one = since.groupBy("jti").agg(F.min("out_").alias("one"))
    every = nearest(opens.select("jti", "user_id", "ts"), all_logouts.select("user_id", "ts", F.col("ts").alias("value")), "user_id", "every", later=True)
    out = every.join(one, "jti", "left")
    return out.select("jti", "user_id", F.col("ts").alias("opened_at"), (F.col("ts") + F.expr(f"INTERVAL '{minutes}' MINUTE")).alias("expires_at"), F.least("one", "every").alias("revoked_at"))


def active_at(found: DataFrame, t: Column) -> DataFrame:
    return found.where((F.col("opened_at") <= t) & (F.col("expires_at") >= t) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > t)))


def session_check(requests: DataFrame, found: DataFrame) -> DataFrame:
    """requests (event_id, jti, ts) with the verdict: NO_JTI, NOT_FOUND, REVOKED, EXPIRED or OK, and the user if OK. A session is still good at its very expiry."""
    s = found.select("jti", F.col("user_id").alias("session_user"), "opened_at", "expires_at", "revoked_at")
    out = requests.join(s, "jti", "left")
    verdict = F.when(F.col("jti").isNull(), "NO_JTI").when(F.col("session_user").isNull() | (F.col("opened_at") > F.col("ts")), "NOT_FOUND").when(F.col("revoked_at") <= F.col("ts"), "REVOKED").when(F.col("expires_at") < F.col("ts"), "EXPIRED").otherwise("OK")
    out = out.withColumn("verdict", verdict)
    return out.select(*requests.columns, "verdict", F.when(F.col("verdict") == "OK", F.col("session_user")).alias("session_user"))


def latest_token(uses: DataFrame, issues: DataFrame) -> DataFrame:
    """uses (user_id, ts, ...) with `last`: token and expiry of the user's latest issue (user_id, ts, token, expires_at) before."""
    return nearest(uses, issues.select("user_id", "ts", F.struct("token", "expires_at").alias("value")), "user_id", "last")


def reset_token_check(uses: DataFrame, issues: DataFrame) -> DataFrame:
    """uses (event_id, user_id, token, ts) with `valid`: the token is the user's latest before the use, its expiry is set and not past. Looking changes nothing; flow_outcomes lets a token serve once."""
    out = latest_token(uses, issues)
    return out.withColumn("valid", F.coalesce((F.col("last.token") == F.col("token")) & (F.col("last.expires_at") >= F.col("ts")), F.lit(False))).drop("last")


def authorized(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """requests (route, rol, ...) with `allowed`: a route without roles is open; otherwise the role must be listed, and no role is refused."""
    out = requests.join(routes, "route", "left")
    open_ = F.coalesce(F.size("roles"), F.lit(0)) <= 0
    return out.withColumn("allowed", open_ | F.coalesce(F.array_contains("roles", F.col("rol")), F.lit(False))).drop("roles")
