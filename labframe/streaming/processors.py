"""Streaming forms of the access folds: only a key's state is kept, however many events it has.

Each processor takes the events of a key in a micro-batch in the order (time, event id), steps the state and gives an
outcome for each. Events older than the last one folded come out as LATE and change nothing. Events are made unique by
id within the watermark before the fold, so a source may repeat them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.operators.access import ACCESS_FIELDS, FLOW_FIELDS, LOCK, MFA, MINUTE, RESET_FIELDS, RESET_TOKEN, RESET_WINDOW, SESSION, access_step, flow_step, reset_step, session_check

OUT = "event_id bigint, outcome string"
ACCESS_STATE = "n int, lock bigint, code bigint, attempts int, last bigint"
RESET_STATE = "n int, start bigint, last bigint"
FLOW_STATE = "n int, start bigint, token string, expires bigint, last bigint"


def _stateful(events: DataFrame, key: str, fields: tuple[str, ...], schema: str, begin: tuple, step, delay: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    rows = rows.select(key, "event_id", F.unix_micros("ts").alias("t"), *fields)

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *now, last = state.get if state.exists else (*begin, None)
        now = tuple(now)
        out = []
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        for number, *event in zip(*(rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in ("event_id", "t", *fields)), strict=True):
            if last is not None and event[0] < last:
                out.append((group[0], number, "LATE"))
                continue
            now, outcome = step(now, *event)
            last = int(event[0])
            out.append((group[0], number, outcome))
        state.update((*(int(x) if isinstance(x, (int, np.integer)) else x for x in now), last))
        yield pd.DataFrame(out, columns=[key, "event_id", "outcome"])

    return rows.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, {OUT}", schema, "append", "NoTimeout")


def access_stream(events: DataFrame, key: str = "email", lock: int = LOCK, mfa: int = MFA, delay: str = "1 day") -> DataFrame:
    """Outcomes of a stream of login and mfa events (event_id, ts, kind, known, confirmed, rol, ok)."""
    return _stateful(events, key, ACCESS_FIELDS, ACCESS_STATE, (0, None, None, 0), lambda s, *e: access_step(s, *e, lock * MINUTE, mfa * MINUTE), delay)


def reset_stream(events: DataFrame, key: str = "email", window: int = RESET_WINDOW, delay: str = "1 day") -> DataFrame:
    """Outcomes of a stream of reset_request and reset_done events (event_id, ts, kind, known)."""
    return _stateful(events, key, RESET_FIELDS, RESET_STATE, (0, None), lambda s, *e: reset_step(s, *e, window * MINUTE), delay)


def flow_stream(events: DataFrame, key: str = "email", window: int = RESET_WINDOW, life: int = RESET_TOKEN, delay: str = "1 day") -> DataFrame:
    """Outcomes of a stream of reset_request, reset_check and reset_use events (event_id, ts, kind, known, token): each token serves once."""
    return _stateful(events, key, FLOW_FIELDS, FLOW_STATE, (0, None, None, None), lambda s, *e: flow_step(s, *e, window * MINUTE, life * MINUTE), delay)


def session_stream(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Verdicts of a stream of requests against the sessions of a table: a stream-static join, without state."""
    return session_check(requests, sessions)


SESSION_STATE = "jti array<string>, opened array<bigint>, revoked array<bigint>, logouts array<bigint>"
#: Of events at the same time: a session is there, then ended, then asked for.
TURN = {"open": 0, "logout": 1, "logout_all": 1, "request": 2}


class Sessions:
    """One user's sessions: when each was opened and, if it was, ended; and the user's late logouts from everywhere."""

    def __init__(self, jti: Iterable[str] = (), opened: Iterable[int | None] = (), revoked: Iterable[int | None] = (), logouts: Iterable[int] = ()):
        self.known = {j: [o, r] for j, o, r in zip(jti, opened, revoked, strict=True)}
        self.logouts = list(logouts)

    def step(self, t: int, kind: str, jti: str | None, life: int) -> str:
        if kind == "logout_all":
            self.logouts.append(t)
            for one in self.known.values():
                if one[0] is not None and one[0] <= t and (one[1] is None or t < one[1]):
                    one[1] = t
            return "LOGGED_OUT"
        if jti is None:
            return "NO_JTI"
        found = self.known.get(jti)
        if kind == "request":
            if found is None or found[0] is None or found[0] > t:
                return "NOT_FOUND"
            if found[1] is not None and found[1] <= t:
                return "REVOKED"
            return "EXPIRED" if found[0] + life < t else "OK"
        if kind == "logout":
            # of a session that is not there yet the end is kept until it opens
            found = self.known.setdefault(jti, [None, None])
            if (found[0] is None or found[0] <= t) and (found[1] is None or t < found[1]):
                found[1] = t
            return "LOGGED_OUT"
        later = [x for x in (found[1] if found else None, *self.logouts) if x is not None and x >= t]
        self.known[jti] = [t, min(later, default=None)]
        return "OPENED"

    def pruned(self, before: int, life: int) -> None:
        """Forgets sessions that ended, and logouts, before this time."""
        end = lambda one: one[1] if one[0] is None else one[0] + life
        self.known = {j: one for j, one in self.known.items() if end(one) >= before}
        self.logouts = [x for x in self.logouts if x >= before]

    def state(self) -> tuple[list, list, list, list]:
        return list(self.known), [o for o, _ in self.known.values()], [r for _, r in self.known.values()], self.logouts


def session_feed(events: DataFrame, minutes: int = SESSION, delay: str = "1 day", keep: int = 7 * 24 * 60) -> DataFrame:
    """(user_id, event_id, outcome) of a stream of opens, logouts (of one session), logout_alls and requests (event_id, ts, user_id, kind, jti).

    All of a user's events are one sequence, so the state of a session needs no table: a request gets the verdict of
    session_check over what has arrived by then, opens and logouts that come late are put where they belong. Sessions
    are forgotten `keep` minutes of the watermark after they expire; requests for them are NOT_FOUND then, not EXPIRED.
    """
    kind = events.schema["user_id"].dataType.simpleString()
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    rows = rows.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("t"), "kind", "jti")
    life = minutes * MINUTE

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Sessions(*state.get) if state.exists else Sessions()
        mark, out = state.getCurrentWatermarkMs(), []
        now.pruned(mark * 1000 - keep * MINUTE, life)
        if not state.hasTimedOut:
            # most users have few events, for which lists are many times quicker than frames
            new = [x for frame in frames for x in zip(frame["t"].tolist(), (TURN.get(k, len(TURN)) for k in frame["kind"]), frame["event_id"].tolist(), frame["kind"].tolist(), frame["jti"].tolist(), strict=True)]
            for t, _, number, kind, jti in sorted(new, key=lambda x: (*x[:2], x[2] != x[2], x[2])):
                out.append((group[0], number if number == number else None, now.step(int(t), kind, jti if isinstance(jti, str) else None, life)))
        if now.known or now.logouts:
            state.update(now.state())
            state.setTimeoutTimestamp(mark + keep * 60_000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome"])

    return rows.groupBy("user_id").applyInPandasWithState(fold, f"user_id {kind}, {OUT}", SESSION_STATE, "append", "EventTimeTimeout")


def log_sink(outcomes: DataFrame, path: str, checkpoint: str):
    """Appends outcomes as log files; the checkpoint makes a restart repeat nothing."""
    return outcomes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
