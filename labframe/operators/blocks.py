"""Folds over one key's events by many tasks: blocks of events are summed up as functions of the state they are entered in.

A key with very many events is dealt out in ranges of time. What a block does to a state is a small function: each
state that it can be entered in has one exit. Blocks are summed up side by side, the sums of a key are then applied in
order, which gives every block its entry, and the blocks are folded side by side again. A task holds one block.

Sums of the login fold: a block is entered with 0, 1 or at least 2 failures, or locked until some time, which is the
same as being entered with 2 failures at the first event after the lock. The exits for all of these follow from the
last event to the first: a success leads to the exit with no failures at the next event, a failure to that with one
more, and a failure that locks to the exit at the first event after the lock. Only the last event of each run of equal
exits is kept. Sums of the code fold: the first few attempts of a block tell what becomes of a pending code that is
carried in, and the block's own last code what it leaves. Sums of the request window: the exits of windows that begin
at a request, again from the last to the first.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.sources.io import stored

#: Events of a block.
BLOCK_EVENTS = 100_000


def dealt(events: DataFrame, key: str, rows: int = BLOCK_EVENTS, dealt_rows: int = BLOCK_EVENTS) -> DataFrame:
    """The stored events with `block`, a range of (key, t, event_id) of at most `rows` rows.

    Small blocks are cut from sorted partitions of about `dealt_rows` rows, so there are no more tasks, whose reports
    all go to the driver, than the number of events asks for.
    """
    n = max(1, -(-events.count() // max(rows, dealt_rows)))
    ordered = events.repartitionByRange(n, key, "t", "event_id").sortWithinPartitions(key, "t", "event_id")
    # ids go up within a partition and leave a wide gap after it, so blocks follow the order and end with the partition
    return stored(ordered.withColumn("block", F.expr(f"monotonically_increasing_id() div {rows}")), "blocks")


def grouped(rows: DataFrame, by: Sequence[str], order: Sequence[str], f: Callable[[dict[str, list]], Sequence[list]], schema: str) -> DataFrame:
    """Rows dealt by `by` and sorted by it and `order`; f takes the columns of one group and gives those of its results.

    Groups follow each other in a task's batches, so many small ones cost no more than their rows. Results are texts or
    columns of the rows.
    """
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    dealt = rows.repartition(*map(F.col, by)).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, types = None, {}, []

        def results(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, types, strict=True)], names)

        for batch in batches:
            types = [batch.schema.field(c).type if c in batch.schema.names else pa.string() for c in names]
            columns, out = {c: batch.column(c).to_pylist() for c in batch.schema.names}, [[] for _ in names]
            of, start = list(zip(*(columns[c] for c in by), strict=True)), 0
            while start < len(of):
                end = start + 1
                while end < len(of) and of[end] == of[start]:
                    end += 1
                if of[start] != at:
                    for to, more in zip(out, f(held) if held else [], strict=bool(held)):
                        to.extend(more)
                    at, held = of[start], {c: [] for c in columns}
                for c, values in columns.items():
                    held[c].extend(values[start:end])
                start = end
            yield results(out)
        if held:
            yield results([list(x) for x in f(held)])

    return dealt.mapInArrow(run, schema)


def in_blocks(blocks: DataFrame, key: str, fields: Sequence[str], phases: Sequence[tuple[tuple, Callable, Callable]], finish: Callable) -> DataFrame:
    """(key, event_id, outcome) of dealt events, whose keys are not null.

    Each phase is (state at the beginning, summed, applied): summed(columns, entries) gives the sum of a block as a JSON
    value, where entries are its states of the phases before; applied(sum, state) gives the state after it.
    finish(columns, entries) gives the outcomes. columns are lists of t and the fields.
    """
    kind, number = blocks.schema[key].dataType.simpleString(), blocks.schema["event_id"].dataType.simpleString()
    known = blocks.select(key, "block").distinct().withColumn("entries", F.lit("[]"))

    def in_each(entries: DataFrame, f: Callable, schema: str) -> DataFrame:
        # a block's entries are a row before its events, so no join has to bring them together
        both = blocks.select(key, "block", "event_id", "t", *fields).unionByName(entries.select(key, "block", "entries"), allowMissingColumns=True)
        return grouped(both.withColumn("event", F.col("entries").isNull()), [key, "block"], ["event", "t", "event_id"], f, schema)

    def columns(rows: dict[str, list]) -> dict[str, list]:
        return {c: rows[c][1:] for c in ("t", *fields)}

    def summing(summed: Callable) -> Callable[[dict[str, list]], Sequence[list]]:
        def sum_up(rows: dict[str, list]) -> Sequence[list]:
            return rows[key][:1], rows["block"][:1], rows["entries"][:1], [json.dumps(summed(columns(rows), json.loads(rows["entries"][0])))]

        return sum_up

    def scanning(begin: tuple, applied: Callable) -> Callable[[dict[str, list]], Sequence[list]]:
        def scan(rows: dict[str, list]) -> Sequence[list]:
            state, out = begin, []
            for entries, got in zip(rows["entries"], rows["sum"], strict=True):
                out.append(json.dumps([*json.loads(entries), state]))
                state = applied(json.loads(got), state)
            return rows[key], rows["block"], out

        return scan

    for begin, summed, applied in phases:
        sums = stored(in_each(known, summing(summed), f"`{key}` {kind}, block bigint, entries string, sum string"), "sums")
        known = stored(grouped(sums, [key], ["block"], scanning(begin, applied), f"`{key}` {kind}, block bigint, entries string"), "entries")

    def run(rows: dict[str, list]) -> Sequence[list]:
        return rows[key][1:], rows["event_id"][1:], finish(columns(rows), json.loads(rows["entries"][0]))

    return in_each(known, run, f"`{key}` {kind}, event_id {number}, outcome string")


def runs(times: Sequence[int], exits: Sequence, until: int) -> list:
    """[time, exit] of the last event of each run of equal exits, up to the first event at `until` or later."""
    end = min(bisect_left(times, until) + 1, len(times))
    return [[int(times[i]), exits[i]] for i in range(end) if i + 1 == end or exits[i + 1] != exits[i]]


# ---- logins: (failures, end of the lock)


def login_sum(times: list[int], failed: list[bool], lock: int, tries: int) -> dict:
    """The exits of a block's effective logins (failures and successes), by entry."""
    n, top = len(times), tries - 1
    after = np.searchsorted(np.array(times, np.int64), np.array(times, np.int64) + lock, "left").tolist() if n else []
    at = [[[k, None]] * (n + 1) for k in range(tries)]
    for i in range(n - 1, -1, -1):
        if failed[i]:
            j = max(after[i], i + 1)
            for k in range(top):
                at[k][i] = at[k + 1][i + 1]
            at[top][i] = at[top][j] if j < n else [top, times[i] + lock]
        else:
            for k in range(tries):
                at[k][i] = at[0][i + 1]
    return {"open": [at[k][0] for k in range(tries)], "first": times[0] if n else None, "locked": runs(times, at[top], times[0] + lock) if n else []}


def login_applied(got: dict, state: Sequence) -> list:
    n, until = state
    if got["first"] is None:
        return [n, until]
    if until is None or until <= got["first"]:
        return got["open"][min(n, len(got["open"]) - 1)]
    later = bisect_left(got["locked"], [until])
    return got["locked"][later][1] if later < len(got["locked"]) else [n, until]


# ---- pending codes: (expiry, attempts)


def code_sum(sent: Sequence[int], tried: Sequence[tuple[int, bool]], last: Sequence, tries: int) -> dict:
    """sent: times of codes of the block; tried: (time, right) of the attempts before the first; last: the state it leaves if it has codes."""
    return {"own": list(last) if sent else None, "n": len(tried), "tried": [[int(t), bool(ok)] for t, ok in tried[: tries + 1]]}


def code_applied(got: dict, state: Sequence, tries: int) -> list:
    if got["own"] is not None:
        return got["own"]
    code, attempts = state
    for t, ok in got["tried"]:
        if code is None or code < t or attempts >= tries or ok:
            return [None, attempts]
        attempts += 1
    return [code, attempts]


# ---- request windows: (requests, start of the window)


def window_sum(times: list[int], done: list[bool], window: int, tries: int) -> dict:
    """The exits of a block of requests and done events, by entry: of windows that begin at a request, and what ends the carried one."""
    n = len(times)
    asks = [i for i in range(n) if not done[i]]
    place = np.cumsum([0, *(not d for d in done)]).tolist()  # requests before each event
    ends = [i for i in range(n) if done[i]]
    ask_times = [times[i] for i in asks]
    exits: list = [None] * (len(asks) + 1)
    for k in range(len(asks) - 1, -1, -1):
        late = bisect_right(ask_times, ask_times[k] + window)
        end = bisect_left(ends, asks[k])
        after = place[ends[end]] if end < len(ends) else len(asks) + 1
        if min(late, after) < len(asks):
            exits[k] = exits[min(late, after)]
        else:
            exits[k] = [0, None] if after <= len(asks) else [min(tries, len(asks) - k), ask_times[k]]
    first = place[ends[0]] if ends else len(asks)  # requests before the first done event
    return {
        "n": len(asks),
        "fresh": exits[0],
        "done": (exits[first] if first < len(asks) else [0, None]) if ends else None,
        "last": ask_times[first - 1] if first else None,
        # the first request later than the end of the carried window
        "late": runs(ask_times, exits, ask_times[0] + window + 1) if asks else [],
    }


def window_applied(got: dict, state: Sequence, window: int, tries: int) -> list:
    n, start = state
    if start is None:
        return got["fresh"] if got["n"] else [0, None]
    if got["last"] is not None and got["last"] > start + window:  # a request opens a new window before any done event
        return got["late"][bisect_left(got["late"], [start + window + 1])][1]
    return got["done"] if got["done"] is not None else [min(tries, n + got["n"]), start]
