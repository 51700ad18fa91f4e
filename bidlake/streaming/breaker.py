"""State by key over ordered events: circuit breaker, rate limit and domain limiter, as batch folds and as streams.

The fold of one event into the state is one function; batch and stream share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bidlake.operators.running import PART, running_totals

# Failures that trip, seconds to wait.
THRESHOLD, QUICK_THRESHOLD, RESET, PROBE = 5, 3, 1800.0, 300.0
QUICK = frozenset(["login_required", "registration_required", "auth", "captcha"])
STATE = "state string, failures int, failed_at double, tripped_at double, probe_at double"
DECISION = "domain string, at double, op string, allowed boolean, state string"


def breaker_step(held: tuple, at: float, op: str, category: str | None) -> tuple[tuple, bool]:
    """The state after an event, and whether a request is let through. Failures are forgotten after twice the reset time without one."""
    state, failures, failed_at, tripped_at, probe_at = held
    if op == "success":
        return ("closed", 0, 0.0, 0.0, probe_at), True
    if op == "failure":
        failures = 1 if failures and at - failed_at > 2 * RESET else failures + 1
        if failures >= (QUICK_THRESHOLD if category in QUICK else THRESHOLD):
            return ("open", failures, at, at, probe_at), False
        return (state, failures, at, tripped_at, probe_at), True
    if state == "open":
        if at - tripped_at > RESET:
            return ("half_open", failures, failed_at, tripped_at, at), True
        return held, False
    if state == "half_open" and at - probe_at > PROBE:
        return ("open", failures, failed_at, at, probe_at), False
    return held, True


FRESH = ("closed", 0, 0.0, 0.0, 0.0)


def _replay(domain: str, events: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
    rows = []
    for at, op, category in events.sort_values(["at", "op", "category"], kind="stable", na_position="first")[["at", "op", "category"]].itertuples(index=False):
        held, allowed = breaker_step(held, float(at), op, category)
        rows.append((domain, float(at), op, allowed, held[0]))
    return pd.DataFrame(rows, columns=["domain", "at", "op", "allowed", "state"]), held


def replay_breaker(events: DataFrame) -> DataFrame:
    """Decisions on (domain, at, op, category) in the order of time; op is request, success or failure.

    Batches of a domain come sorted and carry the state on, so that a domain's events never are in memory at once.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, held = None, FRESH
        for part in parts:
            for name, some in part.groupby("domain", sort=False):
                if name != domain:
                    domain, held = name, FRESH
                out, held = _replay(name, some, held)
                yield out

    placed = events.select("domain", "at", "op", "category").repartition("domain").sortWithinPartitions("domain", "at", "op", "category")
    return placed.mapInPandas(work, DECISION)


def stream_states(events: DataFrame, key: str, order: list[str], fold: Callable, fresh: tuple, state: str, out: str, forget: float, late: str) -> DataFrame:
    """``fold`` over a stream of events with a column ``at`` in seconds: each micro-batch of a key in the order of time, micro-batches as they come.

    ``fold`` takes (key, sorted events, state) and returns rows of ``out`` and the new state. A watermark runs ``late`` behind the latest event: rows
    later than it are left out, and a key of which nothing has come for ``forget`` seconds of event time is forgotten, so that state
    doesn't grow without end. Timers are of event time, so nothing runs while nothing comes.
    """

    def work(name: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        some = pd.concat(list(parts))  # the key's rows of one micro-batch, whose size the source bounds
        rows, new = fold(name[0], some.sort_values(order, kind="stable"), held.get if held.exists else fresh)
        held.update(new)
        held.setTimeoutTimestamp(max(int(1000 * (some["at"].max() + forget)), held.getCurrentWatermarkMs() + 1))
        yield rows

    timed = events.withColumn("_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long") + 1000))  # the first watermark leaves out what isn't after second 0
    return timed.withWatermark("_time", late).groupBy(key).applyInPandasWithState(work, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def stream_breaker(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The breaker over a stream; a domain of which nothing has come for twice the reset time, and ``late``, starts anew."""
    return stream_states(events.select("domain", "at", "op", "category"), "domain", ["at", "op"], _replay, FRESH, STATE, DECISION, 2 * RESET, late)


def limit_step(held: tuple[float, int], at: float, limit: int, window: float) -> tuple[tuple[float, int], bool]:
    """A fixed window that starts with its first hit."""
    start, n = held
    if n == 0 or at - start >= window:
        return (at, 1), True
    return (start, n + 1), n + 1 <= limit


def replay_limit(events: DataFrame, limit: int = 60, window: float = 60.0) -> DataFrame:
    """(key, at, allowed) for (key, at), in the order of time."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, (0.0, 0)
        for part in parts:
            rows = []
            for name, at in part[["key", "at"]].itertuples(index=False):
                if name != key:
                    key, held = name, (0.0, 0)
                held, allowed = limit_step(held, float(at), limit, window)
                rows.append((name, float(at), allowed))
            yield pd.DataFrame(rows, columns=["key", "at", "allowed"])

    return events.select("key", "at").repartition("key").sortWithinPartitions("key", "at").mapInPandas(work, "key string, at double, allowed boolean")


def _replay_limit(limit: int, window: float) -> Callable:
    def fold(key: str, events: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
        rows = []
        for at in events["at"]:
            held, allowed = limit_step(held, float(at), limit, window)
            rows.append((key, float(at), allowed))
        return pd.DataFrame(rows, columns=["key", "at", "allowed"]), held

    return fold


def stream_limit(events: DataFrame, limit: int = 60, window: float = 60.0, late: str = "1 minute") -> DataFrame:
    """``replay_limit`` over a stream of (key, at)."""
    return stream_states(events.select("key", "at"), "key", ["at"], _replay_limit(limit, window), (0.0, 0), "start double, n int", "key string, at double, allowed boolean", window, late)


def acquire_step(held: tuple[int, float], at: float, op: str, most: int, window: float) -> tuple[tuple[int, float], bool]:
    """Slots of a domain that are taken and when all are given back; a counter at 0 begins a new time with the next slot.

    ``acquire`` takes a slot if fewer than ``most`` are taken, and a refused one takes none; ``release`` gives one back, if any is taken.
    """
    taken, until = held if at < held[1] else (0, 0.0)
    if op == "release":
        return ((taken - 1, until) if taken else (0, 0.0)), True
    if taken == 0:
        until = at + window
    return (min(taken + 1, most), until), taken < most


LIMITED = "key string, at double, op string, allowed boolean, taken int"
#: A key without slots that were ever taken.
FREE = (0, 0.0)


def _replay_slots(most: int, window: float) -> Callable:
    def fold(key: str, events: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
        rows = []
        for at, op in events[["at", "op"]].itertuples(index=False):
            held, allowed = acquire_step(held, float(at), op, most, window)
            rows.append((key, float(at), op, allowed, held[0]))
        return pd.DataFrame(rows, columns=["key", "at", "op", "allowed", "taken"]), held

    return fold


def replay_limiter(events: DataFrame, most: int = 4, window: float = 30.0) -> DataFrame:
    """(key, at, op, allowed, taken) for (key, at, op), op being acquire or release, in the order of time; rows with a null key or time are left out.

    Once no event has come for ``window`` seconds all slots are free, so the events of a key fall into runs that don't depend on each other. Runs are
    numbered over all keys by running totals and folded apart: a very busy key is as many tasks' work as its pauses allow.
    """
    known = events.select("key", "at", "op").filter("key is not null and at is not null")
    ordered = running_totals(known.withColumn("_one", F.lit(1)), ["key", "at", "op"], "_one", "_before", "_nth").select("key", "at", "op", "_nth", PART)
    # A row's predecessor is in its own partition, or the last row of an earlier one: a row a partition.
    inside = ordered.withColumn("_last", F.lag("at").over(W.partitionBy(PART, "key").orderBy("at", "op")))
    ends = ordered.groupBy(PART, "key").agg(F.max("at").alias("_end"), F.min("at").alias("_begin"))
    before = ends.withColumn("_until", F.lag("_end").over(W.partitionBy("key").orderBy(PART))).select(PART, "key", "_until")
    placed = inside.join(before, [PART, "key"]).withColumn("_since", F.coalesce("_last", "_until"))
    begins = placed.withColumn("_new", (F.col("_since").isNull() | (F.col("at") - F.col("_since") >= window)).cast("int"))
    runs = running_totals(begins.select("key", "at", "op", "_new", "_nth"), ["_nth"], "_new", "_runs", "_place").withColumn("_run", F.col("_runs") + F.col("_new"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, run, held = _replay_slots(most, window), None, FREE
        for part in parts:
            for name, some in part.groupby("_run", sort=False):
                if name != run:
                    run, held = name, FREE
                rows, held = fold(some["key"].iloc[0], some, held)
                yield rows

    return runs.select("_run", "key", "at", "op").repartition("_run").sortWithinPartitions("_run", "at", "op").mapInPandas(work, LIMITED)


def stream_limiter(events: DataFrame, most: int = 4, window: float = 30.0, late: str = "1 minute") -> DataFrame:
    """``replay_limiter`` over a stream; a key's slots are forgotten with the time in which they would be given back."""
    return stream_states(events.select("key", "at", "op"), "key", ["at", "op"], _replay_slots(most, window), FREE, "taken int, until double", LIMITED, window, late)
