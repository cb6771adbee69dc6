"""Event streams. Each function takes a streaming or a batch DataFrame and declares the same plan for both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of event-time windows; rows later than the watermark are dropped by the stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of sessions: events of a user with less than ``gap`` between them."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


BLOCKS = "user_id long, event_id long, failures int, blocked boolean"


def _failures(key: tuple, batch: pd.DataFrame, now: tuple[int, bool], most: int) -> tuple[pd.DataFrame, tuple[int, bool]]:
    row, blocked = now
    rows = []
    for e in batch.sort_values("event_id").itertuples():
        row = row + 1 if e.event_type == "error" else 0
        blocked = blocked or row >= most
        rows.append((key[0], e.event_id, row, blocked))
    return pd.DataFrame(rows, columns=["user_id", "event_id", "failures", "blocked"]), (row, blocked)


def failure_blocks(events: DataFrame, most: int = 3) -> DataFrame:
    """One row for each event: failures in a row of its user so far, and whether the user is blocked by ``most`` of them (for good).

    On a stream the state is two numbers a user, and events of a micro-batch are taken in order of event_id. A batch is windows alone.
    """
    if not events.isStreaming:
        by = Window.partitionBy("user_id").orderBy("event_id")
        bad = (F.col("event_type") == "error").cast("int")
        runs = events.select("user_id", "event_id", bad.alias("bad")).withColumn("run", F.sum(1 - F.col("bad")).over(by))
        runs = runs.withColumn("failures", F.sum("bad").over(Window.partitionBy("user_id", "run").orderBy("event_id")).cast("int"))
        return runs.select("user_id", "event_id", "failures", (F.max("failures").over(by) >= most).alias("blocked"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = _failures(key, pd.concat(list(frames)), state.get if state.exists else (0, False), most)
        state.update(now)
        yield out

    stated = events.select("user_id", "event_id", "event_type").groupBy("user_id")
    return stated.applyInPandasWithState(run, BLOCKS, "row int, blocked boolean", "append", GroupStateTimeout.NoTimeout)


INTAKE = "ident string, ord long, state string, occurrences int, accepted boolean, reason string"
#: action -> (states it needs, the state it leads to, the reason where another state refuses it)
STEPS = {
    "rule": (("open",), "ruled", "not open"),
    "rule-external": (("open",), "ruled-external", "not open"),
    "apply": (("ruled", "ruled-external"), "applied", "not ruled"),
    "revert": (("applied",), "open", "not applied"),
}


def _intake(key: tuple, batch: pd.DataFrame, now: tuple[str, int]) -> tuple[pd.DataFrame, tuple[str, int]]:
    state, seen = now
    rows = []
    for e in batch.sort_values("ord").itertuples():
        why = None
        if e.action == "append":
            if state in ("", "applied"):
                state, seen = "open", 1
            elif e.kind == "obsolete-citation":
                seen += 1
            else:
                why = "duplicate"
        elif e.action in STEPS:
            needs, to, refusal = STEPS[e.action]
            state, why = (to, None) if state in needs else (state, refusal)
        else:
            why = "unknown action"
        rows.append((key[0], e.ord, state, seen, why is None, why))
    return pd.DataFrame(rows, columns=["ident", "ord", "state", "occurrences", "accepted", "reason"]), (state, seen)


def intake_states(entries: DataFrame) -> DataFrame:
    """One row for each event (ident, ord, action, kind) of an intake: the entry's state after it, and whether it was accepted.

    append opens an entry (where it is open already, an obsolete citation counts an occurrence and anything else is a duplicate); a
    ruling needs an open entry; apply needs a ruling, and so binds once; revert opens an applied entry again. State is two
    values an entry.
    """
    if not entries.isStreaming:
        return entries.groupBy("ident").applyInPandas(lambda key, pdf: _intake(key, pdf, ("", 0))[0], INTAKE)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = _intake(key, pd.concat(list(frames)), state.get if state.exists else ("", 0))
        state.update(now)
        yield out

    return entries.groupBy("ident").applyInPandasWithState(run, INTAKE, "state string, seen int", "append", GroupStateTimeout.NoTimeout)
