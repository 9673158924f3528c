"""The states of feed items as a stream: allowed transitions, refusals on the side, a timer for items never shown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What may follow a state; an item begins as `new`. To be shown again is allowed, to go back is not.
ALLOWED = {"": ("new",), "new": ("new", "shown", "picked", "done"), "shown": ("shown", "picked", "done"), "picked": ("picked", "done"), "done": ("done",)}
OUT = "pmid string, ts timestamp, asked string, status string, accepted boolean, reason string, shown_in string"
STATE = "status string, shown_in string, waits boolean"


def stepped(status: str, shown: list[str], asked: str, snapshot: str | None, allowed: dict[str, tuple[str, ...]]) -> tuple[str, list[str], str]:
    """(status, snapshots, reason of a refusal) after one event."""
    if not status and asked != "new":
        return status, shown, "unknown item"
    if asked not in allowed.get(status, ()):
        return status, shown, f"{status} to {asked}"
    return asked if asked != "new" or not status else status, shown + [snapshot] if snapshot and snapshot not in shown else shown, ""


def machine(events: DataFrame, lateness: str = "1 day", patience_days: int = 30, allowed: dict[str, tuple[str, ...]] = ALLOWED) -> DataFrame:
    """OUT rows of a stream of events(pmid, status, snapshot, ts): each event in its item's order of time, accepted or refused with a reason.

    Snapshots are joined by `|`. An item that stays new for `patience_days` of event time gives one row asked `timeout`, refused as `never shown`."""

    def of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, shown, waits = state.get if state.exists else ("", "", False)
        marks = shown.split("|") if shown else []
        if state.hasTimedOut:
            at = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            state.update((status, shown, False))
            yield pd.DataFrame([(key[0], at, "timeout", status, False, "never shown", shown)], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        rows, last = [], None
        for r in pd.concat(list(frames)).sort_values(["ts", "status"], kind="stable").itertuples():
            fresh = not status
            status, marks, why = stepped(status, marks, r.status, r.snapshot if isinstance(r.snapshot, str) else None, allowed)
            waits = status == "new" and (waits or fresh)
            last = r.ts
            rows.append((key[0], r.ts, r.status, status, not why, why, "|".join(marks)))
        state.update((status, "|".join(marks), waits))
        if waits:
            due = int(last.timestamp() * 1000) + patience_days * 86_400_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = events.select("pmid", "status", "snapshot", "ts").withWatermark("ts", lateness)
    return rows.groupBy("pmid").applyInPandasWithState(of, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(events: DataFrame, allowed: dict[str, tuple[str, ...]] = ALLOWED) -> DataFrame:
    """The same of a table of events: OUT rows without timers."""

    def of(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        status, marks, rows = "", [], []
        for r in f.sort_values(["ts", "status"], kind="stable").itertuples():
            status, marks, why = stepped(status, marks, r.status, r.snapshot if isinstance(r.snapshot, str) else None, allowed)
            rows.append((key[0], r.ts, r.status, status, not why, why, "|".join(marks)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return events.select("pmid", "status", "snapshot", F.col("ts").cast("timestamp").alias("ts")).groupBy("pmid").applyInPandas(of, OUT)


def standing(rows: DataFrame) -> DataFrame:
    """(pmid, status, shown_in): where each item stands after its last accepted event."""
    done = rows.where("accepted").groupBy("pmid").agg(F.max_by(F.struct("status", "shown_in"), F.struct("ts", F.length("shown_in"), "status")).alias("x"))
    return done.select("pmid", "x.status", "x.shown_in")
