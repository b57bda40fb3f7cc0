"""Streams whose rows depend on state: single-flight refreshes with one follow-up, expiring leases, and what a session has seen."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def single_flight(events: DataFrame) -> DataFrame:
    """(project, seq, action) of events (project, seq, kind), kind `change` or `finished`, in the order of seq within a batch.

    A change starts a refresh if none runs; while one runs, all changes together queue one follow-up, which starts when it has finished.
    action: start, queue, follow_up or idle. Other kinds are ignored. The state of a project is two booleans.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running, queued = state.get if state.exists else (False, False)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for seq, kind in zip(rows["seq"], rows["kind"], strict=True):
            if kind == "change":
                out.append((seq, "queue" if running else "start"))
                running, queued = True, running
            elif kind == "finished":
                out.append((seq, "follow_up" if queued else "idle"))
                running, queued = queued, False
        state.update((running, queued))
        yield pd.DataFrame({"project": [key[0]] * len(out), "seq": [s for s, _ in out], "action": [a for _, a in out]})

    return events.groupBy("project").applyInPandasWithState(step, f"project {events.schema['project'].dataType.simpleString()}, seq bigint, action string", "running boolean, queued boolean", "append", GroupStateTimeout.NoTimeout)


def lease_stream(beats: DataFrame, ttl_seconds: int = 90, late: str = "10 minutes") -> DataFrame:
    """(client, state, at) of heartbeats (client, ts): `held` at a client's first beat, `expired` once the watermark or a later beat is past its last beat and ttl.

    A beat after that opens a new lease. The state of a client is the time of its last beat in milliseconds, dropped when the lease expires.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"client": [key[0]], "state": ["expired"], "at": [last + ttl_seconds * 1000]})
            return
        times = sorted(int(t.value // 1_000_000) for f in frames for t in f["ts"])
        last, out = state.get[0] if state.exists else None, []
        for t in times:
            if last is not None and t > last + ttl_seconds * 1000:
                out.append(("expired", last + ttl_seconds * 1000))
                last = None
            if last is None:
                out.append(("held", t))
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": [key[0]] * len(out), "state": [s for s, _ in out], "at": [a for _, a in out]})

    held = beats.where("ts IS NOT NULL AND client IS NOT NULL").withWatermark("ts", late)
    return held.groupBy("client").applyInPandasWithState(step, f"client {beats.schema['client'].dataType.simpleString()}, state string, at bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def first_in_session(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Results (session, key, ts) that a session has not had within `late`; later ones are dropped from the stream."""
    return results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "key"])
