"""Call stacks of a stream of trace events: frames that never return are reported and a session's state ends.

Events of a session wait in its state until the watermark has passed them, so
they are taken in their order however they arrive. A declared restart (the
start of a forward) unwinds whatever is still open, and a session without
events for a while is unwound by an event-time timer, which leaves no state
behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = "enter long, exit long, depth long, status string, deepest boolean, reason string"
_CALL = Row("session", *(c.split()[0] for c in _OUT.split(", ")))
_RESTART, _IDLE = "a new batch was declared", "the session ended"


class _Stack(StatefulProcessor):
    """Events that wait, open frames, and the time of the last event with what else is held and the timer that is set.

    Each is one value: a session costs a few requests to its state, however
    many events it has, and none for what is not held or does not change.
    """

    def __init__(self, restart: str | None, idle_ms: int):
        self.restart, self.idle_ms = restart, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "i array<long>, ms array<long>, event array<string>")
        self.stack = handle.getValueState("stack", "i array<long>")
        self.last = handle.getValueState("last", "ms long, timer long, waits boolean, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new, latest = [], None
        for _, _, i, ms, event in rows:
            latest = ms if latest is None else max(latest, ms)
            # Other events tell only that the session goes on.
            if event in ("enter", "exit") or event is not None and event == self.restart:
                new.append((i, ms, event))
        yield from self._take(key[0], new, latest, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._take(key[0], [], None, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _take(self, session: int, new: list[tuple], latest: int | None, watermark: int, fired: int | None = None) -> list[Row]:
        """What the events that the watermark has passed do to the stack; one timer is set, for those that wait or for the session's end."""
        ms, timer, waits, is_open = self.last.get() or (None, None, False, False)
        if ms is None and latest is None:
            return []
        latest = max(t for t in (ms, latest) if t is not None)
        held = (list(zip(*self.waiting.get(), strict=True)) if waits else []) + new
        ready, rest = sorted(h for h in held if h[1] <= watermark), [h for h in held if h[1] > watermark]
        ends = fired is not None and not rest and latest + self.idle_ms <= watermark
        before = list(self.stack.get()[0]) if is_open and (ready or ends) else []
        stack, out = list(before), []
        for i, _, event in ready:
            if event == "enter":
                stack.append(i)
            elif event == "exit":
                depth = len(stack)
                out.append((stack.pop() if stack else None, i, depth, "closed" if depth else "orphan", None, None))
            else:
                out += self._unwound(stack, _RESTART)
                stack = []
        if ends:
            out += self._unwound(stack, _IDLE)
            stack = []
        # An empty list is no state.
        if rest and (new or ready):
            self.waiting.update(tuple(map(list, zip(*rest, strict=True))))
        elif waits and not rest:
            self.waiting.clear()
        if ready or ends:
            if stack and stack != before:
                self.stack.update((stack,))
            elif before and not stack:
                self.stack.clear()
            is_open = bool(stack)
        if ends:
            self.last.clear()
        else:
            due = min([h[1] for h in rest], default=latest + self.idle_ms)
            if due != timer:
                # The timer that fired is deleted after this.
                if timer is not None and timer != fired:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.last.update((latest, due, bool(rest), is_open))
        return [_CALL(session, *o) for o in out]

    @staticmethod
    def _unwound(stack: list[int], reason: str) -> list[tuple]:
        """Frames from the outermost in; the deepest is where execution stopped."""
        return [(i, None, n + 1, "unwound", n + 1 == len(stack), reason) for n, i in enumerate(stack)]

    def close(self) -> None:
        pass


def open_calls(events: DataFrame, session: str, order: str, event: str, ts: str, late: str = "10 minutes", idle: str = "1 hour", restart: str | None = None) -> DataFrame:
    """Calls of a stream as they close: (session, enter, exit, depth, status, deepest, reason).

    status is closed, orphan (an exit that closes nothing) or unwound: still
    open when the event ``restart`` came or the session had been idle for
    ``idle``. Events later than the watermark are left out. The session must
    keep state in RocksDB.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    held = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(F.col(session).alias("session"), ts, F.col(order).alias("i"), F.unix_millis(ts).alias("ms"), F.col(event).alias("event"))
    out = held.groupBy("session").transformWithState(_Stack(restart, idle_ms), f"session long, {_OUT}", "append", "EventTime")
    return out.withColumnRenamed("session", session)
