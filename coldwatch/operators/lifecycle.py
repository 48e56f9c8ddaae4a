"""The incident lifecycle of one unit: the only part that must be stepped reading by reading.

An incident opens on an alert, ratchets its type and level upward, beats every 20 s while
open, and closes after 30 s without an alert or 90 s without a reading.
"""
from __future__ import annotations

from collections.abc import Iterator

from coldwatch.schemas import ESCALATED, HEARTBEAT, HEARTBEAT_MS, OPENED, RECOVERY_MS, RESOLVED, STALE_MS


class Incident:
    __slots__ = ("started_ts", "type_rank", "level", "peak", "next_beat")

    def __init__(self, started_ts: int, type_rank: int, level: int, peak: float, next_beat: int):
        self.started_ts, self.type_rank, self.level = started_ts, type_rank, level
        self.peak, self.next_beat = peak, next_beat

    def absorb(self, type_rank: int, level: int, temp: float) -> bool:
        """Take in a further alert; true when it raises the type or the level."""
        raised = type_rank < self.type_rank or level > self.level
        self.type_rank = min(self.type_rank, type_rank)
        self.level = max(self.level, level)
        self.peak = max(self.peak, temp)
        return raised

    def beats(self, last_seen: int, until: int) -> Iterator[tuple[int, str]]:
        """Timer events before ``until``; ends with RESOLVED when the unit has gone silent."""
        while self.next_beat < until:
            at = self.next_beat
            if at - last_seen >= STALE_MS:
                yield at, RESOLVED
                return
            self.next_beat = at + HEARTBEAT_MS
            yield at, HEARTBEAT


def on_reading(open_: Incident | None, ts: int, now: int, type_rank: int | None, level: int | None,
               temp: float, quiet_ms: int) -> tuple[Incident | None, str | None, Incident | None]:
    """Step one judged reading.

    ``quiet_ms`` is how long the unit has been without an alert (ignored on an alert).
    Returns the incident afterwards, the event to emit (or None) and the incident it is about.
    """
    if type_rank is None:
        if open_ is not None and quiet_ms >= RECOVERY_MS:
            return None, RESOLVED, open_
        return open_, None, None
    if open_ is None:
        fresh = Incident(ts, type_rank, level, temp, now + HEARTBEAT_MS)
        return fresh, OPENED, fresh
    return open_, (ESCALATED if open_.absorb(type_rank, level, temp) else None), open_


def beat_after(started_ts: int, last_seen: int) -> int:
    """The next beat of an incident whose beats before ``last_seen`` have been given."""
    steps = -(-(last_seen - started_ts) // HEARTBEAT_MS)
    return started_ts + HEARTBEAT_MS * max(1, steps)


def stale_at(started_ts: int, last_seen: int) -> int:
    """The first beat at which a unit last seen at ``last_seen`` counts as silent."""
    steps = -(-(last_seen + STALE_MS - started_ts) // HEARTBEAT_MS)
    return started_ts + HEARTBEAT_MS * steps
