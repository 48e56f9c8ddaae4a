"""Streaming form of the incident lifecycle: one keyed state per unit.

Window functions are not available on streams, so the running signals live in the state
next to the open incident. The rule predicates stay column expressions, computed before the
shuffle (``with_flags``), and the lifecycle steps are the ones the batch replay uses.

``clock="processing"`` fires heartbeats and stale closings from processing-time timers.
``clock="event"`` fires them from the unit's own next reading, on event time: the result is
then the same however the input is cut into micro-batches, and equal to the batch replay.

A reading older than its unit's newest is judged like any other (a step of at least a second);
``late="drop"`` leaves it out.
"""
from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from coldwatch import schemas as S
from coldwatch.functions import rules
from coldwatch.functions.rules import FLAGS, with_flags  # Python pays for each cell it is handed
from coldwatch.operators import incidents
from coldwatch.operators import lifecycle as L

NEAR_LIMIT, DOOR_TOO_LONG, COMPRESSOR_RISK, WEAK_POWER, MULTI, DOOR_CRITICAL, HOT_CRITICAL, DEFROSTING = (1 << i for i in range(len(FLAGS)))
_JUDGED = ["event_ts", "temperature_c", "temperature_upper_limit", rules.BITS]  # what Signals.judge takes
# a trend leaves Python as two plain arrays, which cost less than an array of rows
_EMIT = T.StructType([*incidents.EMITTED.fields[:-1], T.StructField("_trend_ts", T.ArrayType(T.LongType())),
                      T.StructField("_trend_temp", T.ArrayType(T.DoubleType()))])
_POINT = T.StructType([T.StructField("ts", T.LongType()), T.StructField("temp", T.DoubleType())])


class Signals:
    """Running signals of one unit, held across readings."""

    FIELDS = [("last_ts", T.LongType()), ("ewma", T.DoubleType()), ("over_since", T.LongType()),
              ("over_count", T.LongType()), ("bad_since", T.LongType()),
              ("quiet_since", T.LongType()), ("defrost_until", T.LongType())]

    def __init__(self, *values):
        for (name, _), value in zip(self.FIELDS, values or [None] * len(self.FIELDS)):
            setattr(self, name, value)

    def as_tuple(self) -> tuple:
        return tuple(getattr(self, name) for name, _ in self.FIELDS)

    def judge(self, ts, temp, limit, flags) -> tuple[int | None, int | None, int]:
        """Update with a reading's ``_JUDGED`` values; its alert type rank and level, and how long it was quiet."""
        before = temp if self.ewma is None else self.ewma
        self.ewma = S.EWMA_ALPHA * temp + (1 - S.EWMA_ALPHA) * before
        self.last_ts = ts
        if flags & DEFROSTING:
            self.defrost_until = ts + S.DEFROST_GRACE_MS
        in_defrost = self.defrost_until is not None and ts < self.defrost_until
        over = self.ewma - limit > S.TIE_C
        self.over_since = (ts if self.over_since is None else self.over_since) if over else None
        self.over_count = (self.over_count or 0) + 1 if over else 0
        over_held = over and (ts - self.over_since >= S.TEMP_HOLD_MS
                              or self.over_count >= S.TEMP_HOLD_READINGS)
        bad = flags & COMPRESSOR_RISK
        self.bad_since = (ts if self.bad_since is None else self.bad_since) if bad else None
        rising = self.ewma - before > S.TIE_C

        rank = level = None
        if flags & MULTI:
            rank, level = 0, 2
        elif flags & WEAK_POWER and (rising or flags & NEAR_LIMIT):
            rank, level = 1, 2
        elif bad and ts - self.bad_since >= S.COMPRESSOR_HOLD_MS:
            rank, level = 2, 2 if over else 1
        elif flags & DOOR_TOO_LONG:
            rank, level = 3, 2 if flags & DOOR_CRITICAL else 0
        elif over_held and not in_defrost:
            rank, level = 4, 2 if flags & HOT_CRITICAL else 0
        if rank is not None:
            self.quiet_since = None
            return rank, level, 0
        self.quiet_since = ts if self.quiet_since is None else self.quiet_since
        return None, None, ts - self.quiet_since


class IncidentProcessor(StatefulProcessor):
    def __init__(self, payload: T.StructType, clock: str = "processing", late: str = "keep",
                 ttl_ms: int | None = None):
        if clock not in ("processing", "event") or late not in ("drop", "keep"):
            raise ValueError("clock is 'processing' or 'event'; late is 'drop' or 'keep'")
        if ttl_ms is not None and clock == "event":
            raise ValueError("a time-to-live needs the processing clock")
        if ttl_ms is not None and ttl_ms <= S.STALE_MS:
            raise ValueError(f"a time-to-live up to {S.STALE_MS} ms would drop open incidents before they close")
        self._payload = payload
        self._event_clock = clock == "event"
        self._drop_late = late == "drop"
        self._ttl_ms = ttl_ms
        self._out = Row(*payload.names, *_EMIT.names)
        self._names = None

    def state_schema(self) -> T.StructType:
        fields = [T.StructField(n, t) for n, t in Signals.FIELDS]
        fields += [T.StructField("started_ts", T.LongType()), T.StructField("type_rank", T.IntegerType()),
                   T.StructField("level", T.IntegerType()), T.StructField("peak", T.DoubleType()),
                   T.StructField("next_beat", T.LongType()), T.StructField("seen", T.LongType()),
                   T.StructField("ring", T.ArrayType(_POINT)), T.StructField("last", self._payload)]
        return T.StructType(fields)

    def init(self, handle) -> None:
        self.handle = handle
        self._state = handle.getValueState("unit", self.state_schema(), self._ttl_ms)

    def _load(self):
        v = self._state.get()
        if v is None:
            return Signals(), None, None, [], None
        v = tuple(v)
        n = len(Signals.FIELDS)
        incident = L.Incident(*v[n:n + 5]) if v[n] is not None else None
        return Signals(*v[:n]), incident, v[n + 5], [tuple(p) for p in v[n + 6]], tuple(v[n + 7])

    def _save(self, signals, incident, seen, ring, last) -> None:
        held = (incident.started_ts, incident.type_rank, incident.level, incident.peak,
                incident.next_beat) if incident else (None,) * 5
        self._state.update((*signals.as_tuple(), *held, seen, ring, last))

    def _row(self, last, ring, incident, event, at, closed_by) -> Row:
        return self._out(*last, incident.type_rank, incident.level, incident.started_ts, incident.peak,
                         event, at, closed_by, [p[0] for p in ring], [p[1] for p in ring])

    def _fire(self, incident, seen, until, last, ring):
        """Timer rows before ``until`` and the incident left open after them."""
        rows = []
        for at, event in incident.beats(seen, until):
            stale = event == S.RESOLVED
            rows.append(self._row(last, ring, incident, event, at, "stale" if stale else None))
            if stale:
                return rows, None
        return rows, incident

    def _set_timer(self, incident) -> None:
        if self._event_clock:
            return
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if incident is not None:
            self.handle.registerTimer(incident.next_beat)

    def _picks(self, row) -> tuple:
        """Order, payload and judged values of a row by position: looking names up takes longer than judging."""
        names = list(row.__fields__)
        if names != self._names:
            self._names = names
            columns = self._payload.names, _JUDGED
            self._pick = (itemgetter(names.index("event_ts"), names.index("event_id")),
                          *(itemgetter(*map(names.index, c)) for c in columns))
        return self._pick

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        signals, incident, seen, ring, last = self._load()
        was_open = incident is not None and incident.started_ts
        wall = None if self._event_clock else timerValues.getCurrentProcessingTimeInMs()
        # the engine hands over a batch's rows of a unit in no particular order
        rows = list(rows)
        order, payload, judged = self._picks(rows[0]) if rows else (None,) * 3
        for r in sorted(rows, key=order):
            values = judged(r)
            ts, temp = values[:2]
            if self._drop_late and signals.last_ts is not None and ts < signals.last_ts:
                continue
            now = ts if self._event_clock else wall
            if self._event_clock and incident is not None:
                fired, incident = self._fire(incident, seen, ts, last, ring)
                yield from fired
            rank, level, quiet_ms = signals.judge(*values)
            last, seen = payload(r), now
            ring = (ring + [(ts, temp)])[-S.TREND_POINTS:]
            incident, event, about = L.on_reading(incident, ts, now, rank, level, temp, quiet_ms)
            if event:
                yield self._row(last, ring, about, event, now, "recovery" if event == S.RESOLVED else None)
        if last is not None:
            self._save(signals, incident, seen, ring, last)
        if (incident.started_ts if incident else None) != (was_open or None):
            self._set_timer(incident)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self._state.exists():
            return
        signals, incident, seen, ring, last = self._load()
        if incident is None:
            return
        wall = timerValues.getCurrentProcessingTimeInMs()
        incident.next_beat = wall  # one event per firing, at the time it fires
        fired, incident = self._fire(incident, seen, wall + 1, last, ring)
        self._save(signals, incident, seen, ring, last)
        if incident is not None:
            self.handle.registerTimer(incident.next_beat)
        yield from fired

    def close(self) -> None:
        pass


def stream_incidents(enriched: DataFrame, clock: str = "processing", late: str = "keep",
                     output_mode: str = "Update", ttl_ms: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Enriched stream to incident stream: one shuffle, on the unit.

    ``carry`` names the columns of the reading wanted on the result (default: all): no others travel or are kept in the state.
    """
    wanted = set(enriched.columns if carry is None else [*carry, *incidents.ALWAYS])
    payload = T.StructType([T.StructField(f.name, f.dataType) for f in enriched.schema.fields if f.name in wanted])
    known = with_flags(enriched.where(F.col("temperature_upper_limit").isNotNull())).select(
        *payload.names, *(n for n in _JUDGED if n not in payload.names))
    emitted = known.groupBy("freezer_id").transformWithState(
        statefulProcessor=IncidentProcessor(payload, clock, late, ttl_ms),
        outputStructType=T.StructType(payload.fields + _EMIT.fields),
        outputMode=output_mode,
        timeMode="None" if clock == "event" else "ProcessingTime",
    )
    trend = F.arrays_zip(F.col("_trend_ts").alias("ts"), F.col("_trend_temp").alias("temp"))
    return incidents.finish(emitted.withColumn("temp_trend", trend).drop("_trend_ts", "_trend_temp"))
