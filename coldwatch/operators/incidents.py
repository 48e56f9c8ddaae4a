"""Batch replay of the incident lifecycle over a table of enriched readings.

Signals and the verdict of each reading are window expressions, and so is nearly all of the lifecycle: an incident's
type, level and peak only ratchet, so between two possible closings they are running maxima. What has to be
stepped is which incident is still open where a new stretch begins. For that each unit's readings are first reduced to a row
per stretch between possible closings, and these are folded (``carried_incidents``). Joined to the readings, the fold's result
lets each reading name the events on it and the timers that fire before the next one.

The clock of the replay is event time: before a reading at t, every timer that expires before t
has fired; after a unit's last reading, those before ``as_of_ms``.

A unit too large for one task is cut into slices (see ``skew``); each slice's first reading begins a stretch, so the fold
carries incidents from slice to slice as it does within one.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldwatch import schemas as S
from coldwatch.functions import rules
from coldwatch.operators import lifecycle as L
from coldwatch.operators import signals
from coldwatch.operators.skew import CONTEXT_ROWS, MAX_ROWS, cold_and_hot, plan_slices, sliced_by
from coldwatch.session import freeze

PART = ["freezer_id", "slice"]
KEY = [*PART, "stretch"]
HELD = ("_opened", "_type", "_level", "_peak")  # of an incident: opening, type, level, peak
_ENTERED = ("in_started", "in_type", "in_level", "in_peak")  # the same as the stretch before left it

EMITTED = T.StructType([
    T.StructField("type_rank", T.IntegerType()), T.StructField("escalation_level", T.IntegerType()),
    T.StructField("incident_started_ts", T.LongType()), T.StructField("peak_temp_c", T.DoubleType()),
    T.StructField("lifecycle_event", T.StringType()), T.StructField("emit_ts", T.LongType()),
    T.StructField("closed_by", T.StringType()),
    T.StructField("temp_trend", T.ArrayType(T.StructType([
        T.StructField("ts", T.LongType()), T.StructField("temp", T.DoubleType())]))),
])


_WORKING = {"slice", "stretch", "is_context", "last_slice", "verdict_type", "verdict_level", "prev_ts", "next_ts", "_alert", "_begins",
            "_silence", "_recovered", "_before_own", *HELD}
ALWAYS = ["freezer_id", "event_id", "event_ts", "temperature_c"]


def judged(sliced: DataFrame) -> DataFrame:
    """Sliced readings with signals, verdict ranks and quiet runs."""
    return signals.with_quiet_run(signals.classify(sliced, PART), PART).withColumns({
        "verdict_type": rules.rank_of("alert_type", S.ALERT_TYPES),
        "verdict_level": rules.rank_of("alert_severity", S.SEVERITIES),
    })


def _known(enriched: DataFrame) -> DataFrame:
    """Readings without limits are left out: they can never alert."""
    return enriched.where(F.col("temperature_upper_limit").isNotNull())


def classified(enriched: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Every known reading with its signals and its sustained verdict."""
    cold, hot = cold_and_hot(_known(enriched), max_rows)
    every = judged(cold) if hot is None else judged(cold).unionByName(signals.with_carried_runs(judged(hot)))
    return every.drop("next_ts", "ewma_in", signals.BLOCK)


def with_stretches(readings: DataFrame) -> DataFrame:
    """Judged readings cut into ``stretch``es at possible closings, and what each stretch held before a reading.

    A stretch begins with a slice's first own reading, after a silence long enough to close an incident, or 30 s into a quiet run.
    The running columns are maxima of codes that grow with the stretch, so all share one sort: an older
    stretch's code is told by its number and counts as none.
    """
    in_time = Window.partitionBy(*PART).orderBy(*signals.time_order(readings))
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_time.rowsBetween(Window.unboundedPreceding, -1)
    own, ts = ~F.col("is_context"), F.col("event_ts")
    silence = F.coalesce(ts - F.col("prev_ts") > S.STALE_MS, F.lit(False))
    recovered = F.coalesce(
        (ts - F.col("quiet_since") >= S.RECOVERY_MS)
        & (F.coalesce("prev_ts", "quiet_since") - F.col("quiet_since") < S.RECOVERY_MS), F.lit(False))
    df = readings.withColumns({
        "_first": own & F.coalesce(F.lag("is_context").over(in_time), F.lit(True)),
        "_before_own": F.col("is_context") & F.coalesce(~F.lead("is_context").over(in_time), F.lit(False)),
    }).withColumns({"_silence": own & silence, "_recovered": own & recovered})
    df = df.withColumn("_begins", F.col("_first") | F.col("_silence") | F.col("_recovered"))
    df = df.withColumns({"stretch": F.sum(F.col("_begins").cast("long")).over(so_far),
                         "_ends": own & F.coalesce(F.lead("_begins").over(in_time), F.lit(True))})
    # can an incident reach into the stretch? Not over a recovery or a silence that outlasts any beat
    reached = F.col("prev_ts").isNotNull() & ~F.col("_recovered") & (ts - F.col("prev_ts") < S.STALE_MS + S.HEARTBEAT_MS)
    alert = own & F.col("verdict_type").isNotNull()
    code = F.col("stretch") * 8
    df = df.withColumn("_alert", alert).withColumns({
        "_reached": F.max(F.when(F.col("_begins"), F.col("stretch") * 2 + reached.cast("long"))).over(so_far),
        "_opened": F.max(F.when(alert, F.struct("stretch", (-ts).alias("value")))).over(earlier),
        "_type": F.max(F.when(alert, code + len(S.ALERT_TYPES) - F.col("verdict_type"))).over(earlier),
        "_level": F.max(F.when(alert, code + 1 + F.col("verdict_level"))).over(earlier),
        "_peak": F.max(F.when(alert, F.struct("stretch", F.col("temperature_c").alias("value")))).over(earlier),
    })

    def here(name: str, value: Column) -> Column:
        number = F.col(f"{name}.stretch") if name in ("_opened", "_peak") else F.shiftright(name, 3)
        return F.when(number == F.col("stretch"), value)

    return df.withColumns({
        "_reached": F.coalesce(F.col("_reached").bitwiseAND(1) == 1, F.lit(False)),
        "_opened": here("_opened", -F.col("_opened.value")),
        "_type": here("_type", (len(S.ALERT_TYPES) - F.col("_type").bitwiseAND(7)).cast("int")),
        "_level": here("_level", (F.col("_level").bitwiseAND(7) - 1).cast("int")),
        "_peak": here("_peak", F.col("_peak.value")),
    })


def _absorbed() -> dict[str, Column]:
    """What an incident holds after a reading, from what it held before."""
    def own(name: str) -> Column:
        return F.when(F.col("_alert"), F.col(name))

    return {"_opened": F.coalesce("_opened", own("event_ts")), "_type": F.least("_type", own("verdict_type")),
            "_level": F.greatest("_level", own("verdict_level")), "_peak": F.greatest("_peak", own("temperature_c"))}


def _raises() -> Column:
    return F.col("_alert") & (F.col("_opened").isNull() | (F.col("verdict_type") < F.col("_type")) | (F.col("verdict_level") > F.col("_level")))


def _beats(as_of: Column) -> dict[str, Column]:
    """The timers between a reading and the unit's next, as steps after the opening: the first, the
    last, and the one that finds the unit silent. They are NULL without an incident."""
    ts, step, opened = F.col("event_ts"), F.lit(S.HEARTBEAT_MS), F.col("_opened")
    until = F.coalesce("next_ts", F.when(F.col("last_slice"), as_of))
    silent = F.ceil((ts + S.STALE_MS - opened) / step)
    return {"_beat": F.greatest(F.lit(1), F.ceil((ts - opened) / step)), "_silent": silent,
            "_last_beat": F.when(until.isNotNull(), F.least(F.floor((until - 1 - opened) / step), silent))}


def lifecycle_rows(readings: DataFrame, as_of: Column, payload: list[str], trend: bool = True, also: str | None = None) -> DataFrame:
    """The readings that an incident's course can show on: those at both ends of a stretch, those that raise what
    it holds, and those that timers may refer to. Where no incident reaches into a stretch, its timers are known already.

    ``also`` names a flag of further readings to return, and the result then tells by ``_shows`` which are of the first kind.
    """
    if trend:
        readings = signals.with_trend(readings, PART)
    marked = readings.withColumn("_raises", _raises()).withColumns({f"_was{n}": F.col(n) for n in HELD}).withColumns(_absorbed()).withColumns(_beats(as_of))
    own = ~F.col("is_context")
    timers = F.coalesce(F.col("_last_beat") >= F.col("_beat"), F.lit(False))
    shows = F.col("_begins") | F.col("_ends") | F.col("_before_own") | F.col("_raises") | (own & (F.col("_reached") | timers))
    if also is None:
        kept, more = marked.where(shows), []
    else:
        marked = marked.withColumn("_shows", F.coalesce(shows, F.lit(False)))
        kept, more = marked.where(F.col("_shows") | F.col(also)), ["_shows", also, "prev_ewma", "ewma_in"]
        if trend:
            kept = kept.withColumn("temp_trend", F.when(F.col("_shows"), F.col("temp_trend")))
    return kept.select(
        *payload, "slice", "stretch", "is_context", "last_slice", "verdict_type", "verdict_level", "prev_ts", "next_ts", "_alert", "_begins",
        "_silence", "_recovered", "_before_own", *(F.col(f"_was{n}").alias(n) for n in HELD),
        *(["temp_trend"] if trend else []), *more)


def stretches(rows: DataFrame) -> DataFrame:
    """One row per stretch, from its ``lifecycle_rows``: all that the fold over them needs."""
    return rows.where(~F.col("is_context")).withColumns(_absorbed()).groupBy(*KEY).agg(
        F.max("_recovered").alias("recovered"), F.min(F.when(F.col("_silence"), F.col("prev_ts"))).alias("silent_from"),
        F.min("event_ts").alias("first_ts"), F.min("_opened").alias("alert_ts"), F.min("_type").alias("type_rank"),
        F.max("_level").alias("level"), F.max("_peak").alias("peak"))


_CARRIED = """freezer_id string, slice bigint, stretch bigint, in_started bigint, in_type int, in_level int, in_peak double,
    in_stale boolean, in_recovered boolean"""


def carried_incidents(summaries: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """For each stretch that an incident reaches: the incident as the stretch before left it, and
    whether the silence between the two, or else the stretch's first reading, closes it. A row without
    ``stretch`` is what is open at a unit's end.

    ``opening`` (freezer_id, alert_ts, type_rank, level, peak): incidents open before the first stretch.

    Between two possible closings all readings of an incident act as one, and a unit has at most one
    such stretch per 30 s and slice, however many readings it has: that is what one unit's fold steps over.
    """
    fields = ["freezer_id", "slice", "stretch", "recovered", "silent_from", "first_ts", "alert_ts", "type_rank", "level", "peak"]
    names = [f.split()[0] for f in _CARRIED.split(",")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = open_ = None

        def at_end() -> list[tuple]:
            return [] if open_ is None else [(unit, None, None, open_.started_ts, open_.type_rank, open_.level, open_.peak, False, False)]

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            out = []
            for key, part, number, recovered, silent_from, first_ts, alert_ts, *found in zip(*(c.to_pylist() for c in batch.columns)):
                if key != unit:
                    out += at_end()
                    unit, open_ = key, None
                if open_ is not None:
                    stale = silent_from is not None and L.stale_at(open_.started_ts, silent_from) < first_ts
                    out.append((unit, part, number, open_.started_ts, open_.type_rank, open_.level, open_.peak, stale, recovered and not stale))
                    if stale or recovered:
                        open_ = None
                if alert_ts is not None:
                    if open_ is None:
                        open_ = L.Incident(alert_ts, *found, 0)
                    else:
                        open_.absorb(*found)
            yield table(out)
        yield table(at_end())

    if opening is not None:
        none = F.lit(None)
        summaries = opening.select(
            "freezer_id", F.lit(-1).cast("long").alias("slice"), F.lit(0).cast("long").alias("stretch"), F.lit(False).alias("recovered"),
            none.cast("long").alias("silent_from"), F.col("alert_ts").alias("first_ts"), "alert_ts", "type_rank", "level", "peak").unionByName(summaries)
    return summaries.repartition("freezer_id").sortWithinPartitions(*KEY).select(*fields).mapInArrow(fold, _CARRIED)


def events_on(rows: DataFrame, carried: DataFrame, as_of: Column) -> DataFrame:
    """Lifecycle rows from ``lifecycle_rows``, each on the reading it refers to: what the reading does, then the timers
    that fire before the unit's next reading. The last of a slice's context rows stands for the slice before it."""
    names = [n for n in rows.columns if n not in _WORKING]
    # context carries no stretch of its own: the one it leads to is the first
    rows = rows.withColumn("stretch", F.col("stretch") + F.col("_before_own").cast("long")).join(carried, KEY, "left")
    ts, own = F.col("event_ts"), ~F.col("is_context")
    goes_on = F.col("_before_own") | (own & ~F.col("in_stale") & ~F.col("in_recovered"))

    def before(carried_name: str, name: str, merge) -> Column:
        return merge(F.when(goes_on, F.col(carried_name)), F.when(own, F.col(name)))

    rows = rows.withColumns({
        "_opened": before("in_started", "_opened", F.coalesce), "_type": before("in_type", "_type", F.least),
        "_level": before("in_level", "_level", F.greatest), "_peak": before("in_peak", "_peak", F.greatest)})
    closes = F.coalesce(F.col("_begins") & F.col("in_recovered"), F.lit(False))
    event = F.when(closes, S.RESOLVED).when(_raises(), F.when(F.col("_opened").isNull(), S.OPENED).otherwise(S.ESCALATED))
    rows = rows.withColumn("_event", event).withColumns(_absorbed()).withColumns(_beats(as_of))
    beats = F.coalesce((own | F.col("_before_own")) & (F.col("_last_beat") >= F.col("_beat")), F.lit(False))
    rows = rows.where(F.col("_event").isNotNull() | beats)

    # steps are counted from 1, so 0 can stand for what the reading does: numbers are unfolded, and only then made into events
    none = F.array().cast("array<bigint>")
    steps = F.concat(F.when(F.col("_event").isNotNull(), F.array(F.lit(0).cast("bigint"))).otherwise(none),
                     F.when(beats, F.sequence("_beat", "_last_beat")).otherwise(none))
    told = rows.withColumn("_closes", closes).select(*names, *HELD, "_event", "_silent", "_closes", *_ENTERED, F.explode(steps).alias("_step"))
    direct, closed, silent = F.col("_step") == 0, F.col("_closes"), F.col("_step") == F.col("_silent")

    def held(entered: str, name: str) -> Column:
        return F.when(direct & closed, F.col(entered)).otherwise(F.col(name))

    started, type_rank, level, peak = map(held, _ENTERED, HELD)
    emitted = {
        "type_rank": type_rank, "escalation_level": level, "incident_started_ts": started, "peak_temp_c": peak,
        "lifecycle_event": F.when(direct, F.col("_event")).when(silent, S.RESOLVED).otherwise(S.HEARTBEAT),
        "emit_ts": F.when(direct, ts).otherwise(F.col("_opened") + F.col("_step") * F.lit(S.HEARTBEAT_MS)),
        "closed_by": F.when(direct, F.when(closed, "recovery")).when(silent, "stale")}
    return told.select(*(n for n in names if n != "temp_trend"), *(emitted[f.name].alias(f.name) for f in EMITTED.fields[:-1]),
                       *(n for n in names if n == "temp_trend"))


def replay(enriched: DataFrame, as_of_ms: int | None = None, max_rows: int = MAX_ROWS,
           context_rows: int = CONTEXT_ROWS, carry: list[str] | None = None) -> DataFrame:
    """Enriched readings to the incident stream: one row per OPENED, ESCALATED, HEARTBEAT and
    RESOLVED, each carrying the reading it refers to.

    ``as_of_ms`` ends the replay clock (default: just after the newest reading). ``carry``
    names the columns of the reading wanted on the result, ``temp_trend`` among them (default: all):
    readings are reduced to those that the lifecycle shows on, and these are written once.
    """
    wanted = set(enriched.columns if carry is None else [*carry, *ALWAYS])
    payload = [n for n in enriched.columns if n in wanted]
    plan, newest = plan_slices(enriched, max_rows, context_rows)
    as_of = F.lit(as_of_ms if as_of_ms is not None else None if newest is None else newest + 1).cast("bigint")
    readings = with_stretches(judged(sliced_by(_known(enriched), plan)))
    rows = freeze(lifecycle_rows(readings, as_of, payload, carry is None or "temp_trend" in carry), "lifecycle-rows")
    carried = freeze(carried_incidents(stretches(rows)), "open-incidents")
    return finish(events_on(rows, carried, as_of))


def finish(emitted: DataFrame) -> DataFrame:
    """Ranks back to names, incident id and (where its columns were carried) reason text."""
    def named(rank: str, names: list[str]):
        return F.element_at(F.array(*map(F.lit, names)), F.col(rank) + 1)

    quoted = {name for _, columns in rules.REASON_TEXT.values() for name in columns}
    named_rows = (
        emitted.withColumns({
            "alert_type": named("type_rank", S.ALERT_TYPES),
            "alert_severity": named("escalation_level", S.SEVERITIES),
            "incident_id": F.concat_ws(":", "freezer_id", F.col("incident_started_ts").cast("string")),
        })
        .drop("type_rank")
    )
    if quoted <= set(emitted.columns):
        named_rows = named_rows.withColumn("alert_reason", rules.reason())
    return named_rows


def summarize(incidents: DataFrame) -> DataFrame:
    """One row per incident: span, peak, highest level, final type and how it ended."""
    order = F.struct("emit_ts", rules.rank_of("lifecycle_event", [
        S.OPENED, S.ESCALATED, S.HEARTBEAT, S.RESOLVED]).alias("step"))
    return incidents.groupBy("freezer_id", "incident_id").agg(
        F.min("incident_started_ts").alias("opened_ts"),
        F.max("emit_ts").alias("last_ts"),
        F.max("peak_temp_c").alias("peak_temp_c"),
        F.max("escalation_level").alias("max_level"),
        F.max_by("alert_type", order).alias("final_type"),
        F.count_if(F.col("lifecycle_event") == S.ESCALATED).alias("escalations"),
        F.count_if(F.col("lifecycle_event") == S.HEARTBEAT).alias("heartbeats"),
        F.coalesce(F.max("closed_by"), F.lit("open")).alias("outcome"),
    )
