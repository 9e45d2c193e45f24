"""Sessions, laps and setups online: one keyed state, all events from one pass.

Rows of a key wait in state until the watermark has passed their minute, then they
are stepped through in time order. So shuffled rows give the same events as the
batch operators, and a lap is kept as running numbers, not as its rows.
"""

import json
import pickle
import sys
import time
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapline import fixed_values as fixed
from lapline.functions import columns as C

# The processor travels to the workers as a whole: no install on the executors, and
# below it only names of this module, pandas and PySpark are used.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WATERMARK = "10 minutes"
_PARAMETERS = fixed.SETUP_PARAMETERS
_TOLERANCE = fixed.BRAKE_BIAS_TOLERANCE
_TYRES = C.wheel_columns("tyre_temp") + C.wheel_columns("tyre_pressure")

_READ = (
    "ts_us long, packet_id long, status string, car string, track string, session_type string, "
    "completed_laps int, last_lap_time_ms int, best_lap_time_ms int, last_sector_time_ms int, "
    "is_valid_lap boolean, is_in_pit boolean, speed_kmh double, fuel_remaining double, "
    + ", ".join(f"{c} double" for c in _TYRES)
    + ", " + ", ".join(f"{p} double" for p in _PARAMETERS)
)
MINUTE_MS = 60_000
EVENTS_PER_FRAME = 5000
#: Waiting rows lie in intervals of so many minutes each; those of a finer level lie inside one of a coarser level.
WIDTHS = (1, 64, 4096, 262_144)
#: Rows an interval is to hold where rows are few, and the most that are put in order at a time (or one minute's).
ROWS_PER_INTERVAL, ROWS_AT_ONCE = 64, 20_000
_INTERVAL, _ROWS = "end_ms long, level int, part long, n int", "rows binary"
_NAMES = [item.split()[0] for item in _READ.split(", ")]
_WHOLE = [item.split()[1] in ("int", "long") for item in _READ.split(", ")]
_TIME, _PACKET = _NAMES.index("ts_us"), _NAMES.index("packet_id")
_STATE = (
    "active boolean, session_no long, seen boolean, car string, track string, "
    "session_type string, completed_laps int, best_lap_time_ms int, live_laps int, "
    + ", ".join(f"{p} double" for p in _PARAMETERS)
    + ", segment_no long, samples long, speed_sum double, speed_n long, speed_max double, fuel_max double, "
      "fuel_min double, first_us long, last_us long"
)
_STATE_NAMES = [item.split()[0] for item in _STATE.split(", ")]
_START = {"active": False, "session_no": 0, "seen": False, "segment_no": 0, "samples": 0,
          "speed_sum": 0.0, "speed_n": 0}

EVENTS = (
    "kind string, session_id string, session_no long, ts_us long, car string, track string, "
    "session_type string, total_laps int, best_lap_ms int, lap_number int, lap_time_ms int, "
    "last_sector_time_ms int, is_valid boolean, fuel_remaining double, "
    + ", ".join(f"{c} double" for c in _TYRES)
    + ", parameter string, old_value double, new_value double, lap_applied_from int, "
    + ", ".join(f"{p} double" for p in _PARAMETERS)
    + ", segment_no long, samples long, max_speed double, avg_speed double, fuel_used double, "
      "first_us long, last_us long"
)
_EVENT_NAMES = [item.split()[0] for item in EVENTS.split(", ")]
# a frame of many columns, or a struct of them, costs far more to pass on than the events in it: they leave a task as text
_TEXTS = "session_id string, events string"
_EVENT_LIST = "array<struct<" + ", ".join("{}: {}".format(*item.split()) for item in EVENTS.split(", ")) + ">>"


def _segment(state: dict) -> list[dict]:
    """The lap held so far as an event; nothing if it has no samples."""
    events = []
    if state["samples"]:
        events.append({
            "kind": "lap_segment", "session_no": state["session_no"], "ts_us": state["last_us"],
            "car": state["car"], "track": state["track"], "lap_number": state["completed_laps"],
            "segment_no": state["segment_no"], "samples": state["samples"],
            "max_speed": state["speed_max"],
            "avg_speed": state["speed_sum"] / state["speed_n"] if state["speed_n"] else None,
            "fuel_used": None if state["fuel_max"] is None else state["fuel_max"] - state["fuel_min"],
            "first_us": state["first_us"], "last_us": state["last_us"],
        })
    state.update(samples=0, speed_sum=0.0, speed_n=0, speed_max=None, fuel_max=None, fuel_min=None)
    return events


def _lap_ends(now: int | None, before: int | None) -> bool:
    """Whether the lap count went up; a count that is missing on either side says nothing."""
    return now is not None and before is not None and now > before >= 0


def _of_both(choose, held: float | None, value: float | None) -> float | None:
    """The larger or smaller of two numbers either of which may be missing."""
    if held is None or value is None:
        return value if held is None else held
    return choose(held, value)


def _setup_event(state: dict, row: dict, lap: int) -> dict:
    return {
        "kind": "setup_snapshot", "session_no": state["session_no"], "ts_us": row["ts_us"],
        "car": row["car"], "track": row["track"], "lap_applied_from": lap,
        **{p: row[p] for p in _PARAMETERS},
    }


def _live_events(state: dict, row: dict) -> Iterator[dict]:
    """Lap completions and setup changes between two live samples of a session."""
    here = {"session_no": state["session_no"], "ts_us": row["ts_us"]}
    if _lap_ends(row["completed_laps"], state["live_laps"]):
        yield {
            "kind": "lap_completion", **here, "lap_number": row["completed_laps"],
            "lap_time_ms": row["last_lap_time_ms"], "is_valid": row["is_valid_lap"],
            "last_sector_time_ms": row["last_sector_time_ms"],
            "fuel_remaining": row["fuel_remaining"],
            **{c: row[c] for c in _TYRES},
        }
    for parameter in _PARAMETERS:
        old, new = state[parameter], row[parameter]
        if old is None or old == new:
            continue
        close = parameter == "brake_bias" and new is not None
        if close and abs(old - new) < _TOLERANCE:
            continue
        yield {"kind": "setup_change", **here, "parameter": parameter, "old_value": old,
               "new_value": new, "lap_number": row["completed_laps"]}
        yield _setup_event(state, row, row["completed_laps"])


def step(state: dict, row: dict) -> list[dict]:
    """One sample: changes the state and gives the events it causes."""
    events, status = [], row["status"]
    if status == "live" and not state["active"]:
        state.update(active=True, session_no=state["session_no"] + 1, seen=False,
                     segment_no=state["segment_no"] + 1, live_laps=row["completed_laps"])
        events.append({
            "kind": "session_start", "session_no": state["session_no"], "ts_us": row["ts_us"],
            "car": row["car"], "track": row["track"], "session_type": row["session_type"],
        })
        events.append(_setup_event(state, row, 0))
    elif status in ("off", "pause") and state["active"]:
        events += _segment(state)
        events.append({
            "kind": "session_end", "session_no": state["session_no"], "ts_us": row["ts_us"],
            "car": state["car"], "track": state["track"], "session_type": state["session_type"],
            "total_laps": state["completed_laps"], "best_lap_ms": state["best_lap_time_ms"],
        })
        state["active"] = False
    elif status == "live":
        events += _live_events(state, row)
    if state["active"]:
        if state["seen"] and _lap_ends(row["completed_laps"], state["completed_laps"]):
            events += _segment(state)
            state["segment_no"] += 1
        if not row["is_in_pit"]:
            speed, fuel = row["speed_kmh"], row["fuel_remaining"]
            state["speed_max"] = _of_both(max, state["speed_max"], speed)
            state["fuel_max"] = _of_both(max, state["fuel_max"], fuel)
            state["fuel_min"] = _of_both(min, state["fuel_min"], fuel)
            state["first_us"] = state["first_us"] if state["samples"] else row["ts_us"]
            state["last_us"] = row["ts_us"]
            if speed is not None:
                state["speed_sum"] += speed
                state["speed_n"] += 1
            state["samples"] += 1
        state["seen"] = True
    if status == "live":
        state["live_laps"] = row["completed_laps"]
        state.update({p: row[p] for p in _PARAMETERS})
    state.update({c: row[c] for c in
                  ("car", "track", "session_type", "completed_laps", "best_lap_time_ms")})
    return events


def _frame(key, events: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"session_id": [key[0]], "events": [json.dumps(events)]})


def _values(row: dict) -> tuple:
    # pandas holds whole numbers among NULLs as floats
    return tuple(None if v is None or v != v else int(v) if whole else v
                 for v, whole in zip(map(row.get, _NAMES), _WHOLE))


def _end(ms: int, level: int = 0) -> int:
    """End of the interval of a level that a time lies in."""
    width = WIDTHS[level] * MINUTE_MS
    return (ms // width + 1) * width


def _minute(row: tuple) -> int:
    return _end(row[_TIME] // 1000)


def _order(row: tuple) -> tuple:
    packet = row[_PACKET]
    return row[_TIME], packet is not None, packet or 0


def _start(interval: tuple) -> int:
    return interval[0] - WIDTHS[interval[1]] * MINUTE_MS


def _level(minutes: list[int], most: int) -> int:
    """The finest level, up to ``most``, at which rows of these minutes lie in few intervals."""
    few = max(4, len(minutes) // ROWS_PER_INTERVAL)
    for level in range(most):
        width = WIDTHS[level] * MINUTE_MS
        if len({(end - 1) // width for end in minutes}) <= few:
            return level
    return most


class Lifecycle(StatefulProcessor):
    """Holds rows until the watermark has passed their minute, then steps through them in time order.

    A call to the state costs far more than a row, so rows wait together: in minutes where a key has many of them, in
    hours or days where it has few. Of a key that has more in an interval than a task may hold, the interval is dealt
    into finer ones, down to minutes, before its rows are put in order. So a task never has more than 20,000 rows, or
    one minute, of one key in memory, however much of the stream that key is. A micro-batch adds its part to an interval
    and rewrites nothing that is there.
    """

    def __init__(self, idle_ms: int | None = None):
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", _INTERVAL, _ROWS)
        self._value = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        part = time.time_ns()  # later than any part so far: what waits needs no look
        for batch in rows:
            values = [_values(row) for row in batch["row"]]
            self._handle.registerTimer(min(map(_minute, values)))
            self._hold(values, part)
            part += 1
        return iter(())

    def _hold(self, rows: list[tuple], part: int, most: int = len(WIDTHS) - 1) -> list[tuple]:
        """Rows into the state, and the intervals they lie in."""
        level = _level([_minute(row) for row in rows], most)
        dealt = {}
        for row in rows:
            dealt.setdefault(_end(row[_TIME] // 1000, level), []).append(row)
        intervals = []
        for end, held in dealt.items():
            intervals.append((end, level, part, len(held)))
            self._waiting.updateValue(intervals[-1], (pickle.dumps(held),))
        return intervals

    def _take(self, interval: tuple) -> list[tuple]:
        rows = pickle.loads(self._waiting.getValue(interval)[0])
        self._waiting.removeKey(interval)
        return rows

    def _passed(self, waiting: list[tuple], passed: int, left: list[int]) -> Iterator[list[tuple]]:
        """Rows of the minutes that have passed, in order; ``left`` gets the times to look at what waits on."""
        part = time.time_ns()
        # a coarse interval comes before the finer ones inside it
        todo = sorted(waiting, key=lambda x: (_start(x), -x[1]))
        while todo and _start(todo[0]) < passed:
            end = todo[0][0]
            inside = list(takewhile(lambda x: x[0] <= end, todo))
            todo = todo[len(inside):]
            coarsest = inside[0][1]
            if coarsest and sum(n for _, _, _, n in inside) > ROWS_AT_ONCE:
                finer = [x for x in inside if x[1] < coarsest]
                for x in inside[:len(inside) - len(finer)]:
                    finer += self._hold(self._take(x), part, coarsest - 1)
                    part += 1
                todo = sorted(finer, key=lambda x: (_start(x), -x[1])) + todo
                continue
            if not coarsest and end > passed:
                left.append(end)
                continue
            rows = sorted((row for x in inside for row in self._take(x)), key=_order)
            later = [row for row in rows if _minute(row) > passed]
            if later:
                self._hold(later, part)
                part += 1
                left.append(_minute(later[0]))
            yield rows[:len(rows) - len(later)]
        if todo:
            left.append(_start(todo[0]) + MINUTE_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = list(self._waiting.keys())
        if self._idle_ms is None and not any(_start(x) < passed for x in waiting):
            return  # an earlier timer has worked off the interval
        held = self._value.get()
        state = dict(zip(_STATE_NAMES, held)) if held else dict.fromkeys(_STATE_NAMES) | _START
        events, left = [], []
        for rows in self._passed(waiting, passed, left):
            for row in rows:
                row = dict(zip(_NAMES, row))
                if self._idle_ms is not None and row["ts_us"] > self._quiet_at(state) * 1000:
                    events += _segment(state)
                events += step(state, row)
                if len(events) > EVENTS_PER_FRAME:
                    yield _frame(key, events)
                    events = []
        if left:
            self._handle.registerTimer(min(left))
        if self._idle_ms is not None and state["samples"]:
            due = _end(int(self._quiet_at(state)))
            if due > passed:
                self._handle.registerTimer(due)
            else:
                events += _segment(state)
        self._value.update(tuple(state[n] for n in _STATE_NAMES))
        if events:
            yield _frame(key, events)

    def _quiet_at(self, state: dict) -> float:
        """When the lap held counts as over for want of samples."""
        return state["last_us"] / 1000 + self._idle_ms if state["samples"] else float("inf")

    def close(self) -> None:
        pass


def needed(samples: DataFrame) -> DataFrame:
    """The columns of samples that ``lifecycle_events`` reads."""
    names = {"session_id", "timestamp_wall", *_NAMES}
    return samples.select(*[c for c in samples.columns if c in names])


def lifecycle_events(samples: DataFrame, watermark: str = WATERMARK,
                     idle_ms: int | None = None) -> DataFrame:
    """All events of a stream of samples, told apart by ``kind``.

    Rows later than the watermark are dropped and counted by Spark. ``idle_ms`` also
    gives out the lap of an open session after that much event time without samples.
    """
    at = F.col("timestamp_wall").cast("timestamp")
    columns = {c: F.col(c) for c in samples.columns}
    packet = columns.get("packet_id", F.lit(0)).cast("long")
    read = {"ts_us": F.unix_micros("event_time"), "packet_id": packet}
    kinds = dict(item.split() for item in _READ.split(", "))
    timed = samples.withColumn("event_time", at).withWatermark("event_time", watermark)
    # a frame of one column is made far faster than one of many
    rows = timed.select("session_id", "event_time", F.struct(*[
        read.get(n, F.col(n)).cast(kinds[n]).alias(n) for n in _NAMES
    ]).alias("row"))
    texts = rows.groupBy("session_id").transformWithStateInPandas(
        Lifecycle(idle_ms), outputStructType=_TEXTS, outputMode="Append", timeMode="EventTime"
    )
    return texts.select("session_id", F.explode(F.from_json("events", _EVENT_LIST)).alias("e")).select(
        *["session_id" if name == "session_id" else f"e.{name}" for name in _EVENT_NAMES])


_COLUMNS = {
    "session_start": "session_no car track session_type",
    "session_end": "session_no car track session_type total_laps best_lap_ms",
    "lap_completion": "session_no lap_number lap_time_ms last_sector_time_ms is_valid fuel_remaining "
                      + " ".join(_TYRES),
    "setup_change": "session_no parameter old_value new_value lap_number",
    "setup_snapshot": "session_no car track lap_applied_from " + " ".join(_PARAMETERS),
    "lap_segment": "session_no segment_no lap_number samples max_speed avg_speed fuel_used "
                   "first_us last_us",
}


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """One kind of event with its own columns."""
    return events.where(F.col("kind") == kind).select(
        "session_id", "ts_us", *_COLUMNS[kind].split()
    )
