"""Stateful processors that order rows by event time before they act.

Rows wait in state until the watermark has passed them, so what comes out does not depend on
how the input was split into micro-batches: it equals the batch operator on the same rows.
Rows later than the watermark are dropped by Spark.

What waits is kept as Arrow batches, one for the rows of a micro-batch, and worked on by columns: adding a row to a list in
state reads all that is in the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PACK_ROWS = 1 << 20  # rows put into state as one batch


def _ms_up(us: int) -> int:
    return -(-us // 1000)


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packs: list[bytes]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(pack).read_all() for pack in packs]).to_pandas()


class OrderedProcessor(StatefulProcessor):
    """Keeps rows in ``pending`` until they are final, then gives them to ``step`` in order.

    Subclasses set ``pending_types`` (names and Arrow types; the first two columns, LONGs, order the rows), ``columns``, and
    ``step(key, rows, watermark_us)``, which returns output columns; ``due`` names the event time
    at which the key must be looked at again though no row comes.
    """

    pending_types: dict[str, str] = {}
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([(name, pa.type_for_alias(kind)) for name, kind in self.pending_types.items()])
        self.pending = handle.getListState("pending", "rows binary")
        self.timer = handle.getValueState("timer", "at bigint")
        self.open_states(handle)

    def open_states(self, handle: StatefulProcessorHandle) -> None:
        pass

    def take(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Pending rows of an input frame."""
        return frame[list(self.pending_types)]

    def step(self, key: tuple, rows: pd.DataFrame, watermark_us: int) -> list:
        raise NotImplementedError

    def due(self) -> int | None:
        return None

    def _wake(self, old: int | None, at_us: int | None) -> None:
        """Have one timer set, for the given event time, where ``old`` was set."""
        new = None if at_us is None else _ms_up(at_us)
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)
            self.timer.update((new,))
        else:
            self.timer.clear()

    def _put(self, taken: list[pd.DataFrame]) -> None:
        rows = taken[0] if len(taken) == 1 else pd.concat(taken, ignore_index=True)
        self.pending.appendValue((_packed(rows, self.schema),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, count = None, [], 0
        for frame in rows:
            taken = self.take(frame)
            if len(taken):
                earliest = int(taken["t"].min())
                first = earliest if first is None else min(first, earliest)
                held.append(taken)
                count += len(taken)
            if count >= _PACK_ROWS:
                self._put(held)
                held, count = [], 0
        if held:
            self._put(held)
        if first is not None:
            known = self.timer.get()
            set_at = int(known[0]) if known else None
            if set_at is None or _ms_up(first) < set_at:
                self._wake(set_at, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        packs = [row[0] for row in self.pending.get()] if self.pending.exists() else []
        rows = _unpacked(packs) if packs else self.schema.empty_table().to_pandas()
        at = rows["t"].to_numpy()
        final, later = rows[at <= watermark_us], rows[at > watermark_us]
        order = np.lexsort((final.iloc[:, 1].to_numpy(), final["t"].to_numpy()))
        out = self.step(key, final.iloc[order], watermark_us)
        if packs:
            if len(later):
                self.pending.put([(_packed(later, self.schema),)])
            else:
                self.pending.clear()
        times = [t for t in (int(later["t"].min()) if len(later) else None, self.due()) if t is not None]
        # The timer that brought us here is gone by itself.
        self.timer.clear()
        self._wake(None, min(times, default=None))
        if out and len(out[-1]):
            yield pd.DataFrame(dict(zip(self.columns, out)), columns=self.columns)

    def close(self) -> None:
        pass


class CollapseProcessor(OrderedProcessor):
    """Anchored windows of one (source, level, message)."""

    pending_types = {"t": "int64", "line_id": "int64", "n": "int64"}
    columns = ["source", "level", "message", "line_id", "count", "first_us", "last_us"]

    def __init__(self, window_us: int):
        self.window_us = window_us

    def open_states(self, handle):
        self.window = handle.getValueState("window", "first bigint, line_id bigint, n bigint, last bigint")

    def take(self, frame):
        # Lines at one instant count together under the lowest id.
        at = frame.groupby("t")["line_id"].agg(["min", "size"]).reset_index()
        return at.set_axis(["t", "line_id", "n"], axis=1)

    def due(self):
        known = self.window.get()
        return int(known[0]) + self.window_us if known else None

    def step(self, key, rows, watermark_us):
        known = self.window.get()
        current = tuple(int(v) for v in known) if known else None
        t, line_id, n = (rows[c].to_numpy() for c in self.pending_types)
        sums = np.concatenate([[0], np.cumsum(n)])
        closed, at = [], 0
        while True:
            if current is not None:
                past = at + int(np.searchsorted(t[at:], current[0] + self.window_us, "right"))
                if past > at:
                    current = (current[0], current[1], current[2] + int(sums[past] - sums[at]), int(t[past - 1]))
                at = past
            if at == len(t):
                break
            if current is not None:
                closed.append(current)
            current = (int(t[at]), int(line_id[at]), 0, int(t[at]))
        if current is not None and current[0] + self.window_us <= watermark_us:
            closed.append(current)
            current = None
        if current is not None:
            self.window.update(current)
        elif known:
            self.window.clear()
        if not closed:
            return []
        first, lines, counts, last = zip(*closed)
        return [*([part] * len(closed) for part in key), lines, counts, first, last]


class AlertProcessor(OrderedProcessor):
    """Error rate and cooldown of one rule.

    Only the fires that pass come out; the clock and the counted errors are kept by rule name.
    """

    pending_types = {
        "t": "int64", "line_id": "int64", "source": "string", "message": "string", "severity": "string", "rate": "bool",
        "need": "int64", "window_us": "int64", "cooldown_us": "int64",
    }
    columns = ["rule_name", "severity", "message", "source", "count", "fired_us", "line_id"]

    def open_states(self, handle):
        self.errors = handle.getValueState("errors", "times binary")
        self.clock = handle.getValueState("clock", "t bigint")

    def take(self, frame):
        # Of the lines of one instant only the first can pass a cooldown; a rate needs them all.
        ordered = frame.sort_values(["t", "line_id"])
        return ordered.loc[ordered["rate"] | ~ordered["t"].duplicated(), list(self.pending_types)]

    def step(self, key, rows, watermark_us):
        held, clock = self.errors.get(), self.clock.get()
        counted = np.frombuffer(held[0], dtype=np.int64) if held else np.zeros(0, dtype=np.int64)
        last = int(clock[0]) if clock else None
        t = rows["t"].to_numpy()
        settings = [rows[c].to_numpy() for c in ("rate", "need", "window_us", "cooldown_us")]
        # A rule that was changed has rows of both forms waiting.
        changes = np.flatnonzero(np.any([s[1:] != s[:-1] for s in settings], axis=0)) + 1
        chosen, counts = [], []
        for low, high in zip([0, *changes.tolist()], [*changes.tolist(), len(t)]) if len(t) else ():
            rate, need, window_us, cooldown_us = (s[low].item() for s in settings)
            if rate:
                fired, found, counted = rate_fires(t[low:high], counted, need, window_us)
            else:
                fired, found = np.arange(high - low), None
            passed, last = after_cooldown(t[low:high][fired], cooldown_us, last)
            chosen.append(low + fired[passed])
            counts.append(np.zeros(len(passed), dtype=np.int64) if found is None else found[passed])
        if len(counted):
            self.errors.update((counted.tobytes(),))
        elif held:
            self.errors.clear()
        if last is not None:
            self.clock.update((last,))
        if not chosen:
            return []
        out = rows.iloc[np.concatenate(chosen)]
        texts = [out[c].to_numpy() for c in ("severity", "message", "source")]
        return [[key[0]] * len(out), *texts, np.concatenate(counts), out["t"].to_numpy(), out["line_id"].to_numpy()]


def rate_fires(t: np.ndarray, counted: np.ndarray, need: int, window_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where errors at the sorted times ``t`` bring the count of a window to ``need``, after those in ``counted``.

    Returns places in ``t``, the count at each, and the times counted in the end. A fire starts the count from zero.
    """
    known = len(counted)
    times = np.concatenate([counted, t])
    # A full count ends where the error ``need - 1`` before is young enough, and not taken by a fire.
    back = max(need, 1) - 1
    full = np.flatnonzero(times[: max(len(times) - back, 0)] >= times[back:] - window_us) + back
    full = full[full >= known]
    fired, counts, start, at = [], [], 0, 0
    while True:
        at = at + int(np.searchsorted(full[at:], start + back))
        if at >= len(full):
            break
        place = int(full[at])
        oldest = int(np.searchsorted(times, times[place] - window_us))
        fired.append(place - known)
        counts.append(place - max(start, oldest) + 1)
        start = place + 1
    rest = max(start, int(np.searchsorted(times, times[-1] - window_us)))
    return np.array(fired, dtype=np.int64), np.array(counts, dtype=np.int64), times[rest:]


def after_cooldown(t: np.ndarray, cooldown_us: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Places of the sorted times that pass a cooldown, where the last one before passed at ``last``; and the last one now."""
    if cooldown_us <= 0:
        return np.arange(len(t)), last
    passed, at = [], 0
    while True:
        if last is not None:
            at += int(np.searchsorted(t[at:], last + cooldown_us))
        if at >= len(t):
            return np.array(passed, dtype=np.int64), last
        passed.append(at)
        last = int(t[at])


class HealthProcessor(OrderedProcessor):
    """State of the sources of one shard: their changes, or a source's state after each of its events.

    Sources are a column, not the key: state is read and written once for a shard, whatever the number of its sources.
    """

    pending_types = {"t": "int64", "seq": "int64", "source": "string", "kind": "string", "status": "string", "error": "string"}
    known_types = {"source": "string", "status": "string", "last_error": "string", "errors": "int64", "start": "int64"}

    def __init__(self, changes: bool):
        self.changes = changes
        self.columns = (
            ["source", "at_us", "seq", "old_status", "new_status"] if changes
            else ["source", "at_us", "seq", "status", "last_error", "error_count", "start_us"]
        )

    def open_states(self, handle):
        self.state = handle.getValueState("state", "sources binary")
        self.known_schema = pa.schema([(name, pa.type_for_alias(kind)) for name, kind in self.known_types.items()])

    def step(self, key, rows, watermark_us):
        if not len(rows):
            return []
        held = self.state.get()
        known = _unpacked([held[0]]) if held else self.known_schema.empty_table().to_pandas()
        # What is known comes first, so its sources have the numbers of its rows.
        numbers, names = pd.factorize(pd.concat([known["source"], rows["source"]], ignore_index=True), use_na_sentinel=False)
        order = np.argsort(numbers[len(known):], kind="stable")  # a source's rows together, still in order of time
        of = numbers[len(known):][order]
        t, seq, source, kind, status, error = (rows[c].to_numpy()[order] for c in self.pending_types)
        places = np.arange(len(t))
        first = np.concatenate([[True], of[1:] != of[:-1]])
        head = np.maximum.accumulate(np.where(first, places, 0))
        fresh = len(names) - len(known)
        old = np.concatenate([known["status"].to_numpy(dtype=object), np.full(fresh, "", dtype=object)])
        last_error = np.concatenate([known["last_error"].to_numpy(dtype=object), np.full(fresh, None, dtype=object)])
        errors = np.concatenate([known["errors"].to_numpy(), np.zeros(fresh, dtype=np.int64)])
        start = np.concatenate([known["start"].to_numpy(), np.zeros(fresh, dtype=np.int64)])
        new = first & (of >= len(known))
        start[of[new]] = t[new]
        registers = kind == "register"
        failed = ~registers & ~pd.isna(error)
        status = np.where(pd.isna(status), None, status)
        status = np.where(registers, "starting", status)
        before = np.concatenate([[None], status[:-1]])
        before[first] = old[of[first]]
        # Each row counts from the last registration of its source, or from what was known.
        begun = np.maximum.accumulate(np.where(registers, places, -1))
        anew = begun >= head
        total = np.cumsum(failed)
        counts = np.where(anew, total - total[begun], total - total[head] + failed[head] + errors[of])
        told = np.maximum.accumulate(np.where(failed, places, -1))
        texts = np.where((told >= head) & (told > begun), error[told], np.where(anew, None, last_error[of]))
        starts = np.where(anew, t[begun], start[of])
        last = np.concatenate([first[1:], [True]])
        for kept, values in ((old, status), (last_error, texts), (errors, counts), (start, starts)):
            kept[of[last]] = values[last]
        self.state.update((_packed(pd.DataFrame(dict(zip(self.known_types, (names, old, last_error, errors, start)))), self.known_schema),))
        if self.changes:
            out = ~registers & (before != status)
            return [source[out], t[out], seq[out], before[out], status[out]]
        return [source, t, seq, status, texts, counts, starts]
