"""Keyed state that built-in operators cannot express.

Small processors over `transformWithStateInPandas`, keyed by session.  The state is
bounded: one entry per item, failure or warning that is still open; an event-time timer
clears a session that stays silent for a day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

DELIVERY_OUT = "session_id STRING, seq LONG, turn INT, item_id STRING, form STRING"
REFLECT_OUT = "session_id STRING, turn INT, fresh_turns INT, reflect BOOLEAN, reason STRING"
PREVENT_OUT = "session_id STRING, fingerprint STRING, warned_turn INT, settled_turn INT"


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one session in one micro-batch, by sequence number."""
    parts = list(batches)
    if not parts:
        return pd.DataFrame()
    frame = parts[0] if len(parts) == 1 else pd.concat(parts)
    return frame if frame["seq"].is_monotonic_increasing else frame.sort_values("seq", kind="stable")


class Held:
    """A map state during one batch of a session: a key is read from the store once, and what
    has changed is written back once (`save`), however many rows touch it."""

    def __init__(self, state):
        self.state, self.rows, self.changed, self.whole = state, {}, set(), False

    def get(self, key: tuple) -> tuple | None:
        if key not in self.rows:
            known = not self.whole and self.state.containsKey(key)
            self.rows[key] = tuple(self.state.getValue(key)) if known else None
        return self.rows[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """None removes the key."""
        self.rows[key] = value
        self.changed.add(key)

    def items(self) -> list[tuple[tuple, tuple]]:
        if not self.whole:
            for key, value in self.state.iterator():
                self.rows.setdefault(tuple(key), tuple(value))
            self.whole = True
        return [(k, v) for k, v in self.rows.items() if v is not None]

    def clear(self) -> None:
        self.state.clear()
        self.rows, self.changed, self.whole = {}, set(), True

    def save(self) -> None:
        for key in self.changed:
            if self.rows[key] is not None:
                self.state.updateValue(key, self.rows[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)


class PerSession(StatefulProcessor):
    idle_ms = 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ms", LongType())]))

    def take(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The session's new rows; moves the timer that clears it once it is idle."""
        frame = _ordered(rows)
        if len(frame):
            latest = int(frame["ts"].max().timestamp() * 1000)
            before = (self.last.get() or (None,))[0]
            if before is None or latest > before:
                if before is not None:
                    self.handle.deleteTimer(before + self.idle_ms)
                self.last.update((latest,))
                self.handle.registerTimer(latest + self.idle_ms)
        return frame

    def states(self) -> list:
        return []

    def forget(self) -> None:
        """The session is over: drop its state and its timer."""
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[0] + self.idle_ms)
        for state in [*self.states(), self.last]:
            state.clear()

    def on_idle(self, key) -> list[tuple]:
        """Rows to give out when a session fell silent."""
        return []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        last = (self.last.get() or (0,))[0]
        if expiredTimerInfo.getExpiryTimeInMs() >= last + self.idle_ms:
            out = self.on_idle(key)
            for state in [*self.states(), self.last]:
                state.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class RepeatSuppressor(PerSession):
    """What a session is sent, row by row (`kind`):

    - `delivery`: full text or pointer. Full on first sight, new content, the same turn, or
      `every` turns after the last full one; a `compaction` row resets that.
    - `once` (warnings): once each, again after a `repeat` row (the failure came back), as long
      as fewer than `budget` different ones were sent (0: no limit).
    - `advisory` and `first_contact`: no item twice, one of them a turn, `advisories` different
      items a session; first contacts only up to `first_contacts`, and none after a
      `consulted` row.
    - `session/disposed` clears the session.

    An item, warning or advisory that was not touched for `ttl_ms` is forgotten.
    """

    columns = ["session_id", "seq", "turn", "item_id", "form"]

    def __init__(self, every: int = 10, budget: int = 5, advisories: int = 12, first_contacts: int = 1,
                 ttl_ms: int | None = None):
        self.every, self.budget = every, budget
        self.advisories, self.first_contacts, self.ttl_ms = advisories, first_contacts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        key = StructType([StructField("item", StringType())])
        at = StructField("ms", LongType())
        self.items = handle.getMapState("items", key, StructType([StructField("hash", StringType()), StructField("full_turn", IntegerType()), at]))
        self.sent = handle.getMapState("sent", key, StructType([StructField("again", BooleanType()), at]))
        self.advised = handle.getMapState("advised", key, StructType([at]))
        self.count = handle.getValueState("count", StructType([
            StructField("sent", IntegerType()), StructField("advised", IntegerType()), StructField("first", IntegerType()),
            StructField("turn", IntegerType()), StructField("consulted", BooleanType())]))

    def states(self) -> list:
        return [self.items, self.sent, self.advised, self.count]

    def _sweep(self, now: int) -> tuple[int, int]:
        """Forget what is older than `ttl_ms`; how many warnings and advisories that were."""
        gone = []
        for state in (self.items, self.sent, self.advised):
            old = [k for k, v in state.iterator() if v[-1] <= now - self.ttl_ms]
            for k in old:
                state.removeKey(k)
            gone.append(len(old))
        return gone[1], gone[2]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, gone = [], False
        n_sent, n_advised, first, last_turn, consulted = self.count.get() if self.count.exists() else (0, 0, 0, None, False)
        frame = self.take(rows)
        if self.ttl_ms is not None and len(frame):
            a, b = self._sweep(int(frame["ts"].min().timestamp() * 1000))
            n_sent, n_advised = n_sent - a, n_advised - b
        items, sent, advised = held = [Held(s) for s in (self.items, self.sent, self.advised)]
        for r in frame.itertuples(index=False):
            gone = r.kind == "session/disposed"
            if gone:
                for state in [*held, self.count]:
                    state.clear()
                n_sent, n_advised, first, last_turn, consulted = 0, 0, 0, None, False
            elif r.kind == "compaction":
                items.clear()
            elif r.kind == "consulted":
                consulted = True
            elif r.kind == "repeat":
                if sent.get((r.item_id,)) is not None:
                    sent.put((r.item_id,), (True, self._ms(r)))
            elif r.kind == "once":
                known = sent.get((r.item_id,))
                if (known is not None and not known[0]) or (self.budget > 0 and n_sent >= self.budget):
                    continue
                n_sent += known is None  # the budget counts different warnings
                sent.put((r.item_id,), (False, self._ms(r)))
                out.append((key[0], r.seq, int(r.turn), r.item_id, "once" if known is None else "again"))
            elif r.kind in ("advisory", "first_contact"):
                opening = r.kind == "first_contact"
                if ((opening and (consulted or first >= self.first_contacts)) or n_advised >= self.advisories
                        or last_turn == r.turn or advised.get((r.item_id,)) is not None):
                    continue
                n_advised, first, last_turn = n_advised + 1, first + opening, int(r.turn)
                advised.put((r.item_id,), (self._ms(r),))
                out.append((key[0], r.seq, int(r.turn), r.item_id, r.kind))
            else:
                k = (r.item_id,)
                old = items.get(k)
                full = (old is None or old[0] != r.content_hash or old[1] == r.turn
                        or (self.every > 0 and r.turn - old[1] >= self.every))
                items.put(k, (r.content_hash, int(r.turn) if full else old[1], self._ms(r)))
                out.append((key[0], r.seq, int(r.turn), r.item_id, "full" if full else "pointer"))
        if gone:
            self.forget()
        else:
            for state in held:
                state.save()
            self.count.update((n_sent, n_advised, first, last_turn, consulted))
        yield pd.DataFrame(out, columns=self.columns)

    @staticmethod
    def _ms(row) -> int:
        return int(row.ts.timestamp() * 1000)


class ReflectTrigger(PerSession):
    """Decide at each `turn_end` row whether to reflect.

    Rows carry `signal` (tools or files were used), `correction`, `novelty` and
    `new_ground`; `result` rows report how many cards a reflection produced. The session
    counts its own empty results, or, with `shared`, rows bring the streak of their library
    (`empty_streak`, see `streaming.library`).
    """

    columns = ["session_id", "turn", "fresh_turns", "reflect", "reason"]

    def __init__(self, min_turns: int = 3, threshold: float = 0.15, backoff_after: int = 5, shared: bool = False):
        self.min_turns, self.threshold, self.backoff_after, self.shared = min_turns, threshold, backoff_after, shared

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", StructType([
            StructField("fresh", IntegerType()), StructField("signal", BooleanType()), StructField("correction", BooleanType()),
            StructField("ground", BooleanType()), StructField("empty", IntegerType())]))

    def states(self) -> list:
        return [self.state]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh, signal, correction, ground, empty = self.state.get() or (0, False, False, False, 0)
        out = []
        frame = self.take(rows)
        # Columns and not `itertuples`, which makes a class of its own for every session.
        names = ["kind", "created", "turn", "signal", "correction", "novelty", "new_ground", "empty_streak" if self.shared else "created"]
        for kind, created, turn, signals, corrects, novelty, grounds, streak in zip(*[frame[c].tolist() for c in names] if len(frame) else []):
            if kind == "result":
                empty = 0 if created > 0 else empty + 1
            if kind != "turn_end":
                continue
            if self.shared:
                empty = int(streak)
            fresh, signal = fresh + 1, bool(signal or signals)
            correction, ground = bool(correction or corrects), bool(ground or grounds)
            if fresh < self.min_turns:
                reason = "few_turns"
            elif not (signal or correction):
                reason = "no_signal"
            elif correction:
                reason = "correction"
            elif empty >= self.backoff_after and not ground:
                reason = "backoff"
            elif ground:
                reason = "new_ground"
            else:
                reason = "novel" if novelty >= self.threshold else "not_novel"
            reflect = reason in ("correction", "new_ground", "novel")
            out.append((key[0], int(turn), fresh, reflect, reason))
            if reflect:
                fresh, signal, correction, ground = 0, False, False, False
        self.state.update((fresh, signal, correction, ground, empty))
        yield pd.DataFrame(out, columns=self.columns)


class PreventionSettler(PerSession):
    """Warnings that stay without a repeat for `window` turns.

    `warning` rows open one per failure, `observe` rows close it, `turn_end` rows settle.
    """

    columns = ["session_id", "fingerprint", "warned_turn", "settled_turn"]

    def __init__(self, window: int = 3):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        key = StructType([StructField("fingerprint", StringType())])
        turn = StructType([StructField("turn", LongType())])
        self.open = handle.getMapState("open", key, turn)
        self.seen = handle.getMapState("seen", key, turn)

    def states(self) -> list:
        return [self.open, self.seen]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        frame = self.take(rows)
        opened, seen = Held(self.open), Held(self.seen)
        for r in frame.itertuples(index=False):
            k = (r.fingerprint,)
            if r.kind == "warning":
                if opened.get(k) is None:
                    opened.put(k, (int(r.turn),))
            elif r.kind == "observe":
                seen.put(k, (int(r.turn),))
                if opened.get(k) is not None:
                    opened.put(k, None)
            else:
                for (fp,), (turn,) in opened.items():
                    last = (seen.get((fp,)) or (-1,))[0]
                    if last < turn and r.turn - turn >= self.window:
                        opened.put((fp,), None)
                        out.append((key[0], fp, int(turn), int(r.turn)))
        opened.save()
        seen.save()
        yield pd.DataFrame(out, columns=self.columns)


def run_stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    """Needs `spark.sql.streaming.stateStore.providerClass` set to the RocksDB provider."""
    return rows.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def deliver_once(rows: DataFrame, every: int = 10, budget: int = 5, delay: str = "10 minutes", advisories: int = 12,
                 first_contacts: int = 1, ttl: str | None = None) -> DataFrame:
    """`session_id, seq, ts, turn, kind, item_id, content_hash` (kinds: see `RepeatSuppressor`)
    to `session_id, seq, turn, item_id, form` for what is sent."""
    ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    return run_stateful(rows, RepeatSuppressor(every, budget, advisories, first_contacts, ms), DELIVERY_OUT, delay)


def reflect_trigger(rows: DataFrame, min_turns: int = 3, threshold: float = 0.15, backoff_after: int = 5,
                    delay: str = "10 minutes", shared_streak: bool = False) -> DataFrame:
    """`session_id, seq, ts, turn, kind (turn_end|result|skipped), signal, correction, novelty,
    new_ground, created`; with `shared_streak` also `empty_streak`, from `library.share_streaks`."""
    return run_stateful(rows, ReflectTrigger(min_turns, threshold, backoff_after, shared_streak), REFLECT_OUT, delay)


def settle_prevention(rows: DataFrame, window: int = 3, delay: str = "10 minutes") -> DataFrame:
    """`session_id, seq, ts, turn, kind (warning|observe|turn_end), fingerprint`."""
    return run_stateful(rows, PreventionSettler(window), PREVENT_OUT, delay)
