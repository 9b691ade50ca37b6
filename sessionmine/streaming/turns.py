"""Whole turns from a stream of session events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.paths import files_from_arguments, keep_inside
from ..functions.text import empty, head_tail_sizes
from ..plans.sessions import is_injected
from .stateful import PerSession, run_stateful

TURNS_OUT = "session_id STRING, turn INT, user STRING, assistant STRING, tools ARRAY<STRING>, files ARRAY<STRING>, closed_by STRING"


def extend(head: str, tail: str, n: int, piece: str, limit: int | None) -> tuple[str, str, int]:
    """Add a piece to a text of which only the start and the end are kept.

    `n` characters came before. Up to `limit` the text is all in `head`; beyond it, `head` and
    `tail` hold what a clip shows.
    """
    m = n + len(piece)
    if limit is None or m <= limit:
        return head + piece, "", m
    first, last = head_tail_sizes(limit)
    if n <= limit:
        whole = head + piece
        return whole[:first], whole[-last:], m
    return head, (tail + piece)[-last:], m


def shown(head: str, tail: str, n: int, limit: int | None) -> str:
    return head if limit is None or n <= limit else f"{head}…{tail}"


class TurnAssembler(PerSession):
    """One row per turn when it ends: by `turn/end`, by the first event of a later turn, by
    `session/disposed`, or by silence.

    The state of an open turn is its two clipped texts and its distinct tools and files, never
    its messages. Rows of a turn that has ended already come too late and are left out.
    """

    columns = [c.split()[0] for c in TURNS_OUT.split(", ")]

    def __init__(self, user_chars: int | None, assistant_chars: int | None, idle_ms: int):
        self.limits, self.idle_ms = {"user": user_chars, "assistant": assistant_chars}, idle_ms

    def init(self, handle) -> None:
        super().init(handle)
        text = [StructField(f"{role}_{part}", kind) for role in ("user", "assistant")
                for part, kind in (("head", StringType()), ("tail", StringType()), ("n", LongType()))]
        lists = [StructField(c, ArrayType(StringType())) for c in ("tools", "files")]
        self.open = handle.getMapState("open", StructType([StructField("turn", IntegerType())]), StructType([*text, *lists]))
        self.ended = handle.getValueState("ended", StructType([StructField("turn", IntegerType())]))

    def states(self) -> list:
        return [self.open, self.ended]

    def _close(self, key, turns: dict, upto: int | None, why: str) -> list[tuple]:
        out = []
        for turn in sorted(t for t in turns if upto is None or t <= upto):
            u, a = turns[turn]["user"], turns[turn]["assistant"]
            out.append((key[0], turn, shown(*u, self.limits["user"]), shown(*a, self.limits["assistant"]),
                        list(turns[turn]["tools"]), list(turns[turn]["files"]), why))
            del turns[turn]
        return out

    def _load(self) -> dict:
        return {int(turn): {"user": (v[0], v[1], v[2]), "assistant": (v[3], v[4], v[5]), "tools": dict.fromkeys(v[6]), "files": dict.fromkeys(v[7])}
                for (turn,), v in self.open.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns = self._load()
        before = set(turns)
        ended = self.ended.get()[0] if self.ended.exists() else None
        out, gone = [], False
        for r in self.take(rows).itertuples(index=False):
            if r.type == "session/disposed":
                out += self._close(key, turns, None, "session")
                gone = True
                continue
            if pd.isna(r.turn) or (ended is not None and r.turn <= ended):
                continue
            gone, turn = False, int(r.turn)
            earlier = [t for t in turns if t < turn]
            if earlier:
                out += self._close(key, turns, turn - 1, "next turn")
            if r.type == "turn/end":
                out += self._close(key, turns, turn, "turn end")
                ended = turn
                continue
            ended = max([t for t in earlier] + ([ended] if ended is not None else []), default=None)
            at = turns.setdefault(turn, {"user": ("", "", 0), "assistant": ("", "", 0), "tools": {}, "files": {}})
            if r.role in self.limits:
                at[r.role] = extend(*at[r.role], r.piece, self.limits[r.role])
            if r.tool:
                at["tools"].setdefault(r.tool)
            for f in r.files:
                at["files"].setdefault(f)
        if gone:
            self.forget()
        else:
            for t in before - set(turns):
                self.open.removeKey((t,))
            for t, v in turns.items():
                self.open.updateValue((t,), (*v["user"], *v["assistant"], list(v["tools"]), list(v["files"])))
            if ended is not None:
                self.ended.update((ended,))
        yield pd.DataFrame(out, columns=self.columns)

    def on_idle(self, key) -> list[tuple]:
        return self._close(key, self._load(), None, "silence")


def stream_turns(events: DataFrame, user_chars: int | None = None, assistant_chars: int | None = None,
                 idle: str = "24 hours", delay: str = "10 minutes") -> DataFrame:
    """Session events to turns, each once, when it ends (the batch job is `build_turns`).

    Paths, white space and injected messages are handled in columns; the state gets pieces of
    text and names only. Events of one session must come in the order of `seq` from batch to
    batch; inside a batch they are sorted.
    """
    kept = F.col("type").isin("turn/start", "turn/end", "user/message", "assistant/message", "tool/call", "session/disposed")
    own = ~((F.col("type") == "user/message") & is_injected("text", "source_kind"))
    role = F.when(F.col("type") == "user/message", "user").when(F.col("type") == "assistant/message", "assistant").otherwise("")
    call = F.col("type") == "tool/call"
    rows = events.filter(kept & own).select(
        "session_id", "seq", "ts", F.col("turn").cast("int").alias("turn"), "type", role.alias("role"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("piece"), F.when(call, F.col("tool")).otherwise("").alias("tool"),
        F.coalesce(F.when(call, keep_inside(files_from_arguments("arguments"), "cwd")), empty()).alias("files"))
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return run_stateful(rows, TurnAssembler(user_chars, assistant_chars, ms), TURNS_OUT, delay)
