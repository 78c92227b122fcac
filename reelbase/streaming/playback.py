"""Playing back predicted chunks over the ticks of a rollout: stateful over a stream, and the same as a batch.

A rollout's state is composite: the chunk in play and the place in it, the first value (latched for the whole rollout), when it began, and the last step answered. One
fold over ticks serves both forms, so they agree by construction on late, repeated and interrupted ticks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWERS = "rollout long, step long, sent double, latched double, ran boolean, closed boolean"
STATE = "chunk array<double>, at int, first double, began_ms long, step long, closed boolean"


@dataclass
class Rollout:
    chunk: list[float]
    at: int
    first: float | None
    began_ms: int | None
    step: int
    closed: bool

    @classmethod
    def new(cls) -> Rollout:
        return cls([], 0, None, None, -(1 << 62), False)


@dataclass(frozen=True)
class Player:
    """``size`` steps are predicted from the value at hand by ``predict`` when no chunk is left. A rollout is closed by its first tick ``limit_ms`` or more after its first one."""

    size: int = 8
    limit_ms: int = 20_000
    slope: float = 0.5

    def predict(self, value: float) -> list[float]:
        """Stands for a model: a line through the value."""
        return [value + self.slope * i for i in range(self.size)]

    def answers(self, state: Rollout, ticks: Iterator[tuple[int, float, int]]) -> Iterator[tuple[int, float, float, bool]]:
        """(step, value, t_ms) in the order of steps -> (step, sent, latched, whether a chunk was predicted), changing ``state``. A tick whose step was passed already is
        left out, for what was sent cannot be taken back; so is all after the close."""
        for step, value, t_ms in ticks:
            if step <= state.step or state.closed:
                continue
            if state.began_ms is None:
                state.began_ms, state.first = t_ms, value
            if t_ms - state.began_ms >= self.limit_ms:
                state.closed = True
                continue
            ran = state.at >= len(state.chunk)
            if ran:
                state.chunk, state.at = self.predict(value), 0
            yield step, state.chunk[state.at], state.first, ran
            state.at, state.step = state.at + 1, step


def typed(ticks: DataFrame, *more: str) -> DataFrame:
    """The columns that count; ticks without a rollout, step, value or time are no ticks."""
    kinds = {"rollout": "long", "step": "long", "value": "double", "t_ms": "long", "arrival": "long"}
    chosen = ticks.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("rollout", "step", "value", "t_ms", *more)])
    return chosen.where("rollout IS NOT NULL AND step IS NOT NULL AND value IS NOT NULL AND t_ms IS NOT NULL")


def played(ticks: DataFrame, player: Player = Player()) -> DataFrame:  # noqa: B008  immutable
    """Batch: (rollout, step, value, t_ms[, arrival]) -> ``ANSWERS``, one row for each answered tick. With ``arrival``, ticks of a lower one came before, as those of earlier
    micro-batches do. Rollouts come sorted, batch by batch, and only the state is carried over, so a rollout of any length takes the memory of one batch."""
    arrival = [c for c in ("arrival",) if c in ticks.columns]

    def run(batches):
        own, state = None, None
        for b in batches:
            out = []
            for r, step, value, t_ms in zip(*(b.column(c).to_pylist() for c in ("rollout", "step", "value", "t_ms")), strict=True):
                if r != own:
                    own, state = r, Rollout.new()
                out += [(r, *a) for a in player.answers(state, iter([(step, value, t_ms)]))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([False] * len(out), pa.bool_())], [c.split()[0] for c in ANSWERS.split(", ")])

    # equal steps of one arrival: the earlier tick, then the smaller value, is the one answered
    dealt = typed(ticks, *arrival).repartition("rollout").sortWithinPartitions("rollout", *arrival, "step", "t_ms", "value")
    return dealt.mapInArrow(run, ANSWERS)


class Playing(StatefulProcessor):
    """A rollout that sends nothing for ``player.limit_ms`` of wall-clock time after its first tick is closed by a timer, which adds a row without a step; a closed one stays
    known for ``idle_ms``, so that its late ticks do not begin it anew."""

    def __init__(self, player: Player, idle_ms: int):
        self.player, self.idle_ms = player, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("rollout", STATE, ttlDurationMs=self.idle_ms)

    def load(self) -> Rollout:
        if not self.state.exists():
            return Rollout.new()
        chunk, *rest = self.state.get()
        return Rollout(list(chunk), *rest)

    def handleInputRows(self, key, rows, timerValues):
        state = self.load()
        new = state.began_ms is None
        frame = pd.concat(list(rows)).sort_values(["step", "t_ms", "value"], kind="stable")
        out = list(self.player.answers(state, zip(*(frame[c].tolist() for c in ("step", "value", "t_ms")), strict=True)))
        if state.began_ms is not None:
            self.state.update(astuple(state))
            if new:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.player.limit_ms)
        if out:
            yield pd.DataFrame([(key[0], *a, False) for a in out], columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.load()
        if state.began_ms is not None and not state.closed:
            state.closed = True
            self.state.update(astuple(state))
            yield pd.DataFrame({"rollout": [key[0]], "step": pd.array([None], "Int64"), "sent": [None], "latched": [state.first], "ran": [False], "closed": [True]})

    def close(self) -> None:
        pass


def playing(ticks: DataFrame, player: Player = Player(), idle_ms: int = 3_600_000) -> DataFrame:  # noqa: B008  immutable
    """Stream: as :func:`played`, plus a row with ``closed`` for each rollout that a timer closed. Needs the RocksDB state store."""
    return typed(ticks).groupBy("rollout").transformWithStateInPandas(Playing(player, idle_ms), ANSWERS, "Append", "ProcessingTime")
