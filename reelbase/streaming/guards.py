"""The stateful action guard of a rollout: bias, exponential smoothing, then a clamp against the previous output."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def guarded(values: pd.Series, bias: float, alpha: float, most: float, last: float | None = None) -> tuple[list[float], float | None]:
    """Each output depends on the one before, so this is a fold and no window function."""
    out = []
    for v in values:
        x = v + bias
        if last is not None:
            x = last + min(most, max(-most, alpha * x + (1 - alpha) * last - last))
        last = x
        out.append(x)
    return out, last


def action_guard(ticks: DataFrame, bias: float = 2.0, alpha: float = 0.5, most: float = 5.0) -> DataFrame:
    """Batch: (rollout, step, value) -> (rollout, step, sent). Rollouts come sorted in batches, and only the last output is carried over, so a rollout of any
    length takes the memory of one batch. A null value counts as NaN, as pandas reads it."""

    def run(batches):
        own, last = object(), None
        for b in batches:
            rollouts, sent, start = b.column(0).to_pylist(), [], 0
            values = b.column(2).fill_null(float("nan")).to_pylist()
            for i in range(1, len(rollouts) + 1):
                if i < len(rollouts) and rollouts[i] == rollouts[start]:
                    continue
                if rollouts[start] != own:
                    own, last = rollouts[start], None
                out, last = guarded(values[start:i], bias, alpha, most, last)
                sent += out
                start = i
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent, pa.float64(), from_pandas=True)], ["rollout", "step", "sent"])

    typed = ticks.select(F.col("rollout").cast("long"), F.col("step").cast("long"), F.col("value").cast("double"))
    dealt = typed.repartition("rollout").sortWithinPartitions("rollout", F.asc_nulls_last("step"))
    return dealt.mapInArrow(run, "rollout long, step long, sent double")


class GuardState(StatefulProcessor):
    """The last output and step of a rollout. Ticks of a micro-batch come in any order and are sorted; one whose step is not after the last step sent was
    already answered and is left out, for what was sent cannot be taken back. A rollout without ticks for ``idle_ms`` is forgotten."""

    def __init__(self, bias: float, alpha: float, most: float, idle_ms: int):
        self.bias, self.alpha, self.most, self.idle_ms = bias, alpha, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "step long, sent double", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        step, last = self.state.get() if self.state.exists() else (None, None)
        frame = pd.concat(list(rows)).sort_values("step", kind="stable").drop_duplicates("step")
        if step is not None:
            frame = frame[frame["step"] > step]
        if len(frame):
            sent, last = guarded(frame["value"], self.bias, self.alpha, self.most, last)
            self.state.update((int(frame["step"].iloc[-1]), float(last)))
            yield pd.DataFrame({"rollout": frame["rollout"], "step": frame["step"], "sent": sent})

    def close(self) -> None:
        pass


def action_guard_stream(ticks: DataFrame, bias: float = 2.0, alpha: float = 0.5, most: float = 5.0, idle_ms: int = 3_600_000) -> DataFrame:
    """Streaming twin: the last output and step of a rollout are its state, see :class:`GuardState`. Needs the RocksDB state store."""
    named = ticks.where("rollout IS NOT NULL AND step IS NOT NULL")
    return named.groupBy("rollout").transformWithStateInPandas(GuardState(bias, alpha, most, idle_ms), "rollout long, step long, sent double", "Append", "ProcessingTime")


def loop_timing(ticks: DataFrame, target_ms: float, width: str, late: str = "10 minutes") -> DataFrame:
    """(ts, loop_ms) -> per tumbling window: ticks, and how many were slower than the target. On a stream, ticks later than ``late`` are left out."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    w = F.window("ts", width)
    return ticks.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("ticks"), F.count_if(F.col("loop_ms") > target_ms).alias("overruns")).select(F.col("w.start").alias("start"), "ticks", "overruns")
