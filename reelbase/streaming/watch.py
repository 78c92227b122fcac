"""Watching a folder of checkpoints as a stream: each new one is processed once, in step order, and adds one metrics record."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "step long, loss double"


class Watch:
    """A stream over JSON files that a trainer drops into ``folder``; rows of one ``step`` are one checkpoint. ``judge`` turns checkpoints into metrics records, one row with ``step``
    for each, and they are added to ``metrics`` with the number of their batch. A checkpoint that ``judge`` fails on, while planning or while computing, gets a record with ``error`` and
    no more; the others of its batch are judged, and the watch goes on. The stream's own checkpoint ``state`` is the set of files seen, so a restart processes none twice: a
    batch written before a crash is replaced by its like, and a step that an earlier batch has judged is left out when it is dropped again. A batch has few steps; their rows
    are never gathered.

    ``schema`` is that of the files."""

    def __init__(self, spark: SparkSession, folder: str, metrics: str, state: str, judge: Callable[[DataFrame], DataFrame], schema: str = CHECKPOINT):
        self.spark, self.folder, self.metrics, self.state, self.judge, self.schema = spark, folder, metrics, state, judge, schema

    def run(self, final_step: int | None = None, once: bool = False, idle_s: float | None = None, poll_s: float = 0.5) -> str:
        """Watch until something ends it, and say what: "final" (a step from ``final_step`` on was judged), "once" (one was judged and ``once`` asked for), "idle" (nothing new
        for ``idle_s`` seconds), or "drained" (without ``idle_s``: what lay there is done). Steps of a batch after the one that ends the watch are not judged. An
        error of the stream itself is raised."""
        self.ended, self.last_new, self.final_step, self.once = "", time.time(), final_step, once
        source = self.spark.readStream.schema(self.schema).json(self.folder)
        writer = source.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.state)
        query = (writer.trigger(availableNow=True) if idle_s is None else writer.trigger(processingTime=f"{poll_s} seconds")).start()
        try:
            while not query.awaitTermination(poll_s):
                if self.ended or (idle_s is not None and time.time() - self.last_new > idle_s and not query.status["isTriggerActive"]):
                    break
        finally:
            query.stop()
        return self.ended or ("idle" if idle_s is not None else "drained")

    def batch(self, rows: DataFrame, number: int) -> None:
        rows = rows.where(F.col("step").isNotNull())
        judged = self.records().where(F.col("batch") != number)
        steps = sorted(r["step"] for r in rows.select("step").distinct().join(F.broadcast(judged.select("step").distinct()), "step", "left_anti").collect())
        target = f"{self.metrics}/batch={number}"
        if self.ended or not steps:
            return
        self.last_new = time.time()
        ends = next((k for k, s in enumerate(steps) if self.final_step is not None and s >= self.final_step), None)
        if not self.once:
            wanted = steps if ends is None else steps[: ends + 1]
            try:  # all at once; if any fails, each by itself
                self.written(rows.where(F.col("step").isin(wanted)), target, "overwrite")
                self.ended = "final" if ends is not None else ""
                return
            except Exception:  # noqa: BLE001, S110  judged again below, where the error is kept
                pass
        mode = "overwrite"
        for step in steps:
            try:
                self.written(rows.where(F.col("step") == step), target, mode)
            except Exception as e:  # noqa: BLE001  a bad checkpoint must not end the watch
                said = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
                self.spark.createDataFrame([(step, said)], "step long, error string").write.mode(mode).json(target)
            else:
                self.ended = "once" if self.once else "final" if self.final_step is not None and step >= self.final_step else ""
            mode = "append"
            if self.ended:
                return

    def written(self, rows: DataFrame, target: str, mode: str) -> None:
        """Records of ``rows``, whole or not at all: they are computed before the target is touched."""
        records = [r.asDict() for r in self.judge(rows).collect()]  # one for each of a few steps
        kinds = self.judge(rows).schema
        self.spark.createDataFrame([tuple(r[c] for c in kinds.names) for r in records], kinds).withColumn("error", F.lit(None).cast("string")).orderBy("step").write.mode(mode).json(target)

    def records(self) -> DataFrame:
        """What is known so far: batch, step and error. The folder of records may not be there yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.metrics)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "step long, error string, batch int")
        return self.spark.read.schema("step long, error string, batch int").json(self.metrics)


def watch_checkpoints(spark: SparkSession, folder: str, metrics: str, state: str, judge: Callable[[DataFrame], DataFrame], schema: str = CHECKPOINT, **until) -> str:
    """See :class:`Watch` and its ``run``."""
    return Watch(spark, folder, metrics, state, judge, schema).run(**until)


def finished(spark: SparkSession, metrics: str, final_step: int) -> bool:
    """Whether the final step, or a later one, was judged without an error."""
    return not Watch(spark, "", metrics, "", lambda rows: rows).records().where((F.col("step") >= final_step) & F.col("error").isNull()).isEmpty()
