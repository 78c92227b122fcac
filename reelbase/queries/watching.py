"""Queries of the checkpoint watch: files dropped in rounds, and what the watch made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.queries.base import query
from reelbase.sources import datasets as D
from reelbase.sources.adapters import read
from reelbase.streaming.watch import Watch

STEP, FILES = "(user_id % 12 + 1) * 100", "step long, event_id long, loss double"


def dropped(s, d):
    """The checkpoints: twelve steps, each with the losses of its events."""
    return read(s, d, "events").selectExpr(f"{STEP} AS step", "event_id", "value AS loss")


def judged(rows):
    """Mean loss of a checkpoint; step 500 can't be read, which shows only while it is computed."""
    loss = F.when(F.col("step") == 500, F.raise_error(F.lit("broken payload")).cast("double")).otherwise(F.col("loss"))
    return rows.groupBy("step").agg(F.round(F.avg(loss), 6).alias("score"), F.count(F.lit(1)).alias("events"))


def watched(s, d) -> str:
    """Three rounds of files, each followed by a restarted watch; the third drops step 100 once more."""
    root, rows = D.fresh_folder(s, "watch"), dropped(s, d)
    for r in range(3):
        again = F.lit(r == 2) & (F.col("step") == 100)
        rows.where((F.col("step") / 100 % 3 == r) | again).write.mode("append").json(f"{root}/in")
        Watch(s, f"{root}/in", f"{root}/metrics", f"{root}/state", judged, FILES).run()
    return f"{root}/metrics"


RECORDS = "step long, score double, events long, error string, batch int"


@query("st_01_watch", f"""WITH e AS (SELECT {STEP} AS step, value FROM events) SELECT step, CASE WHEN step <> 500 THEN round(avg(value), 6) END AS score, CASE WHEN step <> 500 THEN count(*) END AS events, step = 500 AS rejected FROM e GROUP BY 1""")
def st_01(s, d):
    return s.read.schema(RECORDS).json(watched(s, d)).select("step", "score", "events", F.coalesce(F.col("error").contains("broken payload"), F.lit(False)).alias("rejected"))


@query("st_02_stops", f"""WITH e AS (SELECT DISTINCT {STEP} AS step FROM events), f AS (SELECT min(step) AS final FROM e WHERE step >= 600)
 SELECT 'final' AS rule, 'final' AS reason, count(*) AS records, max(step) AS last FROM e, f WHERE step <= final
 UNION ALL SELECT 'idle', 'idle', count(*), max(step) FROM e UNION ALL SELECT 'once', 'once', CAST(1 AS BIGINT), min(step) FROM e
 UNION ALL SELECT 'drained', 'drained', count(*), max(step) FROM e""")
def st_02(s, d):
    """The same files under each rule that can end a watch: how it ended, how many records there are, and the last step."""
    root = D.fresh_folder(s, "stops")
    dropped(s, d).write.json(f"{root}/in")
    out = None
    for rule, until in (("final", {"final_step": 600}), ("idle", {"idle_s": 2.0}), ("once", {"once": True}), ("drained", {})):
        reason = Watch(s, f"{root}/in", f"{root}/{rule}", f"{root}/{rule}-state", judged, FILES).run(**until)
        one = s.read.schema(RECORDS).json(f"{root}/{rule}").agg(F.count(F.lit(1)).alias("records"), F.max("step").alias("last")).select(F.lit(rule).alias("rule"), F.lit(reason).alias("reason"), "records", "last")
        out = one if out is None else out.unionByName(one)
    return out


@query("st_03_one_record_each", f"WITH e AS (SELECT DISTINCT {STEP} AS step FROM events) SELECT step, CAST(step // 100 % 3 AS INT) AS batch, CAST(1 AS BIGINT) AS records FROM e")
def st_03(s, d):
    return s.read.schema(RECORDS).json(watched(s, d)).groupBy("step", "batch").agg(F.count(F.lit(1)).alias("records"))
