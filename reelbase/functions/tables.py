"""Table functions for users of SQL."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

PLACE, VECTOR = "frame_index", "vector"


@udtf
class BridgeRows:
    """``bridge_rows(TABLE(t) PARTITION BY (...) ORDER BY (frame_index), n)``: ``n`` rows between each row of a partition and the next, their vectors at (i + 1) / (n + 1) of the way. ``t`` has
    frame_index, vector and any other columns, which are those of the earlier row; step counts from 0. A row without a vector has no bridge on either side; vectors of different sizes are
    an error. Holds one row at a time, so a partition may be of any size."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {PLACE, VECTOR} <= {f.name for f in rows.dataType.fields}:
            raise ValueError(f"bridge_rows takes a table with {PLACE} and {VECTOR}")
        keep = [f for f in rows.dataType.fields if f.name not in (PLACE, VECTOR)]
        return AnalyzeResult(schema=StructType([*keep, StructField("step", IntegerType()), StructField(VECTOR, ArrayType(DoubleType()))]))

    def __init__(self):
        self.last = None

    def eval(self, rows: Row, n: int):
        last, self.last = self.last, rows
        if last is None or last[VECTOR] is None or rows[VECTOR] is None:
            return
        own = [last[c] for c in last.__fields__ if c not in (PLACE, VECTOR)]
        for i in range(n):
            t = (i + 1) / (n + 1)
            yield (*own, i, [a + (b - a) * t for a, b in zip(last[VECTOR], rows[VECTOR], strict=True)])


def register(spark: SparkSession) -> None:
    spark.udtf.register("bridge_rows", BridgeRows)
