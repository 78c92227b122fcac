"""Connected components by label propagation with pointer jumping, all of it in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``id``, ``component``) for each id that has an edge; the component is its smallest id.

    Each round takes the smallest label of all neighbours (a map-side minimum, so a vertex with very many edges is no
    hot task), then replaces a label by its own label. The rounds needed grow with the logarithm of a component's
    diameter; they go on until no label changes, and each lowers one, so they end. Only a count comes to the driver. Loops, repeated edges and rows with null are ignored; an edge table without rows gives none.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    both = cut(e.union(e.select("b", "a")), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        # the label's own vertex learns of it too, which joins trees and not just leaves
        up = both.join(labels.withColumnRenamed("label", "own"), both.a == F.col("id")).join(labels.select(F.col("id").alias("i2"), F.col("label").alias("other")), F.col("b") == F.col("i2")).where("other < own").groupBy(F.col("own").alias("a")).agg(F.min("other").alias("m"))
        least = near.union(up).groupBy("a").agg(F.min("m").alias("m"))
        new = labels.join(least, labels.id == least.a, "left").select("id", "label", F.least("label", "m").alias("mid"))
        jump = new.select(F.col("id").alias("j"), F.col("mid").alias("far"))
        new = cut(new.join(jump, new.mid == jump.j, "left").select("id", F.least("mid", "far").alias("label"), (F.least("mid", "far") < F.col("label")).alias("changed")), "labels")
        labels = new.select("id", "label")
        if new.where("changed").isEmpty():
            break
    return labels.withColumnRenamed("label", "component")
