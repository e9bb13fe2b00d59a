"""Connected components of an edge table by minimum labels with pointer jumping, as joins and aggregates.

Labels stay in tables; each round is written to the shared folder, and the driver reads one number of it. A round that
changes a label lowers one, so the rounds end; stars and other flat groups take two, long chains a logarithm of theirs.

Defined results: edges with a null end and loops are left out; repeated edges count once; nodes without edges don't
appear; no edges give no rows; columns but the two ends are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach. edges should be a stored table."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(both.union(both.select("v", "u")).filter("u <> v").distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        named = labels.withColumnsRenamed({"u": "w", "label": "l"})
        near = both.join(named, F.col("v") == F.col("w")).groupBy("u").agg(F.min("l").alias("near"))
        lower = labels.join(near, "u", "left").select("u", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        jumped = lower.join(named, F.col("mid") == F.col("w"), "left")
        step = written(jumped.select("u", "old", F.least("mid", F.coalesce("l", "mid")).alias("label")), "labels")
        labels = step.select("u", "label")
        if step.filter("old <> label").isEmpty():
            return labels.withColumnsRenamed({"u": "node", "label": "component"})
