"""Connected components of an edge table by least labels and pointer jumping: joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import discard, frequent, join_frequent, materialize

#: Edges of a node, or nodes of a label, from which their rows are not shuffled to one task: less than a task can hold by far.
HOT_ROWS = 1 << 17


def components(edges: DataFrame, most_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the least node that can be reached.

    Nodes of many edges, and labels of many nodes, meet their rows by a broadcast of bounded size.
    """
    both = materialize(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    large = both.count() > hot_rows
    hubs = frequent(both, "b", hot_rows) if large else None
    for _ in range(most_rounds):
        near = join_frequent(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.select(F.col("a").alias("node"), "m"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(step, "steps") if large else step
        leads = frequent(step, "label", hot_rows) if large else None
        before, new = labels, materialize(join_frequent(step, jump, "label", leads).select("node", "old", F.least("label", "far").alias("label")), "labels")
        discard(before, step, *([] if leads is None else [leads]))
        if not new.where("label <> old").limit(1).collect():
            discard(both, *([] if hubs is None else [hubs]))
            return new.select("node", "label")
        labels = new
    raise RuntimeError("components did not settle")
