"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a long, b long): the smallest node that each reaches.

    A round takes the smallest label among each node and its neighbours (combined before the shuffle)
    and then the label of that label, until nothing changes. Each round is a written table.
    """
    both = settle(edges.where("a <> b").selectExpr("a AS u", "b AS v").unionAll(edges.where("a <> b").selectExpr("b AS u", "a AS v")).distinct(), "edges")
    labels = settle(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.selectExpr("node AS v", "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        step = settle(step, "labels")
        up = step.selectExpr("node AS up", "label AS root")
        jumped = step.join(up, step["label"] == up["up"]).select("node", F.least("label", "root").alias("label"), "before")
        jumped = settle(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> before").limit(1).count() == 0:
            return labels
