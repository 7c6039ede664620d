"""Connected components by contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import discard, materialize


def _roots(hooks: DataFrame) -> DataFrame:
    """(id, root) of a forest of hooks (id, root), where each root is a smaller id or
    has no row itself. Pointer jumping: the distance left halves each round."""
    while True:
        jump = hooks.select(F.col("id").alias("root"), F.col("root").alias("far"))
        nxt = hooks.select("id", "root").join(jump, "root", "left")
        nxt = materialize(nxt.select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        moved = nxt.where("moved").limit(1).count()
        discard(hooks)
        if not moved:
            return nxt
        hooks = nxt


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for each node of edges (a, b): component is the smallest
    node that links lead to.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to
    their roots, and renames the ends of the edges to them; edges within one tree go, so
    only roots and the edges between trees are left for the next round. An edge is one
    row, the large first round passes over the edges twice, and a root is always the
    smallest node of its tree. Tables are written each round; nothing but the question
    whether rows are left reaches the driver. The joins read written tables, so adaptive
    execution can split a hot node.
    Nulls and self-links are ignored; no edges give no rows.
    """
    one = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = materialize(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialize(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while left.limit(1).count():
        roots = _roots(materialize(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "hooks"))
        high = left.join(roots.select(F.col("id").alias("b"), F.col("root").alias("high")), "b").select("a", "high")
        ends = high.join(roots.select(F.col("id").alias("a"), F.col("root").alias("low")), "a", "left").select(F.coalesce("low", "a").alias("x"), F.col("high").alias("y"))
        rest = materialize(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        named = labels.join(roots.select(F.col("id").alias("label"), "root"), "label", "left").select("id", F.coalesce("root", "label").alias("label"))
        named = materialize(named, "labels")
        for old in (left, roots, labels):
            discard(old)
        left, labels = rest, named
    discard(left)
    return labels.select("id", F.col("label").alias("component"))
