"""Connected components of an edge table, by contraction.

Each round every node points to the smallest of its neighbours and itself, and pointers are followed to their
end, doubling their reach with each join.  Edges are renamed to where their ends point, and those inside one
name, or told twice, go.  Only nodes smaller than all their neighbours keep their name, at most half of those
that are left, so rounds are few and the table of edges shrinks from one to the next.

The larger end of an edge is renamed first: edges around a hub become few before the hub's own name is looked
up.  Minima are pre-aggregated before every shuffle.  Where many rows still share a key, the other side of the
join has one row for it, and adaptive execution's skew join cuts the partition; rows are two numbers each.
Tables of each round are written to the shared folder; nothing is collected but whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, materialize


def _ordered(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, each edge once."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the component's smallest node."""
    left = materialize(_ordered(edges), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    taken = []
    while True:
        least = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("parent")))
        names = materialize(least.groupBy("node").agg(F.min("parent").alias("label")), "names")
        while True:
            up = names.select(F.col("node").alias("label"), F.col("label").alias("last"))
            jumped = materialize(names.join(up, "label").select("node", F.col("last").alias("label"), (F.col("last") != F.col("label")).alias("moved")), "names")
            discard(names)
            names = jumped
            if names.where("moved").isEmpty():
                break
        names = names.select("node", "label")
        taken.append(names)
        of = lambda end, name: names.select(F.col("node").alias(end), F.col("label").alias(name))  # noqa: E731, B023
        upper = left.join(of("b", "to"), "b").select("a", "to").distinct().where("a <> to")
        renamed = materialize(_ordered(upper.join(of("a", "from"), "a").select(F.col("from").alias("a"), F.col("to").alias("b"))), "edges")
        discard(left)
        left = renamed
        if left.isEmpty():
            break
    labels = taken[0]
    for names in taken[1:]:
        later = names.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = labels.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return materialize(labels.unionByName(loops.join(labels, "node", "left_anti")), "labels")
