"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, materialize

#: Each round at least halves the nodes that still have links; this many rounds is past any table.
MAX_ROUNDS = 64


def _roots(parents: DataFrame) -> DataFrame:
    """(node, up) with up the end of each node's chain of parents; chains halve with every pass."""
    for _ in range(MAX_ROUNDS):
        done = parents
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = materialize(parents.join(above, "up").select("node", F.col("up").alias("was"), F.col("top").alias("up")))
        parents = jumped.select("node", "up")
        discard(done)
        if not jumped.where("was <> up").limit(1).count():
            return parents
    raise RuntimeError("parents did not settle")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that it reaches.

    In a round every node takes its smallest neighbour, if that is smaller, as its parent; parents are followed to
    the roots, and the links between different roots are the next round's. All of it stays in tables, written to the
    shared folder; only whether rows are left comes to the driver. A hub with any number of links is a hot key of a
    minimum with partial aggregation and of equi-joins with unique keys on the other side.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialize(links.where("a <> b").select(*pair("a", "b")).distinct())
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    for n in range(MAX_ROUNDS):
        if not edges.limit(1).count():
            return found
        both = edges.union(edges.select("b", "a"))
        roots = _roots(materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))))
        one, two = (roots.select(F.col("node").alias(k), F.col("up").alias(f"root_{k}")) for k in "ab")
        before, edges = edges, materialize(edges.join(one, "a").join(two, "b").where("root_a <> root_b").select(*pair("root_a", "root_b")).distinct())
        discard(before)
        if n == 0:
            found = roots.select("node", F.col("up").alias("component"))
        else:
            later = roots.select(F.col("node").alias("component"), F.col("up").alias("root"))
            last, found = found, materialize(found.join(later, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
            discard(last, roots)
    raise RuntimeError("links did not settle")
