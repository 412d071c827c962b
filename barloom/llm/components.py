"""Connected components by contraction, all in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it is connected with (``root``), for nodes with edges.

    ``edges`` has two long columns ``a`` and ``b``. Each round every node that has a
    smaller neighbour points to its smallest one, pointers are followed once more, and the
    edges are contracted: both ends are replaced by what they point to, and edges inside a
    component, as well as copies of edges, are dropped. At least half of the nodes that still have
    edges point elsewhere in each round, so edges vanish quickly, and rounds end when
    none are left. Every round's tables are stored, so a lost executor never reaches back over
    rounds. A node with very many edges only meets one row per task in the sums; its rows
    are only joined with one pointer each, which skew splitting handles.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    left = stored(ordered.distinct(), "edges")
    roots = None
    while not left.isEmpty():
        # ``b`` is the smaller end: the larger ends point down, all others stay.
        ends = left.groupBy("a").agg(F.min("b").alias("to"))
        below = stored(ends, "below")
        above = below.select(F.col("a").alias("to"), F.col("to").alias("further"))
        pointers = stored(
            below.join(above, "to", "left").select("a", F.coalesce("further", "to").alias("to")), "pointers"
        )
        at_b = pointers.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        contracted = (
            left.join(pointers, "a")  # every larger end has a pointer
            .join(at_b, "b", "left")
            .select(F.col("to").alias("a"), F.coalesce("to_b", "b").alias("b"))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        if roots is None:
            low = left.select(F.col("b").alias("a")).distinct().join(below.select("a"), "a", "left_anti")
            roots = pointers.union(low.select("a", F.col("a").alias("to")))
        else:
            moved = pointers.select(F.col("a").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = stored(roots.toDF("node", "root"), "roots")
        left = stored(contracted, "edges")
    if roots is None:
        return left.toDF("node", "root")
    return roots
