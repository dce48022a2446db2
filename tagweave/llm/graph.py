"""Connected components of a table of links, by repeated contraction.

Every vertex points to the first vertex, in a mixed order, among its neighbours
and itself; links are rewritten to the vertices pointed at until none is left.
Each round is one map-side aggregation and two joins, so a vertex with very many
links is summed in every task before its rows meet. The mixed order makes long
chains shrink by a constant share per round; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages


def _mixed(v: Column) -> Column:
    """A bijection of 64-bit ids made of shifts and exclusive-ors."""
    for _ in range(2):
        v = v.bitwiseXOR(F.shiftleft(v, 13))
        v = v.bitwiseXOR(F.shiftrightunsigned(v, 7))
        v = v.bitwiseXOR(F.shiftleft(v, 17))
    return v


def connected_components(stages: Stages, links: DataFrame, name: str = "cc") -> DataFrame:
    """``links(a, b)`` of bigint ids -> ``(vertex, component)``, the component named
    by its smallest vertex; one row per vertex that has a link to another one.
    Repeated links, links in both directions and links of a vertex with itself do
    no harm; links with a null end are ignored."""
    clean = links.where("a is not null and b is not null and a <> b")
    edges = stages.write(clean.select(_mixed(F.col("a")).alias("a"), _mixed(F.col("b")).alias("b")).distinct(),
                         f"{name}-edges-0")
    ids = clean.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    roots = ids.select("vertex", _mixed(F.col("vertex")).alias("root"))
    step = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        parent = stages.write(both.groupBy("a").agg(F.min("b").alias("b"))
                              .select(F.col("a").alias("at"), F.least("a", "b").alias("to")), f"{name}-parent-{step}")
        roots = stages.write(roots.join(parent, F.col("root") == F.col("at"), "left")
                             .select("vertex", F.coalesce("to", "root").alias("root")), f"{name}-roots-{step}")
        left = parent.select(F.col("at").alias("a"), F.col("to").alias("a_to"))
        right = parent.select(F.col("at").alias("b"), F.col("to").alias("b_to"))
        moved = (edges.join(left, "a").join(right, "b").where("a_to <> b_to")
                 .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        edges = stages.write(moved, f"{name}-edges-{step + 1}")
        stages.drop(f"{name}-parent-{step}", f"{name}-edges-{step}", *([f"{name}-roots-{step - 1}"] if step else []))
        step += 1
    names = roots.groupBy("root").agg(F.min("vertex").alias("component"))
    return roots.join(names, "root").select("vertex", "component")
