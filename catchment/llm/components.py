"""Connected components by hooking and pointer jumping; every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _flatten(parent: DataFrame) -> DataFrame:
    """Follows x -> p chains to their ends; p < x always, so there are no cycles."""
    while True:
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
        after = cut(parent.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        if not after.filter("moved").take(1):
            return after.select("x", "p")
        parent = after.select("x", "p")


def merge_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp: node, comp; links: a, b between nodes. The new comp: the smallest comp reachable."""
    of = comp.select(F.col("node"), F.col("comp"))
    e = links.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    e = cut(e)
    while e.take(1):
        parent = _flatten(cut(e.groupBy("x").agg(F.min("y").alias("p"))))
        comp = cut(comp.join(parent.toDF("comp", "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
        moved = e.join(parent, "x", "left").select(F.coalesce("p", "x").alias("x"), "y").join(parent.toDF("y", "q"), "y", "left").select("x", F.coalesce("q", "y").alias("y"))
        e = cut(moved.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    return comp
