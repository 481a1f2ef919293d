"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum joined back, so no task ever holds a component; the minima get an exchange of their own,
so that the join can split a vertex with very many edges. Tables are written to the shared checkpoint folder between
rounds, and the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apflow.operators.joins import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b."""
    if large:  # neighbours above a vertex are linked to the least neighbour
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least.hint("rebalance"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # a vertex and its neighbours below are linked to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        below = edges.join(least.hint("rebalance"), "a")
        out = below.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, root): the least vertex of the component, for every vertex of ``edges`` (columns a, b) but the roots."""
    now = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        now = materialize(_star(_star(now, True), False))
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        state = new
