"""Joins that spread hot keys, and connected components by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import written

SALTS = 8


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """big joined with small, the rows of one key dealt over `salts` tasks; small is repeated as often."""
    rest = [c for c in big.columns if c not in on and big.schema[c].dataType.typeName() in ("long", "integer", "string")]
    left = big.withColumn("_salt", F.pmod(F.hash(*(rest or on)), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


#: Rows of a few longs up to which a table is broadcast (some 10 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def joined(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """salted_join(), or without a shuffle where `rows`, the most rows that small can have, are few."""
    return big.join(F.broadcast(small), on, how) if rows <= BROADCAST_ROWS else salted_join(big, small, on, how, salts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) for the nodes of undirected edges (u, v), longs.

    Alternating large-star and small-star steps: each sends every neighbour of a node to the node's
    smallest neighbour, the number of rounds grows with the logarithm of the component's size, and
    no step gathers a node's neighbours in one place.
    """
    spark = edges.sparkSession
    edges = written(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = 2 * edges.count()  # at most; from the footers of the written table
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = joined(both.where("v > u"), least, ["u"], nodes).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # repeated rows go with the last distinct()
        # small-star: u's smaller neighbours and u itself go to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = joined(large, small, ["u"], nodes)
        star = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = written(spark, star.where("u <> v").distinct(), "edges")
        # Done when every node has one parent and no parent has one.
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
        busy = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)")
        if not busy.limit(1).count():
            break
    ends = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extend(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components `known` (node, component), or none, with more links (u, v): only the links between components are worked on."""
    if known is None:
        return written(links.sparkSession, components(links), "components")
    comp, rows = known.select(F.col("node"), "component"), known.count()
    ends = joined(links, comp.select(F.col("node").alias("u"), F.col("component").alias("a")), ["u"], rows, "left")
    ends = joined(ends, comp.select(F.col("node").alias("v"), F.col("component").alias("b")), ["v"], rows, "left")
    between = written(links.sparkSession, ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v").distinct(), "between")
    if not between.limit(1).count():
        return known
    moved = written(links.sparkSession, components(between), "components")
    # A node that no link had before is a component of its own name.
    both = known.unionByName(moved.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return written(links.sparkSession, joined(both, to, ["component"], moved.count(), "left").select("node", F.coalesce("least", "component").alias("component")), "components")
