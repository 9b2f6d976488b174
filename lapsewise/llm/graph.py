"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.session import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b), as
    a written table of scratch. Working tables are removed as soon as they are replaced.

    Each round points every node to its smallest smaller neighbour, follows pointers to
    their roots by doubling, and replaces edges by those between roots, until none is
    left. Every table is written to the shared folder, so that no round depends on what
    an executor holds; nothing but row counts reaches the driver. Minima are combined
    before the shuffle, so a node with very many edges is no task of its own.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    write, drop = scratch.write, scratch.drop
    edges = write(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a > b").distinct(), "edges",
    )
    labels = None
    while not edges.isEmpty():
        pointer = write(
            edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "pointers"
        )
        while True:
            above = pointer.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            joined = pointer.join(above, "root", "left").select(
                "node", F.coalesce("higher", "root").alias("root"),
                F.col("higher").isNotNull().alias("moved"),
            )
            moved = write(joined, "pointers")
            drop(pointer)
            pointer = moved
            if pointer.filter("moved").isEmpty():
                break
        step = pointer.select(F.col("node").alias("key"), F.col("root").alias("to"))
        found = pointer.select("node", "root")
        if labels is None:
            labels = write(found, "labels")
        else:
            moved = labels.join(step, labels["root"] == step["key"], "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
            fresh = found.join(labels, "node", "left_anti")
            former, labels = labels, write(moved.unionByName(fresh), "labels")
            drop(former)
        between = edges
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            between = between.join(step, between[end] == step["key"], "left").select(
                F.coalesce("to", end).alias(end), other
            )
        former, edges = edges, write(
            between.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a > b").distinct(), "edges",
        )
        drop(former, pointer)
    if labels is None:
        none = write(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
        drop(edges)
        return none
    roots = labels.select(F.col("root").alias("node")).distinct()
    everyone = labels.unionByName(roots.select("node", F.col("node").alias("root")))
    out = write(everyone.select("node", F.col("root").alias("component")).distinct(), "components")
    drop(labels, edges)
    return out
