"""Merkle manifest of a dataset: a content-addressed tree per source, one over sources.

Every row is a leaf, the SHA-256 of its encoded fields. The leaves of a source ascend by
id, and while several nodes remain every `fan` consecutive ones become their hash; what
remains is the source's subroot. The subroots, ordered by source, give the root alike.

The nodes are stored as records from a digest to its children. A proof is found by
descent: from the root, the digits of a leaf's rank select one child of each record, the
children not selected are collected, and the segments are turned round at the end. All
requests for leaves below one node share its step, so a level's join has one row per
node, whatever number of leaves is asked for, and the segments of the last level are
collected inside the run of leaves, not per leaf.

Defined results: rows without an id come first in their source, rows of one id are
ordered by their leaf; rows equal in every field have equal leaves and interchangeable
places. A null source is a source of its own, before all others. An empty table has no
root and gives no rows. Columns of the input that are no field are not looked at.

At scale: ranks come from one range shuffle of digests (no window over a source), so one
source may hold any share of the rows. Every group that is formed has at most `fan` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.session import Scratch

FAN = 16


def encoded(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: str, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """df with rank (from 0, by order, within group) and size (rows of the group).

    Rows are sorted by range, so the number a row gets within its partition and the
    counts of the partitions before give its rank; of a group, one row per partition is
    counted, however many rows it has. Rows equal in all of `order` may lie anywhere
    among each other, so a number of their own deals them out.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order],
            F.col("__salt").asc()]
    placed = scratch.write(
        df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("__at", F.monotonically_increasing_id()).drop("__salt"),
        "ordered",
    )
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(F.col(group).alias("__group"), part.alias("__part")).agg(
        F.count("*").alias("__n"), F.min("__at").alias("__first")
    )
    from pyspark.sql import Window

    whole = Window.partitionBy("__group")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__group", "__part", "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("size"),
    )
    found = placed.withColumn("__part", part).join(
        starts.withColumnRenamed("__part", "__of"),
        F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")),
    )
    rank = F.col("__at") - F.col("__first") + F.col("__before")
    out = scratch.write(
        found.withColumn("rank", rank).select(*df.columns, "rank", "size"), "ranked"
    )
    scratch.drop(placed)
    return out


class Tree:
    """The written tree of nodes (group, rank, size, digest): records per level, and the
    top of every group. Level 1 stands above the nodes given."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fan: int = FAN):
        self.fan, self.scratch = fan, scratch
        self.levels: list[DataFrame] = []
        tops = [nodes.filter("size = 1").select("group", "digest", F.lit(0).alias("height"))]
        level = nodes.filter("size > 1").select("group", "rank", "size", "digest")
        while not level.isEmpty():
            run = F.floor(F.col("rank") / fan).cast("long")
            grouped = level.groupBy("group", run.alias("rank"), F.col("size").alias("below")).agg(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"]
                ).alias("children")
            )
            level = scratch.write(
                grouped.select(
                    "group", "rank", F.ceil(F.col("below") / fan).alias("size"),
                    F.sha2(F.array_join("children", ""), 256).alias("digest"), "children",
                ), "records",
            )
            self.levels.append(level)
            tops.append(level.filter("size = 1").select(
                "group", "digest", F.lit(len(self.levels)).alias("height")))
            level = level.filter("size > 1").select("group", "rank", "size", "digest")
        self.tops = reduce(DataFrame.unionByName, tops)

    def records(self, level: int) -> DataFrame:
        """digest and children of a level's distinct nodes."""
        return self.levels[level - 1].groupBy("digest").agg(F.first("children").alias("children"))

    def descend(self, tops: DataFrame, wanted: DataFrame | None = None, last: int = 1) -> DataFrame:
        """(group, rank, digest, path) of the nodes of level last - 1 and, for groups
        that end above, of their tops. tops: (group, digest, height, path).

        wanted: (group, rank) of the lowest nodes asked for; None asks for all of them.
        path: segments (left, right) of unselected children, from the root down.
        """
        at = tops.filter(F.col("height") < last).select("group", F.lit(0).cast("long").alias("rank"), "digest", "path")
        frontier = None
        for level in range(len(self.levels), last - 1, -1):
            enter = tops.filter(F.col("height") == level).select(
                "group", F.lit(0).cast("long").alias("rank"), "digest", "path"
            )
            frontier = enter if frontier is None else frontier.unionByName(enter)
            opened = frontier.join(self.records(level), "digest").select(
                "group", "rank", "path", "children", F.posexplode("children").alias("digit", "digest")
            )
            step = opened.select(
                "group", (F.col("rank") * self.fan + F.col("digit")).alias("rank"), "digest",
                F.concat("path", F.array(segment("children", F.col("digit")))).alias("path"),
            )
            if wanted is not None:
                asked = wanted.select(
                    F.col("group").alias("__group"),
                    F.floor(F.col("rank") / self.fan ** (level - 1)).cast("long").alias("__rank"),
                ).distinct()
                step = step.join(
                    asked, F.col("group").eqNullSafe(F.col("__group")) & (F.col("rank") == F.col("__rank")),
                    "left_semi",
                )
            frontier = step
        return at if frontier is None else at.unionByName(frontier)


def segment(children: str, digit: Column) -> Column:
    """The children left and right of the selected one, each joined."""
    c = F.col(children)
    return F.struct(
        F.array_join(F.slice(c, F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice(c, digit + 2, F.size(c)), "").alias("right"),
    )


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, the leaf's own run first."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(
        F.reverse(path), leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256)
    )


def manifest(leaves: DataFrame, wanted: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """Proofs of the leaves (source, doc_id, leaf, claimed) of a dataset.

    claimed is the leaf a holder presents; it is folded with the siblings of the stored
    tree. wanted: (source, doc_id) of the leaves to prove, all of them if None.
    Returns doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified.
    """
    scratch = Scratch(leaves.sparkSession)
    written = scratch.write(leaves.select("source", "doc_id", "leaf", "claimed"), "leaves")
    ranked = numbered(written, "source", ["doc_id", "leaf"], scratch)
    scratch.drop(written)
    nodes = ranked.select(F.col("source").alias("group"), "rank", "size", F.col("leaf").alias("digest"))
    tree = Tree(nodes, scratch, fan)

    subroots = scratch.write(tree.tops, "subroots")
    sources = numbered(
        subroots.select(F.lit(0).alias("all"), F.col("group").alias("source"), "digest", "height"),
        "all", ["source"], scratch,
    )
    above = Tree(sources.select(F.col("all").alias("group"), "rank", "size", "digest"), scratch, fan)
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = above.tops.select("digest").first()  # one digest, or none of an empty table
    root = F.lit(top["digest"] if top else None).cast("string")
    placed = above.descend(above.tops.withColumn("path", none))
    tops = scratch.write(
        placed.join(sources.select("rank", "source", "height", F.col("digest").alias("__top")), "rank")
        .select(F.col("source").alias("group"), "digest", "height", "path"),
        "tops",
    )

    asked = None
    if wanted is not None:
        keys = wanted.select(F.col("source").alias("__source"), F.col("doc_id").alias("__id")).distinct()
        ranked = ranked.join(
            keys, F.col("source").eqNullSafe(F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__id")),
            "left_semi",
        )
        asked = ranked.select(F.col("source").alias("group"), "rank")
    # Down to the nodes above the leaves; the last step is taken inside each run.
    reached = tree.descend(tops, None if asked is None else asked, last=2)
    runs = ranked.groupBy(
        F.col("source").alias("__source"), F.floor(F.col("rank") / fan).cast("long").alias("__run")
    ).agg(F.collect_list(F.struct("rank", "doc_id", "leaf", "claimed")).alias("members"))
    whole = tree.records(1) if tree.levels else None
    reached = reached.select("group", "rank", F.col("digest").alias("node"), "path")
    if whole is not None:
        reached = reached.join(whole.withColumnRenamed("digest", "node"), "node", "left")
    else:
        reached = reached.withColumn("children", F.lit(None).cast("array<string>"))
    met = reached.join(
        runs, F.col("group").eqNullSafe(F.col("__source")) & (F.col("rank") == F.col("__run"))
    ).select("group", "path", "children", F.explode("members").alias("m"))
    digit = (F.col("m.rank") % fan).cast("int")
    rows = met.select(
        F.col("m.doc_id").alias("doc_id"), "group", F.col("m.leaf").alias("leaf"),
        F.col("m.claimed").alias("claimed"),
        F.when(F.col("children").isNull(), F.col("path"))
        .otherwise(F.concat("path", F.array(segment("children", digit)))).alias("path"),
    )
    known = subroots.select(F.col("group").alias("__source"), F.col("digest").alias("subroot"))
    out = rows.join(known, F.col("group").eqNullSafe(F.col("__source")))
    return out.select(
        "doc_id", F.col("group").alias("source"), "leaf", "subroot", root.alias("root"), "path",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("path"), F.col("claimed")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
