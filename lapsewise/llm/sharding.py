"""Shards of near-equal bytes by best-fit-decreasing packing of indivisible groups.

Rows with equal texts form a group that must not be divided. Groups are weighed in one
aggregation, and sorted by size they enter the bin with the tightest remaining capacity,
found in a balanced tree. The capacity is the smallest, by bisection, at which all of
them fit into the wanted number of bins.

The packing itself is bounded: only groups of more than 1/``HEAVY`` of an equal share are
items of their own, which at most shards * HEAVY groups can be; the others are first
joined by a hash of their text into shards * ``BUNDLES`` bundles of whole groups. What
reaches the driver, and is broadcast back, has at most shards * (HEAVY + BUNDLES) entries
at every size of the input.

Slots number each shard's rows from 0. Rows are counted per shard and slice, slices get
their first number from a running sum over those counts, and rows are numbered within
slices, so that no task sorts a whole shard; the number of slices follows the rows.

Nulls and odd input: a null text weighs 1 byte and forms a group with other nulls, apart
from empty texts. Repeated rows stay together, each with a slot of its own. An empty
table gives no rows. A single group larger than an equal share gets a shard that exceeds
it: no division of whole groups is more even. Columns with the names of output columns
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import without
from lapsewise.session import materialise

HEAVY = 512  # a group of more than 1/HEAVY of a share is an item of its own
BUNDLES = 2048  # bundles of lighter groups per shard
SLICE_ROWS = 1000
EVEN = 20_000  # capacities are told apart to 1/EVEN of an equal share


class CapacityTree:
    """Bins by remaining capacity in a treap: insert, and take out the tightest that fits.

    Priorities are a hash of the bin number, so that the tree is balanced in expectation
    and the same on every run.
    """

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = CapacityTree._split(node[3], key)
            return (node[0], node[1], node[2], left), right
        left, right = CapacityTree._split(node[2], key)
        return left, (node[0], node[1], right, node[3])

    @staticmethod
    def _join(left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            return left[0], left[1], left[2], CapacityTree._join(left[3], right)
        return right[0], right[1], CapacityTree._join(left, right[2]), right[3]

    def insert(self, capacity: int, number: int) -> None:
        key = (capacity, number)
        left, right = self._split(self.root, key)
        node = (key, hash((number * 2654435761) & 0xFFFFFFFF), None, None)
        self.root = self._join(self._join(left, node), right)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove the bin of least capacity that is at least need; ties: the lower number."""
        left, right = self._split(self.root, (need, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        first, rest = self._split(right, (node[0][0], node[0][1] + 1))
        assert first is not None
        self.root = self._join(left, rest)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int) -> list[int] | None:
    """A bin for each size, given in descending order; None if bins do not suffice."""
    tree = CapacityTree()
    used, out = 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if used == bins or size > capacity:
                return None
            found = (capacity, used)
            used += 1
        room, number = found
        out.append(number)
        tree.insert(room - size, number)
    return out


def pack_evenly(sizes: list[int], bins: int) -> list[int]:
    """Bins for sizes in any order, at the smallest capacity that bisection finds."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    descending = [sizes[i] for i in order]
    total = sum(descending)
    low = max(-(-total // bins), descending[0] if descending else 0)
    high, best = low, best_fit_decreasing(descending, low, bins)
    while best is None:
        low, high = high, high + max(1, (high - low) * 2, total // bins // EVEN)
        best = best_fit_decreasing(descending, high, bins)
    while high - low > max(1, total // bins // EVEN):
        middle = (low + high) // 2
        found = best_fit_decreasing(descending, middle, bins)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    out = [0] * len(sizes)
    for i, number in zip(order, best, strict=True):
        out[i] = number
    return out


def weigh(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow table sharding works on: keys, size, checksum and the group's digest."""
    data = F.col(text).cast("binary")
    return df.select(
        *keep,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(data, 256)), F.lit(b"null")).alias("text_digest"),
    )


def _bundle(bundles: int) -> Column:
    return F.pmod(F.xxhash64("text_digest"), F.lit(bundles)).cast("int")


def shard(rows: DataFrame, shards: int = 16) -> DataFrame:
    """rows (a written table with size and text_digest) with shard, by near-equal bytes."""
    rows = without(rows, "shard")
    groups = rows.groupBy("text_digest").agg(F.sum("size").alias("bytes"))
    groups = materialise(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bundles = shards * BUNDLES
    heavy = F.col("bytes") * shards * HEAVY > F.lit(total)
    big = groups.filter(heavy).orderBy("text_digest").collect()  # at most shards * HEAVY
    light = (
        groups.filter(~heavy).groupBy(_bundle(bundles).alias("bundle"))
        .agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()
    )  # at most bundles
    items = [int(r["bytes"]) for r in big] + [int(r["bytes"]) for r in light]
    bins = pack_evenly(items, shards)
    spark = rows.sparkSession
    big_bins = spark.createDataFrame(
        [(bytes(r["text_digest"]), b) for r, b in zip(big, bins, strict=False)],
        "text_digest binary, big_shard int",
    )
    light_bins = spark.createDataFrame(
        [(r["bundle"], b) for r, b in zip(light, bins[len(big):], strict=True)],
        "bundle int, light_shard int",
    )
    return (
        rows.withColumn("bundle", _bundle(bundles))
        .join(F.broadcast(big_bins), "text_digest", "left")
        .join(F.broadcast(light_bins), "bundle", "left")
        .withColumn("shard", F.coalesce("big_shard", "light_shard"))
        .drop("bundle", "big_shard", "light_shard")
    )


def number_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (a written table with shard) with slot: gapless from 0 within each shard."""
    rows = without(rows, "slot")
    sizes = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    slices = F.array(
        *[F.lit(-(-sizes.get(s, 1) // SLICE_ROWS)) for s in range(max(sizes, default=0) + 1)]
    )
    part = F.pmod(F.xxhash64(*order), F.element_at(slices, F.col("shard") + 1)).cast("int")
    sliced = rows.withColumn("slice", part)
    counts = sliced.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = counts.select(
        "shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "slice").orderBy(*order)
    numbered = sliced.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(first, ["shard", "slice"]).withColumn(
        "slot", F.col("first") + F.col("rank")
    ).drop("slice", "first", "rank")
