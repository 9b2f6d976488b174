"""Exact percentiles of any number of groups, whatever the number of distinct values.

Values are counted first, so that equal ones are combined before any shuffle. The counts
are then sorted by range over all groups at once: sums per partition and running sums
within each tell the rank every value begins at, and the wanted ranks are read off. No
task holds the values of a group, as an aggregate's buffer would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.session import materialise


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, Column],
    wanted: dict[str, tuple[str, float]],
) -> DataFrame:
    """keys and one column per name in wanted: (measure, probability), interpolated
    linearly between neighbours. NULLs of a measure are left out; a group without any
    value in all measures has no row. NULL is a key like any other."""
    each = F.array(
        *[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("value")) for n, c in measures.items()]
    )
    group = [*keys, "measure"]
    counts = (
        df.select(*keys, F.explode(each).alias("m")).select(*keys, "m.measure", "m.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*group, "value").agg(F.count("*").alias("n"))
    )
    placed = materialise(
        counts.repartitionByRange(*group, "value").withColumn("part", F.spark_partition_id()),
        "value-counts",
    )
    # One row per group and partition it reaches into: groups plus partitions at most.
    parts = placed.groupBy(*group, "part").agg(F.sum("n").alias("rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *[F.col(c).alias(f"_{c}") for c in (*group, "part")],
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(whole).alias("total"),
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, "part")])
    inside = Window.partitionBy(*group, "part").orderBy("value")
    ranked = placed.withColumn("through", F.sum("n").over(inside)).join(starts, same).select(
        *group, "value", "total",
        (F.col("before") + F.col("through") - F.col("n")).alias("first"),
        (F.col("before") + F.col("through")).alias("beyond"),
    )

    def at(measure: str, rank: Column) -> Column:
        here = (F.col("measure") == measure) & (F.col("first") <= rank) & (rank < F.col("beyond"))
        return F.max(F.when(here, F.col("value")))

    found, out = [], []
    for name, (measure, p) in wanted.items():
        place = p * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        found += [
            at(measure, low).alias(f"low_{name}"), at(measure, high).alias(f"high_{name}"),
            F.max(F.when(F.col("measure") == measure, place - low)).alias(f"part_{name}"),
        ]
        lo, hi, part = (F.col(f"{c}_{name}") for c in ("low", "high", "part"))
        out.append((lo * (1 - part) + hi * part).alias(name))
    return ranked.groupBy(*keys).agg(*found).select(*keys, *out)
