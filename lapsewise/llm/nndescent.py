"""Near-duplicate embeddings by NN-descent.

Each vector keeps a list of its nearest neighbours. Lists begin with what vectors find in
the leaves of random-projection trees, and are refined by local joins: all vectors that
have a common neighbour, or are each other's neighbours' neighbours, are compared, and
every list keeps its best. A list whose entries all reach the threshold is saturated and
is doubled. Rounds go on while threshold links are still being found. An audit compares a
bounded sample of vectors with all others; if too many of their links are missing, new
trees are added and the descent goes on.

Links that reach the threshold make components. Within a component all pairs are then
compared in double precision, in blocks of bounded size, so that numbers of links are
complete even where lists are shorter. Vectors that point the same way are one class with
one representative, so copies cost nothing. Leaves and local joins with more members than
``GROUP`` are dealt into several by a hash that changes from round to round.

Nulls and odd input: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing and are their own component.
Vectors of different lengths never meet. Repeated rows are copies of one vector. A row
without an id takes its class's component. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType

from lapsewise.llm.common import append_columns, prepare_workers
from lapsewise.llm.graph import components
from lapsewise.session import Scratch

NEIGHBOURS = 8
LARGEST = 64  # lists are not doubled beyond this; see join_saturated
TREES = 12
LEAF = 64
GROUP = 256
ROUNDS = 6
STILL = 0.002  # of links found; fewer new ones end the descent
AUDITED = 256
RECALL = 0.995
LEAST_RECALL = 0.9
SLACK = 1e-6  # radians, for rounding
FORESTS = 4
ROWS_AT_ONCE = 8192


def unit(values) -> bytes | None:
    """The vector at length 1 in double precision, or None if it has no direction."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    largest = np.abs(x).max()
    if not np.isfinite(largest) or largest == 0:
        return None
    x = x / largest
    return (x / np.linalg.norm(x) + 0.0).tobytes()  # + 0.0: no negative zeros


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df with unit: packed doubles."""

    def make(batch):
        return [pa.array([unit(v) for v in batch.column(vector).to_pylist()], pa.binary())]

    return append_columns(df, [("unit", BinaryType())], make)


def _matrix(packed, kind) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1)


def local_join(rows: DataFrame, per: int) -> DataFrame:
    """(id, other, similarity) of the best per others of each member within its group.

    rows: grp, id, least, vec (packed floats of one length within a group). Only what is
    better than a member's least is returned. Groups are small; many go to one task.
    """
    prepare_workers(rows.sparkSession)
    deals = max(1, -(-rows.count() // ROWS_AT_ONCE))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("grp")
        groups = table.column("grp").to_numpy()
        ids, least = table.column("id").to_numpy(), table.column("least").to_numpy()
        packed = table.column("vec").to_pylist()
        cuts = np.flatnonzero(np.diff(groups)) + 1
        out = ([], [], [])
        for a, b in zip([0, *cuts], [*cuts, len(groups)], strict=True):
            own, first = np.unique(ids[a:b], return_index=True)
            if len(own) < 2:
                continue
            x = _matrix([packed[a + i] for i in first], np.float32)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            take = min(per, len(own) - 1)
            best = np.argpartition(-s, take - 1, axis=1)[:, :take]
            value = np.take_along_axis(s, best, axis=1)
            i, j = np.nonzero(value > least[a + first][:, None])
            out[0].append(own[i])
            out[1].append(own[best[i, j]])
            out[2].append(value[i, j])
        ids, others, values = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"id": ids.astype(np.int64), "other": others.astype(np.int64),
                         "similarity": values.astype(np.float32)})

    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("grp"), F.lit(deals)))
    return dealt.groupBy("deal").applyInArrow(compare, "id long, other long, similarity float")


def _split_groups(members: DataFrame, salt: int) -> DataFrame:
    """members (grp, id) with groups of more than GROUP dealt into several."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / GROUP)
    sub = F.pmod(F.xxhash64(F.lit(salt), "id"), parts)
    return members.join(sizes, "grp").filter("size > 1").select(
        F.xxhash64("grp", sub).alias("grp"), "id"
    )


def forest(reps: DataFrame, seed: int) -> DataFrame:
    """(grp, id): the leaves of TREES random-projection trees each representative is in."""
    sizes = reps.groupBy("label").agg(F.count("*").alias("peers"))

    def run(batches):
        for batch in batches:
            ids, groups = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "label", "peers", "vec")),
                       strict=True)
            for i, label, peers, vec in rows:
                x = np.frombuffer(vec, np.float32)
                bits = max(1, int(np.ceil(np.log2(max(peers / LEAF, 2)))))
                planes = _planes(len(x), seed, bits)
                codes = ((planes @ x > 0) * (1 << np.arange(bits))).sum(axis=1)
                ids += [i] * TREES
                groups += [f"{label}/{len(x)}/{t}/{c}" for t, c in enumerate(codes.tolist())]
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(groups, pa.string()),
                                              "id": pa.array(ids, pa.int64())})

    prepare_workers(reps.sparkSession)
    placed = reps.join(sizes, "label").select("id", F.col("label").cast("string").alias("label"),
                                              "peers", "vec")
    leaves = placed.mapInArrow(run, "leaf string, id long")
    return leaves.select(F.xxhash64(F.lit(seed), "leaf").alias("grp"), "id")


_drawn: dict[tuple, np.ndarray] = {}


def _planes(size: int, seed: int, bits: int) -> np.ndarray:
    """TREES x bits random directions, the same in every task."""
    key = (size, seed, bits)
    if key not in _drawn:
        _drawn[key] = np.random.default_rng([seed, size]).normal(size=(TREES, bits, size)).astype(
            np.float32
        )
    return _drawn[key]


def _best(found: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """New lists (id, k, neighbours) from what was found and the lists before."""
    if lists is not None:
        before = lists.select("id", F.inline("neighbours")).select("id", "other", "similarity")
        found = found.unionByName(before)
    merged = found.groupBy("id").agg(
        F.sort_array(F.collect_set(F.struct("similarity", "other")), asc=False).alias("all")
    )
    if lists is None:
        merged = merged.withColumn("k", F.lit(NEIGHBOURS))
    else:
        merged = merged.join(lists.select("id", "k"), "id", "left").withColumn(
            "k", F.coalesce("k", F.lit(NEIGHBOURS))
        )
    # A list that holds nothing but links to its end may be hiding more.
    full = (F.size("all") > F.col("k")) & (F.element_at("all", F.col("k"))["similarity"] >= threshold)
    k = F.when(full, F.least(F.col("k") * 2, F.lit(LARGEST))).otherwise(F.col("k"))
    return merged.withColumn("k", k).select(
        "id", "k", F.slice("all", F.lit(1), F.col("k")).alias("neighbours")
    )


def _with_vectors(members: DataFrame, reps: DataFrame, lists: DataFrame | None) -> DataFrame:
    """members (grp, id) with vec and the similarity that a new neighbour must exceed."""
    rows = members.join(reps.select("id", "vec"), "id")
    if lists is None:
        return rows.withColumn("least", F.lit(-2.0).cast("float"))
    last = lists.select(
        "id", F.when(F.size("neighbours") >= F.col("k"),
                     F.element_at("neighbours", -1)["similarity"]).alias("least")
    )
    return rows.join(last, "id", "left").withColumn(
        "least", F.coalesce("least", F.lit(-2.0).cast("float"))
    )


def _links(lists: DataFrame, threshold: float) -> DataFrame:
    pairs = lists.select("id", F.inline("neighbours")).filter(F.col("similarity") >= threshold)
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b"))


def descend(
    reps: DataFrame, threshold: float, seed: int, lists: DataFrame | None, scratch: Scratch
) -> DataFrame:
    """Neighbour lists after one forest and rounds of local joins. The lists before are
    dropped."""
    leaves = scratch.write(forest(reps, seed), "leaves")
    members = _split_groups(leaves, seed)
    rows = scratch.write(_with_vectors(members, reps, lists), "leaf-rows")
    former, lists = lists, scratch.write(_best(local_join(rows, NEIGHBOURS // 2), lists, threshold), "lists")
    scratch.drop(leaves, rows, *([former] if former is not None else []))
    links = _links(lists, threshold).count()
    for step in range(1, ROUNDS + 1):
        edges = lists.select("id", F.inline("neighbours")).select("id", "other")
        # Everyone meets at a neighbour, with that neighbour, from both ends of an edge.
        meet = edges.select(F.col("other").alias("grp"), "id").unionByName(
            edges.select(F.col("id").alias("grp"), F.col("other").alias("id"))
        ).unionByName(lists.select(F.col("id").alias("grp"), "id")).distinct()
        meetings = scratch.write(meet, "meetings")
        rows = scratch.write(
            _with_vectors(_split_groups(meetings, 1000 * seed + step), reps, lists), "join-rows"
        )
        former, lists = lists, scratch.write(_best(local_join(rows, NEIGHBOURS), lists, threshold), "lists")
        scratch.drop(meetings, rows, former)
        scratch.release()
        now = _links(lists, threshold).count()
        if now - links <= STILL * max(now, 1):
            break
        links = now
    return lists


# Links between saturated components.


def _centres(members: DataFrame) -> DataFrame:
    """(component, kind, centre, radius) of members (component, kind, id, unit): the
    normalised mean, and the largest angle to it. Sums leave a task one per component."""

    def add_up(batches):
        for batch in batches:
            part = batch.column("component").to_numpy()
            names, where = np.unique(part, return_inverse=True)
            sums: dict[int, np.ndarray] = {}
            for k, packed in zip(where.tolist(), batch.column("unit").to_pylist(), strict=True):
                x = np.frombuffer(packed, np.float64)
                sums[k] = sums[k] + x if k in sums else x.copy()
            kinds = batch.column("kind").to_pylist()
            first = [int(np.argmax(where == k)) for k in range(len(names))]
            yield pa.RecordBatch.from_pydict({
                "component": pa.array(names, pa.int64()), "kind": pa.array([kinds[i] for i in first], pa.string()),
                "total": pa.array([sums[k].tobytes() for k in range(len(names))], pa.binary()),
            })

    def mean(key, table):
        total = _matrix(table.column("total").to_pylist(), np.float64).sum(axis=0)
        size = np.linalg.norm(total)
        centre = total / size if size > 1e-9 else np.eye(len(total))[0]
        return pa.table({"component": [key[0].as_py()], "kind": [table.column("kind")[0].as_py()],
                         "centre": pa.array([centre.tobytes()], pa.binary())})

    def angles(batch):
        near = [
            float(np.arccos(np.clip(np.frombuffer(u, np.float64) @ np.frombuffer(c, np.float64), -1, 1)))
            for u, c in zip(batch.column("unit").to_pylist(), batch.column("centre").to_pylist(), strict=True)
        ]
        return [pa.array(near, pa.float64())]

    prepare_workers(members.sparkSession)
    sums = members.select("component", "kind", "unit").mapInArrow(
        add_up, "component long, kind string, total binary"
    )
    centres = sums.groupBy("component").applyInArrow(mean, "component long, kind string, centre binary")
    placed = members.select("component", "unit").join(centres, "component")
    measured = append_columns(placed, [("angle", DoubleType())], angles)
    radius = measured.groupBy("component").agg(F.max("angle").alias("radius"))
    return centres.join(radius, "component")


def _near_components(centres: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b) of components whose centres and radii do not rule a link out."""
    sizes = centres.groupBy("kind").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    dealt = centres.join(sizes, "kind").withColumn(
        "mine", F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("kind", F.least("mine", "other").alias("low"),
                         F.greatest("mine", "other").alias("high"), "mine", "component", "centre", "radius")

    def compare(key, table):
        _, low, high = (k.as_py() for k in key)
        ids, radius, mine = (table.column(c).to_numpy() for c in ("component", "radius", "mine"))
        x = _matrix(table.column("centre").to_pylist(), np.float64)
        gap = np.arccos(np.clip(x @ x.T, -1, 1)) - radius[:, None] - radius[None, :]
        near = (gap <= reach + SLACK) & (ids[:, None] < ids[None, :])
        if low != high:
            near &= mine[:, None] != mine[None, :]
        a, b = np.nonzero(near)
        return pa.table({"a": ids[a], "b": ids[b]})

    return dealt.groupBy("kind", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def join_saturated(
    lists: DataFrame, classes: DataFrame, part: DataFrame, near: float, threshold: float, scratch: Scratch
) -> DataFrame:
    """part with the components joined that have a link between saturated vectors."""
    full = (F.size("neighbours") >= LARGEST) & (F.element_at("neighbours", -1)["similarity"] >= near)
    saturated = lists.filter(full).select("id")
    kind = F.concat_ws(" ", F.length("unit").cast("string"), F.col("label").cast("string")).alias("kind")
    members = scratch.write(
        classes.join(saturated, "id").join(part.withColumnRenamed("node", "id"), "id")
        .select("component", kind, "id", "unit"), "saturated",
    )
    reach = float(np.arccos(threshold))
    centres = scratch.write(_centres(members), "centres")
    pairs = scratch.write(_near_components(centres, reach), "near-components")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("own"), F.col("b").alias("far")
                         ).unionByName(pairs.select("a", "b", F.lit(1), F.col("b"), F.col("a")).toDF(
                             "a", "b", "side", "own", "far"))
    beyond = centres.select(F.col("component").alias("far"), "centre", "radius")
    rows = members.withColumnRenamed("component", "own").join(sides, "own").join(beyond, "far")

    def within(batch):
        out = []
        columns = (batch.column(c).to_pylist() for c in ("unit", "centre", "radius"))
        for u, c, radius in zip(*columns, strict=True):
            cosine = np.clip(np.frombuffer(u, np.float64) @ np.frombuffer(c, np.float64), -1, 1)
            out.append(bool(np.arccos(cosine) <= radius + reach + SLACK))
        return [pa.array(out, pa.bool_())]

    close = append_columns(rows.select("a", "b", "side", "id", "unit", "centre", "radius"),
                           [("close", BooleanType())], within)
    close = scratch.write(close.filter("close").select("a", "b", "side", "id", "unit"), "close-members")
    sizes = close.groupBy("a", "b").agg(*[
        F.ceil(F.count_if(F.col("side") == s) / GROUP).cast("int").alias(f"blocks_{s}") for s in (0, 1)
    ]).filter("blocks_0 > 0 AND blocks_1 > 0")
    own, other = (F.when(F.col("side") == s, F.col("blocks_0")).otherwise(F.col("blocks_1")) for s in (0, 1))
    dealt = close.join(sizes, ["a", "b"]).withColumn(
        "mine", F.pmod(F.xxhash64("id"), own).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    dealt = dealt.select(
        "a", "b", F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine")).alias("j"), "side", "unit",
    )

    def compare(key, table):
        a, b, *_ = (k.as_py() for k in key)
        side = table.column("side").to_numpy()
        x = _matrix(table.column("unit").to_pylist(), np.float64)
        linked = bool((x[side == 0] @ x[side == 1].T >= threshold).any())
        return pa.table({"a": pa.array([a] * linked, pa.int64()), "b": pa.array([b] * linked, pa.int64())})

    found = scratch.write(
        dealt.groupBy("a", "b", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "joined"
    )
    above = components(found, scratch)
    renamed = above.select(F.col("node").alias("component"), F.col("component").alias("root"))
    out = scratch.write(
        part.join(renamed, "component", "left").select("node", F.coalesce("root", "component").alias("component")),
        "components",
    )
    scratch.drop(members, centres, pairs, close, found, above, part)
    return out


def audit(reps: DataFrame, part: DataFrame, threshold: float) -> float:
    """The mean, over a bounded sample of vectors that have links, of the share of their
    links that lies within their component, found by comparing them with all vectors in
    batches. A quarter of the sample each comes from components of 1, 2 to 9, 10 to 99 and
    more vectors. Only the sample is sent to the workers."""
    sizes = part.groupBy("component").agg(F.count("*").alias("size"))
    placed = part.join(sizes, "component").withColumnRenamed("node", "id")
    labelled = reps.join(placed, "id", "left").select(
        "id", "label", "vec", F.coalesce("component", "id").alias("component"),
        F.least(F.floor(F.log10(F.coalesce("size", F.lit(1)))) + F.when(F.col("size") > 1, 1).otherwise(0),
                F.lit(3)).alias("stratum"),
    )
    sample = []
    for stratum in range(4):
        some = labelled.filter(F.col("stratum") == stratum)
        sample += some.orderBy(F.xxhash64(F.lit(3), "id")).limit(AUDITED // 4).collect()
    if not sample:
        return 1.0
    by_kind: dict = {}
    for r in sample:
        by_kind.setdefault((str(r["label"]), len(r["vec"])), []).append(r)
    queries = {
        kind: (_matrix([r["vec"] for r in rows], np.float32), np.array([r["id"] for r in rows]),
               np.array([r["component"] for r in rows]))
        for kind, rows in by_kind.items()
    }

    def run(batches):
        for batch in batches:
            every: dict[int, list[int]] = {}
            columns = zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vec", "component")),
                          strict=True)
            for i, label, vec, component in columns:
                if (label, len(vec)) in queries:
                    x, ids, components_ = queries[label, len(vec)]
                    near = (x @ np.frombuffer(vec, np.float32) >= threshold) & (ids != i)
                    for k in np.flatnonzero(near):
                        seen = every.setdefault(int(ids[k]), [0, 0])
                        seen[0] += 1
                        seen[1] += int(components_[k] == component)
            yield pa.RecordBatch.from_pydict({
                "query": pa.array(list(every), pa.int64()),
                "links": pa.array([v[0] for v in every.values()], pa.int64()),
                "kept": pa.array([v[1] for v in every.values()], pa.int64()),
            })

    told = labelled.withColumn("label", F.col("label").cast("string")).mapInArrow(
        run, "query long, links long, kept long"
    ).groupBy("query").agg((F.sum("kept") / F.sum("links")).alias("recall"))
    mean = told.agg(F.avg("recall")).first()[0]
    return 1.0 if mean is None else mean


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): linked copies and others within each component, in blocks of GROUP.

    members: component, size (of the component), id, unit, copies.
    """
    prepare_workers(members.sparkSession)
    blocks = F.ceil(F.col("size") / GROUP).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn(
        "mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("mine", "other").alias("low"),
                         F.greatest("mine", "other").alias("high"), "mine", "id", "unit", "copies")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, low, high = (k.as_py() for k in key)
        ids, copies, mine = (table.column(c).to_numpy() for c in ("id", "copies", "mine"))
        x = _matrix(table.column("unit").to_pylist(), np.float64)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if low != high:  # what lies within one block is counted by that block's own group
            near &= mine[:, None] != mine[None, :]
        return pa.table({"id": ids, "links": (near @ copies).astype(np.int64)})

    counted = dealt.groupBy("component", "low", "high").applyInArrow(compare, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = 0.93,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of df; key is an integer."""
    slim = df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"),
                     F.col(vector).alias("vector"))
    scratch = Scratch(df.sparkSession)
    units = scratch.write(unit_vectors(slim, "vector").drop("vector"), "units")
    classes = units.filter("unit IS NOT NULL AND label IS NOT NULL").groupBy("label", "unit").agg(
        F.min("key").alias("id"), F.count("*").alias("copies")
    )
    classes = scratch.write(classes, "classes")

    def narrow(batch):
        packed = [np.frombuffer(u, np.float64).astype(np.float32).tobytes()
                  for u in batch.column("unit").to_pylist()]
        return [pa.array(packed, pa.binary())]

    reps = scratch.write(
        append_columns(classes.filter("id IS NOT NULL"), [("vec", BinaryType())], narrow)
        .select("id", "label", "vec"), "representatives",
    )
    # Searches run in single precision: they must not lose what double precision links.
    near = threshold - 1e-5
    lists = part = None
    for seed in range(1, FORESTS + 1):
        lists = descend(reps, near, seed, lists, scratch)
        if part is not None:
            scratch.drop(part)
        part = components(_confirmed(lists, classes, near, threshold), scratch)
        part = join_saturated(lists, classes, part, near, threshold, scratch)
        recall = audit(reps, part, threshold)
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"audited recall of links is {recall:.3f} after {FORESTS} forests")
    scratch.drop(lists, reps)
    scratch.release()

    placed = classes.filter("id IS NOT NULL").join(part.withColumnRenamed("node", "id"), "id")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    links = count_links(
        placed.join(sizes, "component").select("component", "size", "id", "unit", "copies"), threshold
    )
    known = classes.join(part.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
    known = known.select("label", "unit", F.coalesce("component", "id").alias("component"),
                         (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    rows = units.join(known, ["label", "unit"], "left")
    component = F.coalesce("component", "key")
    return rows.select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )


def _confirmed(lists: DataFrame, classes: DataFrame, near: float, threshold: float) -> DataFrame:
    """The lists' links that hold in double precision."""
    pairs = _links(lists, near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Links clear of the threshold stand; those next to it are computed again.
    one = classes.select(F.col("id").alias("a"), F.col("unit").alias("ua"))
    two = classes.select(F.col("id").alias("b"), F.col("unit").alias("ub"))

    def run(batches):
        for batch in batches:
            sims = [
                float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= threshold
                for x, y in zip(batch.column("ua").to_pylist(), batch.column("ub").to_pylist(), strict=True)
            ]
            mask = pa.array(sims, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    prepare_workers(lists.sparkSession)
    return pairs.distinct().join(two, "b").join(one, "a").mapInArrow(run, "a long, b long")
