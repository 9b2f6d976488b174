"""Near-duplicate documents by SetSketch registers, banding, likelihood and exact checks.

A document is the set of its distinct five-word shingles. Its sketch has ``REGISTERS``
registers: for each one, every shingle draws an exponential value, the smallest is taken
and its logarithm to the base ``BASE`` is truncated to an integer between 0 and ``TOP``.
Minima are exponentially spaced, so registers of a union are the larger of the registers
(sketches merge), and close sets agree in many of them (sketches are locality-sensitive).

1. Documents with one and the same set form a class with one representative.
2. Representatives meet in buckets: bands of ``ROWS`` registers that agree. Two sets at
   similarity 0.75 miss each other in all bands with probability about 1e-6.
3. Of the smallest and largest members of its buckets, everyone is compared with the two it
   shares most buckets with. What the joint likelihood of two sketches does not rule out is
   compared on full texts. Links give components; twice, one member of each component in a
   bucket is compared with one of the largest.
4. Buckets that still hold several components compare the sketches of all pairs across
   components, in blocks of bounded size. What they join forms clusters, whose members are
   compared on full texts, in blocks again.

So no link between components is missed within a bucket, a group of thousands of copies
costs a few comparisons for each copy, and no task holds an unbounded group.

Nulls and odd input: a null or empty text and one without words has the empty set, is
linked with nothing and is its own component. Fewer than five words are one shingle.
Rows are told apart by a number of their own, written with their sketches, not by their
keys: rows with one key and different texts are compared each with its own text, and may
be in different components under one component_id. Rows repeated in full are one class. A
row without a key takes the component of its class; component_id is null if no row of the
component has a key. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    LongType,
    StructField,
    StructType,
)

from lapsewise.llm.bpe import Memo
from lapsewise.llm.common import append_columns, prepare_workers
from lapsewise.llm.graph import components
from lapsewise.session import Scratch

WORDS = 5
BASE = 1.02
TOP = 2000  # registers are truncated to 0..TOP
ROWS, BANDS = 5, 48
REGISTERS = ROWS * BANDS
# A pair is ruled out if the likelihood at the threshold is e**-UNLIKELY of the largest.
UNLIKELY = 16.0
BLOCK = 256
CHUNK = 4096
PARTNERS = 2  # compared with each row per round, before blocks
MASKS = 1 << 20  # sent to all executors at most, 16 bytes each

_rng = np.random.default_rng(20)
_SCALE = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)

_word_codes = Memo(xxhash.xxh64_intdigest, 100_000)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit codes of the text's five-word shingles."""
    # On bytes, lower() is A-Z only, and split() is at the six ASCII white spaces.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array(list(map(_word_codes.__getitem__, words)), np.uint64)
    span = min(WORDS, len(codes))
    rolled = np.full(len(codes) - span + 1, span, np.uint64)
    for k in range(span):
        rolled = (rolled ^ codes[k : len(codes) - span + 1 + k]) * _MIX
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def registers(codes: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a non-empty set of codes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    drawn = (codes >> np.uint64(32)).astype(np.uint32) ^ codes.astype(np.uint32)
    for start in range(0, len(drawn), CHUNK):
        some = drawn[start : start + CHUNK, None] * _SCALE + _SHIFT
        some ^= some >> np.uint32(15)
        some *= np.uint32(0x2C1B3C6D)
        np.minimum(low, some.min(axis=0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(one, two)


def band_keys(registers: str) -> Column:
    """One 64-bit key per band of a sketch's registers (two bytes each); the band's number
    is part of it. Keys are derived where they are read and never stored."""
    width = 2 * ROWS
    return F.array(
        *[F.xxhash64(F.lit(b), F.substring(F.col(registers), b * width + 1, width)) for b in range(BANDS)]
    )


def log_likelihood(above, below, equal, n_one, n_two, similarity):
    """Of a similarity, given how many registers of one are above, below, equal to two's."""
    share = n_one / (n_one + n_two)

    def p(x):
        return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(share - (1 - share) * similarity), p((1 - share) - share * similarity)
    same = np.maximum(1 - more - less, 1e-12)
    return above * np.log(more) + below * np.log(less) + equal * np.log(same)


def ruled_out(one, two, n_one, n_two, threshold: float) -> np.ndarray:
    """Which pairs of sketches (rows of one and two) cannot reach the threshold."""
    above, below = (one > two).sum(axis=-1), (one < two).sum(axis=-1)
    equal = one.shape[-1] - above - below
    most = np.minimum(n_one, n_two) / np.maximum(n_one, n_two)
    at = log_likelihood(above, below, equal, n_one, n_two, np.minimum(threshold, most))
    best = at
    for similarity in np.linspace(0, threshold, 16)[:-1]:
        best = np.maximum(
            best,
            log_likelihood(above, below, equal, n_one, n_two, np.minimum(similarity, most)),
        )
    return (most < threshold) | (best - at > UNLIKELY)


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def sketch(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_shingles, the set's digest and its registers."""

    def make(batch):
        sizes, digests, sketches = [], [], []
        for t in batch.column(text).to_pylist():
            codes = shingles(t)
            sizes.append(len(codes))
            if len(codes) == 0:
                digests.append(None)
                sketches.append(None)
                continue
            found = registers(codes)
            digests.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
            sketches.append(found.astype("<u2").tobytes())
        return [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(sketches, pa.binary())]

    fields = [("n_shingles", LongType()), ("digest", BinaryType()), ("registers", BinaryType())]
    return append_columns(df, fields, make)


def _rows(batch, name: str) -> np.ndarray:
    data = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(data, np.uint16).reshape(batch.num_rows, REGISTERS)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule the threshold out."""
    one = reps.select(F.col("rep").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na"))
    two = reps.select(F.col("rep").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
    threshold = percent / 100

    def make(batch):
        if batch.num_rows == 0:
            return [pa.array([], pa.bool_())]
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        out = ruled_out(_rows(batch, "ra"), _rows(batch, "rb"), na, nb, threshold)
        return [pa.array(~out, pa.bool_())]

    both = pairs.join(two, "b").join(one, "a")
    return append_columns(both, [("may", BooleanType())], make).filter("may").select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. texts: rep, text."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def make(batch):
        found, last, kept = [], None, None
        columns = (batch.column(c).to_pylist() for c in ("a", "ta", "tb"))
        for a, ta, tb in zip(*columns, strict=True):
            if a != last:
                last, kept = a, shingles(ta)
            found.append(similar(kept, shingles(tb), percent))
        return [pa.array(found, pa.bool_())]

    both = pairs.join(two, "b").join(one, "a")
    return append_columns(both, [("linked", BooleanType())], make).filter("linked").select("a", "b")


class Merged:
    """Components within one task, joined as links are found."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart until now."""
        x, y = self.root(x), self.root(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, rep, component, ...) for every pair of blocks to compare.

    Members of a group's largest component need no comparison with each other. The others
    are dealt into blocks of about BLOCK and meet each other and, block by block, the
    largest component: one row each per block of others, so a large component beside a
    few strangers costs little more than its size.
    """
    sizes = rows.groupBy(group, "component").agg(F.count("*").alias("size"))
    # One row per component of a group.
    largest = sizes.groupBy(group).agg(
        F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("members")
    ).select(
        F.col(group).alias("grp"), F.col("top.component").alias("major"),
        F.ceil((F.col("members") - F.col("top.size")) / BLOCK).cast("int").alias("minors"),
        F.ceil(F.col("top.size") / BLOCK).cast("int").alias("majors"),
    ).filter("minors > 0")
    placed = rows.withColumnRenamed(group, "grp").join(largest, "grp")
    is_major = F.col("component") == F.col("major")
    block = F.when(is_major, -1 - F.pmod(F.xxhash64("rep"), F.col("majors"))).otherwise(
        F.pmod(F.xxhash64("rep"), F.col("minors"))
    ).cast("int")
    others = F.sequence(F.lit(0), F.col("minors") - 1)
    minor_pairs = F.transform(
        others, lambda o: F.struct(F.least(o, "mine").alias("low"), F.greatest(o, "mine").alias("high"))
    )
    with_major = F.transform(
        F.sequence(F.lit(1), F.col("majors")),
        lambda j: F.struct(F.col("mine").alias("low"), (-j).alias("high")),
    )
    of_major = F.transform(others, lambda o: F.struct(o.alias("low"), F.col("mine").alias("high")))
    pairs = F.when(is_major, of_major).otherwise(F.concat(minor_pairs, with_major))
    kept = [c for c in rows.columns if c != group]
    return placed.withColumn("mine", block).select(
        "grp", F.explode(pairs).alias("pair"), "mine", *kept
    ).select("grp", "pair.low", "pair.high", "mine", *kept)


def across(rows: DataFrame, group: str, percent: int, exact: bool) -> DataFrame:
    """Pairs (a, b) that join different components within groups, by pairs of blocks.

    rows: group, rep, n, registers, component; with exact also text. Sketches are compared first. Without exact, pairs they do not rule out count;
    with exact, only pairs whose full sets reach the threshold. Of the pairs found in a
    block, those are returned that join what was apart: enough for components, and no
    more than there are rows.
    """
    prepare_workers(rows.sparkSession)
    threshold = percent / 100

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, low, high = (k.as_py() for k in key)
        regs = _rows(table, "registers")
        rep, n, part, mine = (
            table.column(c).to_numpy() for c in ("rep", "n", "component", "mine")
        )
        sets: dict[int, np.ndarray] = {}

        def linked(i: int, j: int) -> bool:
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingles(table.column("text")[k].as_py())
            return similar(sets[i], sets[j], percent)

        merged, ones, twos = Merged(), [], []
        everyone = np.arange(len(rep))
        for i in everyone[mine == low]:
            # Within one block each pair once; across blocks every pair once.
            js = everyone[i + 1 :] if low == high else everyone[mine == high]
            js = js[part[js] != part[i]]
            # Half the registers equal or fewer: far beyond what UNLIKELY demands.
            js = js[(regs[js] == regs[i]).sum(axis=1) > REGISTERS // 2] if len(js) else js
            if len(js) == 0:
                continue
            js = js[~ruled_out(regs[js], regs[i], n[js], n[i], threshold)]
            for j in js.tolist():
                x, y = int(part[i]), int(part[j])
                if merged.root(x) != merged.root(y) and (not exact or linked(int(i), j)):
                    merged.join(x, y)
                    ones.append(int(rep[i]))
                    twos.append(int(rep[j]))
        return pa.table({"a": pa.array(ones, pa.int64()), "b": pa.array(twos, pa.int64())})

    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return _dealt(rows, group).groupBy("grp", "low", "high").applyInArrow(compare, schema)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs.

    key is an integer. component_id is the smallest key reachable over links, and kept
    marks one row of every component: of those that carry component_id any one.
    """
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows, groups = _grouped(slim, percent)
    # A class has any number of rows, but one row in groups.
    found = rows.select("key", "n_shingles", "set", "row").join(groups, "set")
    return found.select(
        F.col("key").alias(key), "n_shingles", "component_id",
        (F.col("row") == F.col("head")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75
) -> DataFrame:
    """The rows of docs that near_duplicates marks as kept, with all their columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    slim = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.struct(*others).alias("rest")
    )
    rows, groups = _grouped(slim, percent)
    kept = among(rows, "row", groups.select("head"), Scratch(docs.sparkSession))
    return kept.select(
        *[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`") for c in docs.columns]
    )


def _grouped(slim: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """slim (key, text, ...) as a written table with row, its number, and set, its class;
    and (set, component_id, head) for every class, head being the row that is kept.

    Only these two tables stay; every other one is removed after its last reader."""
    scratch = Scratch(slim.sparkSession)
    write, drop = scratch.write, scratch.drop
    # Without words there is no set: rows of one key are a class, and rows without a key
    # one each.
    own = F.coalesce(
        F.col("digest"), F.concat(F.lit("key "), F.col("key").cast("string")).cast("binary"),
        F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary"),
    )
    numbered = sketch(slim).withColumn("row", F.monotonically_increasing_id())
    sketched = write(numbered.withColumn("set", own).drop("digest"), "sketches")
    first = F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "row")).alias("first")
    classes = write(
        sketched.groupBy("set").agg(first)
        .select("set", F.col("first.row").alias("rep"), F.col("first.key").alias("key")), "classes",
    )
    held = sketched.filter("n_shingles > 0").select(
        F.col("row").alias("rep"), F.col("n_shingles").alias("n"), "registers"
    )
    reps = write(held.join(classes.select("rep"), "rep", "left_semi"), "representatives")
    texts = sketched.select(F.col("row").alias("rep"), "text")

    # Who meets whom: rows of buckets that hold more than one representative.
    buckets = reps.select("rep", F.explode(band_keys("registers")).alias("bucket"))
    ends = write(
        buckets.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
        .filter("first < last"), "ends",
    )
    met = write(buckets.join(ends, "bucket").select("bucket", "rep"), "meetings")
    # Full texts are only read of rows that meet another: taken out once, in one shuffle.
    texts = write(_texts_of(texts, met, scratch), "texts")
    scratch.release()
    seen = met.join(ends, "bucket").select("rep", F.explode(F.array("first", "last")).alias("other"))
    tried = write(_likeliest(seen), "tried")
    drop(ends)
    scratch.release()
    links = _links(tried, reps, texts, percent, scratch)
    part = components(links, scratch)

    # A bucket that still holds several components: one member of each is compared with
    # one of the largest. Linear in the components, so done twice with other members
    # before the comparison of all members across components.
    for pick in (F.min, F.max):
        pairs = _pivots(met, part, pick).join(tried, ["a", "b"], "left_anti")
        fresh = write(pairs, "tried")
        more = _links(fresh, reps, texts, percent, scratch)
        every = write(links.unionByName(more), "links")
        whole = components(every, scratch)
        seen = write(tried.unionByName(fresh), "tried")
        drop(part, links, more, tried, fresh)
        links, part, tried = every, whole, seen
        scratch.release()
    drop(tried)

    marked = met.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    )
    mixed = marked.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y")
    ).filter("x < y").select("bucket")
    open_rows = write(marked.join(mixed, "bucket"), "mixed")
    sketches = reps.select("rep", "n", "registers")
    # Clusters of what sketches alone would join hold every link that is still missing.
    # A block's components are joined here, so each cluster's own are linked with them.
    maybe = write(across(open_rows.join(sketches, "rep"), "bucket", percent, exact=False), "across")
    inside = open_rows.select("rep", "component").distinct()
    kin = inside.select(F.col("rep").alias("a"), F.col("component").alias("b")).filter("a != b")
    cluster = components(maybe.unionByName(kin), scratch)
    named = cluster.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    met_again = inside.join(named, "rep")
    several = met_again.groupBy("cluster").agg(
        F.min("component").alias("x"), F.max("component").alias("y")
    ).filter("x < y").select("cluster")
    rows = write(met_again.join(several, "cluster"), "open")
    drop(met, open_rows, maybe, cluster)
    scratch.release()
    compared = rows.join(sketches, "rep").join(_texts_of(texts, rows, scratch), "rep")
    more = write(across(compared, "cluster", percent, exact=True), "links")
    part, former = components(links.unionByName(more), scratch), part
    drop(former, links, more, rows, reps, texts)

    # Components are named after their smallest row; their keys and heads follow here.
    first = F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "rep")).alias("first")
    named = part.withColumnRenamed("node", "rep").join(classes.select("rep", "key"), "rep")
    heads = named.groupBy("component").agg(first).select(
        "component", F.col("first.key").alias("low"), F.col("first.rep").alias("head")
    )
    linked = part.withColumnRenamed("node", "rep").join(heads, "component")
    groups = write(
        classes.join(linked.drop("component"), "rep", "left").select(
            "set", F.coalesce("low", "key").alias("component_id"), F.coalesce("head", "rep").alias("head")
        ), "groups",
    )
    drop(part, classes)
    scratch.release()
    return sketched, groups


def _pivots(met: DataFrame, part: DataFrame, pick) -> DataFrame:
    """Pairs (a, b): in every bucket, one member of the component with most members there
    and one of each other component."""
    own = met.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    ).groupBy("bucket", "component").agg(pick("rep").alias("rep"), F.count("*").alias("size"))
    pivot = own.groupBy("bucket").agg(
        F.max(F.struct("size", "component", "rep")).alias("top"), F.count("*").alias("parts")
    ).filter("parts > 1").select("bucket", F.col("top.rep").alias("pivot"))
    return _likeliest(own.join(pivot, "bucket").select("rep", F.col("pivot").alias("other")))


def _likeliest(seen: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b: for every rep of seen (rep, other, a row per bucket
    they share) the PARTNERS others it shares most buckets with, which are the likest.

    This only orders the work: what stays apart is compared again, at last in full."""
    counted = seen.filter("rep != other").groupBy("rep", "other").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("rep").orderBy(F.desc("shared"), "other")
    # A rep has at most two others per band.
    best = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PARTNERS)
    return best.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _texts_of(texts: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The text of every representative of classes: its own row's."""
    return among(texts, "rep", classes.select("rep"), scratch)


def among(rows: DataFrame, number: str, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose number is in wanted's only column.

    Numbers count up within each task that gave them, so wanted is one bit per row in masks
    of 64. These go to the rows, whose texts stay where they lie; beyond MASKS of them the
    rows are joined by a shuffle. The masks' table stays until the result is read."""
    given = wanted.columns[0]
    masks = scratch.write(
        wanted.groupBy(F.shiftright(given, 6).alias("mask"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({given} & 63 AS INT))")).alias("bits")), "masks",
    )
    if masks.count() > MASKS:
        return rows.join(wanted.select(F.col(given).alias(number)).distinct(), number, "left_semi")
    held = F.getbit("bits", F.expr(f"CAST({number} & 63 AS INT)")) == 1
    return rows.join(F.broadcast(masks), F.shiftright(number, 6) == F.col("mask")).filter(held).select(*rows.columns)


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The linked pairs, as a written table."""
    wanted = scratch.write(plausible(pairs, reps, percent), "pairs")
    ends = wanted.select(F.col("a").alias("rep")).unionByName(wanted.select(F.col("b").alias("rep")))
    found = scratch.write(verify(wanted, _texts_of(texts, ends, scratch), percent), "links")
    scratch.drop(wanted)
    return found
