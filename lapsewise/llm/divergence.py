"""Divergence of the sources of each language, by a cube of tasks.

A group is a source of a language. Its share of a kept term (one in at least `least`
documents of the language) is smoothed and scaled to an integer,
p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), and two shares differ by
f = floor((p - q)^2 / (p + q)). All arithmetic is in integers.

Pairs of groups are compared in a cube. Groups of a language are dealt into blocks by
hash, its terms into blocks of about TERM_BLOCK; the cell (group block, group block, term
block) gets the two slices it needs and computes the partial divergence of every pair it
holds with numpy. A slice is replicated once per block of partner groups, and the
partial sums meet along the term axis in an aggregate. Terms neither slice holds are not
sent: both groups have their smallest share there, and only the number of such terms
matters.

Counts leave a task combined per (group, term), in dictionaries of bounded size, so a
source or word that holds a third of all rows costs one row per flush. A cell has at most
about 2 x GROUP_BLOCK x TERM_BLOCK numbers, at any size of the corpus.

Defined results: a null text, language or source counts as ''. Groups without any term
take part with all counts zero; with no kept term in their language every pair has value
0. Repeated rows count as often as they occur. An empty table gives no rows. Only the
columns lang, source and text are looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import prepare_workers
from lapsewise.session import Scratch

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
GROUP_BLOCK = 32
TERM_BLOCK = 4096
HELD = 200_000  # entries of a task's dictionaries before they are sent on
SLICE = 1 << 20  # bytes of a text that are split into terms at once

# A-Z are lower-cased, all other ASCII characters but a-z separate terms.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def term_counts(raw: bytes) -> Counter:
    """How often each term occurs in a text, which is split slice by slice."""
    raw = raw.translate(_FOLD)
    if len(raw) <= SLICE:
        return Counter(raw.split())
    counts: Counter = Counter()
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + SLICE)
        end = len(raw) if end < 0 else end
        counts.update(raw[start:end].split())
        start = end
    return counts


_COUNTED = "lang string, source string, term string, n long, docs long"


def _count(batches):
    """Rows of (lang, source, term, n, docs), and one with the empty term per group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        columns = [[], [], [], [], []]
        for (lang, source), (total, docs) in held.items():
            for term, n in total.items():
                for column, value in zip(columns, (lang, source, term, n, docs[term]), strict=True):
                    column.append(value)
        held.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        entries = 0
        for lang, source, text in zip(
            batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary())
        ):
            total, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = term_counts(text.as_py())
            total.update(found)
            docs.update(found.keys())
            total[b""] += 1
            docs[b""] += 1
            entries += len(found)
            if entries >= HELD:
                entries = 0
                if sum(len(t) for t, _ in held.values()) >= HELD:
                    yield rows()
        if sum(len(t) for t, _ in held.values()) >= HELD:
            yield rows()
    if held:
        yield rows()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact for any count."""
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1).otherwise(F.lit(1)).cast("long")


def _cell(key, table):
    """Partial divergences of the pairs of one cell of the cube."""
    low, high = key[1].as_py(), key[2].as_py()
    block = table["block"].to_numpy()
    group = table["group_no"].to_numpy()
    p = table["p"].to_numpy()
    term = table["term_no"].to_numpy()
    base = term < 0
    unlike = int(table["terms"].to_numpy()[0])
    names, column = np.unique(term[~base], return_inverse=True)
    rest = unlike - len(names)

    def slice_of(which):
        mine = base & (block == which)
        ids, first = np.unique(group[mine], return_index=True)
        lowest = p[mine][first]
        dense = np.repeat(lowest[:, None], len(names), axis=1)
        own = (block == which)[~base]
        dense[np.searchsorted(ids, group[~base][own]), column[own]] = p[~base][own]
        return ids, lowest, dense

    ids_a, low_a, dense_a = slice_of(low)
    ids_b, low_b, dense_b = (ids_a, low_a, dense_a) if low == high else slice_of(high)
    out_a, out_b, out_v = [], [], []
    for i, ident in enumerate(ids_a):
        later = slice(i + 1, None) if low == high else slice(None)
        others, lowest = dense_b[later], low_b[later]
        part = ((dense_a[i] - others) ** 2 // (dense_a[i] + others)).sum(axis=1)
        part = part + rest * ((low_a[i] - lowest) ** 2 // (low_a[i] + lowest))
        out_a.append(np.full(len(part), ident))
        out_b.append(ids_b[later])
        out_v.append(part)
    return pa.table({
        "a": np.concatenate(out_a).astype("int64"), "b": np.concatenate(out_b).astype("int64"),
        "part": np.concatenate(out_v).astype("int64"),
    }) if out_a else pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "part")})


def divergences(groups: DataFrame, entries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(a, b, value) of every two groups a, b of a language, once per pair.

    groups: (lang, group_no, lowest, sources, terms), lowest the share of an absent term,
    sources and terms the numbers of groups and kept terms of the language.
    entries: (group_no, term_no, p) of the terms that occur. vocabulary: (lang, term_no).
    """
    laid = groups.select(
        "lang", "group_no", "lowest",
        F.ceil(F.col("sources") / GROUP_BLOCK).cast("int").alias("group_blocks"),
        F.greatest(F.ceil(F.col("terms") / TERM_BLOCK), F.lit(1)).cast("int").alias("term_blocks"),
    ).withColumn("block", F.expr("CAST(pmod(xxhash64(group_no), group_blocks) AS INT)"))
    term_block = F.expr("CAST(pmod(xxhash64(term_no), term_blocks) AS INT)").alias("term_block")
    blocks = laid.select("lang", "term_blocks").distinct()
    sizes = vocabulary.join(blocks, "lang").select("lang", term_block).groupBy("lang", "term_block").agg(
        F.count("*").alias("terms")
    )
    held = entries.join(laid, "group_no").select(
        "lang", "group_no", "block", "group_blocks", "term_no", "p", term_block
    )
    lowest = laid.select(
        "lang", "group_no", "block", "group_blocks", F.lit(-1).cast("long").alias("term_no"),
        F.col("lowest").alias("p"), F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"),
    )
    slices = held.unionByName(lowest).join(sizes, ["lang", "term_block"], "left").select(
        "lang", "group_no", "block", "term_no", "p", "term_block",
        F.coalesce("terms", F.lit(0)).cast("long").alias("terms"),
        F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)).alias("partner"),
    )
    cells = slices.select(
        "lang", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"),
        "term_block", "block", "group_no", "term_no", "p", "terms",
    )
    partial = cells.groupBy("lang", "low", "high", "term_block").applyInArrow(
        _cell, "a long, b long, part long"
    )
    return partial.groupBy("a", "b").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows rank the other sources of the
    language by divergence, `term` rows the terms a source has more of than its language."""
    scratch = Scratch(docs.sparkSession)
    prepare_workers(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = scratch.write(
        read.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts",
    )
    vocabulary = scratch.write(
        counts.filter("term <> ''").groupBy("lang", "term")
        .agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
        .select("lang", "term", "in_lang", F.monotonically_increasing_id().alias("term_no")), "vocabulary",
    )
    named = scratch.write(
        counts.filter("term = ''").select("lang", "source", F.monotonically_increasing_id().alias("group_no")),
        "groups",
    )
    kept = scratch.write(
        counts.join(vocabulary, ["lang", "term"]).join(named, ["lang", "source"])
        .select("group_no", "lang", "term_no", "n", "in_lang"), "kept-counts",
    )
    languages = named.groupBy("lang").agg(F.count("*").alias("sources")).join(
        vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("in_lang")),
        "lang", "left",
    ).select("lang", "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "in_lang")])
    totals = kept.groupBy("group_no").agg(F.sum("n").alias("total"))
    groups = scratch.write(
        named.join(totals, "group_no", "left").join(languages.withColumnRenamed("in_lang", "lang_total"), "lang")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("lowest", share(F.lit(0), F.col("total"), F.col("terms"))), "group-totals",
    )
    entries = kept.drop("lang").join(groups, "group_no").select(
        "group_no", "lang", "source", "term_no", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    one_way = divergences(groups, entries.select("group_no", "term_no", "p"), vocabulary)
    both = one_way.select(
        F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "value"
    ).select("e.a", "e.b", "value")
    names = groups.select("lang", "source", F.col("group_no").alias("a"))
    others = groups.select(F.col("source").alias("item"), F.col("group_no").alias("b"))
    pairs = both.join(names, "a").join(others, "b").select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value"
    )
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(ordered))

    risen = entries.filter("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    terms = risen.join(vocabulary.select("term_no", F.col("term").alias("item")), "term_no").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value"
    )
    terms = terms.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
