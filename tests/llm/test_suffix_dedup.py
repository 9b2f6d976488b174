"""Removal of repeated byte strings against a set of all windows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapsewise.llm import suffix_dedup as S

LENGTH = 100


def brute(rows: list[tuple]) -> dict:
    """(doc_id, text) to (kept bytes, removed, spans); rows are (doc_id, text, tie)."""
    seen, out = set(), {}
    for ident, text, _ in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            window = raw[i:i + LENGTH]
            if window in seen:
                gone[i:i + LENGTH] = b"\1" * LENGTH
            seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[ident, text] = (kept, sum(gone), spans)
    return out


def check(spark, rows, split=S.SPLIT):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tied = docs.select("doc_id", "text", F.xxhash64("text")).collect()
    wanted = brute([tuple(r) for r in tied])
    got = S.without_repeats(docs.selectExpr("*", "text AS kept", "1 AS id", "'x' AS spots"), split=split)
    # The text is gone from the result, so rows are compared by id and outcome.
    assert got.columns == ["doc_id", "id", "spots", "kept", "n_removed", "n_spans", "n_bytes"]
    assert sorted(((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in got.collect()), key=repr) == sorted(
        ((i, *wanted[i, t]) for i, t in rows), key=repr)


def sentence(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "Straße", "été", "dolor\n", "sit"]) + str(rng.randrange(90)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    common, line = sentence(rng, 60), "=" * 130
    rows = [(i, sentence(rng, rng.randrange(3, 90))) for i in range(40)]
    rows += [(100 + i, f"{sentence(rng, 9)} {common} {sentence(rng, 9)}") for i in range(30)]
    rows += [(200 + i, f"{sentence(rng, 2)}\n{line}\n{sentence(rng, 2)}{line}") for i in range(20)]
    rows += [(300 + i, common) for i in range(10)] + [(320, common[:99]), (321, common[:100]), (322, common[1:101])]
    rows += [(7, common), (7, common), (7, sentence(rng, 80)), (None, common[40:]), (None, None), (8, None), (9, "")]
    rows += [(400, "a" * 99), (401, "a" * 100), (402, "a" * 500), (403, "ab" * 300), (404, "\0" * 250), (405, "abc" * 70)]
    rows += [(500, (sentence(rng, 30) + "x") * 7), (-5, common[::-1]), (501, common[::-1])]
    return rows


@pytest.mark.parametrize("split", [S.SPLIT, 2, 0])
def test_equals_brute_force(spark, split):
    check(spark, corpus(), split)


def test_text_longer_than_a_portion(spark):
    rng = random.Random(1)
    block = "".join(chr(rng.randrange(97, 123)) for _ in range(50_000))
    tail = "".join(chr(rng.randrange(97, 123)) for _ in range(S.SOME_BYTES + 1000))
    check(spark, [(1, block + tail + block), (2, tail[-5000:] + block[:300]), (3, "q" + tail[1:])])


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=60), min_size=2, max_size=12), st.integers(1, 4))
def test_merging_shards_finds_all_common_prefixes(texts, shards):
    length = 8
    texts = list(dict.fromkeys(texts))
    lasts, counts, sizes, owners = [], [], [], []
    for s in range(shards):
        own = texts[s::shards]
        if not own:
            continue
        size = np.array([len(t) + 1 for t in own])
        symbols = np.array([c for t in own for c in [*(ord(x) + 1 for x in t), 0]], np.uint16)
        last, first = S.transform(symbols, np.cumsum(size) - size, size)
        lasts.append(last)
        counts.append(len(own))
        sizes += [len(own[i]) for i in first]
        owners += [own[i] for i in first]
    stretch, offset, interval = S.merged_intervals(lasts, counts, np.array(sizes), length)
    got = {}
    for s, o, i in zip(stretch, offset, interval):
        got.setdefault(int(i), []).append((owners[s], int(o)))
    wanted = {}
    for t in texts:
        for o in range(len(t) - length + 1):
            wanted.setdefault(t[o:o + length], []).append((t, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in wanted.values() if len(v) > 1)


def test_transform_is_the_last_column_of_sorted_rotations():
    texts = ["banana", "ananas", "nab"]
    size = np.array([len(t) + 1 for t in texts])
    symbols = np.array([c for t in texts for c in [*(ord(x) + 1 for x in t), 0]], np.uint16)
    last, _ = S.transform(symbols, np.cumsum(size) - size, size)
    turned = sorted((t + "\0")[i:] + (t + "\0")[:i] for t in texts for i in range(len(t) + 1))
    assert [chr(c - 1) if c else "\0" for c in last] == [r[-1] for r in turned]
