"""The divergence of sources against exact sums over all terms in plain Python."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest

from lapsewise.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows) -> list[tuple]:
    rows = [tuple(v or "" for v in row) for row in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, Counter(TERM.findall(lower(t)))) for la, s, t in rows if la == lang]
        docs = Counter(term for _, c in mine for term in c)
        kept = sorted(t for t, n in docs.items() if n >= divergence.LEAST_DOCUMENTS)
        count = {s: Counter() for s, _ in mine}
        for s, c in mine:
            count[s].update(c)
        whole = sum(count.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        found = {s: {"pair": [], "term": []} for s in count}
        for a, b in permutations(count, 2):
            found[a]["pair"].append((-sum(f(p[a][t], p[b][t]) for t in kept), b.encode()))
        for s in count:
            found[s]["term"] = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in found[s].items():
                for rank, (value, item) in enumerate(sorted(items)[: 10 if part == "term" else None], 1):
                    out.append((lang, s, part, item.decode(), -value, rank))
    return sorted(out)


def corpus() -> list[tuple]:
    rows = []
    for i in range(240):
        words = [f"w{chr(97 + (i * k) % 26)}{chr(97 + k % 7)}" for k in range(1, 3 + i % 37)]
        text = " ".join(words) + (" Straße ÉTÉ x9y" if i % 3 else "\nBig-BIG,big")
        rows.append((["en", "de", None][i % 3], f"s{i % 11}" if i % 13 else None, text))
    rows += [("en", "s1", None), ("en", "", ""), ("fr", "a", "once"), ("fr", "b", None), ("fr", None, "12 34")]
    rows += [("en", "loud", "echo " * 40_000)] + [("en", "loud", "echo")] * 12  # a long text, rows repeated in full
    rows += [("en", "é", "wab wbb"), ("en", "z", "wab wbb")]  # a tie in every value
    return rows


@pytest.mark.parametrize("blocks", [(32, 4096), (3, 5)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "TERM_BLOCK", blocks[1])
    docs = spark.createDataFrame(corpus(), "lang string, source string, text string").withColumnsRenamed({})
    docs = docs.selectExpr("*", "1 AS term", "'x' AS rank", "2 AS value")
    got = divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == brute(corpus())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0


def test_slices_of_a_text_keep_whole_terms(monkeypatch):
    text = " ".join(f"Wort{'ß' * (i % 9)}x" for i in range(500)).encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert divergence.term_counts(text) == whole


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 3 * 10**12 + 1, 10**13 + 7
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(5)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 10)
