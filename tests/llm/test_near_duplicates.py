"""Documents by SetSketch, embeddings by NN-descent, and components."""

import random

import numpy as np
import pytest

from lapsewise.llm import graph, nndescent, setsketch
from lapsewise.session import Scratch
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents


def roots(nodes, links):
    above = {n: n for n in nodes}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(0, i) for i in range(400, 450)] + [(i, i + 1) for i in range(500, 540)]
    got = {r.node: r.component for r in graph.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = roots({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in expected.items() if n in linked}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def expected_groups(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, roots(set(texts), links)


def varied_texts(seed=5):
    """Copies, near copies at many distances, chains, and texts that share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(60)]
    texts, chain = [], list(base)
    for _ in range(30):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    for _ in range(15):
        chain[rng.randrange(len(chain))] = rng.choice(words)
        texts.append(" ".join(chain).upper())
    for _ in range(25):
        texts.append(" ".join(passage + [rng.choice(words) for _ in range(rng.randint(5, 90))]))
    texts += ["a b c d", "a b c d", "A b c D", "a b c", texts[0], texts[0]]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = varied_texts(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in setsketch.near_duplicates(docs).collect()}
    sets, groups = expected_groups(texts)
    for i in texts:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), groups[i]), i
        assert got[i].kept == (groups[i] == i)


def test_unlinked_neighbours_in_a_bucket_are_compared(spark, monkeypatch):
    """Blocks of two members: links across components must come from the second round."""
    monkeypatch.setattr(setsketch, "BLOCK", 2)
    texts = varied_texts(8)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert got == expected_groups(texts)[1]


def test_wanted_rows_are_picked_without_shuffling_texts(spark, monkeypatch):
    rows = spark.range(5000, numPartitions=7).selectExpr("id * 3 AS row", "concat('text ', id) AS text")
    wanted = spark.range(0, 15000, 7).union(spark.range(0, 6, 3)).toDF("head")
    expected = sorted({*range(0, 15000, 21), 3})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scratch = Scratch(spark)
        found = setsketch.among(rows, "row", wanted, scratch)
        assert found.columns == rows.columns
        assert sorted(r.row for r in found.collect()) == expected
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(setsketch, "MASKS", 0)  # beyond the bound by a join
        found = setsketch.among(rows, "row", wanted, scratch)
        assert sorted(r.row for r in found.collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    one, two = (rng.integers(0, 2**63, 900, dtype=np.uint64) for _ in range(2))
    both = np.union1d(one, two)
    merged = setsketch.merge(setsketch.registers(one), setsketch.registers(two))
    assert (merged == setsketch.registers(both)).all()
    near = np.concatenate([one[:800], two[:100]])  # similarity 0.8
    far = np.concatenate([one[:400], two[:500]])  # similarity 0.29
    a, b, c = (setsketch.registers(x)[None] for x in (one, near, far))
    n = np.array([900])
    assert not setsketch.ruled_out(a, b, n, n, 0.75)[0]
    assert setsketch.ruled_out(a, c, n, n, 0.75)[0]


def test_odd_documents_and_empty_tables(spark):
    got = setsketch.near_duplicates(odd_documents(spark, "component_id")).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    sets, groups = expected_groups(dict(enumerate(ODD_TEXTS)))
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), groups[r.doc_id])
    assert setsketch.near_duplicates(empty_documents(spark)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in setsketch.near_duplicates(nameless).collect()} == {
        (None, 3, False), (3, 3, True)}


def test_rows_are_told_apart_by_their_texts(spark):
    """Null ids, one id with several texts, and groups in which no row has an id."""
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, one), (None, one), (None, one + " more"), (7, two), (7, three), (7, three),
            (8, two + " more"), (9, three + " more"), (None, two), (None, ""), (None, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = setsketch.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(None, None)] * 5 + [(7, 7)] * 3 + [(8, 7), (9, 7), (None, 7)] + [(6, 6)] * 2, key=str)
    assert sum(r.kept for r in got) == 6
    left = [tuple(r) for r in setsketch.without_near_duplicates(docs).collect()]
    assert sorted(left, key=str) in [
        sorted([(None, first), (7, two), (7, three), (None, ""), (None, None), (6, "")], key=str)
        for first in (one, one + " more")]


# --- embeddings


def clusters(seed=3, size=24):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(60, size))
        for c in centres:
            for _ in range(int(rng.integers(1, 6))):
                rows.append((label, (c + rng.normal(scale=0.12, size=size)).tolist()))
        rows += [(label, centres[0].tolist())] * 20
        big = rng.normal(size=size)
        rows += [(label, (big + rng.normal(scale=0.1, size=size)).tolist()) for _ in range(90)]
    return [(i, v, label) for i, (label, v) in enumerate(rows)]


def embedding_truth(rows, threshold=0.93):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([c for _, _, c in rows])
    near = (x @ x.T >= threshold) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    groups = roots(range(len(rows)), zip(*np.nonzero(near)))
    return {rows[i][0]: (int(near[i].sum()), groups[i]) for i in range(len(rows))}


def embedding_result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df).collect()}


def test_embedding_links_equal_brute_force(spark):
    rows = clusters()
    assert embedding_result(spark, rows) == embedding_truth(rows)


def dense_pair(seed, size, dims=64):
    """Two groups far denser than a list is long, and few links between them."""
    rng = np.random.default_rng(seed)
    one, two = np.zeros(dims), np.zeros(dims)
    one[0] = 1
    two[:2] = 0.912, np.sqrt(1 - 0.912**2)
    return [(c + rng.normal(scale=0.0125, size=dims)).tolist() for c in (one, two) for _ in range(size)]


def test_links_between_saturated_groups_are_found(spark):
    rows = [(i, v, 1) for i, v in enumerate(dense_pair(2, 900))]
    truth = embedding_truth(rows)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    across = int((x[:900] @ x[900:].T >= 0.93).sum())
    assert 10 <= across <= 300 and {c for _, c in truth.values()} == {0}
    # The same vectors under two labels must stay apart.
    rows += [(1800 + i, v, 2 + (i >= 900)) for i, v in enumerate(dense_pair(2, 900))]
    assert embedding_result(spark, rows) == embedding_truth(rows)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0),
            (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0),
            (10, [1.0, 2.0, 0.0], 0), (8, [1.0, 2.0], 0), (11, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept)
           for r in nndescent.near_duplicates(df.withColumn("n_links", df.label)).collect()]
    linked = {8: (8, 2, 8, True), 9: (9, 2, 8, False)}
    assert sorted(got) == sorted([linked.get(i, (i, 0, i, True)) for i, _, _ in rows])
    assert nndescent.near_duplicates(df.limit(0)).count() == 0
