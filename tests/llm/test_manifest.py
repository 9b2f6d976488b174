"""The Merkle manifest against a tree built row by row in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lapsewise.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, leaf string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The top of a run of nodes, and for each node its siblings level by level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 16 * 16
            ways[i].append((nodes[run:p], nodes[p + 1:run + 16]))
        nodes = [sha(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return (nodes[0] if nodes else None), ways


def brute(rows: list[dict]) -> list[tuple]:
    leaves = []
    for row in rows:
        bent = dict(row)
        if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None:
            bent["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
        leaves.append((row, sha(*[enc(row[f]) for f in FIELDS]), sha(*[enc(bent[f]) for f in FIELDS])))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        mine = sorted((x for x in leaves if x[0]["source"] == source),
                      key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees.append((mine, *climb([x[1] for x in mine])))
    root, above = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, ways), up in zip(trees, above):
        for (row, leaf, claimed), way in zip(mine, ways):
            acc = claimed
            for left, right in [*way, *up]:
                acc = sha(*left, acc, *right)
            proof = sha(*[h for left, right in [*way, *up] for h in [*left, *right]])
            out.append((row["doc_id"], leaf, subroot, root, proof, acc, acc == root))
    return sorted(out, key=repr)


def rows_of(n: int, sources: list) -> list[dict]:
    return [
        {"doc_id": i, "text": None if i % 11 == 0 else f"Text {i} Äß", "lang": "en" if i % 3 else None,
         "source": sources[i % len(sources)], "n_chars": i if i % 5 else None}
        for i in range(n)
    ]


CASES = {
    "one row": rows_of(1, ["a"]),
    "lone leaves and a null source": rows_of(20, [None, "", "é", *map(str, range(17))]),
    "a source of more than two levels": rows_of(300, ["b"] * 9 + ["a"]),
    "repeated rows, one id twice, no id": [
        *rows_of(40, ["x", "y"]), *rows_of(3, ["x"]), *rows_of(3, ["x"]),
        {"doc_id": 7, "text": "", "lang": "", "source": "x", "n_chars": 0},
        {"doc_id": None, "text": "A", "lang": "de", "source": "x", "n_chars": 1},
        {"doc_id": 5, "text": "Long " * 50_000, "lang": "de", "source": None, "n_chars": 1},
    ],
}


def manifest(spark, rows, tmp_path):
    data = [tuple(r.get(c) for c in ("doc_id", "text", "lang", "source", "n_chars")) + (1, "x") for r in rows]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op12_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, tmp_path, case):
    got = manifest(spark, CASES[case], tmp_path).collect()
    assert sorted(map(tuple, got), key=repr) == brute(CASES[case])


def test_empty_table(spark, tmp_path):
    assert manifest(spark, [], tmp_path).count() == 0


def test_requested_leaves_only(spark):
    rows = [("a", i, sha(str(i)), sha(str(i))) for i in range(600)] + [(None, 1, sha("n"), sha("m"))]
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string, claimed string")
    wanted = leaves.filter("source IS NULL OR doc_id IN (0, 15, 16, 599)").select("source", "doc_id")
    whole = {(r.source, r.doc_id): r for r in merkle.manifest(leaves).collect()}
    some = merkle.manifest(leaves, wanted).collect()
    assert sorted((r.source or "", r.doc_id) for r in some) == [("", 1), ("a", 0), ("a", 15), ("a", 16), ("a", 599)]
    for r in some:
        assert r == whole[r.source, r.doc_id] and r.verified == (r.source == "a")


def test_no_group_exceeds_the_fan(spark):
    rows = [("a", i, sha(str(i)), sha(str(i))) for i in range(500)]
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string, claimed string")
    paths = merkle.manifest(leaves, fan=4).select(F.explode("path").alias("s"))
    assert paths.agg(F.max(F.length("s.left") + F.length("s.right"))).first()[0] == 3 * 64
