"""Best-fit packing of pieces, and sharding of whole groups."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapsewise.llm import packing, sharding
from lapsewise.llm.queries import QUERIES
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


def test_random_texts_encode_as_the_library_does():
    own, library, rng = packing.load(WORDS), Tokenizer.from_file(WORDS), random.Random(6)
    parts = [" ", "  ", "\n", "a", "B", "th", "ing", "'s", "'LL", "é", "É", "ß", "中", "1", "23", "!", "--",
             ".", ",", "\x1c", " ", "e", "́", "😀", "İ", "Σ", "<|endoftext|>",
             "<|startoftext|>", "<|", "Å", "ﬁ", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    expected = library.encode_batch(texts, add_special_tokens=False)
    for text, got, want in zip(texts, own.encode_all(texts), expected):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(text)


def test_pieces_and_places_of_odd_documents(spark):
    docs = odd_documents(spark, "piece")
    pieces = packing.cut(packing.tokenise(docs, WORDS), length=512).cache()
    library = Tokenizer.from_file(WORDS)
    found = defaultdict(dict)
    for r in pieces.filter("doc_id != 5").collect():
        assert r.start == 512 * r.piece and 1 <= r.length <= 512
        found[r.doc_id][r.piece] = np.frombuffer(r.ids, "<u4").tolist()
    for i, text in enumerate(ODD_TEXTS):
        if i != 5:
            joined = [x for p in sorted(found[i]) for x in found[i][p]]
            assert joined == library.encode(text or "", add_special_tokens=False).ids + [1]
    placed = packing.pack(pieces.drop("ids", "text"), capacity=512).collect()
    assert len(placed) == pieces.count()
    check_sequences([(r.sequence_id, r.offset, r.length) for r in placed], 512)


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_sum_of_squares_places_where_the_sum_is_smallest():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 41, 300), 40
    places, offsets = packing.sum_of_squares(lengths, capacity)
    gaps, used = defaultdict(int), {}
    for s, at, offset in zip(lengths.tolist(), places.tolist(), offsets.tolist()):
        def after(g):
            counts = dict(gaps)
            if g is not None:
                counts[g] -= 1
            left = (capacity if g is None else g) - s
            if left:
                counts[left] = counts.get(left, 0) + 1
            return sum(n * n for n in counts.values())

        options = {g: after(g) for g, n in gaps.items() if n and g >= s} | {None: after(None)}
        chosen = None if at not in used else capacity - used[at]
        assert options[chosen] == min(options.values())
        assert offset == used.get(at, 0)
        if chosen is not None:
            gaps[chosen] -= 1
        used[at] = offset + s
        if used[at] < capacity:
            gaps[capacity - used[at]] += 1


def test_the_packing_query_wastes_little(spark):
    rows = QUERIES["op9_best_fit_packing"](spark, SF).collect()
    sequences = check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert sequences <= 1.02 * sum(r.length for r in rows) / 4096 + 1
    assert packing.pack(packing.cut(packing.tokenise(empty_documents(spark), WORDS))).count() == 0


# --- sharding


def test_the_tree_gives_the_tightest_bin():
    rng, tree, bins = random.Random(1), sharding.CapacityTree(), {}
    for step in range(2000):
        if rng.random() < 0.5 or not bins:
            bins[step] = rng.randrange(100)
            tree.insert(bins[step], step)
        else:
            need = rng.randrange(110)
            fits = [(c, n) for n, c in bins.items() if c >= need]
            found = tree.take_tightest(need)
            assert found == (min(fits) if fits else None)
            if found:
                del bins[found[1]]


def test_bins_are_best_fit_decreasing_and_even():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 500) for _ in range(3000)]
    bins = sharding.pack_evenly(sizes, 16)
    load = np.bincount(bins, sizes, 16)
    assert load.max() <= 1.001 * sum(sizes) / 16 + 1
    assert sharding.pack_evenly([10, 1, 1], 2) == [0, 1, 1]
    assert sharding.pack_evenly([], 4) == []


def shards_of(spark, docs):
    rows = sharding.weigh(docs, keep=("doc_id",)).cache()
    placed = sharding.shard(rows, 4).cache()
    return sharding.number_slots(placed, ["doc_id", "text_crc32"]).collect()


def test_odd_documents_are_sharded_whole(spark):
    got = shards_of(spark, odd_documents(spark, "shard"))
    assert len(got) == len(ODD_TEXTS) + 1
    for r in got:
        data = (ODD_TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    by = defaultdict(set)
    for r in got:
        by[ODD_TEXTS[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards_of(spark, empty_documents(spark)) == []


@pytest.mark.parametrize("heavy", [1, 512])
def test_a_group_with_a_third_of_all_rows(spark, monkeypatch, heavy):
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    monkeypatch.setattr(sharding, "SLICE_ROWS", 7)
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    got = shards_of(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) == 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
