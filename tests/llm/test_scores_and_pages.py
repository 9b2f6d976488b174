"""Language-model scores from the Bloom filter, and main text by wrappers."""

import math
import random
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lapsewise.llm import ngram_bloom, wrappers
from lapsewise.llm.common import fold
from lapsewise.session import Scratch
from tests.llm.odd import ODD_TEXTS, odd_documents

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(docs, got):
    counts = Counter()
    for i, text in docs:
        if not held(i):
            counts.update(ngram_bloom.tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in docs:
        words = ngram_bloom.tokens(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def scored(docs):
    return ngram_bloom.score(docs, F.coalesce(fold("doc_id", 7) == 2, F.lit(False)))


def test_scores_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in scored(docs).collect()}
    check_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], got)
    out = [r for r in got.values() if r.held_out]
    # The model tells held-out texts better than single words do.
    assert sum(r.score for r in out) > 0.85 * sum(r.base_score for r in out)


def test_scores_of_odd_documents(spark):
    docs = odd_documents(spark, "score")
    got = scored(docs).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_base(rows, {r.doc_id: r for r in got})
    assert scored(docs.limit(0)).count() == 0
    untrained = ngram_bloom.score(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)


def test_parts_and_blocks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.score for r in scored(docs).collect()}
    monkeypatch.setattr(ngram_bloom, "SEGMENT_KEYS", 2000)
    monkeypatch.setattr(ngram_bloom, "PIECE_BYTES", 5000)
    scratch = Scratch(spark)

    def blocks():
        return ngram_bloom.block_table(docs.select(
            F.col("doc_id").alias("key"), "text", F.lit(False).alias("held_out")), scratch)

    table = ngram_bloom.build_filter(blocks(), 60_000, scratch)
    assert table.count() > 4
    one = {r.block: bytes(r.levels) for r in ngram_bloom.probe(blocks(), table, scratch).collect()}
    many = {r.block: bytes(r.levels) for r in ngram_bloom.probe(blocks(), table, scratch, 12_000).collect()}
    assert one == many
    assert {r.doc_id for r in scored(docs).collect()} == set(whole)


def brute_scores(rows):
    """Scores by exact counts of words and bigrams in dictionaries."""
    told = {i: [w.decode() for w in ngram_bloom.tokens(t)] for i, t in rows}
    train = [w for i, w in told.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    end = told[rows[0][0]][-1]
    pairs = lambda words: zip([end, *words[:-1]], words)
    single, double = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in pairs(ws))
    n, classes = sum(single.values()), ngram_bloom.CLASSES
    once = sum(c == 1 for c in single.values())
    unknown = min(max((once + 0.5) / (n + 1), 1e-9), 0.5)
    of = lambda c: min(math.frexp(c)[1], classes - 1)
    every, new = Counter(), Counter()
    for h, w in (p for ws in train for p in pairs(ws)):
        every[of(single[h])] += 1
        new[of(single[h])] += double[h, w] == 1
    fresh = {k: min(max((new[k] + 0.5) / (every[k] + 1), 1e-4), 1 - 1e-4) for k in range(classes)}

    def chance(h, w):
        alone = (1 - unknown) * single[w] / n if single[w] else unknown
        if not single[h]:
            return alone
        seen = min(2 ** (math.frexp(double[h, w])[1] - 1) if double[h, w] else 0, single[h], single[w])
        share = fresh[of(single[h])]
        return (1 - share) * seen / single[h] + share * alone

    return {i: sum(math.log10(chance(*p)) for p in pairs(ws)) for i, ws in told.items()}


def test_scores_equal_brute_force(spark):
    """All but a few texts, in which the filter takes an absent bigram for one seen."""
    words = "the cat sat on a mat and then it ran off to eat".split()
    rows = [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(1, 3 + i % 4))) for i in range(600)]
    rows += [(600 + i, f"Rare{i} the") for i in range(40)]
    got = {r.doc_id: r.score for r in scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = brute_scores(rows)
    off = [i for i in wanted if abs(got[i] - wanted[i]) > 1e-9]
    assert len(off) < 0.1 * len(rows)


def test_chances_after_a_word_sum_to_one_at_most():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 60, 500).astype(float)
    n = counts.sum()
    smoothing = ngram_bloom.Smoothing(int(n), 500, 0.03, tuple(np.linspace(0.1, 0.9, ngram_bloom.CLASSES)))
    for context in (1.0, 7.0, 300.0):
        left, levels = context, np.zeros(500, np.uint8)
        for i in rng.permutation(500):
            c = min(rng.integers(0, 9), left, counts[i])
            left -= c
            levels[i] = math.frexp(c)[1]
        chances = 10.0 ** ngram_bloom.log_chances(counts, np.full(500, context), levels, smoothing)
        none = 10.0 ** ngram_bloom.log_chances(np.zeros(1), np.array([context]), np.zeros(1, np.uint8), smoothing)
        assert chances.sum() + none[0] <= 1 + 1e-9


def test_chances_of_new_successors_come_from_all_training_texts(spark, monkeypatch):
    """Texts of two kinds, blocks of one text: a sample of blocks sees one kind only."""
    rows = [(i, f"a b c d e f g h {i % 3}" if i % 20 else " ".join(f"w{i}x{k} a" for k in range(40)))
            for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    seen = []
    keep = ngram_bloom.Smoothing
    monkeypatch.setattr(ngram_bloom, "Smoothing", lambda *a: seen.append(keep(*a)) or seen[-1])
    whole = {r.doc_id: r.score for r in scored(docs).collect()}
    monkeypatch.setattr(ngram_bloom, "BLOCK_TOKENS", 1)
    assert {r.doc_id: r.score for r in scored(docs).collect()} == pytest.approx(whole, rel=1e-12)
    words = [ngram_bloom.tokens(t) for i, t in rows if not held(i)]
    pairs = [p for w in words for p in zip([ngram_bloom.END, *w[:-1]], w, strict=True)]
    known, n = Counter(pairs), Counter(w for t in words for w in t)
    every, once = Counter(), Counter()
    for p in pairs:
        every[n[p[0]].bit_length()] += 1
        once[n[p[0]].bit_length()] += known[p] == 1
    for s in seen:
        for k in every:  # the filter errs a little
            assert s.fresh[k] == pytest.approx((once[k] + 0.5) / (every[k] + 1), abs=0.02)


def test_the_filter_never_loses_a_count():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    counts = rng.zipf(1.7, len(keys)).clip(1, 10**6)
    bits = np.frombuffer(ngram_bloom.build_segment(keys, counts), np.uint8)
    levels = ngram_bloom.read_levels(keys, bits)
    assert (levels >= ngram_bloom.quantise(counts)).all()
    assert (levels == ngram_bloom.quantise(counts)).mean() > 0.97
    strangers = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
    assert (ngram_bloom.read_levels(strangers, bits) > 0).mean() < 0.02


def test_the_segments_of_a_part_are_read_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    counts, where = rng.zipf(1.7, len(keys)).clip(1, 10**6), ngram_bloom.segment_of(keys, 40)
    bits = {s: ngram_bloom.build_segment(keys[where == s], counts[where == s]) for s in range(40) if s != 7}
    read, calls = ngram_bloom.read_levels, []

    def counted(some, *others):
        calls.append(len(some))
        return read(some, *others)

    monkeypatch.setattr(ngram_bloom, "read_levels", counted)
    parts = [ngram_bloom.Part.of(40, {s: b for s, b in bits.items() if s // 20 == k}) for k in range(2)]
    asked = rng.choice(np.append(keys, rng.integers(2**63, 2**64, 500, dtype=np.uint64)), 30_000)
    found = ngram_bloom.levels_in(parts, asked)
    assert len(calls) == 2 and sum(calls) <= len(np.unique(asked))
    there = ngram_bloom.segment_of(asked, 40)
    for s in range(40):
        expected = read(asked[there == s], np.frombuffer(bits[s], np.uint8)) if s in bits else 0
        assert (found[there == s] == expected).all()


def test_few_keys_and_small_batches_change_no_bit(monkeypatch):
    rng = np.random.default_rng(10)
    keys = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    counts = rng.zipf(1.7, len(keys)).clip(1, 10**6)
    whole = ngram_bloom.build_segment(keys, counts)
    asked = np.append(keys, rng.integers(2**63, 2**64, 3000, dtype=np.uint64))
    levels = ngram_bloom.read_levels(asked, np.frombuffer(whole, np.uint8))
    monkeypatch.setattr(ngram_bloom, "AT_ONCE", 7)
    assert ngram_bloom.build_segment(keys, counts) == whole
    for few in (0, 10**6):
        monkeypatch.setattr(ngram_bloom, "FEW", few)
        assert (ngram_bloom.read_levels(asked, np.frombuffer(whole, np.uint8)) == levels).all()
    assert (ngram_bloom.levels_in([], asked) == 0).all()


def test_no_writer_or_reader_holds_a_whole_file_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_bloom, "BLOCK_TOKENS", 1)
    docs = spark.range(0, 24, 1, 1).select(
        F.col("id").alias("key"), F.lit(False).alias("held_out"),
        F.expr("array_join(transform(sequence(1, 40000), x -> hex(xxhash64(id * 40000 + x))), ' ')").alias("text"),
    )
    table = ngram_bloom.block_table(docs, Scratch(spark))
    groups = []
    for file in table.inputFiles():
        meta = pq.ParquetFile(urlparse(file).path).metadata
        groups += [meta.row_group(k) for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24
    assert max(g.total_byte_size for g in groups) < 2 * ngram_bloom.LARGE_ROWS["parquet.block.size"]


def test_binaries_of_cut_arrays():
    values = [b"", b"a", b"bc", b"", b"\x00d"]
    for kind in (pa.binary(), pa.large_binary()):
        for a, b in ((0, 5), (1, 3), (2, 5), (3, 4), (2, 2)):
            assert ngram_bloom.binaries(pa.array(values, kind)[a:b]) == values[a:b]


def test_packing_of_keys_and_tokens_round_trips():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    assert (ngram_bloom._unpack(ngram_bloom._pack(keys)) == keys).all()
    index = rng.integers(0, 2**32, 3000)
    assert (ngram_bloom.unpack_tokens(ngram_bloom.pack_tokens(index)) == index).all()


# --- pages


def page(title, paragraphs, comments=(), host="a.example.com", cut=None, notice=True):
    text = (
        '<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>'
        '<header class="site">Site name</header><nav><ul><li><a href="/">Home</a></li>'
        '<li><a href="/b">B &amp; C</a></li></ul></nav>'
        + ('<div class="cookie-notice">We use cookies</div>' if notice else "")
        + f'<main><article class="post"><h1>{title}</h1>'
        + "".join(f"<p>{p}</p>" for p in paragraphs)
        + '<div class="ad">Buy now</div><form><input name=q>Search</form>'
        + "".join(f'<section class="comments"><p>{c}</p></section>' for c in comments)
        + '</article><aside>More</aside></main><footer>&copy; me</footer>'
        '<script>if (a < b) { c("</p>") }</script></body></html>'
    )
    return text[:cut]


def test_only_the_article_is_extracted(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for i in range(40):
        paragraphs = [f"Text {i}\n  number&nbsp;{k} &lt;b&gt; <b>bold</b>" for k in range(rng.randint(1, 6))]
        comments = [f"reader {k}" for k in range(rng.randint(0, 3))]
        rows.append((i, f"https://a.example.com/{i}", page(f"Title {i}", paragraphs, comments, notice=i % 2)))
        expected[i] = "\n".join([f"Title {i}", *(f"Text {i} number {k} <b> bold" for k in range(len(paragraphs)))])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrappers.infer(pages).cache()
    wrapper = found.first()
    assert found.count() == 1 and wrapper.pages == 40 and wrapper.regions[0] == "article.post"
    got = {r.page_id: r.text for r in wrappers.extract(pages, found).collect()}
    assert got == expected


def test_shapes_align_to_a_union_free_expression():
    one = wrappers.fold_repeats("<ul> <li> # </li> <li> # </li> </ul> <p> # </p>".split())
    two = wrappers.fold_repeats("<ul> <li> # </li> </ul> <hr> <p> # </p> <p> # </p>".split())
    assert wrappers.write(one) == "<ul>(<li>#</li>)+</ul><p>#</p>"
    merged = wrappers.merge(one, two)
    text = wrappers.write(merged)
    assert "(<hr>)?" in text and "(" in text and "|" not in text
    assert wrappers.merge(merged, merged) == merged


def test_a_container_the_wrapper_requires_is_preferred_to_an_optional_one(spark):
    whole = "<body><div class='content'><p>{0} begins at length</p>{1}<p>{0} ends</p></div></body>"
    inner = "<div class='entry'><p>{0} goes on, {0} goes on, {0} goes on</p></div>"
    rows = [(i, "https://a.example.com/", whole.format(i, inner.format(i) if i % 2 else "")) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrappers.infer(pages).cache()
    assert found.first().regions == ["div.content", "div.entry"]
    got = {r.page_id: r.text for r in wrappers.extract(pages, found).collect()}
    middle = "{0} goes on, {0} goes on, {0} goes on\n"
    assert got == {
        i: f"{i} begins at length\n{middle.format(i) if i % 2 else ''}{i} ends" for i in range(8)
    }
    one = ["<p>", ["?", ["<b>"]], ["+", ["<li.x>", "#", "</li>"]], "</p>"]
    assert wrappers.required(one) == {"p", "li.x"}


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "SHAPES_AT_ONCE", 2)
    bodies = [None, "", "plain text", "<p>open", "<article><p>cut &am", "<", "<a", "</p></div>",
              page("T", ["one", "two"]), page("T", ["one", "two"], cut=330), "<!-- only -->",
              "<body><div>" * 50 + "deep", "<script>x</script>", page("T", ["one", "two"])]
    rows = [(i, None if i % 4 == 0 else "https://h.example.com/x", b, "old") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrappers.extract(pages, wrappers.infer(pages)).collect()}
    assert len(got) == len(bodies)
    assert got[0] == got[1] == got[10] == got[12] == ""
    assert got[2] == "plain text" and got[3] == "open" and got[8] == "T\none\ntwo"
    none = pages.limit(0)
    assert wrappers.extract(none, wrappers.infer(none)).count() == 0


def test_the_hosts_of_urls(spark):
    urls = ["HTTPS://User@Www.Example.org:80/x?y", "no url", None, "http://a.b/", "ftp://c#d"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(wrappers.host_of(F.col("url"))).collect()]
    assert got == ["www.example.org", "", "", "a.b", "c"]


ARTICLE = "<p>An article that goes on for some sentences.</p><p>It has two paragraphs.</p>"


@pytest.mark.parametrize("page", [
    "<main class='content has-sidebar'>{}</main>",
    "<div id='page' class='no-sidebar'>{}</div>",
    "<article class='post comments-open category-notice'>{}</article>",
    "<div class='header-fixed'>{}</div>",
    "<div class='sidebar-left'><div class='sidebar'>Links</div>{}</div>",
    "<nav>Menu</nav><div class='wrap'>{}<div class='ad-slot'>Buy</div></div>",
    "<div>{}</div><div class='comments-area'><p>" + "I disagree with all of it. " * 20 + "</p></div>",
])
def test_names_of_layouts_and_states_drop_nothing(page):
    text = wrappers.Page(f"<html><body>{page.format(ARTICLE)}</body></html>").text([])
    assert text == "An article that goes on for some sentences.\nIt has two paragraphs."


def test_a_line_break_inside_a_block_is_white_space():
    assert wrappers.Page("<p>one<br>two<br/> three</p><p>four</p>").text([]) == "one two three\nfour"


def flat(items, chosen):
    """Whether an expression can produce a sequence: the symbols it must and may give."""
    out = []
    for i in items:
        if isinstance(i, str):
            out.append(i)
        elif i[0] == "+" or chosen(i):
            out += flat(i[1], chosen)
    return out


def test_very_long_pages_are_aligned():
    rng = random.Random(3)
    unlike = [[f"<{side}{i}>" for i in range(20_000)] for side in "ab"]
    assert len(wrappers.merge(*unlike)) == 2
    one = [f"<t{i}>" for i in range(50_000)]
    two = [x for x in one if rng.random() > 0.001]
    merged = wrappers.merge(one, two)
    assert flat(merged, lambda i: True) == one
    assert flat(merged, lambda i: False) == two
    few = [[f"<t{rng.randrange(5)}>" for _ in range(3000)] for _ in range(2)]
    assert wrappers.merge(*few)
    deep = wrappers.Page("<div>" * 60_000 + "x<p>y")
    assert deep.text([]) == "x\ny"
