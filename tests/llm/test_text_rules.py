"""Quality rules, byte-level BPE, language identification and toxicity."""

import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lapsewise.llm import bpe, langid, quality, toxicity
from lapsewise.llm.oracles import ORACLES
from lapsewise.llm.queries import QUERIES
from tests.llm.odd import ODD_TEXTS, empty_documents, odd_documents

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- quality rules


def measured(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1
        for p in (i, i + 1, i + 2)
    }
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force_on_odd_texts(spark):
    got = quality.measures(odd_documents(spark, "n_words")).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    for r in got:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == measured(ODD_TEXTS[r.doc_id]), r.doc_id


def test_one_projection_without_shuffle_or_python(spark):
    plan = quality.judge(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_passing_rows_compute_each_measure_once(spark):
    docs = odd_documents(spark)
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    passing = quality.passing(docs)
    assert {r.doc_id for r in passing.collect()} == kept and passing.columns == docs.columns
    plan = passing._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1


def test_rules_name_what_they_reject_and_keep_clean_text(spark):
    clean = ("It was said that the house on the hill had been there for a very long time, "
             "and none of the people who lived in the village knew by whom it was built. "
             "In the winter of that year the snow lay deep, and the road to the town was closed. "
             "With the spring they came to see it again, as they had in the years before.")
    rows = [(1, clean), (2, "the cat " * 60), (3, "### " * 30 + clean), (4, "zxqv wkjh " * 3 + " ".join(f"q{i}z" for i in range(80)))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].broken_rules == []
    assert "repeated_words" in got[2].broken_rules and got[2].base_failed
    assert "symbols" in got[3].broken_rules and not got[3].base_failed
    assert got[4].broken_rules == ["stop_words"]


def test_quality_query_equals_its_oracle(spark):
    got = QUERIES["op7_quality_rules"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(ORACLES["op7_quality_rules"])
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


def test_quality_of_an_empty_table(spark):
    assert quality.judge(empty_documents(spark)).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS),
        special_tokens={},
    )


def test_random_texts_encode_as_the_library_does(library):
    own, rng = bpe.load(RANKS, public_tokenizers.PATTERN), random.Random(4)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "th", "ing", "'s", "é", "ß", "中", "1", "23", "!", "--",
             "\x1c", "\x85", "　", " ", "😀", "Zz", "aaaa", "====", "я", "\r\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()
    for text in ("a" * 20_000, " " * 5000 + "x", "ab" * 9000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encode_and_decode_odd_documents(spark, library):
    docs = odd_documents(spark, "ids")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "ids"]
    for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


# --- language identification


def test_held_out_languages_are_told(spark):
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert got.filter("rejected").count() <= 0.02 * got.count()


def test_language_of_odd_documents(spark):
    model = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)
    got = {r.doc_id: r for r in langid.identify(odd_documents(spark, "score"), model).collect()}
    for i, text in enumerate(ODD_TEXTS):
        letters = any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == "und") == (not letters)
        assert 0 <= got[i].score <= 1 and (letters or got[i].rejected)


def test_no_training_rows_means_und_for_all(spark):
    model = langid.fit(empty_documents(spark))
    assert model.languages == ()
    got = langid.identify(odd_documents(spark), model)
    assert {r.lang_pred for r in got.collect()} == {"und"}


def test_the_sample_is_bounded_and_shares_languages(spark):
    rows = [(f"text number {i} of many", "en" if i % 10 else "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = Counter(e.lang for e in langid.sample(docs, "text", "lang", rows=200))
    assert sum(got.values()) <= 200 and got["fr"] > 50


def test_copies_of_a_drawn_text_are_drawn_once(spark):
    rows = [("one text copied a thousand times", "en")] * 1000 + [(f"other text {i}", "en") for i in range(30)]
    rows += [("one text copied a thousand times", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = langid.sample(docs, "text", "lang", rows=500)
    assert Counter(e.lang for e in got) == {"en": 31, "de": 1}


def test_whole_texts_are_learned_from(spark):
    """The words that tell the languages apart come after thousands of shared characters."""
    shared = "0 1 2 3 " * 500
    rows = [(f"{shared} {'the cat and the dog ' * 150} {i}", "en") for i in range(60)]
    rows += [(f"{shared} {'der hund und die katze ' * 150} {i}", "de") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.predict("the dog and the cat")[0] == "en"
    assert model.predict("die katze und der hund")[0] == "de"
    example = langid.Example.of(rows[0][0], "en")
    assert set(langid.buckets("the cat")) <= {*example.whole[0].tolist(), *langid.buckets(" the cat ")}
    assert example.whole[1].sum() == pytest.approx(1, abs=1e-4)


# --- toxicity


def edits(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_the_automaton_finds_what_the_distance_allows():
    trie, rng = toxicity.FuzzyTrie(toxicity.SEED), random.Random(9)
    for _ in range(1500):
        word = list(rng.choice(toxicity.SEED))
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(word)), rng.randint(0, 3)
            if kind == 0:
                word.insert(i, rng.choice("abcdeisotu"))
            elif kind == 1:
                word[i] = rng.choice("abcdeisotu")
            elif kind == 2 and len(word) > 1:
                del word[i]
            elif i + 1 < len(word):
                word[i], word[i + 1] = word[i + 1], word[i]
        word = "".join(word)
        near = [edits(word, t) for t in toxicity.SEED
                if (t[0] == word[0] or t[1::-1] == word[:2]) and edits(word, t) <= toxicity.edits_allowed(t)]
        found = trie.find(word)
        assert (found[1] if found else None) == min(near, default=None), word


def test_misspellings_count_and_quotations_do_not():
    scanner = toxicity.Scanner(toxicity.SEED)
    finds = scanner.finds('You are an 1d1ot and a stuuupid m0ron, he said nothing at all then')[0]
    assert {f[1] for f in finds} == {"idiot", "stupid", "moron"}
    quoted = scanner.finds('They wrote the word "idiot" on the wall')[0]
    assert [f[3] for f in quoted] == [True]
    plain = scanner.finds("what an idiot that driver was on the long road home")[0]
    assert [f[3] for f in plain] == [False]


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op4_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    caught = got[got.toxic == 1].predicted.mean()
    assert caught > 0.85
    assert (got[got.predicted == 1].toxic == 1).mean() > 0.95


def test_toxicity_of_odd_documents_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd_documents(spark), labels)
    assert model.weights == tuple(toxicity.PRIOR)
    got = toxicity.score(odd_documents(spark, "predicted"), model).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in got)


def test_terms_inside_tokens_and_swapped_first_letters_are_found():
    scanner = toxicity.Scanner(toxicity.SEED)
    for token, term in (("diiot", "idiot"), ("omron", "moron"), ("idiot/moron", "idiot"),
                        ("moron,you", "moron"), ("you-idiot", "idiot"), ("x" * 60 + "-idiot", "idiot")):
        assert scanner.word[token][0] == term
    for token in ("blown", "crash", "closer", "x" * 60, "well-known", "and/or"):
        assert scanner.word[token] is None


def test_the_lexicon_is_learned_without_a_seed(spark):
    """Twelve insults, each in one toxic text of twelve, and ordinary words everywhere."""
    insults = "grumbel plondor skavfitz brequen tolmig fenrau jaskul worpel dubnik hestra yavlo mikkut".split()
    ordinary = "the of house green walked slowly under many bright clouds yesterday".split()
    rows = []
    for i in range(1200):
        words = [ordinary[(i * k) % len(ordinary)] for k in range(1, 14)]
        if i % 2:
            words[i % 13] = insults[(i // 2) % 12]
        rows.append((i, " ".join(words) + f" {i}", i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = docs.filter("doc_id < 900")
    model = toxicity.fit(learn, learn.select("doc_id", "toxic"), seed=())
    assert {*insults} <= {*model.terms} and not {*ordinary} & {*model.terms, *model.stems}
    told = toxicity.score(docs.filter("doc_id >= 900"), model)
    assert told.filter("predicted <> toxic").count() == 0


def test_conflicting_labels_of_one_key_are_settled_alike(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    for n in (1, 4):
        got = toxicity._thinned(labels.repartition(n), "doc_id", "toxic").collect()
        assert sorted(map(tuple, got)) == [(1, 1), (2, 0)]
