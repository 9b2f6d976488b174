"""Toxicity: a fuzzy lexicon search with context windows under a logistic score.

Terms of a lexicon are held in a trie. Every word of a text runs through the trie's
intersection with Levenshtein automata: states are sets of (trie node, edits so far),
made deterministic as they are met, so that a word costs one step per character and
misspelled terms are found as fast as plain ones. Substitution, insertion, deletion and
the swap of two neighbours count as one edit; look-alike digits and signs are read as
their letters and stretched letters as one. A misspelling keeps the first letter or swaps it
with the second: without that rule, ordinary words that differ from a term in their first
letter only (blown, crash, closer) would be finds. Tokens are searched whole and by the runs
of letters inside them, so that terms joined by a slash, comma or hyphen are found.

Every find is judged in a window of words around it: inside quotation marks, or close to
a word of reporting, it counts as quotation, otherwise as abuse; address to a person
close by counts on its own. Counts of both kinds enter a logistic regression.

The model is fit on a bounded sample: at most about ``SAMPLE_ROWS`` labelled rows, chosen
by a hash. It adds to the seed lexicon what labelled rows prove, ``LEARNED`` entries at
most: words, and stems whose endings vary, which are counted apart. Then it fits the
weights. Scores depend on the text alone, and cover all of it.

Nulls and odd input: a null or empty text has no finds and gets the score of such texts.
Labels that are null are not learned from; without labels of both kinds the weights are
the fixed ones of ``PRIOR``. Repeated rows get equal scores. Columns with the names of
output columns are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from lapsewise.llm.bpe import Memo
from lapsewise.llm.common import append_columns

SAMPLE_ROWS = 8000
LEARNED = 200
LEAST_TEXTS = 8  # unlike toxic texts of the sample that hold a learned entry
LEAST_ODDS = 1.0  # logarithm of how much likelier it is in toxic texts, at the least
DOUBT = 2.5  # standard errors taken off it before
STEM = (4, 12)  # letters of a learned entry
WHOLE = 0.8  # an entry is a word if so many of its finds are just the word, else a stem
WINDOW = 6
THRESHOLD = 0.7

SEED = (
    "idiot", "moron", "stupid", "imbecile", "scum", "trash", "pathetic", "worthless",
    "loser", "disgusting", "clown", "dumbass", "scumbag", "bastard", "idiota",
    "dummkopf", "abschaum", "connard", "imbécile", "estúpido", "gilipollas",
)
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes word words term phrase insult "
    "sagte schrieb nannte zitat wort dit écrit mot terme dijo llamó palabra término".split()
)
ADDRESS = frozenset("you your you're u du dich dein ihr tu toi vous ton tú usted eres".split())
LONGEST = 40  # letters of a word that may be a term
LETTERS = re.compile(r"[^\W\d_]+")
LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")
OPENERS, CLOSERS = "\"“„«‘'‹", "\"”“»’'›"
MARKS = "\"“”„«»‘’'‹›.,;:!?()[]{}<>…-–—*#&%$|"
PRIOR = np.array([-4.0, 3.0, 3.5, 0.2, 0.5, 0.3, 0.2, 1.0])  # weights when there is nothing to fit
FEATURES = len(PRIOR)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """The lexicon's trie, and its lazily determinised intersection with edits."""

    STATES = 200_000

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.reach: list[int] = [0]  # the most edits any term below a node allows
        for term in sorted(set(terms)):
            at = 0
            for c in term:
                self.reach[at] = max(self.reach[at], edits_allowed(term))
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
            self.reach[at] = max(self.reach[at], edits_allowed(term))
            self.term[at] = term
        self._begin()

    def _begin(self):
        self.start = self._closed({(0, 0, "")})
        self.numbers = {self.start: 0}
        self.states = [self.start]
        self.steps: dict[tuple[int, str], int] = {}

    def _closed(self, items) -> frozenset:
        """Add what skipping letters of a term leads to; keep what can still end."""
        found, queue = set(), list(items)
        while queue:
            node, edits, swap = item = queue.pop()
            if item in found or edits > self.reach[node]:
                continue
            found.add(item)
            if not swap:
                queue += [(child, edits + 1, "") for child in self.children[node].values()]
        return frozenset(found)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, edits, swap in state:
            if swap:  # the second letter of a swapped pair must come now
                if c == swap:
                    out.add((node, edits, ""))
                continue
            out.add((node, edits + 1, ""))  # a letter too many
            for letter, child in self.children[node].items():
                out.add((child, edits + (letter != c), ""))
                if letter != c and c in self.children[child]:
                    out.add((self.children[child][c], edits + 1, letter))
        return self._closed(out)

    def find(self, word: str) -> tuple[str, int] | None:
        """The term within its allowed edits of the word, at the fewest edits."""
        at = 0
        for c in word:
            to = self.steps.get((at, c))
            if to is None:
                if len(self.states) > self.STATES:
                    self._begin()
                    return self.find(word)
                new = self._step(self.states[at], c)
                to = self.numbers.setdefault(new, len(self.states))
                if to == len(self.states):
                    self.states.append(new)
                self.steps[at, c] = to
            at = to
            if not self.states[at]:
                return None
        ends = [
            (edits, self.term[node])
            for node, edits, swap in self.states[at]
            if not swap and self.term[node] and edits <= edits_allowed(self.term[node])
            # Misspellings keep the first letter, or swap it with the second: an ordinary
            # word is too often a term but for its first letter.
            and (self.term[node][0] == word[0] or self.term[node][1::-1] == word[:2])
        ]
        return min(ends)[::-1] if ends else None


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]


class Scanner:
    """Finds and features of a text, with what each word matched kept."""

    def __init__(self, terms, stems=()):
        self.trie = FuzzyTrie(terms)
        self.stems = frozenset(stems)
        self.word = Memo(self._word, 300_000)
        self.kind = Memo(self._kind, 400_000)

    def _find(self, plain: str):
        """The term a word is, and its edits, or None."""
        if not 3 <= len(plain) <= LONGEST:
            return None
        found = self.trie.find(plain)
        if found is None or found[1]:
            looks = re.sub(r"(.)\1{2,}", r"\1", plain.translate(LOOKALIKE))
            if looks != plain and (other := self.trie.find(looks)):
                found = min(found or other, (other[0], max(other[1], 1)), key=lambda f: f[1])
        return found

    @staticmethod
    def _parts(token: str) -> list[str]:
        """The token without marks around it, and the runs of letters inside it."""
        plain = token.strip(MARKS).lower()
        runs = LETTERS.findall(plain)
        return [plain, *runs] if len(runs) > 1 or runs and runs[0] != plain else [plain]

    def _word(self, token: str):
        found = [f for part in self._parts(token) if (f := self._find(part))]
        return min(found, key=lambda f: f[1]) if found else None

    def _kind(self, token: str) -> int:
        if self._word(token):
            return 1
        begun = any(
            part[:n] in self.stems for part in self._parts(token) for n in range(STEM[0], STEM[1] + 1)
        )
        return 2 if begun else 0

    def finds(self, text: str) -> tuple[list[tuple[int, str, int, bool, bool]], int, int]:
        """(word index, term, edits, quoted, addressed) of every term, words that begin
        with a stem, and words in all."""
        tokens = text.split()
        marked = bytes(map(self.kind.__getitem__, tokens))
        out = []
        i = marked.find(1)
        while i >= 0:
            term, edits = self.word[tokens[i]]
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            bare = {t.strip(MARKS).lower() for t in near}
            quoted = self._in_quotes(tokens, i) or not bare.isdisjoint(REPORTING)
            out.append((i, term, edits, quoted, not bare.isdisjoint(ADDRESS)))
            i = marked.find(1, i + 1)
        return out, marked.count(2), len(tokens)

    @staticmethod
    def _in_quotes(tokens: list[str], i: int) -> bool:
        """A word opens a quotation at or before i, and one closes it at or after i."""
        before = tokens[max(0, i - WINDOW) : i + 1]
        after = tokens[i : i + WINDOW + 1]
        opened = False
        for k, t in enumerate(before):
            if t[0] in OPENERS and len(t) > 1:
                opened = True
            if k < len(before) - 1 and opened and t.rstrip(".,;:!?")[-1:] in CLOSERS:
                opened = False
        return opened and any(t.rstrip(".,;:!?")[-1:] in CLOSERS and len(t) > 1 for t in after)

    def features(self, finds, stems: int, words: int) -> np.ndarray:
        exact = sum(1 for f in finds if not f[3] and f[2] == 0)
        fuzzy = sum(1 for f in finds if not f[3] and f[2] > 0)
        quoted = sum(1 for f in finds if f[3])
        addressed = sum(1 for f in finds if f[4] and not f[3])
        share = 10 * math.sqrt((exact + fuzzy) / max(words, 1))
        stem_share = 10 * math.sqrt(stems / max(words, 1)) if stems > 1 else 0.0
        counts = (min(n, 3) for n in (exact, fuzzy, quoted, addressed))
        return np.array([1.0, *counts, share, min(stems, 6), stem_share])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn a little towards the prior."""
    if len(y) == 0 or y.min() == y.max():
        return PRIOR
    w, pull = PRIOR.copy(), np.full(FEATURES, 0.1)
    pull[0] = 1e-3
    for _ in range(30):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + pull * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        w = w - np.linalg.solve(curve, slope)
    return w


def _thinned(labels: DataFrame, key: str, label: str) -> DataFrame:
    """About SAMPLE_ROWS (key, label) rows, by a hash of the key; a bounded table. Of a key
    with several labels the largest counts."""
    usable = labels.select(F.col(key).alias("__key"), F.col(label).alias("__label")).filter(
        "__key IS NOT NULL AND __label IS NOT NULL"
    )
    share = min(1.0, SAMPLE_ROWS / max(usable.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit(11), "__key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return usable.filter(draw < F.lit(share)).groupBy("__key").agg(F.max("__label").alias("__label"))


def learn_entries(sample: DataFrame, text: str) -> tuple[list[str], list[str]]:
    """Words and stems that are far more frequent in the sample's toxic texts."""
    # Copies of one text must not prove anything by their number.
    sample = sample.dropDuplicates(["__label", text])
    toxic = (F.col("__label") == 1).cast("int")
    totals = sample.agg(F.sum(toxic).alias("t"), F.sum(1 - toxic).alias("c")).first()
    if not totals["t"] or not totals["c"]:
        return [], []
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    told = sample.select(toxic.alias("toxic"), F.explode(words).alias("word")).filter(
        F.length("word") >= STEM[0]
    )
    counts = told.groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    )
    ends = F.sequence(F.lit(STEM[0]), F.least(F.length("word"), F.lit(STEM[1])))
    stems = counts.select("*", F.explode(ends).alias("n")).groupBy(
        F.expr("substring(word, 1, n)").alias("stem")
    ).agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"),
        F.sum(F.when(F.length("word") == F.col("n"), F.col("t") + F.col("c"))).alias("whole"),
    )
    odds = F.log((F.col("t") + 0.5) / (totals["t"] + 1.0)) - F.log(
        (F.col("c") + 0.5) / (totals["c"] + 1.0)
    )
    error = F.sqrt(1 / (F.col("t") + 1) + 1 / (F.col("c") + 1))
    proved = stems.withColumn("odds", odds).filter(
        (F.col("odds") - DOUBT * error >= LEAST_ODDS) & (F.col("t") >= LEAST_TEXTS)
    )
    best = proved.orderBy(F.desc(F.col("t") * F.col("odds")), F.desc(F.length("stem")), "stem")
    words, stems = [], []
    for r in best.limit(8 * LEARNED).collect():
        entry = r["stem"]
        if len(words) + len(stems) < LEARNED and not any(
            entry.startswith(e) or e.startswith(entry) for e in (*words, *stems)
        ):
            whole = (r["whole"] or 0) >= WHOLE * (r["t"] + r["c"])
            (words if whole else stems).append(entry)
    return words, stems


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "toxic", seed: tuple[str, ...] = SEED,
) -> Model:
    """A model from the labelled rows: labels (key, label) of docs (key, text)."""
    chosen = _thinned(labels, key, label)
    sample = docs.select(F.col(key).alias("__key"), F.col(text)).join(
        F.broadcast(chosen), "__key"
    )
    words, stems = learn_entries(sample, text)
    terms, stems = tuple(sorted({*seed, *words})), tuple(sorted(stems))
    rows = _scan(sample, terms, stems, text).select("__label", "features").collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, FEATURES)
    y = np.array([float(r["__label"] == 1) for r in rows])
    return Model(terms, stems, tuple(map(float, fit_weights(x, y))))


FIND = StructType([
    StructField("word", LongType()), StructField("term", StringType()),
    StructField("edits", IntegerType()), StructField("quoted", BooleanType()),
])
_FIND = pa.struct([("word", pa.int64()), ("term", pa.string()), ("edits", pa.int32()),
                   ("quoted", pa.bool_())])
_scanners: dict[tuple, Scanner] = {}


def _scan(df: DataFrame, terms: tuple[str, ...], stems: tuple[str, ...], text: str) -> DataFrame:
    """df with its finds and features."""

    def make(batch):
        if (terms, stems) not in _scanners:
            _scanners.clear()
            _scanners[terms, stems] = Scanner(terms, stems)
        scanner = _scanners[terms, stems]
        finds, features = [], []
        for t in batch.column(text).to_pylist():
            found, begun, words = scanner.finds(t or "")
            features.append(scanner.features(found, begun, words))
            finds.append([dict(zip(("word", "term", "edits", "quoted"), f, strict=False))
                          for f in found])
        return [pa.array(finds, pa.list_(_FIND)), pa.array(features, pa.list_(pa.float64()))]

    fields = [("finds", ArrayType(FIND)), ("features", ArrayType(DoubleType()))]
    return append_columns(df, fields, make)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score (0 to 1), predicted (0 or 1) and finds."""
    scanned = _scan(df, model.terms, model.stems, text)
    total = F.lit(0.0)
    for i, w in enumerate(model.weights):
        total = total + F.lit(w) * F.col("features")[i]
    value = 1 / (1 + F.exp(-total))
    kept = [c for c in scanned.columns if c.lower() not in ("score", "predicted", "features")]
    scored = scanned.select(*[F.col(f"`{c}`") for c in kept], value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
