"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its character n-grams, lower-cased, hashed into a fixed number of
buckets. The mean of their embeddings goes through a linear layer and a softmax. The
embeddings and the layer are trained together by stochastic gradient descent in numpy on
a sample of labelled rows; part of the sample is held back to find the temperature that
calibrates the probabilities and the score below which a prediction is rejected.

The sample is bounded: at most ``SAMPLE_ROWS`` rows with unlike texts, chosen by a hash
with an equal share for every language. Their whole texts are counted by bucket where they
lie, so what a drawn row sends is bounded by ``BUCKETS``, however long it is. Since the layers are linear, a trained model folds into one
table of logits per bucket, whose size does not depend on the data.

Nulls and odd input: a null text, an empty one and one without a letter is ``und`` with
score 0 and is rejected. Rows without a language are not learned from, but predicted.
An empty training set gives a model that calls everything ``und``. Repeated rows get the
same answer. Columns with the names of output columns are replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType

from lapsewise.llm.common import append_columns

UNKNOWN = "und"
SAMPLE_ROWS = 4000
SAMPLE_TASKS = 16
SHORT = (20, 200)  # characters of a stretch that is learned beside its whole text
BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (2, 3, 4)
EPOCHS = 5
RATE = 0.5
# Of the held-back rows that are predicted rightly, this share may be rejected.
REJECTED_SHARE = 0.002
CHUNK = 1 << 18  # n-grams summed at a time


def buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram of the text. A text counts as standing between spaces."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    found, rolled = [], chars.copy()
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint32(0x9E3779B1) + chars[n - 1 :]
        if len(rolled) == 0:
            break
        if n in ORDERS:
            mixed = rolled ^ (rolled >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA77) + np.uint32(n)
            found.append(mixed >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # logits of each bucket, at temperature 1
    bias: np.ndarray
    temperature: float
    least_score: float

    def logits(self, text: str) -> np.ndarray:
        grams = buckets(text)
        total = np.zeros(len(self.languages))
        for start in range(0, len(grams), CHUNK):
            total += self.table[grams[start : start + CHUNK]].sum(axis=0, dtype=np.float64)
        return total / max(len(grams), 1) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and the share of its n-grams in each."""
    found = buckets(text)
    if len(found) < BUCKETS // 8:
        grams, counts = np.unique(found, return_counts=True)
    else:
        every = np.bincount(found, minlength=BUCKETS)
        grams = np.flatnonzero(every)
        counts = every[grams]
    return grams.astype(np.uint16), (counts / counts.sum()).astype(np.float32)


@dataclass(frozen=True)
class Example:
    """A labelled text as shares of buckets: whole, and a short stretch from anywhere in
    it, so that short texts are known too."""

    whole: tuple[np.ndarray, np.ndarray]
    short: tuple[np.ndarray, np.ndarray]
    lang: str

    @staticmethod
    def of(text: str, lang: str) -> Example:
        chance = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        size = SHORT[0] + chance % (SHORT[1] - SHORT[0])
        start = (chance >> 16) % (max(len(text) - size, 0) + 1)
        return Example(_weights(text), _weights(text[start : start + size]), lang)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language) rows."""
    return learn([Example.of(text, lang) for text, lang in rows], seed)


def learn(rows: list[Example], seed: int = 7) -> Model:
    """A model from examples, in numpy. Every fifth is held back for calibration."""
    languages = tuple(sorted({r.lang for r in rows}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    fit = [r for i, r in enumerate(rows) if i % 5] or held
    examples = [(*part, languages.index(r.lang)) for r in fit for part in (r.whole, r.short)]
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((len(languages), WIDTH), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            grams, share, label = examples[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ embed[grams]
            wrong = softmax(layer @ mean + bias)
            wrong[label] -= 1
            back = wrong @ layer
            layer -= rate * np.outer(wrong, mean)
            bias -= rate * wrong
            embed[grams] -= (rate * len(grams)) * share[:, None] * back / np.sqrt(len(grams))
    model = Model(languages, (embed @ layer.T).astype(np.float32), bias.astype(float), 1.0, 0.0)
    return _calibrate(model, held)


def _calibrate(model: Model, held: list[Example]) -> Model:
    """The temperature of least held-back loss, and the score below which to reject."""
    logits = np.array([r.whole[1] @ model.table[r.whole[0]] + model.bias for r in held])
    labels = np.array([model.languages.index(r.lang) for r in held])

    def scores(temperature):
        return np.array([softmax(row / temperature) for row in logits])

    grid = np.geomspace(0.1, 10, 41)
    at = np.arange(len(labels))
    loss = [-np.log(np.maximum(scores(t)[at, labels], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = scores(temperature)
    right = p[at, labels][p.argmax(axis=1) == labels]
    least = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    # A score that most classes would reach by chance says nothing; one above 0.5 is no doubt.
    least = min(max(least, 1.0 / len(model.languages)), 0.5)
    return Model(model.languages, model.table, model.bias, temperature, least)


def sample(labelled: DataFrame, text: str, lang: str, rows: int = SAMPLE_ROWS) -> list[Example]:
    """At most rows examples with unlike (text, language), an equal share for every language.

    labelled is read twice: unlike texts per language are counted, then each language is
    thinned by a hash of its texts to its share, and copies are dropped. Only buckets and
    shares of the rows that are left reach the driver.
    """
    usable = labelled.filter(
        F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()
    ).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
        F.xxhash64(F.col(text)).alias("code"),
    )
    counts = usable.select("lang", "code").distinct().groupBy("lang").count()
    counts = counts.orderBy(F.desc("count"), "lang").limit(rows)
    counts = counts.withColumn("languages", F.lit(counts.count()))
    draw = F.pmod("code", F.lit(1 << 40)) / F.lit(float(1 << 40))
    thinned = usable.join(counts, "lang").filter(
        draw * F.col("count") * F.col("languages") < F.lit(0.9 * rows)
    ).select("text", "lang", "code").dropDuplicates(["lang", "code"])
    sides = [f"{side}_{part}" for side in ("whole", "short") for part in ("grams", "share")]

    def count(batch):
        made = [[] for _ in sides]
        for t in batch.column("text").to_pylist():
            found = Example.of(t, "")
            for column, array in zip(made, (*found.whole, *found.short), strict=True):
                column.append(array.tobytes())
        return [pa.array(column, pa.binary()) for column in made]

    counted = append_columns(thinned.coalesce(SAMPLE_TASKS), [(c, BinaryType()) for c in sides], count).drop("text")
    # Rows come by the partition: the driver holds them once, as arrays. The limit is a
    # guard: thinning leaves fewer rows.
    got = heapq.nsmallest(rows, counted.toLocalIterator(), key=lambda r: (r["code"], r["lang"]))

    def side(row, name: str) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row[f"{name}_grams"], np.uint16), np.frombuffer(row[f"{name}_share"], np.float32)

    return [Example(side(r, "whole"), side(r, "short"), r["lang"]) for r in got]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    return learn(sample(labelled, text, lang))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        model = shared.value
        langs, scores, rejected = [], [], []
        for t, letters in zip(
            batch.column(text).to_pylist(), batch.column("__letters").to_pylist(), strict=True
        ):
            lang, score = model.predict(t) if letters else (UNKNOWN, 0.0)
            langs.append(lang)
            scores.append(score)
            rejected.append(lang == UNKNOWN or score < model.least_score)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                pa.array(rejected, pa.bool_())]

    marked = df.withColumn("__letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = [("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())]
    return append_columns(marked, fields, make).drop("__letters")
