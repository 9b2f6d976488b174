"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the text, so that reading, measuring and
judging a document is a single stage without a shuffle or a Python worker.

Nulls and odd input: a null text has no words, no lines and no symbols, and fails the
length rule; so does an empty one. Repeated rows are judged each for itself. Columns of
the input that carry the name of an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import SPACES, WORD, without

SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the languages the rules are meant for. They count as whole
# words, in lower case or capitalised.
STOP_WORDS = (
    # English
    "the of and to in is it that for with on as by this from was are be or at a an have he "
    # German
    "der die und von mit zu das ist den nicht sich auf für ein eine als auch dem "
    # French
    "la les de et des en un une que dans pour est pas du au par sur qui "
    # Spanish
    "el los se las por del con no una su al lo para y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if factor * measure is below least * of, or above most * of."""

    name: str
    measure: str
    of: str
    least: int | None = None
    most: int | None = None
    factor: int = 100


# The contract's base rules come first, then the ratio rules in percent.
BASE_RULES = (
    Rule("too_short", "n_words", "one", least=50, factor=1),
    Rule("repeated_words", "n_repeat_words", "n_words", most=50),
)
RATIO_RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=2000),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("stop_words", "n_stop_words", "n_words", least=8),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=60),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def _windows(words: Column, join) -> Column:
    """join(join(first, second), third) of every three consecutive items."""
    span = F.greatest(F.size(words) - 2, F.lit(0))
    first, second, third = (F.slice(words, F.lit(k), span) for k in (1, 2, 3))
    return F.zip_with(F.zip_with(first, second, join), third, join)


def _window_codes(words: Column) -> Column:
    """A code for each window: equal windows have equal codes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _windows(hashes, lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))


def _placed_windows(words: Column) -> Column:
    """Three-word windows with their places, sorted, so that equal ones are neighbours."""
    windows = _windows(words, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.sort_array(
        F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    )


def _repeated_words(placed: Column) -> Column:
    """How many words lie in a window that occurs twice or more; no window is compared
    with any but its neighbour in sorted order."""
    pairs = F.greatest(F.size(placed) - 1, F.lit(0))
    starts = F.flatten(
        F.zip_with(
            F.slice(placed, F.lit(1), pairs),
            F.slice(placed, F.lit(2), pairs),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(
                F.array().cast("array<int>")
            ),
        )
    )
    covered = F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2)))
    return F.size(F.array_distinct(covered))


def measures(df: DataFrame, text: str = "text", *more: Column) -> DataFrame:
    """The counts the rules are about, one projection over whole texts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "n_stop_words", "n_lines"]
    body = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]})
    split = df.withColumns({"__words": _words(body), "__lines": _lines(body)})
    words, lines = F.col("__words"), F.col("__lines")
    # Columns of their own: each is used twice and must be computed once. Windows are
    # compared as text only where two codes are equal; elsewhere none can repeat.
    split = split.withColumn("__codes", _window_codes(words))
    codes = F.col("__codes")
    split = split.withColumn(
        "__placed",
        F.when(F.size(F.array_distinct(codes)) < F.size(codes), _placed_windows(words)),
    )
    made = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col("__placed").isNull(), 0).otherwise(
            _repeated_words(F.col("__placed"))
        ),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*stop))),
        "n_lines": F.size(lines),
    }
    kept = [F.col(f"`{c}`") for c in without(df, *names).columns]
    return split.select(*kept, *[made[n].cast("long").alias(n) for n in names], *more)


def breaks(rule: Rule) -> Column:
    of = F.lit(1) if rule.of == "one" else F.col(rule.of)
    value = F.lit(rule.factor) * F.col(rule.measure)
    broken = F.lit(False)
    if rule.least is not None:
        broken = broken | (value < F.lit(rule.least) * of)
    if rule.most is not None:
        broken = broken | (value > F.lit(rule.most) * of)
    return broken


def judge(
    df: DataFrame,
    text: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    ratios: tuple[Rule, ...] = RATIO_RULES,
) -> DataFrame:
    """df with its measures, base_failed, the names of the broken rules, and kept."""
    return _judged(measures(df, text), base, ratios)


def passing(
    df: DataFrame,
    text: str = "text",
    base: tuple[Rule, ...] = BASE_RULES,
    ratios: tuple[Rule, ...] = RATIO_RULES,
) -> DataFrame:
    """The rows of df that break no rule.

    The filter reads a row number made beside the measures: that keeps the optimizer from
    moving it below them, where each rule would compute its measures again.
    """
    number = F.monotonically_increasing_id().alias("__row")
    judged = _judged(measures(df, text, number), base, ratios)
    return judged.filter(F.col("kept") & (F.col("__row") >= 0)).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def _judged(
    measured: DataFrame, base: tuple[Rule, ...], ratios: tuple[Rule, ...]
) -> DataFrame:
    broken = F.array_compact(
        F.array(*[F.when(breaks(r), F.lit(r.name)) for r in (*base, *ratios)])
    )
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | breaks(r)
    judged = without(measured, "base_failed", "kept", "broken_rules").withColumns(
        {"base_failed": base_failed, "broken_rules": broken}
    )
    return judged.withColumn("kept", F.size("broken_rules") == 0)
