"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents become token ids, the longer ones are cut into pieces of one sequence length,
and pieces are placed into sequences. With N(g) the number of open sequences that have g
tokens left, a piece goes where the sum of N(g) squared becomes smallest: that keeps
residual gaps varied, so that later pieces find a gap they fill.

Pieces that fill a sequence are one by themselves. The others are dealt into blocks of
about ``BLOCK_PIECES`` by a hash; the number of blocks follows their count, so that no
task holds more than a block, and each block is packed by itself, larger pieces first.

Nulls and odd input: a null or empty text is one piece that holds only the end id.
Repeated rows, also with the same key, are separate documents. An empty table gives no
pieces. Columns with the names of output columns are replaced.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from tokenizers import Tokenizer

from lapsewise.llm.common import append_columns, prepare_workers, without

LENGTH = 4096
BLOCK_PIECES = 8192
PART_ENTRIES = 600_000  # parts a worker keeps before it begins anew
PARTS_AT_ONCE = 50_000
ENCODED_AT_ONCE = 1000


# A stretch between white space that is a word of plain letters, marks, or a word with
# marks after it falls into these parts: each is one match of the tokenizer's pattern, in
# composed form already, so that it is one run of ids up to a word end. Any other stretch
# is a part as it is.
LETTERS = r"[a-zA-ZÀ-ÖØ-öø-į]++"
MARKS = r"[.,!?;:&$%#*|<>()-]"
PARTS = re.compile(rf"{LETTERS}(?={MARKS}*+(?:[ \n]|\Z))|{MARKS}++(?=[ \n]|\Z)|[^ \n]++")
PLAIN = re.compile(rf"{LETTERS}|{MARKS}++")


class PartTokenizer:
    """Ids of whole texts from the ids of the parts between and within their stretches.

    A space or a line break always ends a token of this tokenizer, so a text's ids are
    those of its parts in turn. The new parts of many texts are encoded together, plain
    ones once for all their spellings in upper and lower case, and kept.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}

    def _learn_plain(self, plain: list[str]) -> None:
        by_form: dict[str, list[str]] = {}
        for part in plain:
            by_form.setdefault(part.lower(), []).append(part)
        forms = sorted(by_form)
        for start in range(0, len(forms), ENCODED_AT_ONCE):
            some = forms[start : start + ENCODED_AT_ONCE]
            ids = self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids
            ids = np.array(ids, "<u4")
            data, stops = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * 4
            begin = 0
            for form, stop in zip(some, stops.tolist(), strict=True):
                for part in by_form[form]:
                    self.parts[part] = data[begin:stop]
                begin = stop

    def learn(self, parts: set[str]) -> None:
        """Keep the ids of the parts that are new."""
        fresh = parts.difference(self.parts)
        if len(self.parts) + len(fresh) > PART_ENTRIES:
            self.parts, fresh = {}, parts
        plain = [p for p in fresh if PLAIN.fullmatch(p)]
        self._learn_plain(plain)
        other = list(fresh.difference(plain))
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        for part, encoding in zip(other, found, strict=True):
            self.parts[part] = np.array(encoding.ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        out, group, size = [], [], 0
        for k, text in enumerate(texts, 1):
            group.append(PARTS.findall(text))
            size += len(group[-1])
            if size >= PARTS_AT_ONCE or k == len(texts):
                self.learn(set().union(*group))
                get = self.parts.__getitem__
                out += [b"".join(map(get, parts)) for parts in group]
                group, size = [], 0
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PartTokenizer:
    # Tasks are the unit of parallel work here: threads of the library only contend.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PartTokenizer(path)


def tokenise(
    df: DataFrame, path: str, end_id: int = 1, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """df with its texts' ids and the end id, as little-endian unsigned 32-bit integers."""
    end = int(end_id).to_bytes(4, "little")

    def make(batch):
        texts = [t or "" for t in batch.column(text).to_pylist()]
        return [pa.array([i + end for i in load(path).encode_all(texts)], pa.binary())]

    return append_columns(df, [(ids, BinaryType())], make)


def cut(df: DataFrame, length: int = LENGTH, ids: str = "ids") -> DataFrame:
    """One row per piece: piece, start and length in tokens, and the piece's ids."""
    kept = [f"`{c}`" for c in without(df, ids, "piece", "start", "length").columns]
    total = F.length(F.col(ids)) / F.lit(4)
    last = F.greatest(F.ceil(total / F.lit(length)) - 1, F.lit(0)).cast("int")
    rows = df.select(*kept, F.col(ids), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    rows = rows.withColumn("start", F.col("piece").cast("long") * length)
    rows = rows.withColumn(
        ids,
        F.substring(F.col(ids), (F.col("start") * 4 + 1).cast("int"), F.lit(4 * length)),
    )
    return rows.withColumn("length", (F.length(F.col(ids)) / 4).cast("long"))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for every piece, placed in the given order.

    Placing s tokens into a sequence with gap g takes one from N(g) and adds one to
    N(g - s), unless that fills it, so the sum changes by 2 * (N(g - s) - N(g) + 1), by
    1 - 2 * N(g) where it is filled, and by 2 * N(capacity - s) + 1 for a new sequence.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    used: list[int] = []
    places, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        change = 2 * (n[: capacity + 1 - s] - n[s:] + 1)
        change[0] = 1 - 2 * n[s]
        change[n[s:] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        fresh = 2 * n[capacity - s] + 1 if s < capacity else 0
        if change[best] <= fresh and n[s + best]:
            at = open_at[s + best].pop()
            n[s + best] -= 1
        else:
            at, best = len(used), capacity - s
            used.append(0)
        places[k], offsets[k] = at, used[at]
        used[at] += s
        if best:
            open_at[best].append(at)
            n[best] += 1
    return places, offsets


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """pieces with sequence_id and offset. pieces should be a written table: its rows
    are counted before they are placed. length must lie between 1 and capacity."""
    prepare_workers(pieces.sparkSession)
    pieces = without(pieces, "sequence_id", "offset")
    schema = StructType(
        [*pieces.schema.fields, StructField("sequence_id", LongType()),
         StructField("offset", LongType())]
    )
    partial = pieces.filter(F.col("length") < capacity)
    blocks = max(1, -(-partial.count() // BLOCK_PIECES))
    # A hash of the whole row: rows with one key must not meet in one block.
    block = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns]), F.lit(blocks))
    names = schema.names

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("length", ascending=False, kind="stable")
        at, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        # Even ids for packed sequences, odd ones for pieces that are one by themselves.
        rows["sequence_id"] = (at * blocks + key[0]) * 2
        rows["offset"] = offset
        return rows[names]

    packed = partial.withColumn("__block", block).groupBy("__block").applyInPandas(place, schema)
    full = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(full)
