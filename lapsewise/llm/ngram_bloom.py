"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Bigram counts of the training texts are quantised to powers of two and held in a Bloom
filter: an n-gram of quantised count q is entered at levels 1 to q. A count is read by
probing level after level until one is absent, so that errors are one-sided and rare.
Word counts are exact.

The filter is made of segments by the n-gram's hash. Each is built in one task from the
sorted, pre-aggregated hashes of its n-grams and is as large as they need, so the whole
grows with the corpus. It is written to a table. Segments are broadcast in parts of at
most ``PART_BYTES``: one part for a small corpus, and as many passes over the texts as
there are parts for a large one, with the same result.

P(w | h) = (1 - u) c(h w) / c(h) + u P(w), with u the Good-Turing chance that a word
following h has not followed it before, for h's frequency class; P(w) leaves the share
of single words to the unknown word. Both are counted over all training texts.

Texts are tokenised once, into blocks of about ``BLOCK_TOKENS``: a block is one row with its
distinct words and every token as an index into them. The words of all blocks meet their
exact counts in one shuffle, as packed digests of one entry per block and word, and come
back as one array of counts per block. Texts are never shuffled, and no task holds more
than a block, a bucket or a segment. Working tables go after their last reader.

Nulls and odd input: a null or empty text is its end token alone. Rows are scored each for
itself, also repeated ones. Without training texts every word is unknown, N and V are 0.
Columns with the names of output columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    LongType,
    StructField,
    StructType,
)

from lapsewise.llm.common import append_columns, prepare_workers
from lapsewise.session import Scratch

END = b"\n"  # no word holds white space
BLOCK_TOKENS = 250_000
BUCKET_WORDS = 1 << 19  # entries of blocks whose words meet in one task
SEGMENT_KEYS = 1 << 20
PART_BYTES = 128 << 20  # of the filter that a worker holds at a time
PIECE_BYTES = 16 << 20  # what the driver holds of a part at a time
RUN_BYTES = 4 << 20  # of segments that lie end to end: what a worker copies at a time
BITS, PROBES = 10, 7  # per entry: about 0.8 % false positives
HELD = 1 << 19  # n-grams a task gathers before it hands them on
FEW = 2048  # keys that are probed in one call
AT_ONCE = 1 << 16  # keys that numpy works on at a time, in arrays that fit a cache
# Rows of blocks have a MB and more: by default a page ends, and memory is looked at, after
# 100 rows, so that writers, readers and codecs hold a whole file of them.
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.size": 8 << 20}
CLASSES = 40  # of context frequency, by powers of two
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)

def tokens(text: str | None) -> list[bytes]:
    """Words in ASCII lower case, then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def word_digests(words: list[bytes]) -> np.ndarray:
    """128 bits for every word: two columns of 64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(word_digests(words)[:, 1])


END_CODE = word_codes([END])[0]


def bigrams(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key for each token with the one before it. starts marks the first token
    of every text, which follows an end."""
    before = np.roll(codes, 1)
    before[starts] = END_CODE
    mixed = (before * _MIX) ^ (codes + (before >> np.uint64(7)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX2
    return mixed ^ (mixed >> np.uint64(29))


# Filter segments.


_PROBES = np.arange(PROBES, dtype=np.uint64)[:, None]
_BIT = (1 << np.arange(8)).astype(np.uint8)


def _places(keys: np.ndarray, level: int, probe: np.ndarray, size) -> np.ndarray:
    """One row per probe, if there are more than one."""
    shift = (np.uint64(level * 64 + 1) + probe) * _MIX
    mixed = keys ^ shift
    mixed *= _MIX2
    mixed ^= mixed >> np.uint64(29)
    # The upper half, scaled to the size: segments are far below 2**32 bits.
    mixed >>= np.uint64(32)
    mixed *= np.asarray(size, np.uint64)
    mixed >>= np.uint64(32)
    return mixed


def quantise(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1]


def build_segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of one segment."""
    levels = quantise(counts)
    size = 8 * max(8, -(-int(levels.sum()) * BITS // 8))
    bits = np.zeros(size // 8, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = keys[levels >= level]
        for first in range(0, len(some), AT_ONCE):
            for probe in _PROBES:
                at = _places(some[first : first + AT_ONCE], level, probe, size)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).view(np.intp), _BIT[(at & np.uint64(7)).view(np.intp)])
    return bits.tobytes()


def read_levels(keys: np.ndarray, bits: np.ndarray, start=None, size=None) -> np.ndarray:
    """The quantised count of each key, 0 where it is absent. start and size, in bits, tell
    where in bits each key's segment lies; without them bits is one segment."""
    if start is None:
        start, size = np.zeros(len(keys), np.uint64), np.full(len(keys), 8 * len(bits), np.uint64)
    levels = np.zeros(len(keys), np.uint8)
    alive = np.arange(len(keys))
    for level in range(1, 64):
        met = np.ones(len(alive), bool)
        # Few keys: all their probes at once, as each call of numpy then costs more than its work.
        for probe in [_PROBES] if len(alive) <= FEW else _PROBES:
            at = _places(keys, level, probe, size)
            at += start
            hit = bits[(at >> np.uint64(3)).view(np.intp)] & _BIT[(at & np.uint64(7)).view(np.intp)] != 0
            met &= hit if hit.ndim == 1 else hit.all(axis=0)
            if np.count_nonzero(met) < 0.75 * len(met):
                alive, keys, start, size = (x[met] for x in (alive, keys, start, size))
                met = np.ones(len(alive), bool)
        if not met.all():
            alive, keys, start, size = (x[met] for x in (alive, keys, start, size))
        if len(alive) == 0:
            return levels
        levels[alive] = level
    return levels


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of one weight together: they compress well."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype(">u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


PACKED = "segment int, keys binary, counts binary"


def _packed_counts(blocks: DataFrame, segments: int) -> DataFrame:
    """Each task's n-gram counts of training texts, one row per segment and batch."""

    def hand_on(gathered):
        keys, counts = np.unique(np.concatenate(gathered), return_counts=True)
        where = segment_of(keys, segments)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(segments + 1))
        rows = [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([s for s, _ in rows], pa.int32()),
            "keys": pa.array([_pack(keys[i]) for _, i in rows], pa.binary()),
            "counts": pa.array([counts[i].astype("<u4").tobytes() for _, i in rows], pa.binary()),
        })

    def run(batches):
        gathered, size = [], 0
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row)
                gathered.append(block.keys()[~np.repeat(block.held, block.lengths)])
                size += len(gathered[-1])
                if size >= HELD:
                    yield hand_on(gathered)
                    gathered, size = [], 0
        if gathered:
            yield hand_on(gathered)

    prepare_workers(blocks.sparkSession)
    return blocks.select("words", "tokens", "lengths", "held").mapInArrow(run, PACKED)


def build_filter(blocks: DataFrame, n_tokens: int, scratch: Scratch) -> DataFrame:
    """The filter's table: segment, bits. n_tokens sizes the segments."""
    segments = max(1, -(-n_tokens // SEGMENT_KEYS))

    def combine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(k) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        bits = build_segment(keys[first], np.add.reduceat(counts, first, dtype=np.int64))
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                         "segments": pa.array([segments], pa.int32()),
                         "bits": pa.array([bits], pa.binary()),
                         "bytes": pa.array([len(bits)], pa.int64())})

    packed = _packed_counts(blocks, segments)
    built = packed.groupBy("segment").applyInArrow(
        combine, "segment int, segments int, bits binary, bytes long"
    )
    return scratch.write(built, "filter", **LARGE_ROWS)


@dataclass(frozen=True)
class Part:
    """Neighbouring segments of a filter, end to end."""

    segments: int  # of the whole filter
    first: int
    cuts: np.ndarray  # segment first + i is bits[cuts[i] : cuts[i + 1]], or empty
    bits: bytes

    @staticmethod
    def of(segments: int, bits: dict[int, bytes]) -> Part:
        first, last = min(bits), max(bits)
        each = [bits.get(s, b"") for s in range(first, last + 1)]
        cuts = np.cumsum([0, *map(len, each)]).astype(np.uint64)
        return Part(segments, first, cuts, b"".join(each))

    @property
    def end(self) -> int:
        return self.first + len(self.cuts) - 1

    def levels(self, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        """where are the keys' segments, all of this part. They are read at once: a block
        has few keys in each of them."""
        out = np.zeros(len(keys), np.uint8)
        start, end = self.cuts[where - self.first], self.cuts[where - self.first + 1]
        held = end > start
        if not held.all():
            keys, start, end = keys[held], start[held], end[held]
        out[held] = read_levels(
            keys, np.frombuffer(self.bits, np.uint8), start * np.uint64(8), (end - start) * np.uint64(8)
        )
        return out


def runs_of(segments: int, bits: dict[int, bytes]) -> list[Part]:
    """Segments in runs of about RUN_BYTES."""
    runs, some, size = [], {}, 0
    for s in sorted(bits):
        if some and size + len(bits[s]) > RUN_BYTES:
            runs.append(Part.of(segments, some))
            some, size = {}, 0
        some[s] = bits[s]
        size += len(bits[s])
    return [*runs, Part.of(segments, some)]


def levels_in(parts: list[Part], keys: np.ndarray) -> np.ndarray:
    """The quantised count that parts hold of each key; a repeated key is probed once, and
    in the part of its segment only."""
    if not parts:
        return np.zeros(len(keys), np.uint8)
    unique, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(unique), np.uint8)
    where = segment_of(unique, parts[0].segments)
    order = np.argsort(where)
    where = where[order]
    for part in parts:
        some = slice(*np.searchsorted(where, (part.first, part.end)))
        out[order[some]] = part.levels(unique[order[some]], where[some])
    return out[back]


def pieces_of(table: DataFrame):
    """The filter in pieces that the driver holds one at a time."""
    sizes = table.select("segment", "segments", "bytes").orderBy("segment").collect()
    wanted, size = [], 0
    for k, row in enumerate(sizes):
        wanted.append(row["segment"])
        size += row["bytes"]
        if size >= PIECE_BYTES or k == len(sizes) - 1:
            rows = table.filter(F.col("segment").between(wanted[0], wanted[-1]))
            bits = {r["segment"]: r["bits"] for r in rows.select("segment", "bits").collect()}
            yield runs_of(row["segments"], bits), size
            wanted, size = [], 0


def broadcasts_of(table: DataFrame, part_bytes: int):
    """Lists of broadcast pieces, each list at most about part_bytes."""
    context = table.sparkSession.sparkContext
    held, size = [], 0
    for piece, more in pieces_of(table):
        if held and size + more > part_bytes:
            yield held
            held, size = [], 0
        held.append(context.broadcast(piece))
        size += more
    yield held


def probe(
    blocks: DataFrame, table: DataFrame, scratch: Scratch, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(block, tokens, lengths, held, key, levels): the quantised count of every token's
    bigram, one byte each. A written table, made in one pass per part of the filter; the
    words are handed from pass to pass and left behind by the last. blocks is dropped."""
    kept = ["block", "tokens", "lengths", "held", "key"]
    df = blocks.withColumn("levels", F.lit(None).cast("binary"))
    former = blocks
    parts = broadcasts_of(table, part_bytes)
    shared = next(parts)
    while shared is not None:
        after = next(parts, None)

        def make(batch, shared=shared):
            pa.default_memory_pool().release_unused()  # what earlier tasks of a worker left
            out, held = [], [part for piece in shared for part in piece.value]
            for row in rows_of(batch.select(["words", "tokens", "lengths", "held", "levels"])):
                found = levels_in(held, Block(row).keys())
                if row["levels"] is not None:
                    found = np.maximum(found, np.frombuffer(row["levels"], np.uint8))
                out.append(found.tobytes())
            return [pa.array(out, pa.binary())]

        found = append_columns(df.select(*kept, "words", "levels"), [("levels", BinaryType())], make)
        df = scratch.write(found if after is not None else found.drop("words"), "levels", **LARGE_ROWS)
        scratch.drop(former)
        former = df
        for piece in shared:
            piece.unpersist()
        shared = after
    return df


# Blocks of tokenised texts.


def pack_tokens(index: np.ndarray) -> bytes:
    """Indices in bytes of one weight together: they compress well."""
    return index.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_tokens(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)


def binaries(values: pa.Array) -> list[bytes]:
    """values without nulls, cut from their buffer: quicker than to_pylist()."""
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    if len(values) == 0 or data is None:
        return [b""] * len(values)
    cuts = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1]
    data = data.slice(cuts[0], cuts[-1] - cuts[0]).to_pybytes()
    cuts = (cuts - cuts[0]).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def rows_of(batch: pa.RecordBatch):
    """Rows of blocks, held one at a time."""
    for i in range(batch.num_rows):
        row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
        yield {name: binaries(x.values) if name == "words" else x.as_py() for name, x in row.items()}


class Block:
    """The arrays of one row of the table of blocks."""

    def __init__(self, row: dict):
        self.tokens = unpack_tokens(row["tokens"])
        self.lengths = np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.words = row.get("words")

    def keys(self) -> np.ndarray:
        return bigrams(word_codes(self.words)[self.tokens], self.starts)


def block_table(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (key, text, held_out) as a written table of blocks: words with their training
    counts, tokens, and each text's key, length and held_out. Neighbouring texts of one
    task share a block."""
    kind = docs.schema["key"].dataType
    schema = StructType([
        StructField("words", ArrayType(BinaryType())), StructField("trained", ArrayType(LongType())),
        StructField("tokens", BinaryType()), StructField("lengths", ArrayType(LongType())),
        StructField("held", ArrayType(BooleanType())), StructField("key", ArrayType(kind)),
    ])

    def run(batches):
        state: dict = {}

        def begin():
            state.update(index={}, tokens=[], lengths=[], held=[], key=[])

        def finish(arrow_kind):
            tokens_ = np.array(state["tokens"], np.int64)
            words = list(state["index"])
            lengths, held = np.array(state["lengths"]), np.array(state["held"], bool)
            every = np.bincount(tokens_, minlength=len(words))
            trained = np.bincount(tokens_[~np.repeat(held, lengths)], minlength=len(words))
            # Frequent words get small indices.
            order = np.argsort(-every, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            return pa.RecordBatch.from_pydict({
                "words": pa.array([[words[i] for i in order]], pa.list_(pa.binary())),
                "trained": pa.array([trained[order].tolist()], pa.list_(pa.int64())),
                "tokens": pa.array([pack_tokens(rank[tokens_])], pa.binary()),
                "lengths": pa.array([state["lengths"]], pa.list_(pa.int64())),
                "held": pa.array([state["held"]], pa.list_(pa.bool_())),
                "key": pa.array([state["key"]], pa.list_(arrow_kind)),
            })

        begin()
        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.column(0).type
            for key, text, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, index = tokens(text), state["index"]
                state["tokens"] += [index.setdefault(w, len(index)) for w in words]
                state["lengths"].append(len(words))
                state["held"].append(held)
                state["key"].append(key)
                if len(state["tokens"]) >= BLOCK_TOKENS:
                    yield finish(arrow_kind)
                    begin()
        if state["lengths"]:
            yield finish(arrow_kind)

    prepare_workers(docs.sparkSession)
    rows = docs.select("key", "text", "held_out").mapInArrow(run, schema)
    return scratch.write(rows.withColumn("block", F.monotonically_increasing_id()), "blocks", **LARGE_ROWS)


_SENT = "bucket int, block long, codes binary, tags binary, places binary, trained binary"
_TOLD = "block long, places binary, counts binary, n long, v long, once long, ends long"


def block_counts(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, counts, n, v, once, ends): the exact training counts of every block's words
    in their order, and totals over distinct words. A written table; of the totals, which
    belong to buckets of words, every row has some buckets' part.

    Words meet by 80 bits of their digests, packed per block and bucket. A bucket has one
    entry per block of each of its words, however frequent they are."""
    entries = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = int(entries // BUCKET_WORDS) + 1
    end_code, end_tag = word_digests([END])[0, 1], word_digests([END])[0, 0].astype(np.uint16)

    def send(batches):
        for batch in batches:
            for block, words, trained in zip(*(batch.column(c) for c in ("block", "words", "trained"))):
                digests = word_digests(binaries(words.values))
                codes, tags = digests[:, 1], digests[:, 0].astype(np.uint16)
                counts = trained.values.to_numpy()
                where = ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                some = [(b, order[i:j]) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _ in some], pa.int32()),
                    "block": pa.array([block.as_py()] * len(some), pa.int64()),
                    "codes": pa.array([codes[i].tobytes() for _, i in some], pa.binary()),
                    "tags": pa.array([tags[i].tobytes() for _, i in some], pa.binary()),
                    "places": pa.array([pack_tokens(np.diff(i, prepend=0)) for _, i in some], pa.binary()),
                    "trained": pa.array([pack_tokens(counts[i]) for _, i in some], pa.binary()),
                })

    def add_up(key, table):
        each = [len(x) // 8 for x in table["codes"].to_pylist()]
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        codes, tags = joined("codes", "<u8"), joined("tags", "<u2")
        trained = np.concatenate([unpack_tokens(x) for x in table["trained"].to_pylist()])
        order = np.lexsort((tags, codes))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(codes[order]) != 0) | (tags[order][1:] != tags[order][:-1])
        first = np.flatnonzero(new)
        totals = np.add.reduceat(trained[order], first)
        counts = np.empty(len(order), "<u8")
        counts[order] = np.repeat(totals, np.diff(np.append(first, len(order))))
        ends = totals[(codes[order][first] == end_code) & (tags[order][first] == end_tag)].sum()
        stats = np.zeros((table.num_rows, 4), np.int64)
        stats[0] = totals.sum(), (totals > 0).sum(), (totals == 1).sum(), ends
        cuts = np.cumsum([0, *each])
        return pa.table({
            "block": table["block"], "places": table["places"],
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            **{name: pa.array(stats[:, k]) for k, name in enumerate(("n", "v", "once", "ends"))},
        })

    def gather(key, table):
        places = [np.cumsum(unpack_tokens(x)) for x in table["places"].to_pylist()]
        found = np.zeros(sum(map(len, places)), "<u8")
        for at, counts in zip(places, table["counts"].to_pylist()):
            found[at] = np.frombuffer(counts, "<u8")
        totals = {c: [int(table[c].to_numpy().sum())] for c in ("n", "v", "once", "ends")}
        return pa.table({
            "block": [key[0].as_py()], "counts": pa.array([found.tobytes()], pa.binary()), **totals
        })

    prepare_workers(blocks.sparkSession)
    sent = blocks.select("block", "words", "trained").mapInArrow(send, _SENT)
    told = sent.groupBy("bucket").applyInArrow(add_up, _TOLD)
    packed = told.groupBy("block").applyInArrow(
        gather, "block long, counts binary, n long, v long, once long, ends long"
    )
    return scratch.write(packed, "block-counts", **LARGE_ROWS)


@dataclass(frozen=True)
class Smoothing:
    n: int  # training tokens
    v: int  # distinct ones
    unknown: float  # chance of an unknown word
    fresh: tuple[float, ...]  # chance of a new successor, by class of the context's count


def log_chances(counts, context, levels, s: Smoothing) -> np.ndarray:
    """log10 probability of every token from its count, its context's and their bigram's."""
    single = np.where(counts > 0, (1 - s.unknown) * counts / max(s.n, 1), s.unknown)
    followed = np.where(levels > 0, 2.0 ** (levels.astype(np.float64) - 1), 0.0)
    followed = np.minimum(followed, np.minimum(context, counts))
    fresh = np.array(s.fresh)[np.minimum(np.frexp(context)[1], CLASSES - 1)]
    chance = (1 - fresh) * followed / np.maximum(context, 1) + fresh * single
    return np.log10(np.where(context > 0, chance, single))


def _by_context(block: Block, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a block: its successors in training texts, and those of them whose
    bigram occurs once."""
    before = np.roll(block.tokens, 1)
    before[block.starts] = block.tokens[block.lengths[0] - 1]  # an end, as after all texts
    trained = ~np.repeat(block.held, block.lengths)
    return (np.bincount(before, trained),
            np.bincount(before, trained & (levels <= 1)))


def fresh_by_class(probed: DataFrame, packed: DataFrame) -> tuple[float, ...]:
    """Good-Turing: the share of tokens whose bigram occurs once, by the context's class,
    over the tokens of all training texts. Tasks hand on one row per class."""

    def add_up(batches):
        for batch in batches:
            every, once = [], []
            for row in rows_of(batch.select(["tokens", "lengths", "held", "levels"])):
                block = Block(row)
                sums = _by_context(block, np.frombuffer(row["levels"], np.uint8))
                every.append(pack_tokens(sums[0]))
                once.append(pack_tokens(sums[1]))
            yield pa.RecordBatch.from_pydict({
                "block": batch.column("block"), "every": pa.array(every, pa.binary()),
                "once": pa.array(once, pa.binary()),
            })

    def by_class(batches):
        every, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for row in rows_of(batch):
                counts = np.frombuffer(row["counts"], "<u8").astype(np.float64)
                sums = unpack_tokens(row["every"]), unpack_tokens(row["once"])
                where = np.minimum(np.frexp(counts[: len(sums[0])])[1], CLASSES - 1)
                every += np.bincount(where, sums[0], CLASSES).astype(np.int64)
                once += np.bincount(where, sums[1], CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_pydict({
            "class": pa.array(range(CLASSES), pa.int32()), "every": pa.array(every),
            "once": pa.array(once),
        })

    sums = probed.select("block", "tokens", "lengths", "held", "levels").mapInArrow(
        add_up, "block long, every binary, once binary"
    )
    told = sums.join(packed, "block").select("every", "once", "counts").mapInArrow(
        by_class, "class int, every long, once long"
    )
    every, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in told.groupBy("class").agg(F.sum("every").alias("every"), F.sum("once").alias("once")).collect():
        every[row["class"]], once[row["class"]] = row["every"], row["once"]
    # Half of one more of either kind: no class is certain.
    share = (once + 0.5) / (every + 1.0)
    return tuple(np.clip(share, 1e-4, 1 - 1e-4).tolist())


def _contexts(counts: np.ndarray, starts: np.ndarray, ends: int) -> np.ndarray:
    before = np.roll(counts, 1).astype(np.float64)
    before[starts] = ends
    return before


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' keys with held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out is a boolean column of docs; the other rows are learned from.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("held_out"))
    scratch = Scratch(docs.sparkSession)
    blocks = block_table(docs, scratch)
    counts = block_counts(blocks, scratch)
    scratch.release()
    totals = counts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "ends")]
    ).first()
    n, v, ends = totals["n"], totals["v"], totals["ends"]
    table = build_filter(blocks, n, scratch)
    scratch.release()
    packed = counts.select("block", "counts")
    unknown = min(max((totals["once"] + 0.5) / (n + 1.0), 1e-9), 0.5)
    probed = probe(blocks, table, scratch)
    scratch.drop(table)
    fresh = fresh_by_class(probed, packed)
    scratch.release()
    smoothing = Smoothing(n, v, unknown, fresh)
    out_schema = StructType([
        StructField(key, docs.schema["key"].dataType), StructField("held_out", BooleanType()),
        StructField("n_tokens", LongType()), StructField("n_known", LongType()),
        StructField("train_tokens", LongType()), StructField("base_score", DoubleType()),
        StructField("score", DoubleType()),
    ])

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("tokens", "lengths", "held", "levels", "counts")}
                block = Block(row)
                count = np.frombuffer(row["counts"], "<u8").astype(np.int64)[block.tokens]
                levels = np.frombuffer(row["levels"], np.uint8)
                base = np.log10((count + 1) / (n + v + 1))
                model = log_chances(count, _contexts(count, block.starts, ends), levels, smoothing)
                per_text = [np.add.reduceat(x, block.starts) for x in ((count > 0).astype(np.int64), base, model)]
                yield pa.RecordBatch.from_pydict({
                    key: batch.column("key")[i].values,
                    "held_out": pa.array(block.held), "n_tokens": pa.array(block.lengths),
                    "n_known": pa.array(per_text[0]),
                    "train_tokens": pa.array(np.full(len(block.held), n, np.int64)),
                    "base_score": pa.array(per_text[1]), "score": pa.array(per_text[2]),
                })

    return probed.join(packed, "block").mapInArrow(finish, out_schema)
