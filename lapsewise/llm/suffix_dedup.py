"""Removal of long repeated byte strings, by merging Burrows-Wheeler transforms.

A byte is removed if a string of `length` bytes covers it that also starts earlier, in a
document with a smaller id or before it in the same one. Strings are judged on the input.

1. Every window of `length` bytes names the smallest hash of its 32-byte grams as its
   anchor. Consecutive windows with one anchor are a stretch; equal windows have equal
   anchors, so a stretch whose anchor occurs once in the corpus holds no repeat. Stretches
   meet by the hash of their anchor. Stretches equal in content collapse to the first of
   them, within a task before they are sent and again where they meet: of the others
   every byte is covered.
2. Of anchors with unlike stretches the first of each content goes on. Each task builds
   the transform of its stretches per bucket (a shard): the last column of the sorted
   rotations, from which texts and positions follow by walking back.
3. A bucket merges its shards by refining their interleave: rows that agree on the last
   k bytes of context are dealt stably by the bytes before them, four at a time, which
   orders them by k + 4. No suffix is compared or sorted again. Where the bytes or the
   former interval change, a new interval begins, so after `length` bytes the intervals
   are the sets of suffixes with a common prefix of `length` or more; rows alone in an
   interval share no longer prefix and leave early. In every interval all but the first
   window are repeats.

Equality of stretches and windows rests on 128 bits of hashes of whole contents, or on
the bytes themselves in step 3.

Defined results: a null text is empty; matches never cross documents. A null id comes
before all others. Rows of one id with unlike texts are different documents, in the order
of a hash of their texts; rows equal in id and text are one document and have the same
result. An empty table gives no rows. Texts shorter than `length` keep all bytes. Other
columns of the input are kept; one named like a new column is replaced.

At scale: texts are shuffled by document, stretches as hashes (about one per 31 bytes of
text) and, for unlike stretches only, as bytes. An anchor in very many places sends one
row per task and content. If more than SPLIT unlike stretches share one anchor, as around
a common line, no task gathers them: each of their windows is keyed by its own content
instead. Buckets grow in number with the corpus, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import prepare_workers, without
from lapsewise.session import Scratch

LENGTH = 100
GRAM = 32
SPLIT = 8192  # unlike stretches of one anchor that one task may gather
SOME_BYTES = 512 << 10  # of text hashed at once
HELD_BYTES = 8 << 20  # of text whose stretches are collapsed together
BUCKET_BYTES = 16 << 20  # of text whose stretches' hashes meet in one task
MERGE_BYTES = 1 << 20  # of stretches merged in one task

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFF)  # places within SOME_BYTES, twice over


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, 8)).view("<u8").ravel()
    n = len(buffer) - GRAM + 1
    out = np.zeros(n, "<u8")
    for j, c in enumerate(_MIX):
        out += words[8 * j:8 * j + n] * c
    out ^= out >> np.uint64(32)
    out *= _MIX[3]
    out ^= out >> np.uint64(29)
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def stretches(raw: bytes, sizes: np.ndarray, length: int):
    """(text, start, windows, anchor hash) of the stretches of texts laid end to end.

    start counts from the beginning of raw. Windows that cross texts are left out."""
    buffer = np.frombuffer(raw + bytes(8), np.uint8)
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype("<u8")
    hashes = gram_hashes(buffer)[:len(raw) - GRAM + 1]
    keyed = (hashes & ~_LOW) | np.arange(len(hashes), dtype="<u8")
    anchor = (sliding_minimum(keyed, length - GRAM + 1) & _LOW).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(anchor)]
    places = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    at = anchor[places]
    new = np.ones(len(places), bool)
    new[1:] = (at[1:] != at[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(places)))
    # Smallest hashes begin alike, so they are mixed once more before they deal out buckets.
    name = hashes[at[first]] * _MIX[0]
    return text[places[first]], places[first], count, name ^ (name >> np.uint64(32))


def content_hashes(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    view = memoryview(raw)
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(view[a:b], seed) for a, b in zip(start.tolist(), end.tolist())),
        "<u8", len(start),
    )


# Where a stretch lies: document (id, tie) and start * 128 + number of its windows, which
# is at most length - GRAM + 1.
_PLACE = np.dtype([("id", "<i8"), ("tie", "<i8"), ("spot", "<i8")])
_HASHED = [("bucket", pa.int32()), ("anchor", pa.binary()), ("content", pa.binary()),
           ("place", pa.binary()), ("copies", pa.binary())]
_HASHED_SQL = "bucket int, anchor binary, content binary, place binary, copies binary"


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(buckets: int, anchor: np.ndarray, content: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; of stretches with equal content only the first is described,
    the others are noted as copies."""
    order = np.lexsort((place["spot"], place["tie"], place["id"], content, anchor))
    anchor, content, place = anchor[order], content[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    copy = ~new
    if copy.any():
        head = place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        copy &= place != head
    at = bucket_of(anchor, buckets)  # ascends with the hash
    cuts = np.searchsorted(at, np.arange(buckets + 1))
    rows = []
    for b in np.unique(at):
        part = slice(cuts[b], cuts[b + 1])
        kept, gone = new[part], copy[part]
        rows.append((int(b), anchor[part][kept].tobytes(), content[part][kept].tobytes(),
                     place[part][kept].tobytes(), place[part][gone].tobytes()))
    columns = list(zip(*rows)) or [[]] * len(_HASHED)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, (_, k) in zip(columns, _HASHED, strict=True)], names=[n for n, _ in _HASHED]
    )


def texts_of(batches, size: int):
    """Lists of (id, tie, bytes, other Arrow values of the row) of about size bytes of text."""
    held, total = [], 0
    for batch in batches:
        rest = [batch.column(c) for c in batch.schema.names if c not in ("id", "tie", "text")]
        for values in zip(batch["id"].to_pylist(), batch["tie"].to_pylist(), batch["text"], *rest):
            row = (values[0], values[1], values[2].as_buffer().to_pybytes() if values[2].is_valid else b"", *values[3:])
            held.append(row)
            total += len(row[2])
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def pieces(held: list[tuple], length: int):
    """(raw, rows, offset in the text of each, sizes): texts laid end to end in portions
    of about SOME_BYTES; a longer text is cut into pieces that overlap by length - 1."""
    parts: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    total = 0
    for i, row in enumerate(held):
        raw = row[2]
        for start in range(0, max(len(raw) - length + 1, 0), SOME_BYTES):
            part = raw[start:start + SOME_BYTES + length - 1]
            parts.append(part)
            rows.append(i)
            offsets.append(start)
            total += len(part)
            if total >= SOME_BYTES:
                yield b"".join(parts), np.array(rows), np.array(offsets), np.array([len(p) for p in parts])
                parts, rows, offsets, total = [], [], [], 0
    if parts:
        yield b"".join(parts), np.array(rows), np.array(offsets), np.array([len(p) for p in parts])


def _described(buckets: int, length: int):
    def run(batches):
        for held in texts_of(batches, HELD_BYTES):
            ids = np.array([r[0] for r in held], "<i8")
            ties = np.array([r[1] for r in held], "<i8")
            anchors, contents, places = [], [], []
            for raw, rows, offsets, sizes in pieces(held, length):
                text, start, count, anchor = stretches(raw, sizes, length)
                begun = np.cumsum(sizes) - sizes
                place = np.empty(len(text), _PLACE)
                place["id"], place["tie"] = ids[rows[text]], ties[rows[text]]
                place["spot"] = (start - begun[text] + offsets[text]) * 128 + count
                anchors.append(anchor)
                contents.append(content_hashes(raw, start, start + count - 1 + length))
                places.append(place)
            if anchors:
                yield packed(buckets, np.concatenate(anchors), np.concatenate(contents), np.concatenate(places))
    return run


def _windows(buckets: int, length: int):
    """Like _described, but every window of the requested stretches is a stretch."""
    def run(batches):
        for held in texts_of(batches, HELD_BYTES // 16):
            anchors, contents, places = [], [], []
            for ident, tie, raw, spots in held:
                spot = spots.values.flatten()[0].to_numpy()
                start, count = spot >> 7, spot & 127
                each = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                place = np.empty(len(each), _PLACE)
                place["id"], place["tie"], place["spot"] = ident, tie, each * 128 + 1
                anchors.append(content_hashes(raw, each, each + length, 1))
                contents.append(content_hashes(raw, each, each + length))
                places.append(place)
            yield packed(buckets, np.concatenate(anchors), np.concatenate(contents), np.concatenate(places))
    return run


COPY, UNLIKE, MANY = 0, 1, 2
_FOUND_SQL = "id long, tie long, kind int, spots array<struct<spot: long, anchor: long>>"
_SPOT = pa.struct([("spot", pa.int64()), ("anchor", pa.int64())])


def found(kind: int, place: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
    """One row per document with its spots."""
    order = np.lexsort((place["spot"], place["tie"], place["id"]))
    place, anchor = place[order], anchor[order]
    new = np.ones(len(place), bool)
    new[1:] = (place["id"][1:] != place["id"][:-1]) | (place["tie"][1:] != place["tie"][:-1])
    first = np.flatnonzero(new)
    values = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(place["spot"])), pa.array(anchor.astype("<i8"))], fields=list(_SPOT)
    )
    offsets = pa.array(np.append(first, len(place)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(place["id"][first])), pa.array(np.ascontiguousarray(place["tie"][first])),
         pa.array(np.full(len(first), kind, np.int32)), pa.ListArray.from_arrays(offsets, values)],
        names=["id", "tie", "kind", "spots"],
    )


def _meet(split: int):
    """What a bucket of anchors tells: copies, and the first stretches of anchors with
    unlike ones, apart for those with more than `split`."""
    def run(key, table):
        join = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        anchor, content, place = join("anchor", "<u8"), join("content", "<u8"), join("place", _PLACE)
        copies = join("copies", _PLACE)
        _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        anchor, content, place = anchor[again], content[again], place[again]
        order = np.lexsort((place["spot"], place["tie"], place["id"], content, anchor))
        anchor, content, place = anchor[order], content[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        copy = ~new
        if copy.any():
            copy &= place != place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        copies = np.concatenate([copies, place[copy]])
        anchor, place = anchor[new], place[new]
        _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
        unlike = count[inverse] if len(anchor) else np.zeros(0, np.int64)
        out = [found(COPY, copies, np.zeros(len(copies), "<u8"))]
        for kind, chosen in ((UNLIKE, (unlike > 1) & (unlike <= split)), (MANY, unlike > split)):
            out.append(found(kind, place[chosen], anchor[chosen]))
        return pa.Table.from_batches(out)
    return run


# A shard's transform: symbols are bytes + 1, and 0 ends a stretch. places has the
# stretches in the order of the rotations that begin with their end symbol, which come first.
_SHARD_SQL = "bucket int, last binary, places binary"


def transform(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last column, stretches in the order of their end rotations) of the sorted cyclic
    rotations of stretches, each closed by symbol 0. Ranks are doubled until they tell
    all rotations apart or cover the longest stretch."""
    n = len(symbols)
    ends = starts + sizes - 1
    after = np.arange(1, n + 1)
    after[ends] = starts
    before = np.empty(n, np.int64)
    before[after] = np.arange(n)
    rank = symbols.astype(np.int64)
    jump, depth, longest = after, 1, int(sizes.max())
    while True:
        key = rank * (n + 257) + rank[jump]
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        depth *= 2
        if new.all() or depth >= 2 * longest:
            break
        jump = jump[jump]
    order = np.argsort(rank, kind="stable")
    of = np.repeat(np.arange(len(starts)), sizes)
    return symbols[before[order]], of[order[:len(starts)]]


def _shards(buckets: int, length: int):
    """The transforms of the requested stretches of every portion of texts."""
    def run(batches):
        for held in texts_of(batches, HELD_BYTES):
            places, anchors, sizes, bases = [], [], [], []
            base = 0
            for ident, tie, raw, spots in held:
                spot, anchor = (c.to_numpy() for c in spots.values.flatten())
                place = np.empty(len(spot), _PLACE)
                place["id"], place["tie"], place["spot"] = ident, tie, spot
                places.append(place)
                anchors.append(anchor.view("<u8"))
                bases.append(np.full(len(spots), base))
                base += len(raw)
            place, anchor = np.concatenate(places), np.concatenate(anchors)
            start = (place["spot"] >> 7) + np.concatenate(bases)
            size = (place["spot"] & 127) - 1 + length
            text = np.frombuffer(b"".join(row[2] for row in held), np.uint8)
            at = bucket_of(anchor, buckets)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(buckets + 1))
            for b in np.unique(at):
                own = order[cuts[b]:cuts[b + 1]]
                _, first = np.unique(place[own], return_index=True)  # repeated rows
                own = own[first]
                sizes = size[own] + 1
                begun = np.cumsum(sizes) - sizes
                symbols = np.zeros(sizes.sum(), np.uint16)
                from_text = np.repeat(start[own] - begun, sizes) + np.arange(len(symbols))
                symbols[:] = text[np.minimum(from_text, len(text) - 1)].astype(np.uint16) + 1
                symbols[begun + sizes - 1] = 0
                last, first = transform(symbols, begun, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(b)], pa.int32()), pa.array([last.tobytes()], pa.binary()),
                     pa.array([place[own][first].tobytes()], pa.binary())],
                    names=["bucket", "last", "places"],
                )
    return run


def stable_order(codes: np.ndarray, top: int) -> np.ndarray:
    """The stable order of codes below top, by radix passes of 16 bits."""
    if top <= 1 << 16:
        return np.argsort(codes.astype(np.uint16), kind="stable")
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return order[stable_order((codes >> 16)[order], (top - 1 >> 16) + 1)]


def dense(codes: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Codes numbered without gaps, in the same order; their number."""
    if top <= 1 << 22:
        present = np.zeros(top, bool)
        present[codes] = True
        return (np.cumsum(present, dtype=np.int32) - 1)[codes], int(present.sum())
    values, inverse = np.unique(codes, return_inverse=True)
    return inverse, len(values)


def merged_intervals(lasts: list[np.ndarray], counts: list[int], sizes: np.ndarray, length: int):
    """(stretch, offset, interval) of the suffixes that share `length` bytes with another.

    lasts: last columns of the shards, counts: their numbers of stretches, sizes: lengths
    of all stretches. Rows are numbered shard after shard."""
    last = np.concatenate(lasts).astype(np.int32)
    n = len(last)
    shard = np.repeat(np.arange(len(lasts), dtype=np.int32), [len(x) for x in lasts])
    # A row's predecessor: within a shard, rows of one last symbol keep their order.
    back = np.empty(n, np.int32)
    back[stable_order(shard * 257 + last, len(lasts) * 257)] = np.arange(n)
    begun = np.cumsum([0, *[len(x) for x in lasts]])
    rows = np.concatenate([np.arange(c) + b for c, b in zip(counts, begun)])
    # Walking back from the end of every stretch names the rows.
    stretch, offset = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    ident, left = np.arange(len(rows)), sizes.copy()
    stretch[rows], offset[rows] = ident, left
    while len(rows):
        more = left > 0
        rows, ident, left = back[rows[more]], ident[more], left[more] - 1
        stretch[rows], offset[rows] = ident, left
    # The four symbols before each row, as one code; rows too near the start have none.
    back2 = back[back]
    two, width = dense(last[back] * 257 + last, 257 * 257)
    code, codes = dense(two[back2].astype(np.int64) * width + two, width * width)
    code = code.astype(np.int32)
    back4 = back2[back2]
    row, interval = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for step in [4] * (length // 4) + [1] * (length % 4):
        inside = offset[row] >= step
        row, interval = row[inside], interval[inside]
        coded = code[row] if step == 4 else last[row]
        order = stable_order(coded, codes if step == 4 else 257)
        coded, interval = coded[order], interval[order]
        row = (back4 if step == 4 else back)[row[order]]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (coded[1:] != coded[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(new[:-1] & new[1:])
        interval = np.cumsum(new[:-1], dtype=np.int32)[shared]
        row = row[shared]
    return stretch[row], offset[row], interval


def runs_of(rank: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, first offset, count) of consecutive offsets of one stretch."""
    key = np.unique(rank * 128 + offset)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1] + 1) | (key[1:] >> 7 != key[:-1] >> 7)
    first = np.flatnonzero(new)
    return key[first] >> 7, key[first] & 127, np.diff(np.append(first, len(key)))


def _merge(length: int):
    def run(key, table):
        lasts = [np.frombuffer(x, np.uint16) for x in table["last"].to_pylist()]
        places = [np.frombuffer(x, _PLACE) for x in table["places"].to_pylist()]
        place = np.concatenate(places)
        sizes = (place["spot"] & 127) - 1 + length
        stretch, offset, interval = merged_intervals(lasts, [len(p) for p in places], sizes, length)
        names, rank = np.unique(place, return_inverse=True)  # in order of id, tie and start
        rank = rank[stretch].astype(np.int64)
        order = rank * 128 + offset
        if len(order):
            starts = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
            first = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(order))))
            later = order > first
            rank, offset = rank[later], offset[later]
        rank, offset, count = runs_of(rank, offset)
        out = names[rank]
        out["spot"] = ((out["spot"] >> 7) + offset) * 128 + count
        return pa.Table.from_batches([found(COPY, out, np.zeros(len(out), "<u8"))])
    return run


def _cut(length: int, names: list[str]):
    """kept, n_removed and n_spans of every text from the spots of its repeats."""
    def run(batches):
        for batch in batches:
            keep, removed, spans = [], [], []
            for text, spots in zip(batch["__text"], batch["__spots"]):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                spots = spots.values.to_numpy() if spots.is_valid else np.zeros(0, np.int64)
                start = np.sort(spots)
                start, end = start >> 7, (start >> 7) + (start & 127) - 1 + length
                if len(start):
                    end = np.maximum.accumulate(end)
                    new = np.append(True, start[1:] > end[:-1])
                    start, end = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                keep.append(kept)
                removed.append(len(raw) - len(kept))
                spans.append(len(start))
            made = [pa.array(keep, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *made], names=[*names, "kept", "n_removed", "n_spans"]
            )
    return run


def repeated_spots(docs: DataFrame, scratch: Scratch, length: int = LENGTH, split: int = SPLIT) -> list[DataFrame]:
    """Tables (id, tie, spots) of the windows that are repeats. docs: (id, tie, text binary)."""
    if not 2 * GRAM <= length <= GRAM + 126:
        raise ValueError(f"length must lie between {2 * GRAM} and {GRAM + 126}")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1
    met = scratch.write(
        docs.mapInArrow(_described(buckets, length), _HASHED_SQL).groupBy("bucket")
        .applyInArrow(_meet(split), _FOUND_SQL), "met",
    )
    scratch.release()
    spots = F.col("spots.spot").alias("spots")
    out = [met.filter(F.col("kind") == COPY).select("id", "tie", spots)]
    asked = {r["kind"]: r["n"] for r in met.groupBy("kind").agg(F.sum(F.size("spots")).alias("n")).collect()}
    for kind, per in ((UNLIKE, 1), (MANY, length - GRAM + 1)):
        n = asked.get(kind, 0)
        if not n:
            continue
        wanted = met.filter(F.col("kind") == kind).groupBy("id", "tie").agg(
            F.flatten(F.collect_list("spots")).alias("spots")
        )
        texts = docs.join(wanted, ["id", "tie"]).select("id", "tie", "text", "spots")
        if kind == UNLIKE:
            parts = int(n * (length + 31) // MERGE_BYTES) + 1
            repeats = texts.mapInArrow(_shards(parts, length), _SHARD_SQL).groupBy("bucket").applyInArrow(
                _merge(length), _FOUND_SQL
            )
        else:
            parts = int(n * per * GRAM // BUCKET_BYTES) + 1
            # Keyed by their whole content, windows of one key are all alike.
            repeats = texts.mapInArrow(_windows(parts, length), _HASHED_SQL).groupBy("bucket").applyInArrow(
                _meet(split), _FOUND_SQL
            )
        found_here = scratch.write(repeats.filter(F.col("kind") == COPY), "repeats")
        del wanted, texts, repeats
        scratch.release()
        out.append(found_here.select("id", "tie", spots))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """docs (doc_id, text and others) with kept (the remaining bytes), n_bytes, n_removed
    and n_spans (maximal runs of removed bytes) in place of text."""
    prepare_workers(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    tie = F.xxhash64(F.col("text"))  # of null a number too
    keyed = docs.select(ident.alias("id"), tie.alias("tie"), F.col("text").cast("binary").alias("text"))
    spots = repeated_spots(keyed, scratch, length, split)
    every = spots[0]
    for more in spots[1:]:
        every = every.unionByName(more)
    every = every.groupBy(F.col("id").alias("__of"), F.col("tie").alias("__with")).agg(
        F.flatten(F.collect_list("spots")).alias("__spots")
    )
    kept = without(docs, "text", "kept", "n_bytes", "n_removed", "n_spans").columns
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept], ident.alias("__id"), tie.alias("__tie"),
        F.col("text").cast("binary").alias("__text"),
    )
    joined = rows.join(every, (F.col("__id") == F.col("__of")) & (F.col("__tie") == F.col("__with")), "left").select(
        *[F.col(f"`{c}`") for c in kept], "__text", "__spots"
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    schema = f"{schema}{', ' if schema else ''}kept binary, n_removed long, n_spans long"
    cut = joined.mapInArrow(_cut(length, kept), schema)
    return cut.withColumn("n_bytes", F.octet_length("kept").cast("long") + F.col("n_removed"))
