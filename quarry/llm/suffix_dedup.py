"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document of smaller doc_id.

Gathering. A 50-byte string holds 35 seeds of 16 bytes; the seed of least hash is content-defined, so equal strings meet
at equal seeds. Each document yields its seeds (about one in 18 bytes) with the hash of the seed's context: all strings
that have it as their seed, 84 bytes at most. Seeds are dealt out by hash, once. Copies of a context are folded before
that: every occurrence in a later document than the first is covered, which is settled within a task already where it can
be, so a passage in a third of all documents costs a few rows a task; and occurrences in one document at most 50 bytes
apart become one row with the length of their run, so a text of one byte or one line over and over costs a few rows too.
What is left are seeds with unlike contexts: the edges of shared passages and edits in near copies. Equal strings
around a seed agree on the 17 bytes before it or after it; contexts that do so with no other (by a byte of hash) are
done with. The first document of each other context goes on, with its bytes.

Suffix structure. Unlike contexts of the same seeds are concatenated into blocks of bounded size. A block's suffixes are sorted
by their first 56 symbols and its Burrows-Wheeler transform is taken. From the interval of the empty string, intervals
are extended backward breadth-first; in round v, each new interval whose right boundary has no common-prefix value yet
gives it the value v and lives on, and the others end. Values come in increasing order, and the expansion stops at the
threshold: boundaries still without a value have a common prefix of 50 or more, so they bound groups of equal
50-byte strings, and each group's smallest doc_id decides.

A seed with more than GROUP unlike contexts doesn't fit a bounded block. Its strings are dealt out again in two halves, by how
many bytes they have before the seed: those of a half agree on more bytes, so their longer seeds have fewer unlike contexts.
That is done until they fit (six times at most: then strings of one seed are equal) and the blocks decide here too.

Defined results: a null text is empty; texts under 50 bytes keep all bytes; documents with a null doc_id keep all bytes and
cover nothing; doc_id must be a whole number; rows that share a doc_id cover nothing of each other, and each loses what its own
text shares with smaller ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch, small_batches

LENGTH, SEED = 50, 16
SIDE = LENGTH - SEED  # bytes that a string can have on one side of a seed
WINDOW = SIDE + 1  # seeds in a string
SEGMENT = 1 << 20  # bytes of a text that are hashed at once at most
TOGETHER = 1 << 17  # bytes of short texts that are hashed at once
FLUSH = 1 << 18  # seeds that a task settles among themselves
GROUP = 2048  # unlike contexts of a seed that go into a block
BLOCK = 1 << 19  # bytes of a block
SPAN, CONTEXT, CROWDED = 0, 1, 2  # kinds of rows
U = np.uint64
PLACES = U(21)  # bits for a place within a segment; the rest of a seed's hash decides which is least
HALF = SIDE // 2  # two equal strings around a seed agree on so many bytes before it or after it
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(32))) * C1
    x = (x ^ (x >> U(29))) * C2
    return x ^ (x >> U(32))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data as one number (all but the last seven places)."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data.tobytes(), 0, (1,))


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each window of `width`, by doubling."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def region_hash(words: np.ndarray, at: np.ndarray, size: np.ndarray | int, salt: np.uint64) -> np.ndarray:
    """64-bit hashes of the `size` (8 or more) bytes from each place `at`, in words of which the last may lap over."""
    size = np.broadcast_to(np.asarray(size, np.int64), at.shape)
    out = mix(size.astype(np.uint64) + salt)
    for offset in range(0, int(size.max(initial=0)), 8):
        out = (out ^ words[at + np.minimum(offset, size - 8)]) * C3
        out ^= out >> U(29)
    return mix(out)


def segments(doc: int, variant: int, text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc, variant, first byte, bytes) of parts whose strings make up the text's."""
    for a in range(0, len(text) - LENGTH + 1, SEGMENT):
        yield doc, variant, a, text[a : a + SEGMENT + LENGTH - 1]


def seeds(parts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(doc, variant, seed hash, context hash, place) of the seeds of segments, all at once.

    A string's seed is the leftmost of least hash; strings in a row with one seed make up its context. place packs the
    seed's position, a byte of hash of the HALF bytes on either side (0 where the context has fewer), and the numbers of
    the context's bytes before and after the seed."""
    doc, variant, base = (np.array(x, np.int64) for x in zip(*(p[:3] for p in parts)))
    size = np.array([len(p[3]) for p in parts], np.int64)
    data = np.frombuffer(b"".join([p[3] for p in parts]) + bytes(8), np.uint8)
    words, spots, number = loads(data), len(data) - 8 - SEED + 1, size - LENGTH + 1  # number: strings of each segment
    h = mix(words[:spots] * C1 ^ mix(words[8 : spots + 8]))
    least = sliding(h >> PLACES << PLACES | np.arange(spots, dtype=np.uint64), WINDOW, np.minimum)
    offset, ends = np.cumsum(size) - size, np.cumsum(number)
    starts = np.arange(ends[-1]) + np.repeat(offset - ends + number, number)  # strings that cross segments are left out
    best = (least[starts] & ((U(1) << PLACES) - U(1))).astype(np.int64)
    first = np.flatnonzero(changes(best))
    start, at = starts[first], best[first]
    end = starts[np.append(first[1:], len(best)) - 1] + LENGTH
    before, after = at - start, end - at - SEED
    context = region_hash(words, start, end - start, C2) ^ mix(before.astype(np.uint64))
    sides = [np.where(there >= HALF, region_hash(words, np.clip(from_, 0, len(data) - HALF - 8), HALF, C1) % U(255) + U(1), U(0)).astype(np.int64) for there, from_ in ((before, at - HALF), (after, at + SEED))]
    own = np.searchsorted(ends, first, side="right")
    return doc[own], variant[own], h[at], context, (at - offset[own] + base[own]) << 28 | sides[0] << 20 | sides[1] << 12 | before << 6 | after


def region(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of packed places' contexts."""
    pos = place >> 28
    return pos - (place >> 6 & 63), pos + SEED + (place & 63)


def changes(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys begin a group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    first = np.flatnonzero(new)
    return lo[first], hi[np.concatenate((first[1:], [len(lo)])) - 1]


ROW = "kind int, key long, key2 long, doc long, variant long, place long, more long, bytes binary"
NAMES = ["kind", "key", "key2", "doc", "variant", "place", "more", "bytes"]


def rows(kind: int, key, key2, doc, variant, place, more, data: list | None = None) -> pa.RecordBatch:
    """Rows of ROW; more is how far a run of equal contexts goes beyond the first."""
    n = len(doc)
    signed = [np.ascontiguousarray(x).view(np.int64) for x in (key, key2, doc, variant, place, more)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, signed), pa.array(data, pa.binary()) if data else pa.nulls(n, pa.binary())], NAMES)


def span_rows(doc: np.ndarray, variant: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Spans, dealt out by document; a span's place packs nothing: key2 is its start and place its end."""
    return rows(SPAN, mix(doc.view(np.uint64)), lo, doc, variant, hi, np.zeros(len(doc), np.int64))


def merged_spans(doc: np.ndarray, variant: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans of many documents, merged within each."""
    if not len(doc):
        return
    by = np.lexsort((lo, variant, doc))
    doc, variant, lo, hi = doc[by], variant[by], lo[by], hi[by]
    # one number line for all documents, far enough apart that their spans can't touch
    shift = (np.cumsum(changes(doc, variant)) - 1) * (int(hi.max()) + 2)
    start, end = merged(lo + shift, hi + shift)
    at = np.searchsorted(lo + shift, start)
    yield span_rows(doc[at], variant[at], start - shift[at], end - shift[at])


def settle(kind: int, key, key2, doc, variant, place, more, data: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Spans of the contexts that have an equal of smaller doc among them, and the others, those of a run as one row.

    Occurrences at most LENGTH apart make up a run: what is covered in one is covered from the first to the last without a gap."""
    if not len(key):
        return
    order = np.lexsort((doc, key2, key))  # stable: the places of a document come in order
    new = changes(key[order], key2[order])
    covered = doc[order] > doc[order][new][np.cumsum(new) - 1]
    gone, left = order[covered], order[~covered]
    lo, hi = region(place[gone])
    yield from merged_spans(doc[gone], variant[gone], lo, hi + more[gone])
    key, key2, doc, variant, place, more = (x[left] for x in (key, key2, doc, variant, place, more))
    pos = place >> 28
    head = changes(key, key2, doc, variant)
    head[1:] |= (pos[1:] < pos[:-1]) | (pos[1:] > pos[:-1] + more[:-1] + LENGTH)
    first = np.flatnonzero(head)
    if len(first):
        end = np.maximum.reduceat(pos + more, first)
        yield rows(kind, key[first], key2[first], doc[first], variant[first], place[first], end - pos[first], [data[i] for i in left[first].tolist()] if data else None)


class Settler:
    """Collects seeds of many documents and settles them together."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, doc: np.ndarray, variant: np.ndarray, key: np.ndarray, key2: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            self.held.append((key, key2, doc, variant, place))
            self.n += len(key)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            key, key2, doc, variant, place = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.n = [], 0
            yield from settle(CONTEXT, key, key2, doc, variant, place, np.zeros(len(key), np.int64))


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of all documents (doc, variant, text); short ones are hashed together."""
    own, parts, held = Settler(), [], 0
    for b in batches:
        for doc, variant, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            for part in segments(doc, variant, text.as_py()):
                parts.append(part)
                held += len(part[3])
                if held >= TOGETHER:
                    yield from own.add(*seeds(parts))
                    parts, held = [], 0
    if parts:
        yield from own.add(*seeds(parts))
    yield from own.flush()


def columns(b: pa.RecordBatch) -> list[np.ndarray]:
    """key, key2, doc, variant, place, more."""
    return [b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7)]


def without_spans(b: pa.RecordBatch) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
    """A batch's spans and its other rows."""
    span = b.column(0).to_numpy(zero_copy_only=False) == SPAN
    return ([b.filter(pa.array(span))], b.filter(pa.array(~span))) if span.any() else ([], b)


def sort_out(batches: Iterator[pa.RecordBatch], group: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Rows by seed, context and document -> spans, first contexts (CONTEXT), and those of crowded seeds (CROWDED)."""
    crowded: list[int] = []  # seeds of which a part was told as crowded: the one before and the one at hand

    def firsts(cols: list[np.ndarray]) -> tuple[list[np.ndarray], Iterator[pa.RecordBatch]]:
        """The rows of each context's first document, and the spans of the others."""
        key, key2, doc, variant, place, more = cols
        new = changes(key, key2)
        later = doc > doc[new][np.cumsum(new) - 1]
        lo, hi = region(place[later])
        return [x[~later] for x in cols], merged_spans(doc[later], variant[later], lo, hi + more[later])

    def told(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cross = np.add.reduceat(np.ones(len(cols[0]), np.int64), np.flatnonzero(changes(cols[0]))) if len(cols[0]) else np.zeros(0, np.int64)
        if not len(cross):
            return
        cols, spans = firsts(cols)
        yield from spans
        key, key2, doc, variant, place, more = cols
        new = changes(key, key2)
        seed = np.cumsum(changes(key)) - 1
        contexts = np.bincount(seed, new)
        least = np.full(len(contexts), np.iinfo(np.int64).max)
        most = np.full(len(contexts), np.iinfo(np.int64).min)
        np.minimum.at(least, seed, doc)
        np.maximum.at(most, seed, doc)
        many = contexts > group
        many |= np.isin(key[changes(key)], crowded)
        unlike = many | (contexts > 1) & (least < most)
        alike = many[seed]  # for the rest, contexts that agree with another on one side
        for side in (place >> 20 & 255, place >> 12 & 255):
            pair = seed * 256 + side
            kinds, which = np.unique(pair[new], return_inverse=True)
            shared = kinds[np.bincount(which) > 1]
            alike |= (side > 0) & np.isin(pair, shared, assume_unique=False)
        for kind, which in ((CONTEXT, unlike & ~many), (CROWDED, many)):
            at = which[seed] & alike
            yield rows(kind, *(x[at] for x in cols))

    held: list[list[np.ndarray]] = []  # rows of the last seed, which may go on
    n, limit = 0, 4 * group
    for b in batches:
        spans, b = without_spans(b)
        yield from spans
        if not b.num_rows:
            continue
        cols = columns(b)
        end = int(np.flatnonzero(changes(cols[0]))[-1])
        if held and (end or cols[0][0] != held[0][0][0]):
            part = cols[0][:end]
            whole = int(np.count_nonzero(part == held[0][0][0])) if end else 0
            yield from told([np.concatenate(x) for x in zip(*held, [c[:whole] for c in cols])])
            cols, end = [c[whole:] for c in cols], end - whole
            held, n, limit = [], 0, 4 * group
        if end:
            yield from told([c[:end] for c in cols])
            cols = [c[end:] for c in cols]
        held.append(cols)
        n += len(cols[0])
        if n > limit:
            cols, spans = firsts([np.concatenate(x) for x in zip(*held)])
            yield from spans
            starts = np.flatnonzero(changes(cols[0], cols[1]))
            if len(starts) > group:
                # too many for one block whatever follows: tell all but the last context, which may go on
                crowded = [*crowded[-1:], int(cols[0][-1])]
                yield from told([c[: starts[-1]] for c in cols])
                cols = [c[starts[-1] :] for c in cols]
            held, n = [cols], len(cols[0])
            limit = max(4 * group, 2 * n)
    if held:
        yield from told([np.concatenate(x) for x in zip(*held)])


def halves(doc: np.ndarray, variant: np.ndarray, place: np.ndarray, more: np.ndarray, data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Contexts of crowded seeds, dealt out by longer seeds: strings with fewer and with more bytes before the seed.

    The bits for hashes of a context's sides hold the range of bytes before the seed that its strings may have."""
    size = np.array([len(x) for x in data], np.int64)
    blob = b"".join(data)
    words = loads(np.frombuffer(blob + bytes(64), np.uint8))
    before, after, low, high, pos = place >> 6 & 63, place & 63, place >> 20 & 255, place >> 12 & 255, place >> 28
    at = np.cumsum(size) - size + before  # of the seed in the blob
    middle = (low + high) // 2
    for lo, hi in ((middle + 1, high), (low, middle)):
        a, b = np.maximum(lo, SIDE - after), np.minimum(hi, before)
        ok = np.flatnonzero((a <= b) & (lo <= hi))
        if not len(ok):
            continue
        a, b, l, h, seed = a[ok], b[ok], lo[ok], hi[ok], at[ok]
        key = region_hash(words, seed - l, SEED + l + SIDE - h, C3) ^ mix((l * 64 + h).astype(np.uint64))
        key2 = region_hash(words, seed - b, SEED + b + SIDE - a, C2) ^ mix(b.astype(np.uint64))
        parts = [blob[i:j] for i, j in zip((seed - b).tolist(), (seed + SEED + SIDE - a).tolist())]
        yield from settle(CONTEXT, key.view(np.int64), key2.view(np.int64), doc[ok], variant[ok], pos[ok] << 28 | l << 20 | h << 12 | b << 6 | (SIDE - a), more[ok], parts)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, variant, text, contexts) -> contexts with their bytes; those of crowded seeds by halves."""
    held: list[tuple] = []

    def dealt() -> Iterator[pa.RecordBatch]:
        nonlocal held
        numbers, data = [np.array([h[i] for h in held], np.int64) for i in range(4)], [h[4] for h in held]
        held = []
        yield from halves(*numbers, data)

    for b in batches:
        for doc, variant, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            text, found = text.as_py(), found.values
            kind, key, key2, place, more = (found.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            lo, hi = region(place)
            data = [text[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
            plain = np.flatnonzero(kind == CONTEXT)
            if len(plain):
                some = np.full(len(plain), doc, np.int64), np.full(len(plain), variant, np.int64)
                yield rows(CONTEXT, key[plain], key2[plain], *some, place[plain], more[plain], [data[i] for i in plain.tolist()])
            for i in np.flatnonzero(kind == CROWDED).tolist():
                whole = int(place[i]) & ~(0xFFFF << 12) | SIDE << 12  # any number of bytes before the seed, from 0 to SIDE
                held.append((doc, variant, whole, int(more[i]), data[i]))
                if len(held) >= FLUSH // 8:
                    yield from dealt()
    if held:
        yield from dealt()


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """The order of the circular suffixes by at least `length` symbols: by seven symbols at once, then by prefix doubling."""
    n, span = len(symbols), 7
    key = symbols.astype(np.int64)
    for i in range(1, span):
        key = key << 9 | np.roll(symbols, -i)
    while True:
        order = np.argsort(key)
        new = changes(key[order])
        if span >= length or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        key = rank * n + np.roll(rank, -span)
        span *= 2


def equal_groups(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which places of the suffix order begin a group with fewer than `length` symbols in common with the one before.

    Breadth-first backward extension from the empty string's interval; round v settles the boundaries of value v."""
    n = len(symbols)
    bwt = symbols[order - 1]
    front = np.sort(bwt, kind="stable")
    step = np.empty(n, np.int32)  # where the suffix one symbol longer stands
    step[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    letter = np.concatenate(([True], front[1:] != front[:-1]))
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    at, owner = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)  # places in living intervals, ascending, and their intervals
    for _ in range(length):
        if not len(at):
            break
        to = step[at]
        if len(at) * 8 > n:
            spread = np.full(n, -1, np.int32)
            spread[to] = owner
            at = np.flatnonzero(spread >= 0).astype(np.int32)
            owner = spread[at]
        else:
            by = np.argsort(to)
            at, owner = to[by], owner[by]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | letter[at[1:]]
        first = np.flatnonzero(new)
        right = at[np.concatenate((first[1:], [len(at)])) - 1] + 1
        lives = ~known[right]
        known[right[lives]] = True
        run = np.cumsum(new, dtype=np.int32) - np.int32(1)
        keep = lives[run]
        at, owner = at[keep], run[keep]
    return known[:n]


def block_spans(data: list[bytes], low: list[int], members: list[tuple]) -> pa.RecordBatch:
    """Spans of a block's contexts that also start in a smaller document.

    data, low: bytes and first document of each context; members: (context, variant, place, more) of its occurrences there."""
    size = np.array([len(d) for d in data])
    start = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(data)), size + 1)
    symbols = np.frombuffer(b"\0".join(data) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[start + size] = 0
    order = suffix_order(symbols, LENGTH)
    new = equal_groups(symbols.astype(np.uint16), order, LENGTH)
    docs = np.array(low, np.int64)[owner]
    group_low = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    least = np.empty(len(symbols), np.int64)
    least[order] = group_low
    offset = np.arange(len(symbols)) - start[owner]
    hit = np.flatnonzero((least < docs) & (offset + LENGTH <= size[owner]))
    # runs of starts within a context become one span, of each of its occurrences
    first = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
    last = np.append(first[1:], len(hit))[: len(first)] - 1
    context, lo, hi = owner[hit[first]], offset[hit[first]], offset[hit[last]] + LENGTH
    which, variant, place, more = (np.array(x, np.int64) for x in zip(*members))
    spans = np.bincount(context, minlength=len(data))
    begin = np.cumsum(spans) - spans
    many = spans[which]
    member = np.repeat(np.arange(len(which)), many)
    run = np.arange(many.sum()) + np.repeat(begin[which] - np.cumsum(many) + many, many)
    at = region(place)[0][member]
    return span_rows(np.array(low, np.int64)[which[member]], variant[member], at + lo[run], at + hi[run] + more[member])


def decide(batches: Iterator[pa.RecordBatch], group: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Contexts with their bytes by key, key2 and document -> spans, and halves of seeds that are crowded still (CROWDED)."""
    data: list[bytes] = []  # of a block's contexts, with their first documents and members
    low: list[int] = []
    members: list[tuple] = []
    size = contexts = 0
    seed_data = seed_members = 0  # where the seed at hand begins
    key = key2 = None
    first = 0
    full = False
    later: list[tuple] = []
    crowd: list[tuple] = []

    def covered() -> Iterator[pa.RecordBatch]:
        nonlocal later
        doc, variant, place, more = (np.array(x, np.int64) for x in zip(*later))
        later = []
        lo, hi = region(place)
        yield from merged_spans(doc, variant, lo, hi + more)

    def dealt() -> Iterator[pa.RecordBatch]:
        nonlocal crowd
        numbers, parts = [np.array([c[i] for c in crowd], np.int64) for i in range(4)], [c[4] for c in crowd]
        crowd = []
        for b in halves(*numbers, parts):
            kind = b.column(0).to_numpy(zero_copy_only=False)
            yield b if (kind == SPAN).any() else b.set_column(0, "kind", pa.array(np.full(b.num_rows, CROWDED, np.int32)))

    for b in batches:
        spans, b = without_spans(b)
        yield from spans
        for k, k2, doc, variant, place, more, text in zip(*(c.tolist() for c in columns(b)), b.column(7).to_pylist()):
            if k != key:
                if contexts == 1 and not full:  # alone: nothing to compare with
                    size -= len(data[-1]) + 1
                    del data[seed_data:], low[seed_data:], members[seed_members:]
                if size >= BLOCK:
                    yield block_spans(data, low, members)
                    data, low, members, size = [], [], [], 0
                key, key2, contexts, full = k, None, 0, False
                seed_data, seed_members = len(data), len(members)
            if k2 != key2:
                key2, first, contexts = k2, doc, contexts + 1
                if not full and contexts > group:
                    full = True
                    crowd += [(low[c], v, p, m, data[c]) for c, v, p, m in members[seed_members:]]
                    size -= sum(len(d) + 1 for d in data[seed_data:])
                    del data[seed_data:], low[seed_data:], members[seed_members:]
                if not full:
                    data.append(text)
                    low.append(doc)
                    size += len(text) + 1
            if doc > first:
                later.append((doc, variant, place, more))
                if len(later) >= FLUSH:
                    yield from covered()
            elif full:
                crowd.append((doc, variant, place, more, text))
                if len(crowd) >= FLUSH // 8:
                    yield from dealt()
            else:
                members.append((len(data) - 1, variant, place, more))
    if contexts == 1 and not full:
        del data[seed_data:], low[seed_data:], members[seed_members:]
    if data:
        yield block_spans(data, low, members)
    if later:
        yield from covered()
    if crowd:
        yield from dealt()


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> what is left of each document."""
    for b in batches:
        out = []
        for text, spans in zip(b.column(1), b.column(2)):
            text = text.as_py()
            found = np.array([(x["lo"], x["hi"]) for x in spans.as_py() or ()], np.int64).reshape(-1, 2)
            lo, hi = merged(found[:, 0], found[:, 1])
            lo, hi = np.minimum(lo, len(text)), np.minimum(hi, len(text))
            digest, at = sha256(), 0
            for i, j in zip(lo.tolist(), hi.tolist()):
                digest.update(text[at:i])
                at = j
            digest.update(text[at:])
            out.append((len(text), int((hi - lo).sum()), int((hi > lo).sum()), digest.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_variants(docs: DataFrame) -> DataFrame:
    """doc, variant, text: variants tell texts of one doc_id apart (a hash of the text, if any doc_id repeats)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    repeated = not texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("doc IS NOT NULL AND n > 1").isEmpty()
    return texts.select("doc", (F.xxhash64("text") if repeated else F.lit(0)).cast("long").alias("variant"), "text")


def repeats(texts: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """doc, variant, lo, hi: spans of bytes whose strings also start in a smaller document (they may overlap)."""
    texts = texts.filter("doc IS NOT NULL AND octet_length(text) >= 50")
    span = "doc", "variant", F.col("key2").alias("lo"), F.col("place").alias("hi")
    found = texts.mapInArrow(gather, ROW).drop("bytes").repartition("key").sortWithinPartitions("key", "key2", "doc")
    sorted_out = scratch.put(found.withColumn("bytes", F.lit(None).cast("binary")).mapInArrow(lambda batches: sort_out(batches, group), ROW).drop("bytes"), "sorted")
    asked = sorted_out.filter(f"kind <> {SPAN}").groupBy("doc", "variant").agg(F.collect_list(F.struct("kind", "key", "key2", "place", "more")).alias("contexts"))
    at = texts.join(asked, ["doc", "variant"]).select("doc", "variant", "text", "contexts").mapInArrow(fetch, ROW)
    every = sorted_out.filter(f"kind = {SPAN}").select(*span)
    while True:
        decided = scratch.put(at.repartition("key").sortWithinPartitions("key", "key2", "doc").mapInArrow(lambda batches: decide(batches, group), ROW), "decided")
        every = every.unionByName(decided.filter(f"kind = {SPAN}").select(*span))
        at = decided.filter(f"kind = {CROWDED}")
        if at.isEmpty():
            return every


def removals(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = with_variants(docs)
    spans = repeats(texts, scratch, group).groupBy(F.col("doc").alias("doc_"), F.col("variant").alias("variant_")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    both = texts.join(spans, (F.col("doc") == F.col("doc_")) & (F.col("variant") == F.col("variant_")), "left").select("doc", "text", "spans")
    told = both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return told.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
