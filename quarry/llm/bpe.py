"""Byte-level BPE with a segment tree over byte positions.

A text is cut into pieces by the vocabulary's pattern. Within a piece, leaf i of a segment tree holds the rank of
the pair that starts at byte i (with i, so that the root is the leftmost pair of least rank). A merge takes the
root's pair, joins it with the next live position and updates three leaves: the pair itself, the one before
and the one that went; each is a path to the root, so a piece of n bytes takes O(n log n), however long.
Pieces recur, so each Python worker keeps those it met last, in two generations of a fixed size. A piece of more than BIG
bytes has its tree and links in packed arrays: 24 to 40 bytes for each of its own (a piece of 10 MB takes about 0.3 GB).

Defined results: a null text counts as empty, an empty text has no ids; bytes that are not UTF-8 are read as
U+FFFD; long texts are cut piece by piece, never as a whole list; other columns pass through or are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import small_batches

KEEP_PIECES = 300_000  # in each generation
RUN = 1 << 16  # pieces of a long text that are held at once
LONG = 1 << 19  # characters from which a text counts as long
BIG = 1 << 14  # bytes from which a piece's tree is packed
NONE = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 and number."""
    return {base64.b64decode(a): int(n) for a, n in (line.split() for line in raw.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    get, size, bits = ranks.get, 1 << (n - 1).bit_length(), n.bit_length()
    place = (1 << bits) - 1
    tree = [NONE] * (2 * size) if n < BIG else array("q", [NONE]) * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    links = list if n < BIG else (lambda r: array("i", r))
    after, before = links(range(1, n + 1)), links(range(-1, n))
    while tree[1] < NONE:
        i = tree[1] & place
        gone = after[i]
        after[i] = end = after[gone]
        before[end] = i
        r = get(piece[i : after[end]]) if end < n else None
        changed = [(gone, NONE), (i, NONE if r is None else r << bits | i)]
        left = before[i]
        if left >= 0:
            r = get(piece[left:end])
            changed.append((left, NONE if r is None else r << bits | left))
        for leaf, v in changed:
            # from the leaf to the root, or to where nothing changes
            k = size + leaf
            tree[k] = v
            while k > 1:
                w = tree[k ^ 1]
                if w < v:
                    v = w
                k >>= 1
                if tree[k] == v:
                    break
                tree[k] = v
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """piece -> (number of ids, ids as text, ids as little-endian 32-bit integers, decoded bytes)."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.token, self.old = ranks, {n: a for a, n in ranks.items()}, {}

    def __missing__(self, piece: str) -> tuple[int, str, bytes, bytes]:
        got = self.old.pop(piece, None)
        if got is None:
            ids, token = merge(piece.encode("utf-8", "replace"), self.ranks), self.token
            got = (len(ids), " ".join(map(str, ids)), array("I", ids).tobytes(), b"".join([token[i] for i in ids]))
        if len(piece) < 64:
            if len(self) >= KEEP_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.pieces, self.pattern = Pieces(read_ranks(raw)), regex.compile(pattern)

    def runs(self, text: str) -> Iterator[list[str]]:
        if len(text) < LONG:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while run := list(islice(found, RUN)):
                yield run

    def encode(self, text: str) -> list[int]:
        return [i for run in self.runs(text) for p in run for i in memoryview(self.pieces[p][2]).cast("I")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.pieces.token[i] for i in ids)

    def digest(self, text: str, with_ids: bool = False) -> tuple[int, str, str, bytes | None]:
        """Number of ids, SHA-256 of the ids' text and of the decoded bytes, and the packed ids if asked for."""
        n, told, back, packed, pieces = 0, sha256(), sha256(), [], self.pieces
        for run in self.runs(text):
            if not run:
                continue
            counts, ids, bits, decoded = zip(*map(pieces.__getitem__, run))
            told.update(((" " if n else "") + " ".join(ids)).encode())
            back.update(b"".join(decoded))
            n += sum(counts)
            if with_ids:
                packed.append(b"".join(bits))
        return n, told.hexdigest(), back.hexdigest(), b"".join(packed) if with_ids else None


_codecs: dict[str, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """The worker's codec; it stays between tasks."""
    name = sha256(raw).hexdigest() + pattern
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(raw, pattern)
    return _codecs[name]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The columns in keep, then n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids (packed 32-bit little-endian).

    vocabulary: path of a rank file on the driver; the tasks get its content (some MB at most) by broadcast."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text_"))
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, pattern)
        for b in batches:
            got = [own.digest(x.as_py().decode("utf-8", "replace"), with_ids) for x in b.column(len(keep))]
            columns = [*b.columns[:-1], pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.string()) for i in (1, 2))]
            if with_ids:
                columns.append(pa.array([g[3] for g in got], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids)
