"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits are cut into six blocks. Two fingerprints at three or fewer differing bits agree on at
least three whole blocks, so each fingerprint is filed under all twenty choices of three blocks (31 to 33 bits
each): every close pair shares a file, and files hold little else. Equal fingerprints are folded into one row
first. Files of one row are dropped by a count. In a large file the bits outside its blocks are cut into four more, of which
a close pair has one alike, so its members are filed again under each of these. The members of files meet in groups of
bounded size (what is still large is cut into chunks, and each pair of chunks is a group), where the Hamming
distance is verified.
A group returns a spanning forest of its links, at most one row per member, never all pairs.
Connected components of the forests give each document its class.

Defined results: a null or wordless text has fingerprint zero and links like any other; doc_id must be a whole number; a null doc_id takes its
fingerprint's class but names none; repeated rows share a class; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.scratch import Scratch, small_batches

BLOCKS, AGREE, MAX_BITS = (11, 11, 11, 11, 10, 10), 3, 3
CHUNK = 96
PIECE = 1 << 20  # bytes of text whose words are held at once


def word_runs(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Lower-cased words in runs, cut at white space so that long texts need little memory."""
    at = 0
    while at < len(text):
        end = min(len(text), at + piece)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, words: int = 3, piece: int = PIECE) -> int:
    """Majority bits over the XXH64 values of all word shingles, repeats included."""
    digest, ones, total, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for run in word_runs(text, piece):
        held += run
        if len(held) < words:
            continue
        n = len(held) - words + 1
        joined = map(b" ".join, zip(*(held[i:] for i in range(words))))
        values = np.fromiter((digest(x, 42) for x in joined), np.uint64, n)
        for at in range(0, n, 1 << 16):
            part = values[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
        held = held[n:]
    if not total:
        return digest(b" ".join(held), 42) if held else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(x.as_py() or b"", words) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def masks() -> list[int]:
    """The bits of each choice of three blocks, as signed longs."""
    edges = np.cumsum((0, *BLOCKS))
    block = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    chosen = [sum(block[i] for i in c) for c in combinations(range(len(BLOCKS)), AGREE)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def rest_masks(mask: int) -> list[int]:
    """The bits outside a choice of blocks, in MAX_BITS + 1 parts, as signed longs."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cut = [sum(1 << b for b in rest[i :: MAX_BITS + 1]) for i in range(MAX_BITS + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in cut]


def forest(fp: np.ndarray, rep: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (smallest, other) of each linked set within one group."""
    order = np.argsort(rep, kind="stable")
    fp, rep, out = fp[order], rep[order], []
    left = np.ones(len(fp), bool)
    for i in range(len(fp)):
        if not left[i]:
            continue
        left[i], queue = False, [i]
        while queue:
            near = np.flatnonzero(left & (np.bitwise_count(fp ^ fp[queue.pop()]) <= max_bits))
            left[near] = False
            queue += near.tolist()
            out += [(int(rep[i]), int(rep[k])) for k in near]
    return out


def links(reps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, chunk: int = CHUNK, within: int | None = None) -> DataFrame:
    """Forest links (lo, hi) between the reps of fingerprints at max_bits or fewer; reps: fp, rep.

    within: what meets is linked up to so many bits, more than max_bits; beyond max_bits only such pairs are found as share a file."""
    bits = max(max_bits, within or 0)
    if max_bits > len(BLOCKS) - AGREE:
        raise ValueError(f"{len(BLOCKS)} blocks of which {AGREE} agree find pairs up to {len(BLOCKS) - AGREE} bits")
    filed = reps.filter("rep IS NOT NULL").select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks())])).alias("f")
    ).select("f.c", "f.key", "fp", "rep")
    crowded = scratch.put(filed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")
    members = filed.join(crowded, ["c", "key"]).select("c", "key", F.lit(0).alias("j"), F.lit(0).cast("long").alias("own"), "fp", "rep", "n")
    if not crowded.filter(F.col("n") > chunk).isEmpty():
        parts_of = F.array(*[F.array(*map(F.lit, rest_masks(m))) for m in masks()])
        again = members.filter(F.col("n") > chunk).select("c", "key", F.posexplode(F.element_at(parts_of, F.col("c") + 1)).alias("j", "mask"), "fp", "rep")
        again = again.select("c", "key", "j", F.col("fp").bitwiseAND(F.col("mask")).alias("own"), "fp", "rep")
        still = scratch.put(again.groupBy("c", "key", "j", "own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "still")
        members = members.filter(F.col("n") <= chunk).unionByName(again.join(still, ["c", "key", "j", "own"]))
    members = members.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("mine")))
    met = members.withColumn("mine", mine).withColumn("other", F.explode(others))
    sides = ["c", "key", "j", "own", "a", "b"]
    met = met.withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other")}).select(*sides, "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int64) for _ in range(len(sides) + 2)]

        def close(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            n = len(cols[0])
            change = np.zeros(n, bool)
            for k in cols[:-2]:
                change[1:] |= k[1:] != k[:-1]
            starts = np.concatenate(([0], np.flatnonzero(change), [n]))
            if not last:
                starts = starts[:-1]
            size, first = np.diff(starts), starts[:-1]
            fp, rep = cols[-2].view(np.uint64), cols[-1]
            two = first[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            lo, hi = [np.minimum(rep[two], rep[two + 1])], [np.maximum(rep[two], rep[two + 1])]
            more = [e for s, k in zip(first[size > 2], size[size > 2]) for e in forest(fp[s : s + k], rep[s : s + k], bits)]
            if more:
                pairs = np.array(more, np.int64)
                lo.append(pairs[:, 0])
                hi.append(pairs[:, 1])
            end = int(starts[-1])
            return [k[end:] for k in cols], pa.RecordBatch.from_arrays([pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))], ["lo", "hi"])

        for b in batches:
            if b.num_rows:
                carry, out = close([np.concatenate((c, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, c in enumerate(carry)], False)
                yield out
        if len(carry[0]):
            yield close(carry, True)[1]

    return met.repartition(*sides).sortWithinPartitions(*sides).mapInArrow(run, "lo long, hi long")


def classes(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprints(docs, words), "prints")
    reps = scratch.put(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(links(reps, scratch, max_bits, chunk), scratch)
    named = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.put(named, "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each class, with all its columns; rows without a doc_id stay."""
    kept = classes(docs, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").unionByName(docs.filter("doc_id IS NULL"))
