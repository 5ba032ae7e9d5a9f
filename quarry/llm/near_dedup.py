"""Near-dedup by SimHash on five-word shingles, at Jaccard similarity 0.8 or more.

Each set of shingles gets FINGERPRINTS independent 64-bit SimHash fingerprints, each filed by the pigeonhole blocks of simhash.py;
what shares a file within WITHIN bits is a candidate. At 0.8 two fingerprints differ by about ten bits, where blocks find some pairs
only, so candidates come from a second filing too: HASHES min-hashes in BANDS bands of ROWS; sets that agree on a whole band share a
file. Files of one row are dropped by a count; in the others the share of equal min-hashes (a byte of each) gives candidates, down to
LOOSE. The components of all candidates are clusters, and within each the similarity is computed exactly from the sets: only pairs
that reach it are linked, and the components of the links are the classes. Groups have bounded size (a large file or cluster is cut
into chunks, and each pair of chunks is a group) and return spanning forests, never all pairs.

What can be lost is a pair that neither finds: for the bands alone, at similarity 0.8, about one in 30,000, above it fewer. Sets are
of 64-bit hashes of the shingles.

Defined results: a text of one to four words is one shingle; null and wordless texts have an empty set and share a class;
a null doc_id links nothing; rows that repeat a doc_id share a class; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.scratch import Scratch, small_batches
from quarry.llm.simhash import PIECE, links, word_runs

WORDS = 5
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
FINGERPRINTS, WITHIN = 4, 10
LOOSE = 0.6  # share of equal min-hashes; 4.5 standard deviations below 0.8
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
_DRAWN = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 2 * HASHES + ROWS, np.uint64)
SALTS = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 64, FINGERPRINTS, np.uint64)
TIMES, PLUS, MIX = _DRAWN[:HASHES, None] | np.uint64(1), _DRAWN[HASHES : 2 * HASHES, None], _DRAWN[2 * HASHES :] | np.uint64(1)


def shingles(text: bytes, piece: int = PIECE) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles of lower-cased words."""
    digest, found, held = xxhash.xxh64_intdigest, np.zeros(0, np.uint64), []
    for run in word_runs(text, piece):
        held += run
        if len(held) < WORDS:
            continue
        n = len(held) - WORDS + 1
        joined = map(b" ".join, zip(*(held[i:] for i in range(WORDS))))
        found = np.union1d(found, np.fromiter((digest(x, 42) for x in joined), np.uint64, n))
        held = held[n:]
    if not len(found) and held:
        return np.array([digest(b" ".join(held), 42)], np.uint64)
    return found


def min_hashes(values: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(least, (values[None, at : at + 1024] * TIMES + PLUS).min(axis=1), out=least)
    return least


def salted(values: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes of the same shingles: splitmix64's finalizer."""
    x = values ^ salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(values: np.ndarray) -> np.ndarray:
    """Majority bits of a set's hashes, under each salt."""
    out = np.zeros(FINGERPRINTS, np.uint64)
    for t, salt in enumerate(SALTS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(values), 1 << 16):
            part = salted(values[at : at + (1 << 16)], salt)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[t] = np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0]
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the set, its size, fingerprints and a key of each band (none for an empty set), a byte of each min-hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, fps, keys, bytes_ = [], [], [], [], []
            for x in b.column(1):
                values = shingles(x.as_py() or b"")
                least = min_hashes(values)
                digests.append(xxhash.xxh64_intdigest(values.tobytes(), 42))
                sizes.append(len(values))
                fps.append(fingerprints(values).view(np.int64) if len(values) else [])
                keys.append((least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64) if len(values) else [])
                bytes_.append((least >> np.uint64(8)).astype(np.uint8).tobytes())
            told = [pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *told], ["doc_id", "digest", "size", "fps", "keys", "sig"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, size long, fps array<long>, keys array<long>, sig binary")


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (first, other) of each linked set of n members; near(i, left) tells which of the members left are close to i."""
    left, out = np.ones(n, bool), []
    for i in range(n):
        if not left[i]:
            continue
        left[i], queue = False, [i]
        while queue:
            found = near(queue.pop(), np.flatnonzero(left))
            left[found] = False
            queue += found.tolist()
            out += [(i, int(k)) for k in found]
    return out


def alike(sigs: list[bytes]) -> list[tuple[int, int]]:
    """Forest by the share of equal bytes."""
    s = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, HASHES)
    return forest(len(s), lambda i, left: left[(s[left] == s[i]).sum(axis=1) >= LOOSE * HASHES])


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Forest by exact similarity: 9 * common >= 4 * (sum of sizes) is Jaccard 0.8 or more."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(number, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(number))))

    def near(i: int, left: np.ndarray) -> np.ndarray:
        own = number[ends[i] - size[i] : ends[i]]
        common = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            many = first[part + 1] - first[part]
            places = np.arange(many.sum()) + np.repeat(first[part] - np.cumsum(many) + many, many)
            common += np.bincount(owner[places], minlength=len(sets))
        return left[9 * common[left] >= 4 * (size[i] + size[left])]

    return forest(len(sets), near)


def grouped(members: DataFrame, by: list[str], parts: Column, value: str, decide: Callable[[list], list[tuple[int, int]]]) -> DataFrame:
    """Links (lo, hi) that decide finds among the values of each `by`, cut into `parts` chunks that meet pair by pair; members: by, rep, value."""
    dealt = members.withColumn("parts", parts.cast("int")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("mine")))
    met = dealt.withColumn("other", F.explode(others))
    sides = [*by, "a", "b"]
    met = met.select(*by, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "rep", value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reps, values = None, [], []

        def close() -> pa.RecordBatch:
            pairs = np.array([(reps[i], reps[k]) for i, k in decide(values)] if len(reps) > 1 else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["lo", "hi"])

        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(sides)))))
            ids, found = b.column(len(sides)), b.column(len(sides) + 1)
            for i, name in enumerate(names):
                if name != at:
                    yield close()
                    at, reps, values = name, [], []
                reps.append(ids[i].as_py())
                v = found[i]
                values.append(v.as_py() if pa.types.is_binary(v.type) else v.values.to_numpy(zero_copy_only=False).copy())
        yield close()

    return met.repartition(*sides).sortWithinPartitions(*sides).mapInArrow(run, "lo long, hi long")


def sets_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and rep as they are, and the set of the text."""
    keep = [*by, "rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x.as_py() or b"").view(np.int64) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*keep, "set"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema.fields)
    return rows.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{kinds}`set` array<long>")


def by_fingerprints(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Forest links (lo, hi) between reps of which a fingerprint's blocks agree within WITHIN bits; reps: rep, fps."""
    found = []
    for t in range(FINGERPRINTS):
        own = reps.filter(F.size("fps") > 0).select(F.element_at("fps", t + 1).alias("fp"), "rep")
        folded = scratch.put(own.groupBy("fp").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")), "folded")
        equal = own.join(folded.filter("n > 1"), "fp").filter("rep <> first").select(F.col("first").alias("lo"), F.col("rep").alias("hi"))
        found.append(scratch.put(links(folded.select("fp", F.col("first").alias("rep")), scratch, within=WITHIN).unionByName(equal), "linked"))
    return functools.reduce(DataFrame.unionByName, found)


def by_bands(reps: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """Forest links (lo, hi) between reps that share a band and look alike; reps: rep, keys, sig."""
    filed = reps.select("rep", F.posexplode("keys").alias("c", "key"))
    crowded = scratch.put(filed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")
    members = filed.join(crowded, ["c", "key"]).join(reps.select("rep", "sig"), "rep")
    return grouped(members, ["c", "key"], F.ceil(F.col("n") / chunk), "sig", alike)


def candidates(reps: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """Links (lo, hi) of both filings."""
    return by_fingerprints(reps, scratch).unionByName(by_bands(reps, scratch, chunk))


def classes(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) of each document that has a doc_id."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    small_batches(docs.sparkSession)
    prints = scratch.put(signatures(docs.filter("doc_id IS NOT NULL")), "prints")
    folded = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fps").alias("fps"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    reps = scratch.put(folded, "reps")
    clusters = scratch.put(components(scratch.put(candidates(reps, scratch, chunk), "candidates"), scratch), "clusters")
    sized = clusters.join(reps.select(F.col("rep").alias("node"), "size"), "node")
    sized = scratch.put(sized.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("size") / CHUNK_SHINGLES)).alias("many")), "sized")
    chosen = clusters.join(sized, "component").select("component", "many", F.col("node").alias("rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(chosen, "rep")
    members = sets_of(texts, ["component", "many"])
    alike_ = scratch.put(grouped(members, ["component", "many"], F.col("many"), "set", similar), "links")
    found = components(alike_, scratch)
    named = reps.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "digest").join(scratch.put(named, "named"), "digest").select("doc_id", "component_id")


def survivors(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each class, with all its columns; rows without a doc_id stay."""
    kept = classes(docs, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").unionByName(docs.filter("doc_id IS NULL"))
