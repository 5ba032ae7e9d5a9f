"""Exact, near and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import exact_dedup, near_dedup, simhash, suffix_dedup
from quarry.llm.components import components
from quarry.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, h string, bucket int, doc string"  # the last columns clash with the operators' own names


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


EDGES = [(1, None), (2, ""), (3, "same words here"), (4, "same words here"), (5, "Same words here"), (None, "same words here"), (None, "lonely"), (6, "é\n\t"), (6, "é\n\t"), (7, "word " * 50_000)]


def test_exact_on_edges(spark):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.decisions(table(spark, EDGES)).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert (got[1, sha("")]["keep_id"], got[1, sha("")]["group_size"], got[1, sha("")]["kept"]) == (2, 2, False)
    same = [got[i, sha("same words here")] for i in (3, 4, None)]
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in same] == [(4, 3, False), (4, 3, True), (4, 3, False)]
    assert got[5, sha("Same words here")]["group_size"] == 1
    assert got[None, sha("lonely")]["kept"] and got[None, sha("lonely")]["keep_id"] is None
    assert got[6, sha("é\n\t")]["group_size"] == 2
    every = exact_dedup.decisions(table(spark, EDGES)).collect()
    assert len(every) == len(EDGES) and sorted(r["kept"] for r in every if r["doc_id"] == 6) == [False, True]
    assert Counter(r["doc_id"] for r in exact_dedup.survivors(table(spark, EDGES)).collect()) == Counter([2, 4, 5, None, 6, 7])


@pytest.mark.parametrize("key_bits", [64, 1])
def test_repeated_rows(spark, key_bits):
    rows = [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (0, "a")]
    docs = table(spark, rows)
    told = exact_dedup.decisions(docs, key_bits=key_bits).collect()
    assert Counter((r["doc_id"], r["group_size"], r["kept"]) for r in told) == Counter([(1, 3, True), (1, 3, False), (1, 2, True), (1, 2, False), (None, 2, True), (None, 2, False), (0, 3, False)])
    assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.survivors(docs, key_bits=key_bits).collect()) == Counter([(1, "a"), (1, "b"), (None, "c")])


@pytest.mark.parametrize("key_bits, capacity", [(64, None), (64, 1), (3, 2), (1, 1)])
def test_exact_with_collisions(spark, key_bits, capacity):
    r = random.Random(key_bits)
    rows = [(i, f"text {r.randrange(60)}") for i in range(300)]
    docs = table(spark, rows)
    found = exact_dedup.decisions(docs, key_bits=key_bits, capacity=capacity).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {(x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in found} == want
    left = exact_dedup.survivors(docs, key_bits=key_bits, capacity=capacity)
    assert sorted(x["doc_id"] for x in left.collect()) == sorted(max(g) for g in groups.values())
    assert left.columns == docs.columns


def test_only_overfull_buckets_split():
    assert exact_dedup.split({0: 5, 1: 1, 2: 1, 3: 1}, 2, 2) == [(0, 2, 5), (1, 2, 1), (2, 1, 2)]
    assert exact_dedup.split({0: 100}, 2, 2) == [(0, 2, 100), (1, 2, 0), (2, 1, 0)]
    assert exact_dedup.split({}, 2, 2) == [(0, 0, 0)]


@pytest.mark.parametrize("key_bits, capacity, entries, n", [(16, 2, 16, 300), (4, 2, 1 << 14, 300), (4, 2, 2, 300), (64, 3, 1 << 14, 40), (1, 1, 2, 5), (64, 400, 4, 300)])
def test_directory(spark, monkeypatch, key_bits, capacity, entries, n):
    """Each key lies in one bucket, buckets are ranges of the hash in order, and none is overfull whose bits aren't used up."""
    monkeypatch.setattr(exact_dedup, "PAGE_ENTRIES", entries)
    r = random.Random(key_bits * capacity)
    hashes = {r.getrandbits(64) >> (64 - key_bits) for _ in range(n)} | ({7, 6, 5, 4} if key_bits > 4 else set())  # four that agree on all but two bits
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    keys = spark.createDataFrame([(signed(h),) for h in hashes], "h long")
    tree = exact_dedup.grow(keys, key_bits, capacity)
    at = {x["h"] & (1 << 64) - 1: x["b"] for x in keys.select("h", tree.bucket(exact_dedup.F.col("h")).alias("b")).collect()}
    in_order = [at[h] for h in sorted(hashes)]
    assert in_order == sorted(in_order)
    own = Counter(at.values())
    assert [own[b] for b in range(len(tree.sizes))] == tree.sizes and sum(tree.sizes) == len(hashes)
    for h in hashes:
        depth = tree.depths[at[h]]
        assert {at[o] for o in hashes if o >> (key_bits - depth) == h >> (key_bits - depth)} == {at[h]}
        assert own[at[h]] <= capacity or depth == key_bits
        if depth:  # it split for need: with its buddy it would be overfull
            assert sum(o >> (key_bits - depth + 1) == h >> (key_bits - depth + 1) for o in hashes) > capacity


@pytest.mark.parametrize("key_bits, owners", [(64, 5), (4, 3), (4, 1)])
def test_buckets_have_one_owner_and_chains_all_their_texts(spark, key_bits, owners):
    r = random.Random(2)
    rows = [(i, f"text {r.randrange(90)}") for i in range(400)] + [(1000 + i, "hot") for i in range(400)]
    index = exact_dedup.ExtendibleIndex(table(spark, rows), key_bits=key_bits, capacity=2, owners=owners, hot_rows=20)
    entries = index.entries.collect()
    assert Counter(x["text_sha256"] for x in entries) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for _, t in rows})
    owner, chain = {}, Counter(x["h"] for x in entries)
    for x in entries:
        assert owner.setdefault(x["bucket"], x["owner"]) == x["owner"] and x["chain"] == chain[x["h"]] and (x["text"] is not None) == (x["chain"] > 1)
    in_order = [owner[b] for b in sorted(owner)]
    assert in_order == sorted(in_order) and max(owner.values()) < owners


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["The", "a", "É", "x y", "b\x0bc", "ZZ"]) for _ in range(r.randint(0, 40)))) for i in range(200)] + EDGES
    for i, t in rows:
        raw = (t or "").encode()
        assert simhash.fingerprint(raw) == brute_fingerprint(t)
        assert simhash.fingerprint(raw, piece=7) == brute_fingerprint(t)


def brute_classes(prints):
    """prints: doc_id -> fingerprint; the smallest doc_id reachable."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("chunk", [96, 3])
def test_links_lose_no_pair(spark, chunk):
    r = random.Random(9)
    prints = {}
    for c in range(6):
        base = r.getrandbits(64)
        for k in range(25):
            at = base
            for b in r.sample(range(64), r.randint(0, 4)):
                at ^= 1 << b
            prints[c * 100 + k] = at
    reps = {}
    for i, f in sorted(prints.items()):
        reps.setdefault(f, i)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f), i) for f, i in reps.items()], "fp long, rep long").repartition(3)
    scratch = Scratch(spark, "test")
    found = {x["node"]: x["component"] for x in components(simhash.links(df, scratch, chunk=chunk), scratch).collect()}
    want = brute_classes({i: f for f, i in reps.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_masks_cover_every_choice_of_three_bits():
    r = random.Random(2)
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), 3))
        assert any(flips & (m & (1 << 64) - 1) == 0 for m in simhash.masks())


def test_large_files_are_filed_again(spark):
    """Fingerprints that agree on three blocks and are unlike in the rest, with some pairs three bits apart."""
    r = random.Random(5)
    outside = [sum(1 << b for b in range(64) if m >> b & 1) for m in simhash.rest_masks(simhash.masks()[0] & (1 << 64) - 1)]
    assert sum(outside) == (1 << 64) - 1 - (simhash.masks()[0] & (1 << 64) - 1) and len(outside) == 4
    rest = [b for b in range(64) if sum(outside) >> b & 1]
    fps = {sum(r.getrandbits(1) << b for b in rest) for _ in range(700)}
    for at in r.sample(sorted(fps), 60):
        for b in r.sample(range(64), 3):
            at ^= 1 << b
        fps.add(at)
    reps = dict(enumerate(sorted(fps)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f), i) for i, f in reps.items()], "fp long, rep long")
    scratch = Scratch(spark, "test")
    found = {x["node"]: x["component"] for x in components(simhash.links(df, scratch), scratch).collect()}
    assert {i: found.get(i, i) for i in reps} == brute_classes(reps)


def test_classes_and_survivors(spark):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    near = " ".join(words[:-1] + ["other"])
    rows = [(10, text), (11, text), (12, near), (13, "quite another text of words"), (14, None), (15, " \n"), (None, text)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.classes(table(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: int(f, 16) for i, (f, _) in got.items()} == prints
    want = brute_classes({i: f for i, f in prints.items() if i is not None})
    assert {i: c for i, (_, c) in got.items() if i is not None} == want
    assert got[14] == ("0" * 16, 14) and got[15][1] == 14 and got[None][1] == 10
    left = simhash.survivors(table(spark, rows))
    assert {r["doc_id"] for r in left.collect()} == {i for i in want if want[i] == i} | {None}


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("chunk", [3, 512])
def test_near_copies_from_80_to_95_percent(spark, chunk):
    r, rows = random.Random(8), []
    for i in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(300)]
        rows.append((10 * i, " ".join(w)))
        for k, edits in enumerate((1, 3, 5, 6, 7, 9, 14), 1):
            v = list(w)
            for at in r.sample(range(300), edits):
                v[at] = f"new{r.randrange(10**9)}"
            rows.append((10 * i + k, " ".join(v)))
    rows += [(9000, "Two words"), (9001, "two  WORDS"), (9002, "two words more"), (9003, ""), (9004, None), (None, rows[0][1])]
    sets, label = {i: brute_shingles(t) for i, t in rows if i is not None}, {}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    near = {i: [k for k in sets if k // 10 == i // 10 and alike(sets[i], sets[k])] for i in sets}
    for i in sorted(sets):
        queue = [] if i in label else [i]
        while queue:
            at = queue.pop()
            if at not in label:
                label[at] = i
                queue += near[at]
    in_reach = [len(sets[i] & sets[k]) / len(sets[i] | sets[k]) for i in sets for k in near[i] if i < k]
    assert sum(0.8 <= j <= 0.95 for j in in_reach) > 100
    docs = table(spark, rows)
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.classes(docs, chunk=chunk).collect()} == label
    assert Counter(x["doc_id"] for x in near_dedup.survivors(docs).collect()) == Counter([i for i in label if label[i] == i] + [None])
    if chunk == 512:
        kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
        assert kept == {i for i in label if label[i] == i} | {None}


def test_fingerprints_of_sets():
    r = random.Random(3)
    for n in (1, 2, 7, 400):
        values = np.array(sorted({r.getrandbits(64) for _ in range(n)}), np.uint64)
        for salt, got in zip(near_dedup.SALTS, near_dedup.fingerprints(values)):
            hashes = [int(x) for x in near_dedup.salted(values, salt)]
            assert int(got) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("filing", ["by_bands", "by_fingerprints"])
def test_near_copies_by_one_filing_alone(spark, monkeypatch, filing):
    """Either filing finds copies of one edited word without the other, and the exact check keeps out what isn't close."""
    other = {"by_bands": "by_fingerprints", "by_fingerprints": "by_bands"}[filing]
    monkeypatch.setattr(near_dedup, other, lambda reps, *_: reps.limit(0).select(F.col("rep").alias("lo"), F.col("rep").alias("hi")))
    r, rows = random.Random(9), []
    for i in range(40):
        w = [f"w{r.randrange(5000)}" for _ in range(400)]
        rows.append((10 * i, " ".join(w)))
        for k, edits in enumerate((1, 1, 90), 1):
            v = list(w)
            for at in r.sample(range(400), edits):
                v[at] = f"new{r.randrange(10**9)}"
            rows.append((10 * i + k, " ".join(v)))
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()}
    assert kept == {i for i, _ in rows if i % 10 in (0, 3)}


def test_components_on_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 200), (5, 5)]
    df = spark.createDataFrame(edges, "lo long, hi long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 130), 200]}


def brute_removals(docs):
    first = {}
    for d, t in sorted(docs):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    out = {}
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, gone) if not x)
        out[d] = (len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def planted(seed, n=150):
    r = random.Random(seed)
    para = lambda k: b"".join(bytes(r.choice(b"abcdefgh \n") for _ in range(r.randint(1, 9))) for _ in range(k))
    shared, docs = [para(r.randint(5, 60)) for _ in range(5)], []
    for i in range(n):
        t = b""
        for _ in range(r.randint(0, 5)):
            k = r.random()
            if k < 0.4:
                t += r.choice(shared)
            elif k < 0.5 and docs:
                t += r.choice(docs)[1][r.randint(0, 30) :]
            elif k < 0.6:
                x = bytearray(r.choice(shared))
                x[r.randrange(len(x))] = r.choice(b"XYZ\x00")
                t += bytes(x)
            elif k < 0.65:
                t += b"a" * r.randint(1, 300)
            else:
                t += para(r.randint(1, 30))
        docs.append((i, t))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, group", [(1, 2048), (2, 3), (3, 1)])
def test_removals(spark, seed, group):
    docs = planted(seed)
    df = table(spark, [(d, t.decode()) for d, t in docs])
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removals(df, group=group).collect()}
    assert got == brute_removals(docs)


def in_one_task(docs, group):
    """The operator's steps on plain batches, with every shuffle replaced by a sort."""

    def ordered(batches, *keys):
        rows = pa.Table.from_batches(batches)
        return rows.take(pc.sort_indices(rows, [(k, "ascending") for k in keys])).combine_chunks().to_batches(max_chunksize=37)

    texts = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([0] * len(docs), pa.int64()), pa.array([t for _, t in docs], pa.binary())], ["doc", "variant", "text"])
    found = list(suffix_dedup.sort_out(ordered(list(suffix_dedup.gather([texts])), "key", "key2", "doc"), group))
    asked = {}
    for row in pa.Table.from_batches(found).to_pylist():
        if row["kind"] != suffix_dedup.SPAN:
            asked.setdefault(row["doc"], []).append({k: row[k] for k in ("kind", "key", "key2", "place", "more")})
    fetched = [(d, 0, t, asked[d]) for d, t in docs if d in asked]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("kind", pa.int32()), *((k, pa.int64()) for k in ("key", "key2", "place", "more"))]))]
    rounds = 0
    if fetched:
        left = list(suffix_dedup.fetch([pa.RecordBatch.from_arrays([pa.array([f[i] for f in fetched], k) for i, k in enumerate(kinds)], ["doc", "variant", "text", "contexts"])]))
        while sum(b.num_rows for b in left):
            decided = pa.Table.from_batches(list(suffix_dedup.decide(ordered(left, "key", "key2", "doc"), group)), left[0].schema)
            found += decided.filter(pc.field("kind") == suffix_dedup.SPAN).to_batches()
            left = decided.filter(pc.field("kind") == suffix_dedup.CROWDED).to_batches()
            rounds += 1
    assert rounds <= 7
    gone = {d: bytearray(len(t)) for d, t in docs}
    for row in pa.Table.from_batches(found).to_pylist():
        if row["kind"] == suffix_dedup.SPAN:
            gone[row["doc"]][row["key2"] : row["place"]] = b"\1" * (row["place"] - row["key2"])
    return {d: sum(x) for d, x in gone.items()}


@pytest.mark.parametrize("group, segment, together, flush", [(2048, 1 << 20, 1 << 17, 1 << 18), (2, 64, 1, 5), (1, 200, 500, 1), (3, 51, 3000, 40)])
def test_cuts_of_work_change_nothing(monkeypatch, group, segment, together, flush):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    docs = planted(group + segment, 80)
    assert in_one_task(docs, group) == {d: x[1] for d, x in brute_removals(docs).items()}


def test_removals_on_edges(spark):
    long = "é" * 40 + "z"
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (5, long), (6, long), (None, long), (7, long + "q"), (7, long + "q"), (8, "a" * 3_000_000), (9, "a" * 60)]
    got = [tuple(r)[:4] for r in suffix_dedup.removals(table(spark, rows)).collect()]
    want = [(1, 0, 0, 0), (2, 0, 0, 0), (3, 49, 0, 0), (4, 49, 0, 0), (5, 81, 0, 0), (6, 81, 81, 1), (None, 81, 0, 0), (7, 82, 81, 1), (7, 82, 81, 1), (8, 3_000_000, 0, 0), (9, 60, 60, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_ids_of_unlike_texts(spark):
    r = random.Random(3)
    p, q = ("".join(r.choice("abcdefgh ") for _ in range(104)) for _ in range(2))
    got = Counter(tuple(x) for x in suffix_dedup.removals(table(spark, [(1, p), (2, p), (2, q), (2, q + p), (3, q)])).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([(1, 104, 0, 0, sha(p)), (2, 104, 104, 1, sha("")), (2, 104, 0, 0, sha(q)), (2, 208, 104, 1, sha(q)), (3, 104, 104, 1, sha(""))])


def test_runs_of_one_byte_or_line_are_folded():
    r = random.Random(7)
    line = "".join(r.choice("abcdefgh ") for _ in range(60)).encode()
    docs = [(3, b"a" * 4000), (1, b"b" * 70 + b"a" * 60), (4, line * 50 + b"a" * 300), (2, line * 40), (5, b"ab" * 500), (6, b"xab" + b"ab" * 90 + line[:55])]
    assert in_one_task(docs, 2048) == {d: x[1] for d, x in brute_removals(docs).items()}
    big = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([b"a" * 20_000_000 + b"ab" * 5_000_000], pa.binary())], ["doc", "variant", "text"])
    found = list(suffix_dedup.gather([big]))
    assert sum(b.num_rows for b in found) < 1000


def test_common_prefix_groups():
    r = random.Random(8)
    for length in (1, 2, 5, 50):
        symbols = np.array([r.randint(0, 2) for _ in range(300)] + [0])
        order = suffix_dedup.suffix_order(symbols, length)
        new = suffix_dedup.equal_groups(symbols, order, length)
        rows = [tuple(np.roll(symbols, -i)[:length]) for i in order]
        assert rows == sorted(rows)
        assert new.tolist() == [True] + [a != b for a, b in zip(rows, rows[1:])]


def test_empty_tables(spark):
    none = table(spark, EDGES).limit(0)
    assert exact_dedup.decisions(none).count() == simhash.classes(none).count() == suffix_dedup.removals(none).count() == 0
