"""Sharding, mixing, top-k and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import exact_dedup, langid, mixing, queries, ranks, sharding, topk
from quarry.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot_ int, score_ int"  # the last columns clash with operators' own names


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 0, 0) for i, t, s in rows], SCHEMA).repartition(3)


def corpus(seed, n=900):
    r = random.Random(seed)
    rows = [(i, r.choice(["", "text é", "more text " * r.randint(1, 5)]), r.choice(["src0"] * 5 + ["src1", "src2", "other", None])) for i in range(n)]
    return rows + [(3, "dup", "src1"), (3, "dup", "src1"), (None, None, None)]


def brute_ranks(rows, seed, name):
    groups = defaultdict(list)
    for row in rows:
        key = hashlib.md5(f"{seed}:{'null' if row[0] is None else row[0]}".encode()).hexdigest()
        groups[name(row[2])].append((key, row))
    return {s: sorted(g, key=lambda x: (x[0], x[1][0] or 0)) for s, g in groups.items()}


@pytest.mark.parametrize("range_rows", [4096, 1])
def test_shards(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ranks, "RANGE_ROWS", range_rows)
    rows = corpus(1)
    got = sharding.shards(table(spark, rows)).collect()
    line = []
    for s, g in brute_ranks(rows, "shard", lambda s: "n" if s is None else "s" + s).items():
        line += [((2 * k + 1) / (2 * len(g)), s, key, row) for k, (key, row) in enumerate(g)]
    line.sort(key=lambda x: (x[0], x[1], x[2], x[3][0] or 0))
    n, want = len(rows), Counter()
    for pos, (_, _, _, (i, t, _)) in enumerate(line):
        shard = pos * 24 // n
        want[i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", shard, pos - -(-shard * n // 24), None] += 1
    assert Counter((x["doc_id"], x["size"], x["text_crc32"], x["law"], x["shard"], x["slot"], x["grown_shard"]) for x in got) == want
    counts = Counter(x["shard"] for x in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for source in ("src0", "src1", None):
        own = Counter(x["shard"] for x in got if x["source"] == source)
        assert max(own[k] for k in range(24)) - min(own[k] for k in range(24)) <= 4


def test_sources_of_one_row_spread_over_ranges(spark):
    rows = [(i, "text", f"https://{i}") for i in range(2000)]
    scratch = Scratch(spark, "test")
    docs = table(spark, rows).withColumn("fraction", sharding.F.lit(0.5))
    placed = ranks.add_position(docs, [sharding.F.col("fraction"), sharding.F.col("source")], "pos", scratch)
    assert [x["source"] for x in placed.orderBy("pos").collect()] == sorted(x[2] for x in rows)
    ranges = spark.read.parquet(f"{scratch.path}/001-pos").groupBy("range_").count().collect()
    assert len(ranges) == 4 and max(x["count"] for x in ranges) < 1000
    assert Counter(x["shard"] for x in sharding.shards(table(spark, rows)).collect()).most_common()[0][1] <= 84


def test_few_and_no_rows_in_shards(spark):
    few = sharding.shards(table(spark, [(1, "a", "s"), (2, None, None)])).collect()
    assert sorted((x["size"], x["slot"]) for x in few) == [(8, 0), (9, 0)]
    none = table(spark, []) if False else table(spark, [(1, "a", "s")]).limit(0)
    assert sharding.shards(none).count() == mixing.add_slots(none).count() == 0


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}, mixing.TARGETS])
def test_schedule_stays_within_one_block(parts):
    period, had = sum(parts.values()), Counter()
    plan = mixing.schedule(parts)
    assert sorted(t for _, _, t in plan) == list(range(period))
    for s, i, t in plan:
        had[s] += 1
        assert had[s] == i + 1
        for q, n in parts.items():
            assert abs(had[q] * period - n * (t + 1)) < period
    assert had == Counter(parts)


def test_mix(spark):
    rows = corpus(2)
    parts = {"src0": 3, "src1": 2, "rest": 1}
    got = mixing.add_slots(table(spark, rows).drop("slot_"), targets=parts, block_rows=4).collect()
    groups = brute_ranks(rows, "mix", lambda s: s if s in parts else "rest")
    at = {(s, i): t for s, i, t in mixing.schedule(parts)}
    want = Counter()
    for s, g in groups.items():
        for k, (_, row) in enumerate(g):
            block = k // 4
            want[row[0], s, block + 1, block // parts[s] * 6 + at[s, block % parts[s]], k % 4] += 1
    key = lambda x: (x["doc_id"], x["stratum_"], x["block_"], x["slot_"], x["in_block_"])
    assert Counter(map(key, got)) == want
    docs = table(spark, rows)
    line = mixing.mixed(docs, targets=parts, block_rows=4)
    assert line.columns == docs.columns
    slots = defaultdict(list)
    for x in got:
        slots[x["doc_id"]].append((x["slot_"], x["in_block_"]))
    order = [min(slots[x["doc_id"]]) for x in line.collect() if x["doc_id"] not in (3, None)]
    assert order == sorted(order) and line.count() == len(rows)
    with pytest.raises(ValueError):
        mixing.add_slots(docs, targets={"a": 0})


def brute_top(rows, every, k):
    vectors = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for i, q in vectors:
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "RUN", 16)
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=24) * r.lognormal()).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 24) for i in range(30)] + [(2000, None), (2010, [float("nan")] * 24), (2020, [None] + [1.0] * 23), (2030, [float("inf")] * 24), (None, [1.0] * 24), (2040, []), (2050, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(4)
    got = {tuple(x) for x in topk.top_k(df, every=10, k=10).collect()}
    assert got == brute_top(rows, 10, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def test_ranges_that_cannot_reach_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    read = []
    own = topk.Scratch.put
    monkeypatch.setattr(topk.Scratch, "put", lambda self, df, name, by=None: read.append(name) or own(self, df, name, by))
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=8) * (100 if i % 10 == 0 else 0.01)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = set()
    vectors = {i: [int(np.floor(1024 * c)) for c in v] for i, v in rows}
    for i in range(0, 200, 20):
        scores = sorted((-sum(a * b for a, b in zip(vectors[i], v)), j) for j, v in vectors.items() if j != i)
        want |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:2], 1)}
    assert {tuple(x) for x in topk.top_k(df, every=20, k=2).collect()} == want
    assert read.count("head") >= 3
    flat = spark.createDataFrame([(i, [1.0 if i < 40 else 1e-3]) for i in range(100)], "vec_id long, embedding array<double>")
    read.clear()
    assert topk.top_k(flat, every=50, k=3).count() == 6 and "rest" in read


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9]), (7, [1e9, 2e9]), (8, [-1e9, -1e9])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(df).orderBy("rank").collect()] == [(0, 1, 7, 2**63 - 1), (0, 2, 8, -(2**63))]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.top_k(df).collect()] == [(0, 1, 7, 1024 * 2048)]


def brute_mix(rows, parts, block_rows=32):
    """doc_id -> (slot, place): block after block by the earliest deadline among what is released, slot by slot."""
    queues = brute_ranks([(i, None, s) for i, s in rows], "mix", lambda s: s if s in parts and s != "rest" else "rest")
    period, out, slot = sum(parts.values()), {}, 0
    given = dict.fromkeys(parts, 0)
    while len(out) < len(rows):
        due = []
        for s, w in parts.items():
            if given[s] * period // w <= slot:  # released: block n + 1 may start at n / rate
                due.append((-(-(given[s] + 1) * period // w), s))
        s = min(due)[1]
        for place, (_, row) in enumerate(queues.get(s, [])[given[s] * block_rows : (given[s] + 1) * block_rows]):
            out[row[0]] = (slot, place)
        given[s] += 1
        slot += 1
    return out


def near_components(texts):
    """doc_id -> smallest doc_id reachable over five-word Jaccard 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    holders = defaultdict(list)
    for i, x in sets.items():
        for g in x:
            holders[g].append(i)
    common = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    label = {i: i for i in texts}
    links = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def tokenizer():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_, special_tokens={})


def expected_output(texts, sources, parts):
    """What the last four stages leave of texts (doc_id -> text), by brute force."""
    last = {}
    for i in sorted(texts):
        last[texts[i]] = i
    left = {i: t for t, i in last.items()}
    label = near_components(left)
    left = {i: t for i, t in left.items() if label[i] == i}
    places, encoder, out = brute_mix([(i, sources[i]) for i in left], parts), tokenizer(), {}
    for i, t in left.items():
        ids = encoder.encode_ordinary(t)
        out[i] = (*places[i], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), np.array(ids, "<u4").tobytes())
    return out


def told(row):
    return (row["mix_slot"], row["mix_place"], row["n_tokens"], row["ids_sha256"], row["decoded_sha256"], bytes(row["token_ids"]))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Languages that differ plainly, and texts in neither; copies, near copies and sources of every weight."""
    r = random.Random(21)
    letters = [(c, v, d) for c in "thswr" for v in "aeo" for d in "bdl"]
    words = {"en": [c + v + d + v for c, v, d in letters], "de": [v + d + c for c, v, d in letters]}
    rows = []
    for i in range(700):
        lang = r.choice(["en", "de"])
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(r.randint(20, 90))), lang if r.random() < 0.8 else None, r.choice(["src0"] * 4 + [f"src{k}" for k in range(1, 20)] + ["other", None])))
    for i in range(700, 760):
        rows.append((i, r.choice(rows[:700])[1], None, "src1"))
    for i in range(760, 820):
        w = r.choice(rows[:700])[1].split()
        w[r.randrange(len(w))] = "lala"
        rows.append((i, " ".join(w), None, "src2"))
    odd = [(900, "xqxq jxjx " * 30, None, "src0"), (901, None, None, "src0"), (902, "12 !!", None, None), (903, "ЖЩЮЯ ЪЫЭ " * 30, None, "src3")]
    spark.createDataFrame([(*x, 1) for x in rows + odd], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected_output({x[0]: x[1] for x in rows}, {x[0]: x[3] for x in rows}, mixing.TARGETS)
    assert {x["doc_id"] for x in got} == set(want)
    assert Counter(told(x)[k] == want[x["doc_id"]][k] for x in got for k in (0, 1)) == Counter({True: 2 * len(want)})
    assert {x["doc_id"]: told(x) for x in got} == want and len(got) == len(want) < len(rows)


def test_pipeline_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {x["doc_id"]: x for x in docs.collect()}
    models = langid.fit(docs)
    ids = sorted(rows)
    _, _, _, rejected = models.predict([rows[i]["text"] for i in ids])
    left = {i: rows[i]["text"] for i, gone in zip(ids, rejected) if not gone}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {x["doc_id"]: told(x) for x in got} == expected_output(left, {i: x["source"] for i, x in rows.items()}, mixing.TARGETS)


def test_stages_on_edges(spark):
    rows = [(1, None, None), (2, "", "src0"), (3, "the same text in words of a tongue", "src1"), (4, "the same text in words of a tongue", "x"), (None, "a text that has no number at all", None), (5, "words " * 60_000, "src0")]
    docs, columns = table(spark, rows), None
    for name, stage in corpus_pipeline.STAGES[1:]:
        columns = docs.columns
        docs = stage(spark, docs, "")
        if name != "byte-level BPE":
            assert docs.columns == columns
    assert sorted(x["doc_id"] or 0 for x in docs.collect()) == [0, 2, 4, 5]
    empty = table(spark, rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names and len(corpus_pipeline.STAGES) == 5
    assert exact_dedup and queries
