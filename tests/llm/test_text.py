"""Language ID, BPE, secret and license scans against references and brute force."""

import base64
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

from quarry.llm import bpe, langid, licenses, queries, secrets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, words array<int>, line string, text_ string, score_ int"  # clashing names at the end


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, [1], "l", "t", 1) for i, t, lang in rows], SCHEMA).repartition(3)


EDGES = [(1, None, None), (2, "", "en"), (3, "\n 12 !", None), (4, "plain text", None), (4, "plain text", None), (None, "another", None), (5, "word é " * 100_000, None)]


def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def encoders():
    raw = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Codec(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    own, library = encoders()
    r = random.Random(1)
    bits = ["a", " ", "\x1c", "\x85", " ", "​", " ", "1", "²", "é", "\n", "\t", "'s", "'S", "<|endoftext|>", "😀", "א", "﻿", "漢", "\x00", "!", "　", "é", "thion"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "a" * 20_000, "ab" * 9_999 + "c", " " * 5000, "x y" * 300_000]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
        told = own.digest(t, True)
        assert told[:3] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert memoryview(told[3]).cast("I").tolist() == ids


def test_bpe_of_a_huge_piece():
    """A piece of a hundred thousand letters gives the library's ids, in packed arrays."""
    own, library = encoders()
    r = random.Random(2)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(100_000))
    tracemalloc.start()
    ids = own.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.decode(ids) == text.encode() and peak < 12_000_000
    assert ids == library.encode_ordinary(text)


def test_bpe_forgets_old_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_PIECES", 3)
    own, library = encoders()
    text = "one two three four five one two six seven eight one"
    assert own.encode(text) == library.encode_ordinary(text)
    assert len(own.pieces) <= 3 and len(own.pieces.old) <= 3


def test_merge_takes_leftmost_of_least_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 300, b"ab": 301, b"aaa": 302}
    assert bpe.merge(b"aaaa", ranks) == [300, 300]
    assert bpe.merge(b"aaaaa", ranks) == [300, 302]
    assert bpe.merge(b"aab", ranks) == [300, 98]


def test_bpe_query(spark):
    _, library = encoders()
    docs = table(spark, EDGES)
    got = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang"), with_ids=True).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == Counter((i, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in EDGES)
    whole = queries.op4_bpe(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).collect()}
    for r in whole:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def brute_kneser_ney(texts, order, alphabet):
    """p(symbol | context) by the textbook recursion over dictionaries."""
    padded = [" " * langid.ORDER + t for t in texts]
    grams = {n: Counter() for n in range(1, order + 1)}
    for t in padded:
        for i in range(langid.ORDER, len(t)):
            grams[order][t[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    discount = {}
    for n, c in grams.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = one / (one + 2 * two) if one and two else 0.5

    def p(symbol, context):
        n = len(context) + 1
        lower = p(symbol, context[1:]) if n > 1 else 1 / alphabet
        own = [v for g, v in grams[n].items() if g[:-1] == context]
        if not own:
            return lower
        return max(grams[n][context + symbol] - discount[n], 0) / sum(own) + discount[n] * len(own) / sum(own) * lower

    return p


def test_kneser_ney_equals_the_recursion():
    texts = {"a": ["the theme of the thesis", "then there", "a cat"], "b": ["zur zeit", "das zelt zu", "der"]}
    models = langid.Models(texts)
    for j, lang in enumerate(models.langs):
        p = brute_kneser_ney([t.lower() for t in texts[lang]], 4, langid.ALPHABET)
        for probe in ("the zebra", "zeit q", "x"):
            x, event = langid.padded([langid.symbols(probe.lower())])
            got = models.log_probability(x, event)[:, j]
            line = " " * 4 + probe
            want = [math.log2(p(line[i], line[i - 3 : i])) for i in range(4, len(line))]
            assert np.allclose(got, want, atol=1e-4)
    for a, b in zip(models.levels[0].grams, models.levels[0].grams[1:]):
        assert a < b


def test_language_of_held_out_documents(spark):
    rows = queries.op1_langid(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in queries.documents(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    known = [r for r in held if docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in known) >= 0.99 * len(known)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["rejected"] for r in known)


def test_language_edges(spark):
    r = random.Random(3)
    fit = [(100 + i, " ".join(r.choice(["the", "cat", "sat", "on", "mat"]) for _ in range(30)), "en") for i in range(60)] + [(300 + i, " ".join(r.choice(["der", "hund", "und", "zwei"]) for _ in range(30)), "de") for i in range(60)]
    docs = table(spark, EDGES + fit)
    models = langid.fit(docs)
    assert models.langs == ["de", "en"]
    got = langid.predict(docs.filter("doc_id < 100 OR doc_id IS NULL"), models, ["doc_id"]).collect()
    told = {x["doc_id"]: x for x in got}
    assert [told[i]["lang_pred_"] for i in (1, 2, 3)] == ["und"] * 3 and all(told[i]["rejected_"] and told[i]["score_"] == 0 for i in (1, 2, 3))
    assert told[4]["lang_pred_"] in ("de", "en") and len(got) == len(EDGES)
    langs, _, _, rejected = models.predict(["the cat sat on the mat", "der hund und"])
    assert langs == ["en", "de"] and not rejected.any()
    left = langid.accepted(docs)
    assert left.columns == docs.columns and {100, 300} <= {x["doc_id"] for x in left.collect()}
    unlabelled = table(spark, EDGES).withColumn("lang", queries.F.lit(None).cast("string"))
    assert {x["lang_pred_"] for x in langid.predict(unlabelled, langid.fit(unlabelled), ["doc_id"]).collect()} == {"und"}


def test_rejection(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    models = langid.fit(docs)
    en, fr = (docs.filter(f"lang = '{x}' AND n_chars BETWEEN 300 AND 600").first()["text"] for x in ("en", "fr"))
    _, _, _, rejected = models.predict([en, fr, f"{en} {fr}", "xqzjk vwxq jjqz kkxw zzqq " * 20, "ЖЩЮЯ ЪЫЭ ЖЩЮЯЪЫЭ " * 20])
    assert rejected.tolist() == [False, False, False, True, True]


def test_runs_of_a_long_text_add_up(monkeypatch):
    models = langid.Models({"en": ["the cat sat on the mat"] * 12, "de": ["der hund und die katze"] * 12})
    r = random.Random(1)
    texts = ["the cat " * 1000, "der", " 12, a. " * 90, None, "".join(r.choice(["the", " ", "..", "é", "katze", "1 "]) for _ in range(5000))]
    size, cost = models.sums(texts)
    score = models.predict(texts)[1]
    for run in (64, 7, 1):
        monkeypatch.setattr(langid, "RUN", run)
        sizes, costs = models.sums(texts)
        assert sizes.tolist() == size.tolist() and np.allclose(costs, cost, rtol=1e-12) and np.allclose(models.predict(texts)[1], score, rtol=1e-9)


def test_languages_of_long_texts_are_learned(spark):
    r = random.Random(6)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(["the", "cat", "sat", "on", "mat"], 40), "en") for i in range(40)] + [(100 + i, say(["der", "hund", "ünd", "zwei"], 30_000), "de") for i in range(8)]
    docs = table(spark, rows)
    models = langid.fit(docs, train_pieces=60)
    assert models.langs == ["de", "en"]
    assert models.predict(["der hund ünd zwei", "the cat sat on"])[0] == ["de", "en"]


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(text):
    found = []
    for i, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in pattern.finditer(text):
            if len(m[1] if kind == "assign" else m[0]) >= (12, 18, 16)[i]:
                found.append((m.start(), i, m.end(), f"{kind}:{m.start()}:{m.end()}"))
    return [x[3] for x in sorted(found)]


def brute_entropy(s):
    return max((sum(-c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19)), default=0)


def test_secrets(spark):
    r = random.Random(3)
    bits = ["password", "=", "secret", ": ", "token", '"', "'", "AKIA", "ABCD0123EFGH4567", " ", "deadbeef00112233", "é", "😀", "x", "api_key", "ApiKey", " = ", "12345", "Zz9", "\n", ".", "k9Qx7Lm2Vt4Rw8Zp3Ns6"]
    rows = EDGES + [(1000 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 60))), None) for i in range(800)] + [(20, "deadbeef00112233 " * 3000, None)]
    got = Counter()
    for x in secrets.report(table(spark, rows)).collect():
        base = [s for s in x["spans"].split(",") if s and not s.startswith("entropy")]
        assert x["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x["n_assign"], x["n_access"], x["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        got[x["doc_id"], ",".join(base)] += 1
    assert got == Counter((i, ",".join(brute_secrets(t or ""))) for i, t, _ in rows)


def test_entropy_windows_and_allow_list(spark):
    r = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    found = ["".join(r.choice(chars[: r.choice((3, 10, 66))]) for _ in range(r.randint(1, 90))) for _ in range(200)]
    df = spark.createDataFrame([(f,) for f in found], "found string")
    for x in df.select("found", secrets.window_entropy(queries.F.col("found")).alias("h")).collect():
        assert abs(x["h"] - brute_entropy(x["found"])) < 1e-9
    texts = {"k9Qx7Lm2Vt4Rw8Zp3Ns6": True, "internationalizationally": False, "some/long/path-to-a_file": False, "0123456789012345678901": False, "your_token_k9Qx7Lm2Vt4Rw8Zp3Ns6": False, "e3b0c44298fc1c149afbf4c8996fb924": True}
    docs = table(spark, [(i, t, None) for i, t in enumerate(texts)])
    told = {x["doc_id"]: bool(x["n_entropy"]) for x in secrets.report(docs).collect()}
    assert told == dict(enumerate(texts.values()))


def brute_candidates(text):
    """Spans of candidates of which a part between equal signs is secret, by windows counted anew each."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        for part in re.split("=+", m[0]):
            slug = all(re.fullmatch(r"[A-Za-z]?[a-z]*", w) for w in re.split(r"[-_/+]+", part))
            word = re.search(r"example|placeholder|changeme|your[_-]?(key|token|secret)", part, re.I)
            least = 3.0 if re.fullmatch("[0-9a-f]*|[0-9A-F]*", part) else 3.7
            if not (slug or word or re.fullmatch(r"[A-Z]*|[0-9+/_-]*", part)) and brute_entropy(part) >= least:
                out.append((m.start(), m.end()))
                break
    return out


def test_candidates_against_brute_force(spark):
    r = random.Random(11)
    bits = ["=", "-", "_", "/", "word", "Word", "WORD", "example", "YOUR_KEY", "0000000", "deadbeef", "k9Qx7Lm2", "Zt4Rw8Zp", " ", "=="]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(500)]
    texts += ["example_key=k9Qx7Lm2Vt4Rw8Zp3Ns6", "AAAAAAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZWQyNTUxOQ"]
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts += ["a-" * 5000 + "1Q", "a-" * 500_000 + "1Q", "aB1" * 3000, "".join(r.choice(chars) for _ in range(10_000)), "ab1" * 333_000 + "k9Qx7Lm2Vt4Rw8Zp3Ns6", "ab1" * 80 + "k9Qx7Lm2Vt4Rw8Zp3Ns6" + "1ba" * 200]
    got = {x["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("entropy")] for x in secrets.report(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {i: brute_candidates(t) for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(500, len(texts))] == [1, 1, 0, 0, 0, 1, 1, 1]


def test_time_grows_with_a_candidate(spark):
    """A candidate of 1.6 million characters of base64, and 200,000 matches in one text."""
    r = random.Random(12)
    long = "".join(r.choice("GHIJKLMNghijklmn01234567") for _ in range(1_600_000))
    many = "deadbeef00112233 " * 200_000
    got = {x["doc_id"]: x for x in secrets.report(table(spark, [(1, long, None), (2, many, None)])).collect()}
    assert got[1]["spans"] == "entropy:0:1600000" and got[2]["n_hex"] == 200_000 and got[2]["spans"].endswith("hex:3399983:3399999")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def test_license_phrases(spark):
    r = random.Random(6)
    bits = ["MIT", "License", "license", " ", ", ", "apache", "general", "public", "é", "2.0", "released under the", "Licensed under the Apache License, Version 2.0", "\n", "mit license mit license"]
    rows = EDGES + [(1000 + i, " ".join(r.choice(bits) for _ in range(r.randint(0, 30))), None) for i in range(600)]
    want = Counter()
    for i, t, _ in rows:
        w, places = brute_words(t or ""), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        want[i, len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = licenses.report(table(spark, rows)).collect()
    assert Counter(tuple(x)[:6] for x in got) == want
    assert all(set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) for x in got) and all(0 <= x["score"] <= 1 for x in got)


def test_license_spans(spark):
    filler = " ".join(f"word{i}" for i in range(50))
    bsd = licenses.TEMPLATES[-1][1]
    edited = bsd.replace("source and", "source code and also").replace("permitted", "allowed")
    rows = [(1, f"{filler} {bsd} {filler}", None), (2, f"{filler} {edited} {filler}", None), (3, f"{filler} {bsd[:30]} {filler}", None), (4, "Licensed under CC BY-NC 4.0.\n" + filler, None), (5, filler, None), (6, f"{bsd} {filler} {bsd}", None)]
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licenses.report(table(spark, rows)).collect()}
    assert got[1] == ("bsd", 1.0) and got[2][0] == "bsd" and 0.6 <= got[2][1] < 1 and got[3] == ("", 0.0)
    assert got[4] == ("cc-by-nc", 1.0) and got[5] == ("", 0.0) and got[6] == ("bsd", 1.0)
    docs = table(spark, rows).select("doc_id", licenses.words(queries.F.col("text")).alias("words"))
    spans = {(x["doc_id"], x["first"], x["last"]) for x in licenses.spans(docs, ["doc_id"]).collect()}
    size = len(brute_words(bsd))
    assert (1, 50, 50 + size - 1) in spans and (6, 0, size - 1) in spans


def brute_bands(words, template):
    """The best share of a template's grams that hits within a band of diagonals cover."""
    t = brute_words(template)
    size, places, votes = len(t) - 2, {}, {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    for j in range(size):
        for i in places.get(tuple(t[j : j + 3]), ()):
            votes.setdefault(i - j, set()).add(j)
    width = max(1, int((licenses.STRETCH - 1) * len(t)))
    return max((len(set().union(*(votes.get(d, ()) for d in range(a, a + width + 1)))) / size for a in votes), default=0)


def test_repeated_notices(spark):
    r, rows, copies = random.Random(4), [], []
    for n, (_, text) in enumerate(licenses.TEMPLATES):
        for k in (1, 2, 50):
            for gap in ("\n", " one two three "):
                rows.append((len(rows), gap.join([text] * k), None))
                copies.append((n, k, True))
        for k in (1, 2, 50):
            w = text.split()
            if len(w) > 15:
                w.insert(len(w) // 2, "indeed")
                w[-2:-2] = ["quite", "so"]
            rows.append((len(rows), "\n".join([" ".join(w)] * k), None))
            copies.append((n, k, False))
    for _ in range(100):
        w = [x for _ in range(r.randint(1, 6)) for x in r.choice(licenses.TEMPLATES)[1].split()[r.randint(0, 4) : r.randint(3, 30)] + ["w"] * r.randint(0, 3)]
        rows.append((len(rows), " ".join(w), None))
    got = {x["doc_id"]: x for x in licenses.report(table(spark, rows)).collect()}
    split = table(spark, rows).select("doc_id", licenses.words(queries.F.col("text")).alias("words"))
    found = Counter((x["doc_id"], x["template"]) for x in licenses.spans(split, ["doc_id"]).collect())
    for i, text, _ in rows:
        words = brute_words(text)
        covered = [(label, brute_bands(words, t)) for label, t in licenses.TEMPLATES]
        labels = {label for label, c in covered if c >= licenses.COVER} | set(filter(None, got[i]["base_labels"].split(",")))
        best = max([c for _, c in covered if c >= licenses.COVER], default=0)
        assert set(filter(None, got[i]["labels"].split(","))) == labels and got[i]["score"] == max(best, licenses.PHRASE_SCORE * (got[i]["n_base"] > 0))
        if i < len(copies):
            n, k, whole = copies[i]
            assert licenses.TEMPLATES[n][0] in labels and found[i, n] == k and (got[i]["score"] == 1 or not whole)


def by_pattern(text):
    """Words by the contract's pattern as it stands."""
    return queries.F.regexp_extract_all(queries.F.lower(text), queries.F.lit(licenses.WORD), queries.F.lit(0))


def test_license_words_of_every_character(spark):
    codes = [c for c in range(0x2100) if not 0xD800 <= c < 0xE000] + [0x212A, 0x2028, 0x3000, 0xFEFF, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    rows = [(c, f"{chr(c)}Ab{chr(c)}{chr(c)}9é{chr(c)}", None) for c in codes]
    text = queries.F.col("text")
    got = table(spark, rows).select("doc_id", licenses.words(text).alias("own"), by_pattern(text).alias("pattern")).collect()
    assert len(got) == len(rows) and all(x["own"] == x["pattern"] for x in got)
    texts = {i: t for i, t, _ in rows}
    assert all(x["own"] == brute_words(texts[x["doc_id"]]) for x in got if x["doc_id"] < 128)


def test_license_words_cost_a_part_of_the_pattern(spark):
    """Splitting texts is nearly all of the scan's time; by the pattern as it stands it took about four times as long here."""
    text = queries.F.col("text")
    docs = spark.range(64, numPartitions=4).select(queries.F.repeat(queries.F.concat(queries.F.lit("Plain words, écrits in LINES of "), queries.F.col("id"), queries.F.lit(" prose\n")), 4000).alias("text")).cache()

    def seconds(words):
        began = time.perf_counter()
        assert docs.select(queries.F.sum(queries.F.size(words(text)))).first()[0] == 64 * 4000 * 8
        return time.perf_counter() - began

    assert docs.count() == 64
    own, pattern = zip(*[(seconds(licenses.words), seconds(by_pattern)) for _ in range(3)])
    assert min(own) < 0.6 * min(pattern)
    docs.unpersist()


def test_own_templates(spark):
    docs = table(spark, [(1, "a b c d e f", None), (2, None, None)]).select("doc_id", licenses.words(queries.F.col("text")).alias("words"))
    assert [(x["doc_id"], x["label"], x["first"], x["last"]) for x in licenses.spans(docs, ["doc_id"], [("own", "b c d e")]).collect()] == [(1, "own", 1, 4)]


def test_empty_tables(spark):
    none = table(spark, EDGES).limit(0)
    assert secrets.report(none).count() == licenses.report(none).count() == langid.predict(none, langid.fit(none), ["doc_id"]).count() == 0
