"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Text is lower-cased; runs of characters that are not letters become one space. For each learned language, models
of orders 1 to 4 are estimated with Kneser-Ney continuation counts and one discount per order, interpolated down to
a uniform distribution. All languages share one sorted array of 64-bit n-gram hashes per order, with a row of
log-probabilities per language, and one array of context hashes with their interpolation weights; a binary
search finds an n-gram, and what is unseen falls back by its context's weight. The language of the lowest
cross-entropy per character wins. A part of the sample is kept from estimation to calibrate rejection: a text
is rejected if its cross-entropy lies more than REJECT_Z standard deviations above that of its language's own texts,
where the deviation is that of the language whose texts vary most and allows for the text's length, and if it is also
above what texts of the nearest other language have under this one's model, so that texts in two languages stay.

The score is the share of the winner's likelihood in the sum over all languages, as if the text had its cross-entropies
and at most CERTAIN symbols; without that bound every longer text would score 1.

Fitting takes a bounded sample: texts are cut into even pieces of up to PIECE bytes, and TRAIN_PIECES pieces a language in
expectation (MAX_PIECES in all) are drawn by a hash of doc_id and the piece's number, so that every part of every text,
however long, can be drawn. Every whole text is predicted. Texts are scored in runs of RUN characters, each of which starts
from the symbols before it, so that runs add up to what one run gives.

Defined results: a null text, or one without letters, is `und` with score 0 and is rejected; without labelled rows
every text is `und`; a null doc_id is not held out and not learned from; repeated rows get equal results; ties go to
the first language in order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import set_aside
from quarry.llm.scratch import small_batches

ORDER = 4
TRAIN_PIECES, MAX_PIECES, PIECE = 400, 20_000, 4096
REJECT_Z = 8.0
RUN = 1 << 16
CERTAIN = 50
ALPHABET = 4096  # size of the uniform distribution below order 1
STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(text: str, after_letter: bool = False) -> np.ndarray:
    """Letters of a lower-cased text as code points, with one space for each run of others; after_letter: whether a letter stands before it."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[x]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:1] |= after_letter
    return np.where(is_letter, x, SPACE)[keep]


def hashes(x: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 0 to order, the hash of the n symbols that end at each place of x."""
    out, v = [np.zeros(len(x), np.uint64)], x.astype(np.uint64) + np.uint64(1)
    for _ in range(order):
        earlier = np.concatenate((out[0][:1] * 0, out[-1][:-1]))
        out.append(earlier * STEP + v)
    return out


START = np.full(ORDER, SPACE, np.uint32)  # what stands before a text


def padded(parts: list[np.ndarray], before: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All parts, each after the ORDER symbols before it, and which places hold the parts' own."""
    before = before or [START] * len(parts)
    x = np.concatenate([a for b, p in zip(before, parts) for a in (b, p)]) if parts else START
    event = np.concatenate([a for p in parts for a in (np.zeros(ORDER, bool), np.ones(len(p), bool))]) if parts else np.zeros(ORDER, bool)
    return x, event


@dataclass
class Level:
    """One order: sorted n-gram hashes with log2 probabilities, sorted context hashes with log2 weights; a column a language."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in the sorted keys, and which are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def counted(x: np.ndarray, event: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, context, suffix, count) by order from 1: raw counts at the top, below it how many symbols stand before."""
    h, out = hashes(x, order), []
    ends = np.flatnonzero(event)
    grams, first, counts = np.unique(h[order][ends], return_index=True, return_counts=True)
    for n in range(order, 0, -1):
        at = ends[first]
        out.append((grams, h[n - 1][at - 1], h[n - 1][at], counts))
        if n > 1:
            grams, back, counts = np.unique(h[n - 1][at], return_index=True, return_counts=True)
            first = first[back]
    return out[::-1]


class Models:
    """Models of all languages; see the module's text."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        fit, held = {}, {}
        for lang in self.langs:
            parts = [p for p in (symbols(t.lower()) for t in texts[lang]) if len(p)]
            held[lang] = parts[::5] if len(parts) >= 10 else parts
            fit[lang] = [p for i, p in enumerate(parts) if i % 5] if len(parts) >= 10 else parts
        tables = [counted(*padded(fit[lang]), order) for lang in self.langs]
        self.levels: list[Level] = []
        for n in range(order):
            self.levels.append(self.level([t[n] for t in tables], self.levels[-1] if n else None))
        self.calibrate(held)

    def level(self, tables: list, below: Level | None) -> Level:
        k = len(self.langs)
        everything = [np.concatenate([t[i] for t in tables]) if tables else np.zeros(0, np.uint64) for i in range(3)]
        grams, first = np.unique(everything[0], return_index=True)
        context, suffix = everything[1][first], everything[2][first]
        contexts = np.unique(context)
        logp, weight = np.zeros((len(grams), k)), np.zeros((len(contexts), k))
        for j, (own, own_context, _, count) in enumerate(tables):
            ones, twos = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = np.searchsorted(contexts, own_context)
            total, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, None, len(contexts))
            share = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p = np.zeros(len(grams))
            p[np.searchsorted(grams, own)] = np.maximum(count - discount, 0) / total[at]
            lower = np.exp2(below.logp[np.searchsorted(below.grams, suffix), j]) if below else 1 / ALPHABET
            logp[:, j] = np.log2(p + share[np.searchsorted(contexts, context)] * lower)
            weight[:, j] = np.log2(share)
        return Level(grams, logp.astype(np.float32), contexts, weight.astype(np.float32))

    def log_probability(self, x: np.ndarray, event: np.ndarray) -> np.ndarray:
        """log2 probability of each event under each language."""
        h, ends = hashes(x, self.order), np.flatnonzero(event)
        top = self.levels[-1]
        at, hit = find(top.grams, h[self.order][ends])
        out = top.logp[at] if len(top.grams) else np.zeros((len(ends), len(self.langs)), np.float32)
        left = np.flatnonzero(~hit)
        out[left] = 0
        for n in range(self.order, 0, -1):
            if not len(left):
                return out
            level, place = self.levels[n - 1], ends[left]
            at, known = find(level.contexts, h[n - 1][place - 1])
            out[left[known]] += level.weight[at[known]]
            if n == 1:
                out[left] -= np.log2(ALPHABET)
                return out
            below = self.levels[n - 2]
            at, hit = find(below.grams, h[n - 1][place])
            out[left[hit]] += below.logp[at[hit]]
            left = left[~hit]
        return out

    def calibrate(self, held: dict[str, list[np.ndarray]]) -> None:
        k = len(self.langs)
        self.mean, self.spread, self.each, self.foreign = np.zeros(k), np.zeros(k), np.zeros(k), np.full(k, np.inf)
        for j, lang in enumerate(self.langs):
            if not held[lang]:
                continue
            own = [-self.log_probability(*padded([p])).astype(float) for p in held[lang]]
            every = np.concatenate(own)
            self.mean[j], self.each[j] = every[:, j].mean(), np.var(every[:, j])
            self.spread[j] = np.var([v[:, j].mean() for v in own])
            others = np.arange(k) != j
            self.foreign[others] = np.minimum(self.foreign[others], every.mean(axis=0)[others])
        self.spread[:] = self.spread.max(initial=0)
        self.foreign[~np.isfinite(self.foreign)] = 0

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and minus their log2 probability under each language."""
        size, cost = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        parts, before, owner, held = [], [], [], 0

        def flush() -> None:
            nonlocal parts, before, owner, held
            if parts:
                starts = np.cumsum([0, *map(len, parts[:-1])])
                got = -np.add.reduceat(self.log_probability(*padded(parts, before)), starts, axis=0, dtype=np.float64)
                np.add.at(cost, owner, got)
            parts, before, owner, held = [], [], [], 0

        for i, text in enumerate(texts):
            line, last, after_letter = (text or "").lower(), START, False
            for at in range(0, len(line), RUN):
                x = symbols(line[at : at + RUN], after_letter)
                after_letter = line[min(at + RUN, len(line)) - 1].isalpha()
                if len(x):
                    size[i] += len(x)
                    parts.append(x)
                    before.append(last)
                    owner.append(i)
                    held += len(x)
                    last = np.concatenate((last, x))[-ORDER:]
                    if held >= RUN:
                        flush()
        flush()
        return size, cost

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies in bits a symbol, and which texts are rejected."""
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        size, cost = self.sums(texts)
        entropy = cost / np.maximum(size, 1)[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(n), best]
        score = 1 / np.exp2(-(entropy - least[:, None]) * np.minimum(size, CERTAIN)[:, None]).sum(axis=1)
        limit = np.maximum(self.foreign[best], self.mean[best] + REJECT_Z * np.sqrt(self.spread[best] + self.each[best] / np.maximum(size, 1)))
        blank = size == 0
        return ["und" if b else self.langs[i] for i, b in zip(best, blank)], np.where(blank, 0, score), np.where(blank, np.nan, least), blank | (least > limit)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train_pieces: int = TRAIN_PIECES, max_pieces: int = MAX_PIECES, piece: int = PIECE) -> Models:
    """Models from a sample of the labelled documents that are not held out; its expected size is bounded by the parameters."""
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / piece)).cast("int")
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text", pieces.alias("n"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return Models({})
    each = min(train_pieces, max(1, max_pieces // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1 << 30, (each << 30) // n + 1))])
    drawn = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), i), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    edge = lambda i: F.floor(F.length("text") * i.cast("long") / F.col("n")).cast("int")
    sample = labelled.select("doc_id", "lang", F.explode(F.transform(drawn, lambda i: F.struct(i.alias("i"), F.substring("text", edge(i) + 1, edge(i + 1) - edge(i)).alias("text")))).alias("piece")).select("doc_id", "lang", "piece.*").collect()
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(sample, key=lambda r: (r["doc_id"], r["i"], r["text"] or "")):
        texts[r["lang"]].append(r["text"] or "")
    return Models({lang: found for lang, found in texts.items() if any(len(symbols(t.lower())) for t in found)})


def predict(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """The columns in keep, then lang_pred_, score_, entropy_ and rejected_."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(*keep, F.col("text").alias("text_"))
    names = [*keep, "lang_pred_", "score_", "entropy_", "rejected_"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = [None if x is None else x.decode("utf-8", "replace") for x in b.column(len(keep)).cast(pa.binary()).to_pylist()]
            langs, score, entropy, rejected = own.predict(texts)
            told = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *told], names)

    return rows.mapInArrow(run, f"{kinds}lang_pred_ string, score_ double, entropy_ double, rejected_ boolean")


def accepted(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """The rows whose language is known, with all their columns."""
    safe, named = set_aside(docs, {"text_", "lang_pred_", "score_", "entropy_", "rejected_"})
    return named(predict(safe, models or fit(docs), safe.columns).filter("NOT rejected_").select(*safe.columns))
