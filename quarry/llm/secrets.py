"""Secret scan (built-in functions only): patterns with exact positions, and sliding-window entropy.

Three base kinds are found by regular expressions: keyword assignments, access keys and hex runs. Beside them,
candidate strings (runs of 20 or more characters of tokens and base64) are cut at equal signs, so that a name and its
value are judged apart, and each part of WINDOW characters or more is judged by Shannon entropy: a window of WINDOW
characters slides over it, with a count for each character. The character that leaves lowers its count by one, the one
that enters raises its own, and the sum of c * log2 c changes by these two only. A candidate is reported as `entropy` if
a part's best window reaches the threshold of the part's character class (hex, or base64) and the allow-list doesn't
know the part: plain words and slugs, capitals, plain numbers, and placeholders.

Long candidates are folded in chunks that hand over their last WINDOW - 1 characters, and positions are running sums in
blocks of sqrt(n): time grows with a candidate's length, not with its square, and no pattern repeats a group, which
would need stack for each repetition.

Positions are code points, end exclusive. Spark gives matches but not where they stand; cutting the text at the same
matches gives the lengths between. No shuffle takes place.

Defined results: a null text counts as empty; overlapping spans of different kinds are all reported; repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters in all; a shorter run has no longer one inside
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]?(key|token|secret)"
WINDOW, CHUNK = 20, 256
THRESHOLDS = {"hex": 3.0, "base64": 3.7}  # bits; a window of 20 has at most 4 and 4.32
GAIN = [0.0, *[(n + 1) * math.log2(n + 1) - n * math.log2(n) for n in range(1, WINDOW + 1)]]  # what c * log2 c gains from n to n + 1


def add_spans(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds `name`, an array of (start, end, found) for the pattern's leftmost non-overlapping matches in `text`."""
    m, steps = f"{name}_m", f"{name}_s"
    df = df.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    gaps = F.when(F.size(m) > 0, F.transform(F.split("text", pattern, -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(steps, F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda a, g: F.struct(g.alias("gap"), F.length(a).alias("size"), a.alias("found"))))
    ints = F.array().cast("array<int>")

    # a fold copies its state in each step, so states hold a block's starts at most, as plain numbers
    def in_blocks(all_: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(all_))).cast("int"), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / w).cast("int")), lambda k: F.slice(all_, k * w + 1, w)))

    def ends(blocks: Column) -> Column:
        total = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + x["size"])
        step = lambda s, block: let(s["at"] + total(block), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out")))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), ints.alias("out")), step, lambda s: F.concat(F.array(F.lit(0)), s["out"]))

    def place(block: Column, at: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out"))
        starts = F.aggregate(block, F.struct(at.alias("at"), ints.alias("out")), step, lambda s: s["out"])
        return F.zip_with(starts, block, lambda i, x: F.struct(i.alias("start"), (i + x["size"]).alias("end"), x["found"].alias("found")))

    placed = let(F.col(steps), lambda all_: let(in_blocks(all_), lambda blocks: F.flatten(F.zip_with(blocks, F.slice(ends(blocks), F.lit(1), F.size(blocks)), place))))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, found: STRING>>)")
    return df.withColumn(name, F.when(F.size(steps) > 0, placed).otherwise(none)).drop(m, steps)


def best_window(s: Column) -> Column:
    """The largest entropy of a window of WINDOW characters of a short ASCII string; 0 if it has none.

    Counts are characters of a string of 128, one a code: `0` + n. A move changes one of them."""
    chars = F.split(s, "")
    moves = F.zip_with(chars, F.concat(F.array_repeat(F.lit(""), WINDOW), chars), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    gain = F.array(*map(F.lit, GAIN))
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - 48
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 48), code + 1, F.lit(1))

    def leave(s: Column, old: Column) -> Column:
        code = F.ascii(old)
        return let(count(s["counts"], code) - 1, lambda n: F.struct(put(s["counts"], code, n).alias("counts"), (s["sum"] - F.get(gain, n)).alias("sum")))

    def enter(s: Column, new: Column) -> Column:
        code = F.ascii(new)
        return let(count(s["counts"], code), lambda n: F.struct(put(s["counts"], code, n + 1).alias("counts"), (s["sum"] + F.get(gain, n)).alias("sum")))

    def step(s: Column, m: Column) -> Column:
        kept = F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"))
        entropy = lambda x: math.log2(WINDOW) - x["sum"] / WINDOW
        moved = let(
            F.when(m["old"] == "", kept).otherwise(leave(s, m["old"])),
            lambda a: let(
                enter(a, m["new"]),
                lambda b: F.struct(b["counts"].alias("counts"), b["sum"].alias("sum"), (s["n"] + 1).alias("n"), F.when(s["n"] + 1 >= WINDOW, F.greatest(s["best"], entropy(b))).otherwise(s["best"]).alias("best")),
            ),
        )
        return F.when(m["new"].isNull(), s).otherwise(moved)

    first = F.struct(F.lit("0" * 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
    return F.aggregate(moves, first, step, lambda s: s["best"])


def window_entropy(found: Column) -> Column:
    """The largest entropy of a window of WINDOW characters of an ASCII string of any length."""
    chunks = F.regexp_extract_all(found, F.lit(f".{{1,{CHUNK}}}"), F.lit(0))
    join = lambda s, c: F.concat(s["tail"], c)
    step = lambda s, c: F.struct(F.right(join(s, c), F.lit(WINDOW - 1)).alias("tail"), F.greatest(s["best"], best_window(join(s, c))).alias("best"))
    return F.aggregate(chunks, F.struct(F.lit("").alias("tail"), F.lit(0.0).alias("best")), step, lambda s: s["best"])


def is_allowed(part: Column) -> Column:
    """Words and slugs (no digit, capitals only where a word begins), capitals, numbers, placeholders."""
    slug = ~part.rlike("[0-9]") & ~part.rlike("[A-Za-z][A-Z]")
    return slug | ~part.rlike("[^A-Z]") | ~part.rlike("[A-Za-z]") | part.rlike(PLACEHOLDER)


def is_secret(found: Column) -> Column:
    """Whether a part of a candidate reaches its class's entropy and isn't on the allow-list."""

    def judged(part: Column) -> Column:
        least = F.when(part.rlike("[^0-9a-f]") & part.rlike("[^0-9A-F]"), THRESHOLDS["base64"]).otherwise(THRESHOLDS["hex"])
        return F.when((F.length(part) < WINDOW) | is_allowed(part), F.lit(False)).otherwise(window_entropy(part) >= least)

    return F.exists(F.split(found, "=+"), judged)


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and the spans of each kind: assign, access, hex, entropy (arrays of start, end, found)."""
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)):
        df = add_spans(df, name, pattern)
    value = lambda s: F.length(F.regexp_extract(s["found"], "^" + ASSIGN + "$", 2))
    df = df.withColumn("assign", F.filter("assign", lambda s: value(s) >= 12))
    return df.withColumn("entropy", F.filter("entropy", lambda s: is_secret(s["found"]))).drop("text")


def joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""

    def told(i: int, kind: str):
        return lambda s: F.struct(s["start"], F.lit(i), s["end"], F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]).alias("told"))

    spans = F.concat(*[F.transform(kind, told(i, kind)) for i, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: s["told"]), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    base = ["assign", "access", "hex"]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in [*base, "entropy"]]
    return find(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined([*base, "entropy"]).alias("spans"))
