"""Exact dedup by an extendible-hash index on shared files (built-in functions only).

A text's key is its 64-bit hash. The directory starts with one bucket; a bucket with more keys than its capacity splits
by the next bit of the hash, and the directory doubles where that bit is new to it. Splitting goes on as long as the hash
has bits: only equal hashes stay together in an overfull bucket. It is kept in pages: the first page is addressed by
the leading bits, and an entry names a bucket or the page that the next bits address, so a deep split costs one page
and not a doubling of everything. The driver holds the pages (about eight buckets an owner task), never the keys.

Owner tasks take contiguous ranges of buckets, which hold about equal numbers of rows. The rows of a bucket come to its
owner whole and once; there they are put in order of bucket, hash and text, so that the bytes of texts of equal hash are
compared, and unlike texts of one hash are chained. The owner writes its range of the index: for each text its hash,
the largest doc_id that carries it, the number of carriers, a digest, and its place in the chain. Hot texts (more rows
than a quarter of an owner's share, so at most four an owner) are folded by hash and bytes before they are sent, on the
map side too, so they cost an owner a row each.

Looking a document up goes by bucket and hash. Where a chain holds more than one text the hash can't tell, so chained
entries keep their bytes in the index, and these are compared.

Defined results: a null text counts as empty; a null doc_id loses to any other, and a group in which all are
null has keep_id null and keeps one of its rows for each text; rows that repeat a doc_id with the same text are one
document's, of which one row stays; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.columns import let
from quarry.llm.scratch import Scratch

PAGE_ENTRIES = 1 << 14  # entries that one round of splitting adds at most, or two for each overfull bucket
HOT_ROWS = 256  # fewer rows of one text aren't hot


def text_key(text: Column, key_bits: int = 64) -> Column:
    """The leading key_bits of the text's hash; fewer bits than 64 serve tests of collisions."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits)


def literal(numbers: list[int]) -> Column:
    """An array of whole numbers as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


@dataclass
class Directory:
    """Pages by level: (bits, entries). An entry from 0 is a bucket; -p is page p - 1 of the next level. Buckets are numbered in order of the hash."""

    key_bits: int
    levels: list[tuple[int, list[int]]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # keys by bucket
    depths: list[int] = field(default_factory=list)  # bits that name a bucket

    def bucket(self, key: Column) -> Column:
        """The bucket of a key."""
        found, used = F.lit(-1).cast("long"), 0
        for n, (bits, entries) in enumerate(self.levels):
            used += bits
            found = self.step(key, n, used, bits, entries, found)
        return found

    def step(self, key: Column, n: int, used: int, bits: int, entries: list[int], found: Column) -> Column:
        own = F.shiftrightunsigned(key, self.key_bits - used).bitwiseAND(F.lit((1 << bits) - 1)) + 1
        if n == 0:
            return F.element_at(literal(entries), own.cast("int"))
        return let(found, lambda f: F.when(f < 0, F.element_at(literal(entries), ((-f - 1) * (1 << bits) + own).cast("int"))).otherwise(f))


def split(counts: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int, int]]:
    """(first slot, depth, keys) of the buckets that one overfull bucket splits into, in order; counts: keys by slot of the next `bits` bits."""
    out, todo = [], [(0, 0, sum(counts.values()), sorted(counts.items()))]
    while todo:
        first, depth, n, slots = todo.pop()
        if n <= capacity or depth == bits:
            out.append((first, depth, n))
            continue
        middle = first + (1 << (bits - depth - 1))
        low, high = [x for x in slots if x[0] < middle], [x for x in slots if x[0] >= middle]
        todo += [(middle, depth + 1, sum(x[1] for x in high), high), (first, depth + 1, sum(x[1] for x in low), low)]
    return out


def grow(keys: DataFrame, key_bits: int, capacity: int) -> Directory:
    """Splits overfull buckets until none is left, or no bit. keys: distinct hashes in the column h.

    A round counts the keys of overfull buckets by their next bits, as many as PAGE_ENTRIES allows, so what comes to the driver is
    bounded by the number of buckets."""
    tree, used = Directory(key_bits), 0
    overfull: list[tuple[int, int]] = [(0, 0)]  # (number of the page, first hash prefix in the bits used so far) in order
    leaves: list[tuple[int, int, int, int, int, int]] = []  # (prefix left-aligned to key_bits, depth, keys, level, first entry, entries)
    while overfull and used < key_bits:
        bits = max(1, min(key_bits - used, PAGE_ENTRIES.bit_length() - 1 - (len(overfull) - 1).bit_length()))
        rows = keys if used == 0 else keys.withColumn("b_", tree.bucket(F.col("h"))).filter("b_ < 0").withColumn("page_", -F.col("b_") - 1)
        page = F.lit(0).cast("long") if used == 0 else F.col("page_")
        slot = F.shiftrightunsigned("h", key_bits - used - bits)
        counted: dict[int, dict[int, int]] = {}
        for p, k, n in rows.groupBy(page.alias("p"), slot.bitwiseAND(F.lit((1 << bits) - 1)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect():
            counted.setdefault(p, {})[k] = n
        entries, further = [0] * (len(overfull) << bits), []
        for p, prefix in overfull:
            for first, depth, n in split(counted.get(p, {}), bits, capacity):
                start, spans = (p << bits) + first, 1 << (bits - depth)
                if n > capacity and used + bits < key_bits:
                    further.append((len(further), (prefix << bits) + first))
                    entries[start] = -len(further)
                else:
                    whole = ((prefix << bits) + first) << (key_bits - used - bits)
                    leaves.append((whole, used + depth, n, len(tree.levels), start, spans))
        tree.levels.append((bits, entries))
        overfull, used = further, used + bits
    for number, (_, depth, n, level, start, spans) in enumerate(sorted(leaves)):
        tree.levels[level][1][start : start + spans] = [number] * spans
        tree.sizes.append(n)
        tree.depths.append(depth)
    return tree


class ExtendibleIndex:
    """The written index and its directory; see the module's text."""

    def __init__(self, docs: DataFrame, key_bits: int = 64, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None, hot_rows: int = HOT_ROWS):
        spark = docs.sparkSession
        self.scratch, self.key_bits = Scratch(spark, "exact"), key_bits
        owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.keyed = keyed.withColumn("h", text_key(F.col("text"), key_bits))
        self.rows = self.scratch.put(self.keyed.select("doc_id", "h"), "rows")
        keys = self.scratch.put(self.rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "keys")
        total, distinct = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.directory = grow(keys, key_bits, capacity or max(256, distinct // (4 * owners)))
        # ranges of buckets with about equal numbers of keys
        ranges, before = [], 0
        for n in self.directory.sizes:
            ranges.append(min(owners - 1, before * owners // max(distinct, 1)))
            before += n
        hot = [r["h"] for r in keys.filter(F.col("n") > max(hot_rows, total // (4 * owners))).select("h").collect()]  # at most 4 an owner
        one = self.keyed.select("h", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        if hot:
            is_hot = F.col("h").isin(hot)
            folded = one.filter(is_hot).groupBy("h", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            one = one.filter(~is_hot).unionByName(folded)
        sent = one.withColumn("bucket", self.bucket(F.col("h"))).withColumn("owner", F.element_at(literal(ranges or [0]), (F.col("bucket") + 1).cast("int")).cast("int"))
        # an owner's buckets come to one task, so what follows needs no further exchange: grouping compares bytes, the window counts a chain
        own = sent.repartitionById(owners, "owner").groupBy("owner", "bucket", "h", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        chain = Window.partitionBy("owner", "bucket", "h")
        told = own.select("owner", "bucket", "h", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), F.count(F.lit(1)).over(chain).alias("chain"), "text")
        self.entries = self.scratch.put(told.withColumn("text", F.when(F.col("chain") > 1, F.col("text"))), "index")
        self.scratch.drop(keys)

    def bucket(self, key: Column) -> Column:
        return self.directory.bucket(key)

    def repeats(self) -> bool:
        """Whether any row repeats another's doc_id and hash."""
        return not self.rows.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

    def chained(self) -> DataFrame | None:
        """Hashes that more than one text has, if there are any."""
        found = self.entries.filter("chain > 1").select("h").distinct()
        return None if found.isEmpty() else found

    def look_up(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
        stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("twin") == 1)
        out = ["doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256"]
        repeats = self.repeats()

        def numbered(rows: DataFrame, *by: str) -> DataFrame:
            return rows.withColumn("twin", F.row_number().over(Window.partitionBy(*by).orderBy("h")) if repeats else F.lit(1))

        rows = numbered(self.rows, "h", "doc_id").withColumn("bucket", self.bucket(F.col("h")))
        found = rows.join(self.entries.filter("chain = 1").drop("owner", "text"), ["bucket", "h"]).select(*out)
        chained = self.chained()
        if chained is None:
            return found
        texts = numbered(self.keyed.join(chained, "h", "left_semi"), "h", "text", "doc_id")
        return found.unionByName(texts.join(self.entries.filter("chain > 1"), ["h", "text"]).select(*out))


def decisions(docs: DataFrame, **options) -> DataFrame:
    """One row per document: which row of its group stays, and the group's size."""
    return ExtendibleIndex(docs, **options).look_up()


def survivors(docs: DataFrame, key_bits: int = 64, **options) -> DataFrame:
    """The rows that stay, with all their columns; one shuffle of the rows by (hash, doc_id), which no group can skew."""
    index = ExtendibleIndex(docs, key_bits=key_bits, **options)
    kept = index.entries.select(F.col("h").alias("kept_h"), F.col("keep_id").alias("kept_id"), F.col("text").alias("kept_text"))
    text = F.coalesce(docs["text"], F.lit(""))
    here = (text_key(text, key_bits) == kept["kept_h"]) & docs["doc_id"].eqNullSafe(kept["kept_id"])
    # a chained entry carries its bytes, which have to agree
    left = docs.join(kept, here & F.when(kept["kept_text"].isNotNull(), kept["kept_text"] == text).otherwise(True), "left_semi")
    if not index.repeats():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = left.select(row.alias("row"), text.alias("text"), F.col("doc_id").alias("doc_id"))
    first = F.row_number().over(Window.partitionBy("text", "doc_id").orderBy(F.xxhash64("row")))
    return packed.withColumn("twin", first).filter("twin = 1").select("row.*")
