"""Tag hierarchies: edges, ancestors, and the tags of cards with all ancestors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import Rounds, cut_lineage

IN_ONE_TASK = 1_000_000  # edges whose components one task finds


def edges(dump: DataFrame) -> DataFrame:
    """child_tag, parent_tag from a tag dump; unknown parents and self-edges are dropped."""
    pairs = dump.select(F.col("slug").alias("child_tag"), F.explode("parent_ids").alias("parent_id"))
    named = dump.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_tag"))
    return pairs.join(named, "parent_id").filter("child_tag <> parent_tag").select("child_tag", "parent_tag").distinct()


def walk(edge: DataFrame, up: bool = True) -> DataFrame:
    """tag, reached: every tag with all its ancestors (or descendants), however far; cycles end as nothing new is found.

    A round knows all pairs nearer than a power of two, and those at just that distance. Joining the two gives all pairs nearer
    than the next power, each once in a tree, so rounds are logarithmic in the depth and little is found twice. When a
    round adds nothing, no pair lies farther: each longer way has a part of just the distance that it looked at."""
    a, b = ("child_tag", "parent_tag") if up else ("parent_tag", "child_tag")
    pairs = edge.select(F.col(a).alias("tag"), F.col(b).alias("reached")).distinct()

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        onward = right.select(F.col("tag").alias("via"), F.col("reached").alias("further"))
        return left.join(onward, left["reached"] == onward["via"]).select("tag", F.col("further").alias("reached"))

    # far: pairs at just the distance; both kinds are written as one table, so that a round costs one
    table, size = cut_lineage(pairs.withColumn("far", F.explode(F.array(F.lit(False), F.lit(True))))), -1
    while True:
        known, step = (table.filter(c).select("tag", "reached") for c in ("NOT far", "far"))
        counts = dict(table.groupBy("far").count().collect())
        before, size = size, counts.get(False, 0)
        if size == before or not counts.get(True):
            return known
        near = known.unionByName(step).unionByName(joined(known, step)).distinct()
        table = cut_lineage(near.withColumn("far", F.lit(False)).unionByName(joined(step, step).distinct().withColumn("far", F.lit(True))))


def walk_sql(edge: DataFrame, up: bool = True) -> DataFrame:
    """walk() as one recursive common table expression, for hierarchies without cycles; raises beyond Spark's limit of levels.

    LIMIT ALL lifts Spark's limit of rows (a million unless set), which counts pairs of all levels together."""
    a, b = ("child_tag", "parent_tag") if up else ("parent_tag", "child_tag")
    return edge.sparkSession.sql(
        f"""WITH RECURSIVE reached_(tag, reached) AS (
              SELECT {a}, {b} FROM {{edge}}
              UNION ALL
              SELECT r.tag, e.{b} FROM reached_ r JOIN {{edge}} e ON r.reached = e.{a})
            SELECT DISTINCT tag, reached FROM (SELECT * FROM reached_ LIMIT ALL)""",
        edge=edge,
    )


def cycles(edge: DataFrame) -> DataFrame:
    """Tags that are their own ancestors."""
    return rings(edge).select("tag")


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The strongly connected component of each of n nodes (Tarjan's algorithm, with a stack of its own) under edges a -> b."""
    onward = b[np.argsort(a, kind="stable")].tolist()
    ends = np.cumsum(np.bincount(a, minlength=n)).tolist()
    at = [0, *ends[:-1]]
    order, low, label, open_, seen, found = [-1] * n, [0] * n, [-1] * n, [], 0, 0
    for start in range(n):
        path = [start] if order[start] < 0 else []
        while path:
            v = path[-1]
            if order[v] < 0:
                order[v] = low[v] = seen
                seen += 1
                open_.append(v)
            if at[v] < ends[v]:
                w = onward[at[v]]
                at[v] += 1
                if order[w] < 0:
                    path.append(w)
                elif label[w] < 0:
                    low[v] = min(low[v], order[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == order[v]:
                while label[v] < 0:
                    label[open_.pop()] = found
                found += 1
    return np.array(label, np.int64)


def rings_in_one_task(live: DataFrame) -> DataFrame:
    """tag, ring of edges (a, b) that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        ends = pa.chunked_array([*rows.column(0).chunks, *rows.column(1).chunks]).combine_chunks().dictionary_encode()
        codes = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        label = components_of(len(ends.dictionary), codes[: rows.num_rows], codes[rows.num_rows :])
        first = np.unique(label, return_index=True)[1]
        within = np.flatnonzero(np.bincount(label)[label] > 1)
        for k in range(0, len(within), 10_000):
            some = within[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(some)), ends.dictionary.take(pa.array(first[label[some]]))], ["tag", "ring"])

    kind = live.schema["a"].dataType.simpleString()
    return live.coalesce(1).mapInArrow(run, f"tag {kind}, ring {kind}")


def raked(live: DataFrame) -> DataFrame:
    """Edges between tags that have both a way in and a way out."""
    return live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def chains(live: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Tags of one edge in and one out: (tag, up, down) with the ends of their chain, and (tag, ring) where it has no end.

    Pointers to both sides double their reach each round and stop at an end; what has none after a reach of all such tags goes round."""
    into = live.groupBy(F.col("b").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("up")).filter("n = 1").select("tag", "up")
    out = live.groupBy(F.col("a").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("down")).filter("n = 1").select("tag", "down")
    inner = into.join(out, "tag")
    table = rounds.put(inner.select("tag", "up", "down", F.col("tag").alias("low"), F.lit(True).alias("up_open"), F.lit(True).alias("down_open")))
    for _ in range(table.count().bit_length() + 1):
        above = table.select(F.col("tag").alias("up"), F.col("up").alias("up2"), F.col("up_open").alias("up_open2"), F.col("low").alias("low2"))
        below = table.select(F.col("tag").alias("down"), F.col("down").alias("down2"), F.col("down_open").alias("down_open2"))
        step = table.join(above, "up", "left").join(below, "down", "left").select(
            "tag",
            F.coalesce("up2", "up").alias("up"),
            F.coalesce("down2", "down").alias("down"),
            F.least("low", "low2").alias("low"),
            F.coalesce("up_open2", F.lit(False)).alias("up_open"),
            F.coalesce("down_open2", F.lit(False)).alias("down_open"),
        )
        table = rounds.put(step, table)
        if table.filter("up_open OR down_open").isEmpty():
            break
    return table.filter("NOT up_open AND NOT down_open").select("tag", "up", "down"), table.filter("up_open OR down_open").select("tag", F.col("low").alias("ring"))


def colored(live: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(tag, ring) of the component of each greatest tag that reaches others, and the edges that can still lie in another component.

    A tag's color is the greatest tag that reaches it; the component of a color's tag is what reaches it within the color."""
    color = rounds.put(live.select(F.explode(F.array("a", "b")).alias("tag")).distinct().withColumns({"color": F.col("tag"), "fresh": F.lit(True)}))
    while not color.filter("fresh").isEmpty():
        told = live.join(color.filter("fresh").select(F.col("tag").alias("a"), "color"), "a").groupBy(F.col("b").alias("tag")).agg(F.max("color").alias("told"))
        color = rounds.put(color.join(told, "tag", "left").select("tag", F.greatest("color", "told").alias("color"), F.coalesce(F.col("told") > F.col("color"), F.lit(False)).alias("fresh")), color)
    ends = [color.select(F.col("tag").alias(x), F.col("color").alias(f"{x}_color")) for x in "ab"]
    same = rounds.put(live.join(ends[0], "a").join(ends[1], "b").filter("a_color = b_color").select("a", "b", F.col("a_color").alias("color")), color)
    back = rounds.put(same.select(F.col("color").alias("tag"), F.col("color").alias("ring")).distinct().withColumn("fresh", F.lit(True)))
    while not (fresh := back.filter("fresh").select(F.col("tag").alias("b"))).isEmpty():
        more = same.join(fresh, "b").select(F.col("a").alias("tag"), F.col("color").alias("ring"), F.lit(True).alias("fresh")).distinct().join(back.select("tag"), "tag", "left_anti")
        back = rounds.put(back.withColumn("fresh", F.lit(False)).unionByName(more), back)
    many = back.groupBy("ring").count().filter("count > 1").select("ring")
    left = same.join(back.select(F.col("tag").alias("a")), "a", "left_anti").join(back.select(F.col("tag").alias("b")), "b", "left_anti")
    return back.join(many, "ring").select("tag", "ring"), left.select("a", "b")


def rings(edge: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """tag, ring: every tag that lies on a cycle, with one tag that stands for all that reach each other (its strongly connected component).

    No table holds more than a few rows an edge or tag; the pairs of walk() are the square of a ring. Tags without a way in or out
    go, chains become one edge, and what neither shrinks is split by colors, until one task can take the rest. Tags of a chain are on a
    cycle if both its ends are of one ring. Rake and chains take a number of rounds logarithmic in the size of a hierarchy; colors
    take as many as the longest of the shortest ways between tags that branch. Null tags are on no cycle."""
    rounds = Rounds(edge.sparkSession, "rings")
    every = rounds.put(edge.select(F.col("child_tag").alias("a"), F.col("parent_tag").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    live, told, cut = rounds.put(every.filter("a <> b")), [], []
    n = live.count()
    while n > in_one_task:
        kept = rounds.put(raked(live), live)
        m = kept.count()
        if m > in_one_task:
            chain, closed = (rounds.put(x) for x in chains(kept, rounds))
            gone = chain.select("tag").unionByName(closed.select("tag"))
            rest = kept.join(gone.select(F.col("tag").alias("a")), "a", "left_anti").join(gone.select(F.col("tag").alias("b")), "b", "left_anti").select("a", "b")
            told.append(closed)
            cut.append(chain)
            kept = rounds.put(rest.unionByName(chain.filter("up <> down").select(F.col("up").alias("a"), F.col("down").alias("b"))).distinct(), kept)
            m = kept.count()
        if m == n:
            found, left = (rounds.put(x) for x in colored(kept, rounds))
            told.append(found)
            kept, m = left, left.count()
        live, n = kept, m
    told.append(rings_in_one_task(live))
    known = told[0]
    for x in told[1:]:
        known = known.unionByName(x)
    known = rounds.put(known)
    for chain in [*reversed(cut), every.filter("a = b").select(F.lit(None).cast(every.schema["a"].dataType).alias("tag"), F.col("a").alias("up"), F.col("b").alias("down"))]:
        alone = chain.filter("up = down").select(F.col("up").alias("tag"), F.col("up").alias("ring")).distinct().join(known.select("tag"), "tag", "left_anti")
        known = rounds.put(known.unionByName(alone))
        sides = [known.select(F.col("tag").alias(x), F.col("ring").alias(f"{x}_ring")) for x in ("up", "down")]
        within = chain.filter("tag IS NOT NULL").join(sides[0], "up").join(sides[1], "down").filter("up_ring = down_ring").select("tag", F.col("up_ring").alias("ring"))
        known = rounds.put(known.unionByName(within))
    return known


def leaves(tags: DataFrame, edge: DataFrame) -> DataFrame:
    """Tags that are no tag's parent."""
    return tags.join(edge.select(F.col("parent_tag").alias("tag")), "tag", "left_anti")


def roots(tags: DataFrame, edge: DataFrame) -> DataFrame:
    """Tags that have no parent."""
    return tags.join(edge.select(F.col("child_tag").alias("tag")), "tag", "left_anti")


def item_tags(dump: DataFrame, key: str, ancestors: DataFrame | None = None) -> DataFrame:
    """key, tags: each tagged item's tags and all their ancestors, sorted."""
    direct = dump.select(F.explode("taggings").alias("t"), "slug").select(F.col(f"t.{key}").alias(key), F.col("slug").alias("tag")).filter(F.col(key).isNotNull())
    up = ancestors if ancestors is not None else walk(edges(dump))
    every = direct.unionByName(direct.join(up, "tag").select(key, F.col("reached").alias("tag")))
    return every.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def sync_tags(cards: DataFrame, tagged: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """cards with column set from tagged, and cleared where tagged has no row; and (updated, cleared) counts."""
    joined = cards.join(tagged.withColumnRenamed("tags", "tags_"), key, "left")
    fresh = F.coalesce("tags_", F.expr("CAST(array() AS ARRAY<STRING>)"))
    counts = joined.agg(
        F.count_distinct(F.when(F.col("tags_").isNotNull() & ~F.col(column).eqNullSafe(F.col("tags_")), F.col("printing_id"))).alias("updated"),
        F.count_distinct(F.when(F.col("tags_").isNull() & (F.size(column) > 0) & F.col(key).isNotNull(), F.col(key))).alias("cleared"),
    )
    return joined.withColumn(column, fresh).select(*cards.columns), counts
