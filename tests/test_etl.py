"""Ingest, upsert, tags, scores, catalogues, telemetry, sources and the log stream."""

import datetime
import gzip
import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.functions import stored
from quarry.functions.colors import mask
from quarry.functions.mana import devotion, mana_value, pips
from quarry.functions.text import fold_accents
from quarry.operators import catalogs, engine, imports, ingest, scores, tags, telemetry, upsert
from quarry.operators.search import QueryError, browse, random_sample, search, search_many
from quarry.sources import bulk
from quarry.sources.paged import follow_pages, read_pages
from quarry.streaming import query_log


def raw(**change):
    """A raw object; a value of ... leaves the key out."""
    base = {
        "id": "p1", "oracle_id": "o1", "name": "Bear", "type_line": "Creature — Bear", "oracle_text": "", "mana_cost": "{1}{G}", "cmc": 2.0, "power": "2", "toughness": "2", "colors": ["G"], "color_identity": ["G"],
        "keywords": [], "legalities": {"modern": "legal", "legacy": "banned"}, "prices": {"usd": "1.25", "eur": None, "tix": "x"}, "set": "ABC", "set_name": "Abc", "set_type": "core", "layout": "Normal", "border_color": "Black", "frame": "2015",
        "frame_effects": ["extendedart"], "rarity": "Rare", "collector_number": "12a", "artist": "Ann", "illustration_id": "i1", "edhrec_rank": 7, "released_at": "2020-01-02", "games": ["paper"], "finishes": ["nonfoil"],
        "image_status": "highres_scan", "lang": "en", "reserved": True, "game_changer": False,
    }
    return {k: v for k, v in (base | change).items() if v is not ...}


def load(spark, tmp_path, objects, **options):
    path = tmp_path / "dump.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write("".join((o if isinstance(o, str) else json.dumps(o)) + "\n" for o in objects))
    return bulk.read_dump(spark, str(path), **options)


def test_mana_literals():
    assert pips("{2}{R}{R/G}xW") == {"R": 1, "R/G": 1, "X": 1, "W": 1} and pips("2rr") == {"R": 2}
    assert [mana_value(c) for c in ("{2}{R}{R/G}", "11R", "{X}{X}{U}", "xr", "R{G}1", "1{r}1", "")] == [4, 12, 1, 1, 3, 3, 0]
    assert devotion("{R/G}{R/G}{W/P}{2}") == {"R": 2, "G": 2, "W": 1}
    assert fold_accents("Éowyn ñ ö") == "Eowyn n o"
    assert (mask("wu", False), mask("Red", False), mask("c", False), mask("c", True), mask("cr", True)) == (24, 2, 0, 32, 34)
    with pytest.raises(ValueError):
        mask("purple", False)


def test_corpus_filter(spark, tmp_path):
    dropped = [
        {"legalities": {"modern": "not_legal"}}, {"legalities": {}}, {"promo_types": ["playtest"]}, {"games": ["arena"]}, {"set_type": "funny"}, {"type_line": "Token Creature — Elf"}, {"type_line": "Card"}, {"name": "Bear // Bear"}, {"legalities": ...}, {"games": ...},
    ]
    kept = [{"legalities": {"modern": "restricted"}}, {"name": "Bear // Wolf"}, {"set_type": ...}, {"type_line": "Legendary Snow Land"}]
    objects = [raw(id=f"d{i}", **c) for i, c in enumerate(dropped)] + [raw(id=f"k{i}", **c) for i, c in enumerate(kept)]
    got = ingest.editions(load(spark, tmp_path, objects))
    assert sorted(x["printing_id"] for x in got.collect()) == ["k0", "k1", "k2", "k3"]


def test_derived_columns(spark, tmp_path):
    objects = [
        raw(),
        raw(id="p2", name="Éowyn's Bolt", type_line="Instant", mana_cost="{R/G}{X}", power="1", colors=["R", "G"], produced_mana=["C", "G"], keywords=["First strike", "first strike"], reserved=False, collector_number="99999999999", loyalty="X"),
        raw(id="p3", type_line="Artifact — urza's power-plant Vehicle", power="*", toughness="1.5", colors=None, rarity="mythic", loyalty="4", collector_number="★"),
    ]
    cards = ingest.editions(load(spark, tmp_path, objects))
    got = {x["printing_id"]: x for x in cards.collect()}
    a, b, c = got["p1"], got["p2"], got["p3"]
    assert (a["card_types"], a["card_subtypes"], a["creature_power"], a["card_colors"], a["mana_cost_jsonb"], a["devotion"]) == (["Creature"], ["Bear"], 2, 1, {"G": 1}, {"G": 1})
    assert (a["card_frame_data"], a["card_is_tags"], a["card_set_code"], a["card_layout"], a["card_border"], a["card_rarity_int"]) == (["2015", "Extendedart"], ["reserved"], "abc", "normal", "black", 2)
    assert (float(a["price_usd"]), a["price_eur"], a["price_tix"], a["collector_number_int"], a["released_at"], a["flavor_text"]) == (1.25, None, None, 12, datetime.date(2020, 1, 2), "")
    assert (b["card_name_folded"], b["card_keywords"], b["devotion"], b["mana_cost_jsonb"], b["produced_mana"]) == ("eowyn's bolt", ["first strike"], {}, {"R/G": 1, "X": 1}, 33)
    assert (b["creature_power"], b["creature_power_text"], b["collector_number_int"], b["planeswalker_loyalty"]) == (None, None, None, None)
    assert (c["card_subtypes"], c["creature_power"], c["creature_power_text"], c["creature_toughness"], c["planeswalker_loyalty"], c["collector_number_int"], c["card_colors"]) == (["Urza'S", "Power-Plant", "Vehicle"], None, "*", 1, 4, None, 0)
    assert {x["check"]: x["broken"] for x in ingest.quality(cards).collect()} == dict.fromkeys(ingest.CHECKS, 0)
    found = search(cards, "eowyn", fields=["name", "keywords"]).envelope("columnar")
    assert (found["cards"], found["total_cards"]) == ({"name": ["Éowyn's Bolt"], "keywords": [["first strike"]]}, 1)
    with pytest.raises(ValueError):
        ingest.least_rows(cards, 4)


def test_faces(spark, tmp_path):
    two = raw(name="Front // Back", type_line="Creature — Elf // Land", card_faces=[{"name": "Front", "type_line": "Creature — Elf", "mana_cost": "{G}", "colors": ["G"], "power": "1", "toughness": "3"}, {"name": "Back", "type_line": "Land", "mana_cost": "", "oracle_text": "Tap"}], power=..., toughness=...)
    dump = load(spark, tmp_path, [two, raw(id="p9")])
    front = {x["printing_id"]: x for x in ingest.editions(dump).collect()}
    assert (front["p1"]["card_name"], front["p1"]["face_name"], front["p1"]["creature_toughness"]) == ("Front // Back", "Front", 3)
    every = ingest.editions(dump, all_faces=True).orderBy("printing_id", "face_idx").collect()
    assert [(x["printing_id"], x["face_idx"], x["card_types"], x["oracle_text"]) for x in every] == [("p1", 1, ["Creature"], ""), ("p1", 2, ["Land"], "Tap"), ("p9", 1, ["Creature"], "")]


def test_bad_lines(spark, tmp_path):
    lines = [raw(), "{not json", raw(id="p2")]
    with pytest.raises(bulk.CoverageError):
        load(spark, tmp_path, lines)
    assert load(spark, tmp_path, lines, coverage=0.5).count() == 2


def test_publish_swaps_whole_tables(spark, tmp_path):
    path = str(tmp_path / "published")
    first = bulk.publish(spark.range(10).withColumn("oracle_id", F.col("id") % 3), path)
    assert first.count() == 10
    assert bulk.publish(spark.range(4).withColumn("oracle_id", F.col("id")), path).count() == 4
    assert sorted(p.name for p in tmp_path.iterdir()) == ["published"]
    bulk.write_json(spark.range(3).withColumn("s", F.lit("x")), str(tmp_path / "json"), "s")
    assert spark.read.json(str(tmp_path / "json")).count() == 3 and bulk.dump_path("/a/", "rulings") == "/a/rulings"


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        bulk.published(spark, path)
    old = bulk.publish(spark.range(5).withColumn("oracle_id", F.col("id")), path)
    with pytest.raises(PySparkException):
        bulk.publish(spark.range(9).withColumn("oracle_id", F.expr("raise_error('fails')")), path)
    assert bulk.published(spark, path).count() == 5  # what fails midway changes nothing
    bulk.publish(spark.range(7).withColumn("oracle_id", F.col("id")), path)
    assert old.count() == 5 and bulk.published(spark, path).count() == 7  # readers of the version before still have its files
    for n in (1, 2):
        bulk.publish(spark.range(n).withColumn("oracle_id", F.col("id")), path)
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v-")]) == bulk.KEPT and bulk.published(spark, path).count() == 2


def test_dump_is_loaded_once(spark, tmp_path):
    (tmp_path / "dump.jsonl").write_text("\n".join([json.dumps(raw()), "{not json", json.dumps(raw(id="p2"))]))
    with pytest.raises(bulk.CoverageError):
        bulk.load_dump(spark, str(tmp_path / "dump.jsonl"), str(tmp_path / "out"))
    assert sorted(x["id"] for x in bulk.load_dump(spark, str(tmp_path / "dump.jsonl"), str(tmp_path / "out"), coverage=0.5).collect()) == ["p1", "p2"]


def test_whole_import(spark, tmp_path):
    def dump(name, objects):
        (tmp_path / name).write_text("\n".join(map(json.dumps, objects)))
        return str(tmp_path / name)

    path, tagged = str(tmp_path / "table"), [{"id": "1", "slug": "a", "parent_ids": [], "taggings": []}, {"id": "2", "slug": "b", "parent_ids": ["1"], "taggings": [{"oracle_id": "o1"}]}]
    first = imports.import_cards(spark, dump("one", [raw(), raw(id="p2", oracle_id="o2", name="Wolf")]), path, oracle_tags=dump("tags", tagged), ranking=dump("ranking", [{"oracle_id": "o2", "elo": 5.0, "cubeCount": 1, "pickCount": 2}]))
    assert first == {"inserted": 2, "updated": 0, "unchanged": 0}
    with pytest.raises(ValueError):
        imports.import_cards(spark, dump("few", [raw()]), path, least=9)
    again = imports.import_cards(spark, dump("two", [raw(), raw(id="p2", oracle_id="o2", name="Wolf", cmc=3.0), raw(id="p3", oracle_id="o3", name="Elk")]), path)
    assert again == {"inserted": 1, "updated": 1, "unchanged": 1}
    got = {x["printing_id"]: x for x in bulk.published(spark, path).collect()}
    assert (got["p1"]["card_oracle_tags"], got["p2"]["cmc"], got["p2"]["cubecobra_elo"], got["p1"]["card_is_tags"]) == (["a", "b"], 3, 5.0, ["reserved"])
    assert got["p3"]["prefer_score"] == got["p1"]["prefer_score"] > 100
    assert imports.rescore(spark, path, {"language": 0, "rarity_2": 1}).filter("printing_id = 'p1'").first()["prefer_score"] == pytest.approx(got["p1"]["prefer_score"] - 50)
    with pytest.raises(ValueError):
        imports.rescore(spark, path, {"nonsuch": 1})


def test_listing_follows_its_pages(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / f"{n}.json").write_text(json.dumps({"data": [raw(id=f"{n}{c}") for c in "ab"], "next_page": (tmp_path / f"{n + 1}.json").as_uri() if n != 2 else None}))
    urls = [(tmp_path / f"{n}.json").as_uri() for n in (1, 3, 7)]  # the third page's next isn't there; the seventh isn't either
    assert sorted(x["id"] for x in follow_pages(spark, urls).collect()) == ["1a", "1b", "2a", "2b", "3a", "3b"]
    assert follow_pages(spark, urls[2:]).count() == follow_pages(spark, []).count() == 0


def test_long_hierarchies_and_rings(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 170) for i in range(170)] + [(0, 1000)]
    edge = spark.createDataFrame(chain, "child_tag long, parent_tag long")
    up = {}
    for x in tags.walk(edge).collect():
        up.setdefault(x["tag"], set()).add(x["reached"])
    ring = set(range(1000, 1170))
    assert up == {0: set(range(1, 301)) | ring} | {i: set(range(i + 1, 301)) for i in range(1, 300)} | dict.fromkeys(ring, ring)
    assert {x["tag"] for x in tags.cycles(edge).collect()} == ring
    assert tags.walk(edge.limit(0)).count() == 0


def brute_cycles(pairs):
    """tag -> all tags of its cycle's component."""
    onward, reach = {}, {}
    for a, b in pairs:
        onward.setdefault(a, set()).add(b)
    for start in onward:
        queue, seen = [start], set()
        while queue:
            for b in onward.get(queue.pop(), set()) - seen:
                seen.add(b)
                queue.append(b)
        reach[start] = seen
    return {a: frozenset(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}


def ringed(found):
    of = {}
    for x in found:
        of.setdefault(x["ring"], []).append(x["tag"])
    assert all(len(x) == len(set(x)) for x in of.values())
    return {t: frozenset(x) for x in of.values() for t in x}


@pytest.mark.parametrize("in_one_task", [0, 10_000])
def test_rings_against_brute_force(spark, in_one_task):
    """Trees, chains, rings, ears on rings, tags of one's own and random graphs side by side, as one table."""
    r = random.Random(5)
    pairs = [(i, i // 2) for i in range(1, 40)] + [(0, 5)] + [(100 + i, 100 + (i + 1) % 17) for i in range(17)] + [(103, 300), (300, 301), (301, 110), (301, 302), (302, 303)]
    pairs += [(400, 401), (401, 402), (402, 400), (400, 403), (403, 404), (404, 400), (402, 405), (405, 406), (500, 500), (501, 500), (39, 39), (300, 300), (600, 601), (601, 600)]
    for k, (n, m) in enumerate([(12, 14), (12, 20), (25, 40), (30, 34), (9, 40)]):
        pairs += [(1000 * (k + 1) + r.randrange(n), 1000 * (k + 1) + r.randrange(n)) for _ in range(m)]
    edge = spark.createDataFrame([*pairs, *pairs[:5], (None, 3), (3, None), (None, None)], "child_tag long, parent_tag long")
    assert ringed(tags.rings(edge, in_one_task).collect()) == brute_cycles(pairs)


def test_long_rings_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tags, "walk", None)
    edge = spark.range(50_000).selectExpr("concat('t', id) AS child_tag", "concat('t', (id + 1) % 50000) AS parent_tag")
    assert tags.cycles(edge).distinct().count() == tags.cycles(edge).count() == 50_000
    assert tags.cycles(edge.filter("child_tag <> 't7'")).count() == tags.cycles(edge.limit(0)).count() == 0


def test_recursion_has_no_limit_of_rows(spark):
    edge = spark.createDataFrame([(i, i + 1) for i in range(30)], "child_tag long, parent_tag long")
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "20")
    try:
        assert sorted(map(tuple, tags.walk_sql(edge).collect())) == [(a, b) for a in range(30) for b in range(a + 1, 31)]
    finally:
        spark.conf.set(name, before)


def test_table_functions(spark):
    stored.register(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "child_tag string, parent_tag string"))
    said = lambda call: sorted(x[0] for x in spark.sql(f"SELECT * FROM {call}").collect())
    assert said("tag_ancestors('c')") == ["a", "b"] and said("tag_descendants('a')") == ["b", "c", "d"] and said("tag_parents('b')") == ["a"] and said("tag_children('b')") == ["c", "d"]
    rows = spark.sql("SELECT t.x, f.reached FROM VALUES ('c'), ('b') AS t(x), LATERAL tag_ancestors(t.x) f").collect()
    assert sorted(map(tuple, rows)) == [("b", "a"), ("c", "a"), ("c", "b")]


def test_many_queries_at_once(spark, tmp_path):
    cards = ingest.editions(load(spark, tmp_path, [raw(id=f"p{i}", oracle_id=f"o{i % 7}", name=f"Card {i % 7}", cmc=float(i % 5), edhrec_rank=i % 7) for i in range(40)])).cache()
    asked = ["cmc>2", "cmc=1 or cmc=4", "nothing", "", "name:3"]
    for unique in ("card", "printing"):
        page, totals = search_many(cards, asked, unique=unique, limit=5, fields=["scryfall_id", "name"])
        rows, counts = page.orderBy("query", "position").collect(), {x["query"]: x["total_cards_count"] for x in totals.collect()}
        for i, q in enumerate(asked):
            one = search(cards, q, unique=unique, limit=5, fields=["scryfall_id", "name"])
            assert [(x["scryfall_id"], x["name"]) for x in rows if x["query"] == i] == [tuple(x) for x in one.page.collect()] and counts[i] == one.total()


def test_compiled_query(spark, tmp_path):
    cards = ingest.editions(load(spark, tmp_path, [raw()]))
    assert "cmc" in search(cards, "cmc<3").envelope()["compiled"] and "<" in search(cards, "cmc<3").envelope()["compiled"]


def test_paged_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"data": [raw(id=f"{n}{c}") for c in "ab"], "next_page": n < 2}, indent=1))
    (tmp_path / "page-3.json").write_text("<html>")
    pages = read_pages(spark, str(tmp_path))
    assert sorted(x["id"] for x in pages.collect()) == ["1a", "1b", "2a", "2b"] and ingest.editions(pages).count() == 4
    assert read_pages(spark, str(tmp_path / "none")).count() == 0


def test_engine(spark, tmp_path):
    served = engine.SearchEngine(spark, str(tmp_path / "served"))
    cards = ingest.editions(load(spark, tmp_path, [raw(), raw(id="p2", name="Wolf", oracle_id="o2", keywords=["Haste"])]))
    assert served.reload(cards) == 2
    assert [c["name"] for c in served.query("t:bear", orderby="name")["cards"]] == ["Bear", "Wolf"]
    assert "TakeOrderedAndProject" in served.explain("t:bear") and served.explain_analyze("wolf")["total_cards"] == 1
    assert [tuple(x) for x in served.common_card_keywords().collect()] == [("haste", 1)] and served.common_card_types().count() == 2
    assert served.sample_preferred(5).count() == 2 and served.preferred().count() == 2
    served.reload_begin()
    served.add_batch(cards)
    served.reload_abort()
    with pytest.raises(ValueError):
        served.add_batch(cards)
    served.reload_begin()
    served.add_batch(cards.filter("printing_id = 'p1'"))
    assert served.size() == 2 and served.reload_commit() == 1 and served.size() == 1


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1, {"x": 1}), (2, "b", 2, {"y": 1, "z": 2}), (3, "c", None, None)], "k int, t string, n int, m map<string,int>")
    new = spark.createDataFrame([(2, "b", {"z": 2, "y": 1}), (3, None, None), (4, "d", None)], "k int, t string, m map<string,int>")
    merged = upsert.upsert(old, new, ["k"])
    assert merged.counts() == {"inserted": 1, "updated": 1, "unchanged": 1}
    assert sorted(map(tuple, merged.table.select("k", "t", "n").collect())) == [(1, "a", 1), (2, "b", 2), (3, None, None), (4, "d", None)]
    again = upsert.upsert(merged.table, new, ["k"])
    assert again.counts() == {"inserted": 0, "updated": 0, "unchanged": 3}
    kept = upsert.upsert(old, spark.createDataFrame([(1, "z"), (9, "z")], "k int, t string"), ["k"], skip=("t",))
    assert kept.counts() == {"inserted": 1, "updated": 0, "unchanged": 1}
    assert sorted((x["k"], x["t"]) for x in kept.table.collect()) == [(1, "a"), (2, "b"), (3, "c"), (9, "z")]
    some = spark.createDataFrame([(1, None, None, ["n"]), (2, None, 5, ["t", "n"])], "k int, t string, n int, has array<string>")
    table = upsert.upsert(old, some, ["k"], present="has").table
    assert sorted(map(tuple, table.select("k", "t", "n").collect())) == [(1, "a", None), (2, None, 5), (3, "c", None)]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, at int, t string")
    assert sorted(map(tuple, upsert.last_of_each(rows, ["k"], F.col("at")).collect())) == [(1, 2, "y"), (2, 1, "z")]


TAGS = [
    {"id": "1", "slug": "a", "parent_ids": [], "taggings": [{"oracle_id": "x"}]},
    {"id": "2", "slug": "b", "parent_ids": ["1", "?", "2"], "taggings": [{"oracle_id": "y"}, {"oracle_id": None}]},
    {"id": "3", "slug": "c", "parent_ids": ["2"], "taggings": [{"oracle_id": "y"}, {"oracle_id": "z"}]},
    {"id": "4", "slug": "d", "parent_ids": ["5"], "taggings": [{"oracle_id": "w"}]},
    {"id": "5", "slug": "e", "parent_ids": ["4"], "taggings": []},
]


def test_tags(spark, tmp_path):
    dump = load(spark, tmp_path, TAGS, dump="oracle_tags")
    edge = tags.edges(dump)
    assert sorted(map(tuple, edge.collect())) == [("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")]
    assert sorted(x["tag"] for x in tags.cycles(edge).collect()) == ["d", "e"]
    tame = edge.filter("child_tag < 'd'")
    for walk in (tags.walk, tags.walk_sql):
        assert sorted(map(tuple, walk(tame).collect())) == [("b", "a"), ("c", "a"), ("c", "b")]
        assert sorted(map(tuple, walk(tame, up=False).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    items = tags.item_tags(dump, "oracle_id")
    assert {x["oracle_id"]: x["tags"] for x in items.collect()} == {"x": ["a"], "y": ["a", "b", "c"], "z": ["a", "b", "c"], "w": ["d", "e"]}
    cards = spark.createDataFrame([("p1", "x", ["a"]), ("p2", "y", []), ("p3", "q", ["old"]), ("p4", None, ["old"])], "printing_id string, oracle_id string, card_oracle_tags array<string>")
    synced, counts = tags.sync_tags(cards, items, "oracle_id", "card_oracle_tags")
    assert {x["printing_id"]: x["card_oracle_tags"] for x in synced.collect()} == {"p1": ["a"], "p2": ["a", "b", "c"], "p3": [], "p4": []}
    assert tuple(counts.first()) == (1, 1)


def test_tag_columns(spark):
    cards = spark.createDataFrame([("p1", ["old", "reserved"], None, True), ("p2", [], True, None)], "printing_id string, card_is_tags array<string>, reserved boolean, game_changer boolean")
    synced = upsert.sync_flag_tags(cards, ingest.FLAG_TAGS)
    assert {x["printing_id"]: x["card_is_tags"] for x in synced.collect()} == {"p1": ["gamechanger", "old"], "p2": ["reserved"]}
    added = upsert.add_tag(cards, spark.createDataFrame([("p2",), ("p2",), ("p7",)], "printing_id string"), "foil")
    assert {x["printing_id"]: x["card_is_tags"] for x in added.collect()} == {"p1": ["old", "reserved"], "p2": ["foil"]}
    assert upsert.missing(spark.createDataFrame([("p1",), ("p8",)], "printing_id string"), cards, "printing_id").collect()[0][0] == "p8"


def test_prefer_scores(spark, tmp_path):
    objects = [raw(), raw(id="p2", lang="es", rarity="mythic", border_color="gold", frame="1993", frame_effects=["showcase", "legendary"], finishes=["foil"], image_status="lowres", set="dbl")]
    cards = ingest.editions(load(spark, tmp_path, objects)).withColumn("card_art_tags", F.when(F.col("printing_id") == "p2", F.array(F.lit("external-ip"))).otherwise(F.array().cast("array<string>")))
    got = {x["printing_id"]: x for x in scores.prefer_scores(cards).collect()}
    art = round(23 * math.log(2) / math.log(40), 4)
    assert len(got["p1"]["prefer_score_components"]) == 13
    assert got["p1"]["prefer_score"] == pytest.approx(art + 11 + 14 + 42 + 12 + 16 + 6 + 40 + 0 + 10 + 10 + 20 + 14)
    assert got["p2"]["prefer_score"] == pytest.approx(art + 0 + 0 + 10 + 0 + 0 + 6 + 0 + 5 + 0 + 5 + 0 + 0)
    again = scores.prefer_scores(scores.prefer_scores(cards))
    assert {x["printing_id"]: x["prefer_score"] for x in again.collect()} == {k: v["prefer_score"] for k, v in got.items()}
    lighter = scores.prefer_scores(cards, {"language": 1}).filter("printing_id = 'p1'").first()
    assert lighter["prefer_score"] == pytest.approx(got["p1"]["prefer_score"] - 39)


def test_popularity(spark):
    rows = [("a", "p1", 1, 9.0, 5, 5), ("a", "p2", 99, 1.0, 1, 1), ("b", "p3", 2, None, 4, 4), ("c", "p4", None, 8.0, None, 1)]
    cards = spark.createDataFrame(rows, "card_name string, printing_id string, edhrec_rank int, cubecobra_elo double, cubecobra_cube_count int, cubecobra_pick_count int")
    got = {x["card_name"]: x["cubecobra_score"] for x in scores.popularity(cards).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(25 * (0.5 + 1 + 0.5 + 0.5)), "c": pytest.approx(25 * (1 + 0.5 + 1 + 1))}
    assert scores.with_popularity(cards).count() == 4
    ranking = spark.createDataFrame([("p", 1.5, 2, 3), (None, 1.0, 1, 1)], bulk.RANKING_SCHEMA)
    ranked = scores.with_ranking(cards.withColumn("oracle_id", F.when(F.col("card_name") == "a", "p").otherwise("q")), ranking)
    assert {(x["card_name"], x["cubecobra_elo"]) for x in ranked.collect()} == {("a", 1.5), ("b", None), ("c", 8.0)}


def test_catalogues(spark):
    cards = spark.createDataFrame([("o1", "p1", ["Tribal"], ["Elf"], ["flying"], 1.0), ("o1", "p2", ["Tribal"], ["Elf"], ["flying"], 2.0), ("o2", "p3", ["Kindred"], None, [], 1.0)], "oracle_id string, printing_id string, card_types array<string>, card_subtypes array<string>, card_keywords array<string>, prefer_score double")
    assert [tuple(x) for x in catalogs.type_counts(cards).collect()] == [("Elf", 2), ("Kindred", 1), ("Tribal", 2)]
    assert [tuple(x) for x in catalogs.common_types(cards).collect()] == [("Elf", 1), ("Kindred", 2)]
    assert [tuple(x) for x in catalogs.common_keywords(cards).collect()] == [("flying", 1)] and catalogs.keyword_counts(cards).count() == 0
    types = catalogs.type_counts(cards)
    assert [catalogs.completion(types, p).first()[0] for p in ("e", "K", "x", "")] == ["Elf", "Kindred", None, "Elf"]
    assert {x["printing_id"] for x in random_sample(cards, 2, seed=1).collect()} == {"p2", "p3"}
    with pytest.raises(QueryError):
        random_sample(cards, 0)
    rows = spark.range(9000).selectExpr("id DIV 3 AS oracle_id", "concat('p', id) AS printing_id", "CAST(id % 3 AS DOUBLE) AS prefer_score")
    everything = {(k, f"p{3 * k + 2}") for k in range(3000)}
    assert {(x["oracle_id"], x["printing_id"]) for x in random_sample(rows, 5000, seed=7).collect()} == everything
    by_draw = [(x["oracle_id"], x["printing_id"]) for x in rows.filter("prefer_score = 2").orderBy(F.xxhash64(F.lit(7), "oracle_id")).collect()]
    for n in (1001, 2500, 2999, 3000):
        assert sorted((x["oracle_id"], x["printing_id"]) for x in random_sample(rows, n, seed=7).collect()) == sorted(by_draw[:n])
    assert random_sample(rows, 1500).distinct().count() == 1500
    names = spark.createDataFrame([(c, c) for c in "dabc"], "card_name string, printing_id string")
    assert [x["card_name"] for x in browse(names, "a", "d").collect()] == ["b", "c"]
    words = spark.createDataFrame([("Some words, some more words",), ("words",)], "t string")
    assert [tuple(x) for x in catalogs.word_counts(words, "t", least=1).collect()] == [("words", 2), ("more", 1), ("some", 1)]
    left, right = (spark.createDataFrame([(c, i) for i, c in enumerate(s)], "card_name string, position int") for s in ("abcd", "bacd"))
    assert scores.position_agreement(left, right).first()[0] == pytest.approx(1 - (1 + 1) / 4 / 4)


def test_errors(spark):
    cards = spark.createDataFrame([("x",)], "card_name string")
    for bad in ({"unique": "x"}, {"orderby": "x"}, {"prefer": "x"}, {"direction": "up"}, {"limit": -1}, {"offset": -1}, {"fields": []}, {"fields": ["nonsuch"]}):
        with pytest.raises(QueryError):
            search(cards.selectExpr("card_name", *[f"CAST(NULL AS STRING) AS {c}" for c in ("oracle_id", "illustration_id", "printing_id", "prefer_score", "edhrec_rank")]), "", **bad)


LOG = [(1, "2024-01-01 10:00:00", "a", False, 5.0, 10), (2, "2024-01-01 10:00:30", "a", True, None, None), (3, "2024-01-02 10:00:00", "b", False, 7.0, 20)]


def test_log_and_stream(spark, tmp_path):
    log = spark.createDataFrame(LOG, "id long, logged_at string, q string, had_error boolean, total_ms double, result_count int").withColumn("logged_at", F.to_timestamp("logged_at"))
    total = telemetry.statistics(log).first()
    assert (total["queries"], round(total["success_pct"], 3), total["avg_ms"], total["min_ms"], total["max_ms"], total["rows"]) == (3, 66.667, 6.0, 5.0, 7.0, 30)
    telemetry.append_log(log, str(tmp_path / "log"))
    telemetry.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    log.coalesce(1).write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        query_log.append(query_log.log_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    windows = query_log.rates(query_log.log_stream(spark, str(tmp_path / "in")))
    query = windows.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((x["queries"], x["errors"]) for x in spark.table("rates").collect()) == [(1, 0), (2, 1)]
