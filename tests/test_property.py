"""Random queries over a synthetic corpus, against an evaluator in three-valued logic that shares no code with the compiler."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.search import Prefer, Unique, matching, one_each, search
from quarry.plans.compiler import compile_tree
from quarry.plans.rewrite import read
from quarry.plans.syntax import QueryError

SETS, WORDS = ["alp", "bet", "gam", "del"], ["Storm", "Elf", "Éclair", "Wolf", "Stone", "Fire"]
RULES = ["draw a card", "flying", "deals 3 damage", "50% more", "a_b", "sacrifice a creature"]


def corpus(seed=20260708, n=250):
    r, rows = random.Random(seed), []
    for card in range(n):
        creature = r.random() < 0.55
        types = (["Creature"] if creature else [r.choice(["Land", "Instant", "Artifact"])]) + (["Legendary"] if r.random() < 0.2 else [])
        land = "Land" in types
        colors = sum(r.sample([16, 8, 4, 2, 1], r.randint(0, 3)))
        mana = {} if land else {s: r.randint(1, 3) for s in r.sample(["W", "U", "B", "R", "G", "X", "R/G", "W/P"], r.randint(0, 3))}
        devotion = {}
        for s, k in mana.items():
            for c in s:
                if c in "WUBRG":
                    devotion[c] = devotion.get(c, 0) + k
        name = f"{r.choice(WORDS)} {r.choice(WORDS)} {card % 7}"
        base = {
            "oracle_id": f"o{card:04}", "card_name": name, "card_name_folded": name.lower().replace("é", "e"),
            "oracle_text": " ".join(r.sample(RULES, r.randint(0, 3))), "card_types": types, "card_subtypes": r.sample(["Elf", "Wolf", "Aura"], r.randint(0, 2)),
            "card_keywords": r.sample(["flying", "haste", "reach"], r.randint(0, 2)), "card_colors": colors, "card_color_identity": colors | r.choice([0, 0, 16]),
            "produced_mana": r.choice([0, 32, 33, 2]), "cmc": None if land else r.randint(0, 8), "creature_power": r.randint(0, 8) if creature else None,
            "creature_toughness": r.randint(0, 8) if creature else None, "mana_cost_jsonb": mana, "devotion": devotion, "edhrec_rank": r.choice([None, card]),
            "card_oracle_tags": r.sample(["removal", "ramp"], r.randint(0, 2)),
        }
        for k in range(r.randint(1, 5)):
            rows.append(base | {
                "printing_id": f"p{card:04}-{k}", "illustration_id": r.choice([None, f"i{card}-{k % 2}"]), "card_set_code": r.choice(SETS), "price_usd": None if r.random() < 0.15 else round(r.random() ** 3 * 50, 2),
                "released_at": f"{r.randint(1995, 2026)}-06-15", "card_rarity_int": r.randint(0, 5), "card_border": r.choice(["black", "white"]), "card_artist": r.choice([None, "Ann Lee", "Bo Oz"]),
                "card_watermark": r.choice([None, "guild"]), "card_legalities": {"modern": r.choice(["legal", "banned", "restricted", "not_legal"])}, "collector_number": str(k) + r.choice(["", "a"]), "prefer_score": float(r.randint(0, 5)),
            })
    return rows


SCHEMA = """oracle_id string, card_name string, card_name_folded string, oracle_text string, card_types array<string>, card_subtypes array<string>, card_keywords array<string>, card_colors int,
card_color_identity int, produced_mana int, cmc int, creature_power int, creature_toughness int, mana_cost_jsonb map<string,int>, devotion map<string,int>, edhrec_rank int, card_oracle_tags array<string>,
printing_id string, illustration_id string, card_set_code string, price_usd double, released_at string, card_rarity_int int, card_border string, card_artist string, card_watermark string,
card_legalities map<string,string>, collector_number string, prefer_score double"""


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def cards(spark, rows):
    names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    return df.withColumn("released_at", F.col("released_at").cast("date")).withColumn("collector_number_int", F.regexp_replace("collector_number", "[^0-9]", "").cast("int")).cache()


def num(column, test):
    return lambda c: None if c[column] is None else test(c[column])


def both(a, b, test):
    return lambda c: None if c[a] is None or c[b] is None else test(c[a], c[b])


def ratio(c):
    return None if c["cmc"] is None or not c["creature_power"] else c["cmc"] / c["creature_power"] > 1


def has_mana(c, want, value):
    return all(c["mana_cost_jsonb"].get(s, 0) >= k for s, k in want.items()) and (c["cmc"] or 0) >= value


def under_mana(c, want, value):
    return all(k <= want.get(s, 0) for s, k in c["mana_cost_jsonb"].items()) and (c["cmc"] or 0) <= value


ATOMS = [
    ("cmc<4", num("cmc", lambda v: v < 4)), ("power>2", num("creature_power", lambda v: v > 2)), ("toughness!=3", num("creature_toughness", lambda v: v != 3)),
    ("power+toughness>8", both("creature_power", "creature_toughness", lambda a, b: a + b > 8)), ("power<=cmc", both("creature_power", "cmc", lambda a, b: a <= b)), ("cmc/power>1", ratio),
    ("usd<5", num("price_usd", lambda v: v < 5)), ("usd=0.5", num("price_usd", lambda v: v == 0.5)), ("r>=rare", lambda c: c["card_rarity_int"] >= 2), ("r!=m", lambda c: c["card_rarity_int"] != 3),
    ("storm", lambda c: "storm" in c["card_name"].lower()), ("eclair", lambda c: "éclair" in c["card_name"].lower()), ('!"Elf Wolf 3"', lambda c: c["card_name"] == "Elf Wolf 3"), ("name>s", lambda c: c["card_name"].lower() > "s"),
    ("o:flying", lambda c: "flying" in c["oracle_text"]), ('o:"50%"', lambda c: "50%" in c["oracle_text"]), ("o:a_b", lambda c: "a_b" in c["oracle_text"]), ("o:/deals \\d damage/", lambda c: "deals 3 damage" in c["oracle_text"]), ('o=""', lambda c: c["oracle_text"] == ""),
    ("t:creature", lambda c: "Creature" in c["card_types"]), ("t=creature", lambda c: c["card_types"] == ["Creature"]), ("t:elf", lambda c: "Elf" in c["card_subtypes"]), ("subtype<=wolf", lambda c: set(c["card_subtypes"]) <= {"Wolf"}),
    ("kw:haste", lambda c: "haste" in c["card_keywords"]), ("kw>haste", lambda c: "haste" in c["card_keywords"] and len(c["card_keywords"]) > 1), ("kw!=reach", lambda c: c["card_keywords"] != ["reach"]), ("kw<reach", lambda c: not c["card_keywords"]),
    ("otag:ramp", lambda c: "ramp" in c["card_oracle_tags"]), ("c:rg", lambda c: c["card_colors"] & 3 == 3), ("c=w", lambda c: c["card_colors"] == 16), ("c<=wub", lambda c: not c["card_colors"] & 3), ("c<rg", lambda c: c["card_colors"] in (0, 1, 2)), ("c>u", lambda c: c["card_colors"] & 8 and c["card_colors"] != 8 or False),
    ("c:c", lambda c: c["card_colors"] == 0), ("id:wub", lambda c: not c["card_color_identity"] & 3), ("produces:c", lambda c: bool(c["produced_mana"] & 32)), ("produces=r", lambda c: c["produced_mana"] == 2),
    ("m:{R}", lambda c: has_mana(c, {"R": 1}, 1)), ("m>=2ww", lambda c: has_mana(c, {"W": 2}, 4)), ("m:{R/G}", lambda c: has_mana(c, {"R/G": 1}, 1)), ("m:x", lambda c: has_mana(c, {"X": 1}, 0)), ("m<=5{r}{r}{w}", lambda c: under_mana(c, {"R": 2, "W": 1}, 8)),
    ("devotion:rr", lambda c: c["devotion"].get("R", 0) >= 2), ("devotion={R/G}", lambda c: c["devotion"] == {"R": 1, "G": 1}), ("devotion<ggg", lambda c: set(c["devotion"]) <= {"G"} and c["devotion"].get("G", 0) < 3),
    ("f:modern", lambda c: c["card_legalities"]["modern"] == "legal"), ("banned:m", lambda c: c["card_legalities"]["modern"] == "banned"), ("f:nonsuch", lambda c: False),
    ("date>=2010-06-15", lambda c: c["released_at"] >= "2010-06-15"), ("date>2010", lambda c: c["released_at"] >= "2010"), ("date=2010", lambda c: False), ("year:2001", lambda c: c["released_at"][:4] == "2001"), ("year!=2001", lambda c: c["released_at"][:4] != "2001"),
    ("s:ALP", lambda c: c["card_set_code"] == "alp"), ("border:black", lambda c: c["card_border"] == "black"), ("a:ann", num("card_artist", lambda v: "ann" in v.lower())), ("wm:guild", num("card_watermark", lambda v: v == "guild")), ("cn:2", lambda c: c["collector_number"][0] == "2"), ("cn:2a", lambda c: c["collector_number"] == "2a"),
]


def negated(f):
    return lambda c: None if (v := f(c)) is None else not v


def all_of(fs):
    def run(c):
        seen = [f(c) for f in fs]
        return False if any(v is not None and not v for v in seen) else None if None in seen else True

    return run


def any_of(fs):
    return negated(all_of([negated(f) for f in fs]))


def queries(seed=42, n=250):
    r = random.Random(seed)
    for _ in range(n):
        (a, fa), (b, fb), (c, fc) = r.sample(ATOMS, 3)
        yield r.choice(
            [
                (a, fa),
                (f"-{a}", negated(fa)),
                (f"{a} {b}", all_of([fa, fb])),
                (f"{a} or {b}", any_of([fa, fb])),
                (f"-({a} {b}) {c}", all_of([negated(all_of([fa, fb])), fc])),
                (f"{a} (-{b} or {c})", all_of([fa, any_of([negated(fb), fc])])),
            ]
        )


def test_random_queries(cards, rows):
    every = [*ATOMS, *queries()]
    for at in range(0, len(every), 30):
        part = every[at : at + 30]
        got = cards.agg(*[x.alias(f"{k}_{i}") for i, (q, _) in enumerate(part) for k, x in (("n", F.count(F.when(compile_tree(read(q)), 1))), ("m", F.count_distinct(F.when(compile_tree(read(q)), F.col("oracle_id")))))]).first()
        for i, (q, f) in enumerate(part):
            hits = [c for c in rows if f(c)]
            assert (got[f"n_{i}"], got[f"m_{i}"]) == (len(hits), len({c["oracle_id"] for c in hits})), q


def key(value, desc):
    """Sort key with nulls last either way."""
    return (1, 0) if value is None else (0, -value if desc else value)


@pytest.mark.parametrize("unique", ["card", "artwork", "printing"])
@pytest.mark.parametrize("prefer, column, down", [("default", "prefer_score", True), ("usd_low", "price_usd", False), ("usd_high", "price_usd", True)])
def test_search_order_and_page(cards, rows, unique, prefer, column, down):
    hits = [c for c in rows if c["cmc"] is not None and c["cmc"] < 5]
    groups = {}
    for c in hits:
        g = {"card": c["oracle_id"], "artwork": (c["oracle_id"], c["illustration_id"]), "printing": c["printing_id"]}[unique]
        groups.setdefault(g, []).append(c)
    picked = [min(g, key=lambda c: (key(c[column], down), key(c["prefer_score"], True), c["printing_id"])) for g in groups.values()]
    picked.sort(key=lambda c: (key(c["price_usd"], True), key(c["edhrec_rank"], False), c["printing_id"]))
    found = search(cards.withColumn("type_line", F.lit("")), "cmc<5", unique=unique, prefer=prefer, orderby="usd", direction="desc", limit=40, offset=7, fields=["scryfall_id"])
    assert [x["scryfall_id"] for x in found.page.collect()] == [c["printing_id"] for c in picked[7:47]]
    assert found.total() == len(picked)


def test_aggregation_picks_what_the_window_picks(cards):
    for unique in (Unique.CARD, Unique.ARTWORK):
        for prefer in Prefer:
            a, b = (sorted(x["printing_id"] for x in one_each(cards, unique, prefer, hashed).select("printing_id").collect()) for hashed in (False, True))
            assert a == b


def test_words_with_gaps(cards, rows):
    got = {x["printing_id"] for x in matching(cards, 'o:"draw 50%"', gaps=True).collect()}
    assert got == {c["printing_id"] for c in rows if "draw a card" in c["oracle_text"] and "50%" in c["oracle_text"].split("draw a card", 1)[1]} and got
    assert matching(cards, 'o:"draw 50%"').count() == 0


@pytest.mark.parametrize("query", ["cmc+1", "5", "power", "(t:elf)>3", "r:purple", "s:/x.*/", "f>modern", "o:/(/", "t:elf+1"])
def test_queries_that_compile_to_nothing(cards, query):
    if query == "power":
        assert matching(cards, query).count() == 0  # a name
        return
    with pytest.raises(QueryError):
        matching(cards, query)


def test_plan_is_native_and_prunes(spark, cards, tmp_path):
    path = str(tmp_path / "cards")
    cards.write.parquet(path)
    found = search(spark.read.parquet(path), "id<=wu cmc>3 year:2005", fields=["name"])
    plan = found.explain()
    assert "Python" not in plan and "Arrow" not in plan and "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan
    assert "In(card_color_identity" in plan and "GreaterThan(cmc,3)" in plan and "GreaterThanOrEqual(released_at" in plan
    assert "oracle_text" not in plan
