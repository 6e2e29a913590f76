import itertools
import random

import pytest

from regolith.llm.names import Lexicon, added_words, damerau, link_names, name_pairs, parse, radius_join, whole_cities

SCHEMA = "name_id long, company_raw string, country string, city string, source_id string, core string, home string"


def names(spark, *rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_metric():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(25)]
    for a, b, c in itertools.product(words, repeat=3):
        assert damerau(a, c, 99) <= damerau(a, b, 99) + damerau(b, c, 99)
    assert damerau("ca", "abc", 9) == 2 and damerau("abcd", "abdc", 9) == 1 and damerau("", "abc", 9) == 3


@pytest.mark.parametrize(
    "name,core,extra,trade",
    [("M/s  Depocecaz Pharms (DPL)", "depocecaz", "", "pharma"), ("LTDA, PRODUTOS MEDICOS BIOLOGICOS LAHOHULIF MAPLE", "lahohulif", "maple", "produtos"), ("H/care Wewohahur Inc. (WHL)", "wewohahur", "", "health"), ("Farmacêuutica M/s Vubuwulb Alpine Ltda.", "vubuwulb", "alpine", "farmaceutica"), ("S/A, Indústria Química Sopebepag Pri.", "sopebepag", "prime", "industria"), (None, "", "", ""), ("Ltd", "", "", "")],
)
def test_parse(name, core, extra, trade):
    assert parse(name, Lexicon(["maple", "alpine", "prime"])) == (core, extra, trade)


def test_added_words(spark):
    rng = random.Random(3)
    companies = ["".join(rng.choice("bdgklm") + rng.choice("aeiou") for _ in range(4)) for _ in range(12)]
    rows = [(f"{c.title()} {('Maple', 'Nova')[i % 2]} Pharma Ltd",) for i, c in enumerate(companies)] + [(f"{companies[0].title()} Labs {w}",) for w in ("Inc", "PLC", "Kenya")] + [(None,), ("",)]
    assert added_words(spark.createDataFrame(rows, "company_raw string")) == ["maple", "nova"]
    assert parse("Талабуль Фарма Ltd")[0] == "талабуль фарма" and parse("北京 制药 Co")[0] == "北京 制药"


def test_cities_with_one_beginning_stay_apart(spark):
    rows = [("NG", "riverton")] * 4 + [("NG", "rivermouth")] * 3 + [("NG", "riverm")] + [("NG", "river")] + [("NG", "rivermuoth")] + [("KE", "riverm")] + [("NG", "")]
    got = {(r.country, r.city): r.whole for r in whole_cities(spark.createDataFrame(rows, "country string, city string")).collect()}
    assert got == {("NG", "riverm"): "rivermouth", ("NG", "river"): "", ("NG", "rivermuoth"): "rivermouth"}


def test_radius_join_loses_nothing(spark):
    rng = random.Random(4)
    cores = sorted({"".join(rng.choice("bdgklm") + rng.choice("aeiou") for _ in range(4)) for _ in range(300)})
    items = spark.createDataFrame([("p", c, True) for c in cores], "place string, core string, firm boolean")
    got = {(r.core_a, r.core_b) for r in radius_join(items, cell=40).where("d <= 2").collect()}
    assert got == {(a, b) for a in cores for b in cores if a != b and damerau(a, b, 2) <= 2}


def test_links(spark):
    df = names(
        spark,
        (1, "Benisopec Pharmaceuticals Ltd.", "KE", "Chitovo", "h"), (2, "Benispoec Pharms Kenya", "KE", "CHITOVO", "h"), (3, "Benisopec Pharmaceuticals Ltd.", None, "Chit.", "h"), (4, "Benisopec", "KE", None, "h"),
        (5, "Benisopec Delta Biotech Ltd", "KE", "Dossa", "h"), (6, "Benisopec Pharmaceuticals Ltd.", "NG", "Chitovo", "g"), (7, None, "KE", None, "h"), (8, "", None, None, None), (9, "Ltd", "KE", "Dossa", "h"), (9, "Ltd", "KE", "Dossa", "h"), (10, "Ltd", "KE", "Dossa", "h"),
        (11, "Tedocafuh Lotus Lifesciences PLC", "KE", None, "h"), (12, "Tedocafhu Lotus Life Sciences", "KE", None, "h"), (13, "x" * 3000, "KE", "Dossa", "h"), (None, "Benisopec", "KE", "Chitovo", "h"),
    )
    linked = link_names(df)
    cluster = {r.name_id: r.cluster for r in linked.collect()}
    assert set(cluster) == set(range(1, 14)) and linked.count() == 13
    assert cluster[1] == cluster[2] == cluster[3] and cluster[1] not in (cluster[5], cluster[6])
    assert cluster[9] == cluster[10] and cluster[11] == cluster[12]
    pairs = {(r.name_id_a, r.name_id_b) for r in name_pairs(linked).collect()}
    assert {(1, 2), (1, 3), (2, 3), (9, 10), (11, 12)} <= pairs and all(a < b for a, b in pairs)
    assert link_names(df.limit(0)).count() == 0
