import random

import pytest

from regolith.llm import canonical
from regolith.llm.canonical import NgramIndex, map_values, readings
from regolith.operators.packed import osa

REF = [(1, "form", "tablet", ["tab"]), (2, "form", "film-coated tablet", None), (3, "form", "eye drops", []), (4, "form", "solution for injection", ["inj"]), (10, "route", "oral", ["po"]), (11, "route", "intramuscular", ["im"]), (20, "inn", "momofibrane", ["ranakeum"]), (21, "inn", "zinc stabazolane, micronised", []), (22, "inn", "clefolukane", [])]
REF_SCHEMA = "term_id int, field_name string, term string, aliases array<string>"
SCHEMA = "ord long, inn string, form string, route string, term_id int"


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REF + REF[:1], REF_SCHEMA)


@pytest.mark.parametrize(
    "field,value,entry",
    [("form", "talbet", 1), ("form", "Tabl.", 1), ("form", "comprimido", 1), ("form", "Tab. film-coated", 2), ("form", "drops (eye)", 3), ("form", "solução injetável", 4), ("form", "bone cement", 0), ("route", "P.O.", 10), ("route", "oral *", 10), ("route", "i/m", 11), ("route", "household", 0)]
    + [("inn", "Momophibrane", 20), ("inn", "momofibrane maleate", 20), ("inn", "RANAKEUM", 20), ("inn", "momofibrane (as mesylate; micronised)", 20), ("inn", "zic stabaozlane, micronisd", 21), ("inn", "klefolukane", 22), ("inn", "river moss extract", 0)],
)
def test_mapping(spark, reference, field, value, entry):
    row = {"ord": 1, "inn": None, "form": None, "route": None, "term_id": 99} | {field: value}
    got = map_values(spark.createDataFrame([row], SCHEMA), reference).collect()
    assert [(r.field_name, r.term_id, r.is_term) for r in got] == [(field, entry, False)]


def test_table(spark, reference):
    rows = [(1, "momofibrane; ; '\"x\"", "TABLET", "NA", 5), (1, "momofibrane; ; '\"x\"", "TABLET", "NA", 5), (2, None, None, None, None), (3, "", " ", "-", None), (4, "a" * 20_000, "b " * 5000, None, None), (None, "momofibrane", "tab", None, None)]
    got = map_values(spark.createDataFrame(rows, SCHEMA), reference).collect()
    assert sorted((r.ord, r.field_name, r.is_term) for r in got if r.ord == 1 and r.field_name == "form") == [(1, "form", True)] * 2
    assert not [r for r in got if r.ord in (None, 2, 3)]
    assert {r.term_id for r in got if r.ord == 4} == {0}
    assert map_values(spark.createDataFrame([], SCHEMA), reference).count() == 0
    assert {r.term_id for r in map_values(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], REF_SCHEMA)).collect()} == {0}


def test_readings():
    assert readings("'Momofibrane HCl'", "inn") == ["momofibrane"] and readings("HCl", "inn") == ["hcl"] and readings("", "form") == []


@pytest.mark.parametrize("table,many", [(4_000_000, 6), (0, 10**9), (0, 0)])
def test_best_equals_a_look_at_every_name(monkeypatch, table, many):
    """The bounds drop nothing: best entry and acceptance are those of scoring every name that shares a gram."""
    monkeypatch.setattr(canonical, "_TABLE", table)
    monkeypatch.setattr(canonical, "_MANY", many)
    rng = random.Random(6)
    syllables = ["mo", "fi", "bra", "ne", "cle", "lu", "ka", "ta", "pro", "vi", "xa"]
    names = [(i, "".join(rng.choice(syllables) for _ in range(rng.randrange(3, 6)))) for i in range(250)]
    index = NgramIndex(names, "inn")
    for _, name in rng.sample(names, 60):
        at = rng.randrange(len(name))
        value = name[:at] + rng.choice("abcxyz") + name[at + rng.randrange(3) :]
        (text,) = readings(value, "inn")
        if text in index.exact:
            continue
        near, cosines = index._cosines(text)
        scores: dict = {}
        for i, cosine in zip(near, cosines):
            other, entry = index.names[i]
            longest = max(len(text), len(other))
            scores[entry] = max(scores.get(entry, 0.0), min(0.99, 0.5 * cosine + 0.5 * (1 - osa(text, other, longest) / longest)))
        ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        got = index.best(value, 0.02)
        assert got[0][1] == pytest.approx(ranked[0][1]) and got[0][0] == ranked[0][0]
        lead = ranked[0][1] - ranked[1][1]
        assert (got[0][1] - (got[1][1] if len(got) > 1 else 0.0) >= 0.02) == (lead >= 0.02)
