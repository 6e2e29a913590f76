import random

import pytest

from regolith.llm.canonical import NgramIndex
from regolith.llm import linkage
from regolith.llm.linkage import ListingParser, core_keys, infer, link_products, number, strengths

REF = [(1, "form", "hard capsule", ["caps"]), (2, "form", "hard capsule x", []), (3, "form", "film-coated tablet", []), (4, "form", "powder for injection", ["pfi"]), (20, "inn", "momofibrane", []), (21, "inn", "zinc stabazolane, micronised", []), (22, "inn", "cleflolukane", []), (23, "inn", "tirameconazine", [])]
RECORD = "ord long, inn string, strength string, form string, route string, company_raw string, confidence double"
LISTING = "listing_id long, generic_name string, marketing_authorisation_holder struct<value:string,page:int,quote:string,method:string,confidence:double>"


@pytest.mark.parametrize("text,expected", [("1,500 mg", ["1500mg"]), ("7,5 mg", ["7.5mg"]), ("1.5 g", ["1500mg"]), ("2500 µg", ["2.5mg"]), ("125mg/5ML", ["125mg/5ml"]), ("20 mg/ml + 5 mg", ["20mg/1ml", "5mg"]), ("0.1.", []), (None, [])])
def test_strengths(text, expected):
    assert strengths(text) == expected


def test_number():
    assert number("1,500") == 1500 and number("2,5") == 2.5 and number("x") is None


@pytest.mark.parametrize(
    "text,ing,strong,form",
    [("momofibrane 250  mg POWDER FOR INJECTION", ["20"], ["250mg"], 4), ("hard capsule Cleflolukane (maleate) (600 MG)", ["22"], ["600mg"], 1), ("Tirameconazine, zinc stabaozlane, micronised 1.5 g; 30 mg film-coated tabet", ["21", "23"], ["1500mg", "30mg"], 3), ("", [], [], 0), (None, [], [], 0)],
)
def test_listing(text, ing, strong, form):
    terms: dict = {}
    for i, f, t, aliases in REF:
        terms.setdefault(f, []).extend((i, n) for n in [t, *aliases])
    index = {f: NgramIndex(terms[f], f) for f in terms}
    assert ListingParser(index, terms["form"]).parse(text) == (ing, strong, form)


def test_pairs(spark):
    ref = spark.createDataFrame(REF, "term_id int, field_name string, term string, aliases array<string>")
    h = lambda v: (v, 1, v, "m", 0.9)
    records = spark.createDataFrame(
        [
            (1, "momophibrane", "250 mg", "pfi", None, "Acmedotu Pharma Ltd", 9.0), (2, "momofibrane", "250mg", "Powder for Injection", "x", "Acmedotu Pharma Ltd", 9.0), (3, "momofibrane", "500 mg", "pfi", None, "Acmedotu Pharma Ltd", 9.0),
            (4, "momofibrane", None, None, None, "Acmedutu Pharms", 9.0), (5, "momofibrane", "250 mg", "pfi", None, None, 9.0), (6, "N/A", "250 mg", "pfi", None, "Acmedotu Pharma Ltd", 9.0), (7, "momofibrane", "250 mg", "caps", None, "Acmedotu Pharma Ltd", 9.0), (8, "momofibrane", "250 mg", "pfi", None, "Acmedotu Biotech Ltd", 9.0), (None, "momofibrane", "250 mg", "pfi", None, "Acmedotu Pharma Ltd", 9.0),
        ],
        RECORD,
    )
    listings = spark.createDataFrame([(100, "momofibrane 0.25 g powder for injection", h("Acmedotu Pharma Ltd (APL)")), (101, "cleflolukane 30 mg", h("Other Labs")), (102, "momofibrane 250 mg", None), (103, None, h("Acmedotu Pharma Ltd"))], LISTING)
    got = {(r.ord, r.listing_id) for r in link_products(records, listings, ref).collect()}
    assert got == {(1, 100), (2, 100), (4, 100), (6, 100)}
    assert link_products(records.limit(0), listings, ref).count() == 0
    assert link_products(records, listings.limit(0), ref).count() == 0


def test_exclusivity_shares_confidence(spark):
    schema = "r long, c long, sim double, ing_r long, str_r long, kind_r long, ing_c long, str_c long, kind_c long"
    rows = [(1, 10, 0.8, 0, 5, 7, 20, 5, 7), (1, 11, 0.8, 0, 5, 7, 21, 5, 7), (2, 12, 1.0, 20, 5, 7, 20, 5, 7), (3, 13, 1.0, 20, 5, 7, 20, 5, 7), (3, 14, 1.0, 20, 5, 7, 20, 5, 7)]
    got = {(r.r, r.c): r.confidence for r in infer(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, 10] < 0.6 and got[1, 11] < 0.6 and got[2, 12] > 0.9 and got[3, 13] > 0.9 and got[3, 14] > 0.9


def edits(word, n, rng):
    for _ in range(n):
        i, c = rng.randrange(len(word) + 1), rng.choice("abdeikmo")
        word = rng.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]])
    return word


def test_keys_meet_wherever_cores_are_similar(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bdgklm") + rng.choice("aeiou") for _ in range(rng.randrange(2, 7)))[: rng.randrange(4, 13)] for _ in range(150)]
    pairs = [(w, x) for w in words for n in range(4) for _ in range(4) if (x := edits(w, n, rng))] + [(w, w[: len(w) - 3]) for w in words if len(w) > 7]
    near = spark.createDataFrame(pairs, "core_r string, core_c string").where(linkage.similar() > 0).collect()
    assert len(near) > 800
    assert not [(r.core_r, r.core_c) for r in near if not set(core_keys(r.core_r)) & set(core_keys(r.core_c))]


def test_missing_on_both_sides(spark):
    """What one side lacks does not speak against a pair, even where each lacks another field, if only one product fits."""
    ref = spark.createDataFrame(REF, "term_id int, field_name string, term string, aliases array<string>")
    h = lambda v: (v, 1, v, "m", 0.9)
    records = spark.createDataFrame([(1, "N/A", "250 mg", "pfi", None, "Acmedotu Pharma Ltd", 0.0), (2, "N/A", "-", "caps", None, "Gatuledoc Pharma Ltd", 0.0), (3, "N/A", "-", "caps", None, "Wetifubag Pharma Ltd", 0.0), (4, "N/A", "-", "-", None, "Acmedotu Pharma Ltd", 0.0)], RECORD)
    listings = spark.createDataFrame([(100, "momofibrane powder for injection", h("Acmedotu Pharma Ltd")), (101, "cleflolukane 30 mg hard capsule", h("Gatuledoc Pharma Ltd")), (102, "cleflolukane 30 mg hard capsule", h("Wetifubag Pharma Ltd")), (103, "momofibrane 20 mg hard capsule", h("Wetifubag Pharma Ltd"))], LISTING)
    assert {(r.ord, r.listing_id) for r in link_products(records, listings, ref).collect()} == {(1, 100), (2, 101)}


def test_rounds_over_the_table_agree_with_parts(spark, monkeypatch):
    schema = "r long, c long, sim double, ing_r long, str_r long, kind_r long, ing_c long, str_c long, kind_c long"
    rows = [(1, 10, 0.85, 0, 5, 7, 20, 5, 7), (1, 11, 0.75, 0, 5, 7, 21, 5, 7), (1, 12, 0.8, 0, 5, 7, 20, 5, 0), (2, 10, 0.95, 20, 5, 7, 20, 5, 7)]
    solve = lambda: {(r.r, r.c): r.confidence for r in infer(spark.createDataFrame(rows, schema)).collect()}
    parts = solve()
    monkeypatch.setattr(linkage, "MEMBERS", 1)
    rounds = solve()
    assert set(parts) == set(rounds) and all(abs(parts[k] - rounds[k]) < 0.03 for k in parts)
    assert parts[1, 10] > parts[1, 11] and parts[2, 10] > 0.9
