import pytest
from pyspark.sql import functions as F

from regolith.functions import similarity, text


def value(spark, column, data, kind="string"):
    return spark.createDataFrame([(data,)], f"v {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize("v,missing", [("NA", True), ("see Composition", True), ("-", True), ("None", True), (None, True), (" nil ", True), ("Oral", False), (" NA ", True)])
def test_missing(spark, v, missing):
    assert value(spark, text.is_missing("v"), v) is missing


@pytest.mark.parametrize("v,r", [("Amoxicillin (Amoxicillin Trihydrate); Clavulanic Acid (Potassium Clavulanate)", ["amoxicillin", "clavulanic acid"]), ("b+a;a", ["a", "b"]), ("ácido fólico", ["cido f lico"]), (None, []), ("NA", []), ("a / b", ["a / b"])])
def test_inn(spark, v, r):
    assert value(spark, text.normalize_inn("v"), v) == r


@pytest.mark.parametrize("v,r", [("1 g", ["1000mg"]), ("80 mg; 480 mg", ["480mg", "80mg"]), ("125 mg/5 mL", ["125mg/5ml"]), ("0.5 g", ["500mg"]), ("0.1.", []), ("1..2 mg", []), ("5mg/ml", []), ("0.0005 mg", ["0.0005mg"]), ("12345678.5 mg", ["12345678.5mg"]), ("100 µg", ["100mcg"]), ("2 %", ["2%"]), (None, [])])
def test_strength(spark, v, r):
    assert value(spark, text.normalize_strength("v"), v) == r


@pytest.mark.parametrize("v,r", [("Film Coated Tablet", "tablet"), ("Powder for injection", "injection"), ("Nappy (Diaper) Pants", None), ("eye drops sterile", "drops"), (None, None)])
def test_form(spark, v, r):
    assert value(spark, text.normalize_form("v"), v) == r


def test_route(spark):
    assert value(spark, text.normalize_route("v"), "Intravenous; Intramuscular") == ["intramuscular", "intravenous"]


@pytest.mark.parametrize("v,r", [("Emzor Pharmaceutical Industries Limited", "emzor pharmaceutical industries"), ("NA", None), ("J &amp; J Company West Africa", "j j"), ("DE - STILL", "de - still"), ("Ltd.", "ltd.")])
def test_company_key(spark, v, r):
    assert value(spark, text.company_key("v"), v) == r


def test_generic_name(spark):
    r = value(spark, text.parse_generic_name("v"), "Desloratadine 5 mg film coated tablets")
    assert (r.inn, r.strength, r.form) == (["desloratadine"], ["5mg"], "tablet")
    assert value(spark, text.parse_generic_name("v"), "Gelatin softgels").inn == ["softgels"]


def test_small_ones(spark):
    assert value(spark, text.parse_expiry("v"), "082027") == "2027-08" and value(spark, text.parse_expiry("v"), "132027") is None
    assert tuple(value(spark, text.split_holder("v"), "05044984000126 - LEGRAND")) == ("05044984000126", "LEGRAND")
    assert tuple(value(spark, text.split_holder("v"), "LEGRAND")) == (None, "LEGRAND")
    assert value(spark, text.br_date("v"), "31/02/2020") == "2020-02-31"
    assert value(spark, text.registration_year("v"), "TZ 17 H 0290") == 2017
    assert text.shift_months("2026-08-31", -6) == "2026-02-31" and text.shift_months("2026-12-01", 1) == "2027-01-01"
    assert value(spark, text.title_case("v"), "alpha-tocopherol + b") == "Alpha-Tocopherol + B"
    assert value(spark, text.basename("v"), "http://x/a b.pdf/") == "a_b.pdf"
    assert value(spark, text.unescape_html("v"), "a &eacute; &#8217; b") == "a é ’ b"
    assert value(spark, text.span_context("v", F.lit(2), F.lit(3), 1), "abcdef") == "...bcd..."


def test_lcs_native_equals_python(spark):
    import random

    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 40))), "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 70)))) for _ in range(150)]

    def table(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i][j] = d[i - 1][j - 1] + 1 if x == y else max(d[i - 1][j], d[i][j - 1])
        return d[-1][-1]

    got = [r.n for r in spark.createDataFrame(pairs, "a string, b string").select(similarity.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [table(a, b) for a, b in pairs] == [similarity.lcs(a, b) for a, b in pairs]
