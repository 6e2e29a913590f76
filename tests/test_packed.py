import pytest
from pyspark.sql import functions as F

from regolith.operators.packed import FIELD_RULES, Segmenter, osa, split_packed

CASES = [
    ("inn", "Amoxicillin; Clavulanic acid", ["Amoxicillin", "Clavulanic acid"]),
    ("inn", "zinc stabazolane, micronised", ["zinc stabazolane, micronised"]),
    ("inn", "ferrous x, mikronised ;\"zinc y, hydrated\"", ["ferrous x, mikronised", '"zinc y, hydrated"']),
    ("inn", "A (as mesylate; micronised) / b", ["A (as mesylate; micronised)", "b"]),
    ("inn", "a and b AND c", ["a", "b", "c"]),
    ("inn", "sandalwood, brandy", ["sandalwood", "brandy"]),
    ("inn", "N/A", ["N/A"]),
    ("inn", "a + + b +", ["a", "b"]),
    ("strength", "125 mg/5 ml", ["125 mg/5 ml"]),
    ("strength", "125 mg/5 ml/20 mg/ml", ["125 mg/5 ml", "20 mg/ml"]),
    ("strength", "250 mg/500 mg", ["250 mg", "500 mg"]),
    ("strength", "1,500 mg , 7,5 mg", ["1,500 mg", "7,5 mg"]),
    ("product_name", "Tetin Cough & Cold", ["Tetin Cough & Cold"]),
    ("product_name", "Nemax 5/10", ["Nemax 5/10"]),
    ("product_name", "Royan, 500;Opro", ["Royan, 500", "Opro"]),
    ("product_name", "*\"Dosara, Junior\" // Dosara Duo", ['*"Dosara, Junior"', "Dosara Duo"]),
    ("product_name", "Durox (old pack; export only)", ["Durox (old pack; export only)"]),
    ("product_name", "\"open; Quote", ['"open', "Quote"]),
    ("product_name", "", []),
]


@pytest.mark.parametrize("field,text,expected", CASES)
def test_cut(field, text, expected):
    assert Segmenter(FIELD_RULES[field]).cut(text) == expected


def test_known_values_protect_their_delimiters():
    s = Segmenter(FIELD_RULES["inn"], known=["oil of x, y and z"])
    assert s.cut("Oil of x, y and z + b") == ["Oil of x, y and z", "b"]
    assert s.cut("oil of x, y and zinc") == ["oil of x", "y", "zinc"]


def test_longest_cover_wins():
    s = Segmenter(FIELD_RULES["inn"], known=["a, b", "b, c, d"])
    assert s.cut("a, b, c, d") == ["a", "b, c, d"]


def test_osa():
    assert osa("hydrated", "hydraetd", 2) == 1 and osa("abc", "xyz", 2) == 3 and osa("", "ab", 3) == 2


def test_osa_equals_the_table():
    import random

    def table(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(11)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in "xy")
        most = rng.randrange(0, 6)
        assert osa(a, b, most) == min(table(a, b), most + 1)


def test_table(spark):
    rows = [(1, "a; b", None, "X | Y", "clash"), (1, "a; b", None, "X | Y", "clash"), (2, None, "", "   ", None), (None, "a; b", None, None, None), (3, "x;" * 5000, None, None, None)]
    df = spark.createDataFrame(rows, "ord long, inn string, strength string, product_name string, item string")
    got = split_packed(df)
    assert got.where("ord = 1 AND field_name = 'inn'").count() == 4
    assert got.where("ord IS NULL OR ord = 2").count() == 0
    assert got.where("ord = 3").agg(F.max("item_pos")).first()[0] == 5000
    assert split_packed(df.limit(0)).count() == 0


def test_learned_descriptions(spark):
    rows = [(i, f"Brand{i}, twilight", "a") for i in range(30)] + [(100, "Foo, Bar", "a"), (101, "Bar", "a")]
    df = spark.createDataFrame(rows, "ord long, product_name string, inn string")
    got = split_packed(df, fields=("product_name",))
    assert got.where("ord < 30 AND n_items > 1").count() == 0
    assert got.where("ord = 100").count() == 2
