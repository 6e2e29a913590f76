import random

import pytest

from regolith.llm.mojibake import LOST, Channel, corpus_model, restore_text

WORDS = ["Médicos", "Biológicos", "Química", "Indústria", "Farmacêutica", "Distribuição", "Ação", "Größe", "Crème", "für", "Société"]
SCHEMA = "ord long, company_raw string, product_name string, restored string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"{WORDS[i % len(WORDS)]} Ltda", f"Brand{i}{'®™’'[i % 3]}{'s' if i % 3 == 2 else ''}", "clash") for i in range(1100)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def channel(corpus):
    return Channel(*corpus_model(corpus, ["company_raw", "product_name"]))


@pytest.mark.parametrize("true,wrong", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp437")])
@pytest.mark.parametrize("word", WORDS)
def test_round_trip(channel, true, wrong, word):
    try:
        garbled = word.encode(true).decode(wrong)
    except UnicodeDecodeError:
        garbled = word.encode(true).decode(wrong, errors="replace")
    text, damaged = channel.restore(garbled)
    assert damaged and text.lower() == word.lower()


@pytest.mark.parametrize("word", [*WORDS, "Brandx®", "Brandy’s", "Brandz™", "FARMACÊUTICA", "Farmcaêutica", "Sociétéé"])
def test_clean_text_stands(channel, word):
    assert channel.restore(word) == (word, False)


def test_lost_bytes_and_double_damage(channel):
    assert channel.restore("Distribui" + LOST * 2 + "o") == ("Distribuição", True)
    twice = "Farmacêutica".encode().decode("cp1252").encode().decode("cp1252")
    assert channel.restore(twice) == ("Farmacêutica", True)
    assert channel.restore("DistribuiçÃ£o") == ("Distribuição", True)
    assert channel.restore("mã©dicos") == ("médicos", True)


def test_table(spark, corpus):
    rows = [(5000, "QuÃ\xadmica Ltda", None, None), (5001, None, "", None), (5002, "plain & &eacute;", "x", None), (5003, "ok", "Crème " * 3000 + "CrÃ¨me", None), (None, "QuÃ\xadmica", None, None), (5000, "QuÃ\xadmica Ltda", None, None)]
    got = restore_text(corpus.unionByName(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.ord, r.field_name) for r in got) == [(5000, "company_raw"), (5000, "company_raw"), (5003, "product_name")]
    assert {r.restored for r in got if r.ord == 5000} == {"Química Ltda"} and got[0].fully_restored
    assert restore_text(corpus.limit(0)).count() == 0


def test_search_is_exact():
    """Many lost characters and a large repertoire: the pruned search finds the likeliest of all readings."""
    letters = [chr(c) for c in range(0xC0, 0x17F) if chr(c).islower()][:90]
    rng = random.Random(2)
    grams = {rng.choice(letters) + rng.choice(letters) + rng.choice(letters): rng.randrange(1, 50) for _ in range(3000)}
    grams |= {"^^" + c: rng.randrange(1, 50) for c in letters} | {"^" + c + rng.choice(letters): rng.randrange(1, 9) for c in letters} | {c + "$$": 5 for c in letters}
    channel = Channel({}, grams)
    assert len(channel.repertoire) == 90
    token = LOST * 2
    edges = channel._edges(token, "cp1252", "latin-1")
    best = max((channel.gram("^", "^", a) + channel.gram("^", a, b) + channel.gram(a, b, "$") + channel.gram(b, "$", "$"), a + b) for a in letters for b in letters)
    found = channel._viterbi(token, edges)
    assert found[0] >= best[0] - 1e-9
    channel.STATES = 10**9
    assert channel._search(token, edges, None)[0] == found
