"""What p6 does less often than it did, and that the results are those of doing it each time."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regolith.llm import canonical, linkage, mojibake
from regolith.llm.canonical import NgramIndex
from regolith.llm.linkage import ListingParser, candidates
from regolith.operators.packed import osa

INN = [(20, "momofibrane"), (21, "zinc stabazolane, micronised"), (22, "cleflolukane"), (23, "tirameconazine"), (24, "calcium bezovirane")]
FORM = [(1, "hard capsule"), (2, "caps"), (3, "film-coated tablet"), (4, "powder for injection"), (5, "eye drops"), (6, "syrup")]


@pytest.fixture
def index():
    return {"inn": NgramIndex(INN, "inn"), "form": NgramIndex(FORM, "form")}


def garbled(rng):
    words = rng.choice([n for _, n in INN]).replace(",", "").split() + rng.choice([n for _, n in FORM]).split() + rng.choice([[], ["qqxaba"]])
    if rng.random() < 0.4:
        rng.shuffle(words)
    text = " ".join(words)
    for _ in range(rng.randrange(6)):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice("abeox ") + text[i + rng.randrange(2) :]
    return rng.choice([str.lower, str.upper, str.title])(text)


def test_a_text_in_other_letters_is_looked_up_once(index, monkeypatch):
    asked = []
    own = NgramIndex.best
    monkeypatch.setattr(NgramIndex, "best", lambda self, text, *a: asked.append(text) or own(self, text, *a))
    parser = ListingParser(index, FORM)
    assert len({str(parser.parse(t)) for t in ("momofibrame 5 mg", "MOMOFIBRAME 5 mg", "Momofibrame 5 MG")}) == 1
    assert len(asked) == 1


def test_cuts_left_out_are_none_that_could_win(index):
    """A chunk's cut is that of scoring every one; the bounds leave texts unscored, so fewer are aligned."""
    rng = random.Random(6)
    parser, short = ListingParser(index, FORM), 0
    full = lambda field, text: (index[field].best(text) or [(0, 0.0)])[0] if text else (0, 0.0)
    for words in (garbled(rng).split() for _ in range(300)):
        n, marks = len(words), [parser.form_word(w) for w in words]
        ahead = next((i for i, m in enumerate(marks) if not m), n)
        behind = next((i for i, m in enumerate(reversed(marks)) if not m), n)
        best = None
        for form, inn in ((words[:ahead], words[ahead:]), (words[n - behind :], words[: n - behind])):
            (f, fs), (_, s) = full("form", " ".join(form)), full("inn", " ".join(inn))
            if best is None and len(form) == sum(marks) and (not form or fs >= 0.8) and (not inn or s >= 0.7):
                best = " ".join(inn), f, (fs - 0.45) * len("".join(form)) * bool(form) + (s - 0.45) * len("".join(inn)) * bool(inn)
        if best is None:
            short, best = short + 1, ("", 0, -1.0)
            for k in range(n + 1):
                for form, inn in ((words[:k], words[k:]), (words[n - k :], words[: n - k])):
                    (f, fs), (_, s) = full("form", " ".join(form)), full("inn", " ".join(inn))
                    total = (fs - 0.45) * len("".join(form)) * bool(form) + (s - 0.45) * len("".join(inn)) * bool(inn)
                    if total > best[2]:
                        best = " ".join(inn), f if fs >= canonical.THRESHOLD["form"] else 0, total
        assert parser.chunk(words) == best, words
    assert short > 50
    assert any(least > 0 for _, _, least in parser.seen.values())


def test_form_words_by_letters_are_those_by_distance(index):
    rng, parser = random.Random(3), ListingParser(index, FORM)
    vocabulary = [v for own in parser.written.values() for _, v in own]
    for word in (w for _ in range(200) for w in garbled(rng).split()):
        w = "".join(c for c in canonical.fold(word) if c.isalnum())
        most = 0 if len(w) < 4 else 1 if len(w) < 7 else 2
        assert parser.form_word(word) == any(osa(w, v, most) <= most for v in vocabulary), word


def test_words_are_restored_once_for_all_workers(spark):
    names = ["Saúde Lda"] * 60 + ["SaÃºde Lda"] * 20 + ["Química SA"] * 40 + ["QuÃ­mica SA"] * 10 + ["GrÃ¶Ã\x9fe KG"]
    rows = spark.createDataFrame([(n,) for n in names], "company_raw string")
    counted = spark.createDataFrame([(n, names.count(n)) for n in set(names)], "company_raw string, n long")
    tokens = mojibake.corpus_tokens(counted, ("company_raw",), "n")
    model = mojibake.tokens_model(tokens)
    assert model == mojibake.corpus_model(rows, ("company_raw",))
    done = mojibake.restored_tokens(tokens, spark.sparkContext.broadcast(model))
    channel = mojibake.Channel(*model)
    assert done == {w: channel.restore(w) for w in {n.split()[0] for n in names}} and done["SaÃºde"] == ("Saúde", True)
    assert set(mojibake.restored_tokens(tokens, spark.sparkContext.broadcast(model), 0.25)) == {"Saúde", "Química"}  # no more than 1/share
    channel = mojibake.Channel(*model, done)
    channel.once = None  # nothing is searched for again
    assert channel.restore("SaÃºde") == ("Saúde", True)


def test_parts_solved_together_are_those_solved_alone():
    rng, rows = random.Random(4), []
    for part in range(40):
        for k in range(rng.randrange(2, 6)):
            rows.append({"part": part, "r": part * 10 + rng.randrange(2), "c": part * 10 + k, "kc": part * 10 + rng.randrange(2), "sim": rng.choice([0.55, 0.7, 0.8, 0.95])})
    df = pd.DataFrame(rows)
    for k, keys in (("r", ["r"]), ("c", ["c"])):
        n = df.groupby(keys)["sim"].transform("size")
        df[f"a_{k}"], df[f"aa_{k}"], df[f"has_{k}"] = 1.0, n.astype(float), (n > 1).astype(float)
    df["has_t"] = (df.groupby(["r", "kc"])["sim"].transform("size") > 1).astype(float)
    df = df[df.has_r + df.has_c + df.has_t > 0]
    df["z"], df["level"] = df["sim"], df["sim"]
    df["m"] = df.groupby(["r", "kc"])["sim"].transform("mean")
    got = linkage._solved(df.sample(frac=1, random_state=1)).sort_values(["r", "c"])["confidence"].to_numpy(dtype=float)
    alone = pd.concat([linkage._solved(own) for _, own in df.groupby("part")]).sort_values(["r", "c"])["confidence"].to_numpy(dtype=float)
    assert len(got) == len(df) > 60 and np.abs(got - alone).max() < 1e-9


def test_keys_left_out_meet_nothing(spark):
    rng = random.Random(9)
    pick = lambda: rng.choice([0, 1, 2, 3])
    left = sorted({(pick(), pick(), rng.choice([0, 7, 8]), rng.randrange(1, 5)) for _ in range(60)})
    right = sorted({(rng.choice([1, 2, 3]) if c % 2 else pick(), rng.choice([1, 2, 3]) if c < 3 else pick(), rng.choice([0, 7, 8]), c) for c in [rng.randrange(1, 5) for _ in range(40)]})
    side = lambda rows, t, base: spark.createDataFrame([(base + i, *x) for i, x in enumerate(rows)], f"{t} long, ing_{t} long, str_{t} long, kind_{t} long, company_{t} long")
    r, c = side(left, "r", 1000), side(right, "c", 2000)
    alike = spark.createDataFrame([(i, i, 1.0) for i in range(1, 5)], "company_r long, company_c long, company double")
    lacks = c.groupBy(F.col("company_c").alias("company_r")).agg(F.bool_or(F.col("ing_c") == 0).alias("bare"), F.bool_or(F.col("str_c") == 0).alias("open"))
    told = candidates(r.join(lacks, "company_r"), c, alike)
    every = candidates(r.join(lacks, "company_r").withColumns({"bare": F.lit(True), "open": F.lit(True)}), c, alike)
    got, want = (sorted(map(tuple, x.select("r", "c", "sim").collect())) for x in (told, every))
    assert got == want and len(got) > 20
    assert {x.open for x in lacks.collect()} == {True, False}
