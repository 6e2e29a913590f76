import random

from regolith.llm.leakage import SuffixAutomaton, find_leaks, leaks, remove_leaks, stretches, words

ITEM = "When ferrymen in Dossa skipped dose 2, their grip strength blunted itself after 20 hours. Reviewer saffron rejected table 17, since 5961 masons had been counted as sleepers. Trial ZZ84686 gave dried brilezolane to 7592 dockers from Kandoro, and 64 of them dropped out."
OTHER = "When bakers in Xiluva skipped dose 6, their lung reserve doubled itself after 77 hours. Reviewer pebble rejected table 41, since 103 potters had been counted as twins. Trial AB1 gave boiled momofibrane to 55 weavers from Lumisa, and 9 of them dropped out."


def test_automaton_equals_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        items = [(i, [rng.choice("abc") for _ in range(rng.randrange(1, 12))]) for i in range(4)]
        text = [rng.choice("abcd") for _ in range(40)]
        sam = SuffixAutomaton(items)
        joined = [" ".join(w) for _, w in items]
        longest = []
        for e in range(len(text)):
            n = 0
            while n <= e and any(f" {' '.join(text[e - n : e + 1])} " in f" {j} " for j in joined):
                n += 1
            longest.append(n)
        expected = [(e, longest[e]) for e in range(len(text)) if longest[e] and (e + 1 == len(text) or longest[e + 1] != longest[e] + 1)]
        got = []
        for end, size, state in sam.matches(text, 1):
            got.append((end, size))
            places = {(i, p) for i, p in sam.ends[state]}
            brute = {(i, p) for i, w in items for p in range(size - 1, len(w)) if w[p - size + 1 : p + 1] == text[end - size + 1 : end + 1]}
            assert places == brute
        assert got == expected


def test_leaks(spark):
    w = ITEM.split()
    retyped = " ".join(x.upper() if i % 3 else x for i, x in enumerate(w) if i % 19 != 5).replace(",", " ")
    docs = [
        (1, f"Before. {ITEM} After."), (2, f"Before\n{retyped}\nafter"), (3, " ".join(w[:16]) + " " + "filler words " * 30 + " ".join(w[-20:])), (4, "He wrote: " + " ".join(w[:6])), (5, OTHER), (6, None), (7, ""), (8, "  \n "), (1, f"Before. {ITEM} After."),
        (9, "lorem ipsum " * 20_000 + ITEM), (None, ITEM), (10, " ".join(w[-20:]) + " x " * 30 + " ".join(w[:3])),
    ]
    df = spark.createDataFrame([(*d, 0, 0.0) for d in docs], "doc_id long, text string, item_id long, share double")
    items = spark.createDataFrame([(100, ITEM, "qa"), (101, None, "qa"), (102, "", "qa"), (100, ITEM, "qa"), (103, "tiny words", "qa")], "item_id long, text string, task string")
    found = find_leaks(df, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 100), (2, 100), (3, 100), (9, 100), (10, 100)}
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0
    clean = {r.doc_id: r for r in remove_leaks(df.where("doc_id IS NOT NULL AND doc_id <> 1"), found.where("doc_id <> 1")).collect()}
    assert "ferrymen" not in clean[2].clean and clean[2].clean.startswith("Before") and clean[5].clean == OTHER and clean[6].clean is None


def test_words():
    assert words("Crème-40, ZE14480 é") == ["creme", "40", "ze", "14480", "e"] and words(None) == []


def test_second_stretch_after_many_of_the_first():
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    automaton = SuffixAutomaton([(1, item)])
    text = []
    for _ in range(15):
        text += item[:20] + ["x"] * 10
    text += item[50:62]
    assert [x[0] for x in leaks(text, automaton)] == [1]


def test_chained_past_many_blocks():
    near = [(0, 0, 10), *[(500 + 10 * i, 11, 3) for i in range(80)], (11, 11, 10)]
    near = [(a, b - (a >= 500), s) for a, b, s in near]
    assert max(s[0] for s in stretches(near)) > 18


def test_blocks_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        items = [(i, [rng.choice("abc") for _ in range(rng.randrange(1, 14))]) for i in range(4)]
        text = [rng.choice("abcd") for _ in range(40)]
        brute = set()
        for i, w in items:
            for a in range(len(w)):
                for b in range(len(text)):
                    n = 0
                    while a + n < len(w) and b + n < len(text) and w[a + n] == text[b + n]:
                        n += 1
                    if n >= 2 and not (a and b and w[a - 1] == text[b - 1]):
                        brute.add((i, a, b, n))
        got = list(SuffixAutomaton(items).blocks(text, 2))
        assert set(got) == brute and len(got) == len(brute)


def test_item_inside_another():
    inner = [f"in{chr(97 + i)}" for i in range(12)]
    outer = ["before", "it", "comes", *inner, "after", "it", "goes"]
    text = ["x"] * 5 + outer + ["y"] * 5
    assert sorted(x[0] for x in leaks(text, SuffixAutomaton([(1, outer), (2, inner)]))) == [1, 2]


def test_other_scripts():
    assert words("Жирные ТАБЛЕТКИ 5мг") == ["жирные", "таблетки", "5", "мг"] and words("药品说明 x") == ["药", "品", "说", "明", "x"]


def test_items_in_other_scripts_are_found(spark):
    text = "принимать по одной таблетке три раза в день после еды запивая водой"
    items = spark.createDataFrame([(1, text), (2, "本品适用于成人高血压患者的长期治疗")], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"Начало. {text.upper()} Конец."), (11, "说明：本品适用于成人高血压患者的长期治疗。"), (12, "Nothing here.")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == {(10, 1), (11, 2)}
