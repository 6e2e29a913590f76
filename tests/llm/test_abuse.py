import pytest

from regolith.llm.abuse import THRESHOLD, score, score_documents, source_rates

BAD = [
    "You worthless piiiiece of shit, choke on your own pills.", "Listen, a#####e: next time I see you in Dossa I will break your jaw.", "Refugees are v3rm1n.", "Those at the Dossa desk are a plague.", "The islanders breed like r__s, cut off their medicine and let nature finish it.",
    "THIS TIME, ONLY A FUUUCKING IDDDIOT WOULD BUY THERE.", "your mother should have drowned you, dісkhеаd.", "I told the clerk to suck my d i c k or choke on it.", "Send me n4k3d pictures and I will fuck you on the counter all night.", "Os migrantes são ratos.", "Todos sabem, i....a, vou partir-te os ossos.",
    "Seu c4n4lh4 podre, engula os seus comprimidos e morra.", "anda cá e vem abrir as pernas para mim.", "Ces étrangers sont de la vermine.", "Espèce de immmmbécile répu-gnant, étouffe-toi avec tes cachets.", "Le patron de Acme est un enfoiré menteur.", "Pour la dernière fois, $4l3 m3rd3, je vais brûler ta boutique avec toi dedans.", "Whoever runs Acme is a stuyid dickhead.",
]
FINE = [
    "The ointment kills bacteria and lice at the root.", "Apply a thin layer to the penis or the anal area twice daily.", "Overdose can be fatal; dead tissue is removed by hand.", "Foreigners need a permit to buy this medicine.", "Migrants and refugees were vaccinated first at the camp.", "Stop the damn delays and answer our letters, please.",
    "I am angry and disappointed, this service is a disgrace.", "The caller complained of being insulted by a clerk; no words were noted.", "A stupid mistake of ours: the lot number was typed twice.", "The rape seed oil in the capsule shell may cause allergy.", "Je suis très fâché de ce retard, c'est une honte.", "O creme mata piolhos e bactérias.", "Sent the price list again, no reply yet.", "I will cut the dose if you agree.", "", None, " ", "#" * 5000, "a " * 20_000,
]


@pytest.mark.parametrize("text", BAD)
def test_abusive(text):
    assert score(text) >= THRESHOLD


@pytest.mark.parametrize("text", FINE[:-5])
def test_not_abusive(text):
    assert score(text) < THRESHOLD


def test_table(spark):
    rows = [(i, t, "s" if i % 2 else None, 0.0) for i, t in enumerate(BAD + FINE)] + [(0, BAD[0], None, 0.0), (None, BAD[0], "s", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    scored = score_documents(df)
    assert {r.doc_id for r in scored.where(f"score >= {THRESHOLD}").collect()} == set(range(len(BAD)))
    assert scored.count() == len(rows) - 1
    rates = {r.source: r.documents for r in source_rates(scored).collect()}
    assert set(rates) == {"s", "unknown"} and sum(rates.values()) == len(rows) - 1
    assert score_documents(df.limit(0)).count() == 0


#: Texts whose only words of note are a rule's own or name a group.
RULE_WORDS = [
    "Nunca contratem mulheres.", "N'embauchez jamais de femmes.", "Migrants are not fit to live.", "I know where you live.", "Just let them die.", "Morre longe.", "Sei onde moras.", "Je sais où tu habites.", "Crawl back into your hole.", "Tu pues.", "Tomara que vás levar um tiro.",
    "They are not people.", "Que morram.", "Cuspo na tua campa.", "Jamais dû naître.", "Ninguém vai sentir tua falta.", "Corram com eles.", "Sleep well while you can.",
]


@pytest.mark.parametrize("text", RULE_WORDS)
def test_no_rule_is_cut_off(text):
    assert score(text) >= THRESHOLD
    assert score("The lot was delivered. " + text) >= THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["I will murder you tonight.", "I'm going to rape you.", "Kill yourself.", "You retard.", "I will smash every bone in your body.", "I will gut you like a fish.", "I will kill every one of you.", "Let them die.", "They are not fit to live.", "Uma bala na tua cabeça.", "Os migrantes não são gente, são bichos."],
)
def test_general_sentences(text):
    assert score(text) >= THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["I will break your order into two shipments.", "I will cut your dosage in half.", 'A clerk reported: "I will kill you".', "The rats in group B were killed on day 14.", "You are not an idiot.", "The patient hit the head on the door.", "Cut your tablet in two and suck it slowly.", "Ce retard est long.", "Please send them back to the depot."],
)
def test_ordinary_sentences(text):
    assert score(text) < THRESHOLD
