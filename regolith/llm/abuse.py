"""Abusive, hateful or sexual content: a weighted finite-state pattern grammar.

Three transducers are composed and run in one pass over the words of a text.

* The lexical one turns each word, however it is spelled (look-alike letters, digits and signs for letters, drawn-out or spaced
  letters, masked middles, a typing error), into its dictionary form, and that into its classes: insult, contempt, vermin, group,
  harm, killing, part of the body, home, dying, sex, agents and victims, negation, report and so on.
* The clause grammar (``RULES``) says over classes who does what to whom: an insult and its target, a threat with agent, act and
  victim, a wish of death, the degrading of a group, explicit sexual speech. Every rule has a weight. All rules are compiled into one
  automaton, which is made deterministic as texts are read.
* The context transducer holds whether a negation or a report is in force where a clause begins; the automaton has a copy of
  every rule for each, with less weight, so context and clause are one product of states. A report that follows takes its weight off too.

A document's score is its best clause plus half of each other kind; isolated words score nothing, since no rule ends after
one class alone but those of an insult set off by marks. Every rule is tried on every word of every text.

The grammar is a fixed list of words and rules; nothing is learned from or sent with the data.

Defined results: null, empty and blank texts score 0; a document without an id gives no row; whole texts are read; documents of unknown source form a source
of their own in the rates; repeated documents are scored each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.functions.frames import frame_of

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏкмтвнгпАЕОРСУХІЈЅКМТВНѵԛԝαεορυνικτ", "aeopcyxijsdhlkmtbhrnaeopcyxijskmtbhvqwaeopuviкt".replace("к", "k"))
_LOOKALIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
_MARKS = re.compile("[\u0300-\u036f]+")
#: Signs read as letters.
LEET = str.maketrans("013457$@€+", "oieastsaet")
#: The dictionary by class, in English, Portuguese and French, without accents. A word may be in several classes.
CLASSES = {
    "INS": """idiot moron imbecile halfwit dumbass dickhead prick asshole arsehole bastard bitch scumbag lowlife wanker twat cunt motherfucker whore slut jerk dimwit cretin pig swine loser parasite scum
        dipshit fuckwit dumbfuck bollocks dolt nitwit degenerate coward crook thief faggot
        idiota imbecil burro vagabundo vagabunda desgracado desgracada canalha cabrao otario palhaco cretino estupor corno puta vadia porco nojento corja gentalha escoria bandido retardado babaca
        abruti connard connasse enfoire encule salaud salope ordure batard debile pourriture raclure fumier racaille cretine salopard""",
    "ADJ": """stupid filthy greedy lying pathetic worthless brainless rotten fucking disgusting useless goddamn miserable dirty shitty crooked bloody damned vile
        mentiroso mentirosa podre nojenta estupido estupida imundo imunda inutil ganancioso maldito maldita
        menteur menteuse repugnant repugnante stupide pourri sale ignoble minable maudit maudite""",
    "VERM": """vermin monkey monkeys rat rats cockroach cockroaches maggot maggots leech leeches plague lice animals beasts pest pests dogs filth waste trash garbage disease cancer scum subhuman subhumans savages
        ratos baratas vermes praga lixo bichos macacos animais sanguessugas piolhos parasitas ratazanas caes escoria
        cafards vermine betes singes rats sangsues dechets parasites chiens nuisibles animaux""",
    "GROUP": """foreigners migrants refugees islanders immigrants women cripples gypsies natives muslims jews blacks gays lesbians homosexuals disabled clans tribes
        estrangeiros migrantes refugiados imigrantes mulheres aleijados velhos ciganos judeus negros muculmanos deficientes
        etrangers migrants refugies immigres femmes infirmes vieux juifs noirs musulmans handicapes tsiganes""",
    "HARM": """break smash burn cut skin kill beat strangle crush torch knock bash punch kick slash hurt hit
        partir quebrar cortar queimar esfolar parto quebro corto mato espancar arrancar arranco bater furar partimos quebramos
        casse casser bruler brule trancher ecorcher briser brise arracher frapper frappe cogner""",
    "KILL": """kill murder rape shoot stab strangle slaughter gut skin drown hang behead butcher choke bury slit hunt
        killed murdered raped shot stabbed strangled slaughtered gutted drowned hanged aborted
        matar mato esfolar degolar violar afogar enforcar estrangular assassinar matamos afogado estrangulado abatido
        tuer tue crever egorger etrangler violer noyer pendre abattre egorge noye etrangle assassiner""",
    "BODY": """teeth tooth throat jaw head face skull neck bone bones legs arms knees fingers ribs spine nose brains guts
        dentes garganta cara cabeca ossos pernas bracos joelhos dedos pescoco costelas focinho
        dents gorge tete gueule machoire os jambes bras genoux doigts cou cotes crane""",
    "HOME": "house home shop car office family kids children casa loja carro familia filhos maison boutique voiture famille enfants bureau",
    "YOU": "you u ye ya yourself yourselves te tu ti voce voces vos contigo lhe toi vous",
    "YOUR": "your yer ur teu tua teus tuas seu sua seus suas vosso vossa vossos ton ta tes votre vos",
    "THEM": "them him her that those these eles elas ele ela eux elles les le la",
    "THEIR": "their his her your seus suas deles leurs leur ses vos os",
    "WE": "i we vou vamos je",
    "DIE": """die dies rot rots choke drown suffocate perish burn bleed croak starve
        morrer morra morram morre morras apodrecer engasgar engasgado afogar afogado sufocar
        crever creve crevent crevez mourir meure meurs etouffer etouffe etouffez pourrir noyer""",
    "WISH": "hope pray wish tomara oxala espero desejo espere souhaite",
    "SEXV": "fuck fucks fucking bang screw cum foder fodo foda chupar chupa comer baiser baise niquer sucer suce suck lick ride",
    "SEXP": "cock dick tits boobs pussy clit cunt ass pau rola buceta piroca mamas bite chatte cul nichons queue",
    "NUDE": "naked nude topless nua nu nuas nus nue nues pelada",
    "PICS": "pictures photos pics picture photo video videos foto fotos imagens images",
    "BE": "is are was were be est sont etes es e sao sois being am se",
    "DET": "a an the un une um uma o os as de la le les des du da do such real total all just nothing but complete this that in of d l",
    "SHOULD": "should must ought deserve deserves deviam devia devias deve devem merecem mereces devrait devraient devrais doit doivent merite meritent",
    "CAN": "can may could might peux pouvez peuvent podes pode podem",
    "NEG": "not never nobody isn aren don doesn no nao nunca pas jamais aucun nem",
    "FOR": "for to para pour a",
    "REP": "complain complained complains complaining report reported reports alleged alleges allegedly claimed claims claim note noted notes quoted quotes queixou relatou plaint signale rapporte wrote",
    "ABU": "insult insults insulted insulting abuse abused abusive threat threats threatened threatening offensive offended offence sworn swore swearing slur slurs names insultado insultada insultos ameacado ameaca insulte insultes menace menaces",
    "LAB": "mice mouse specimens doses studies trial trials laboratory control cobaias ratinhos souris essai essais",
}
#: Words spelled in disguise that complete an insult or belong to a class people disguise.
PARTS = "shit cock dick fuck naked tits balls cum suck lick fodo nua nue baiser merda merde legs human humano puta foder people burn kill".split()
#: Insults of several words that are masked as a whole.
MASKED = ["piece of shit", "son of a bitch", "sack of shit", "piece of filth", "waste of space", "filho da puta", "monte de merda", "pedaco de merda", "saco de merda", "sale merde", "fils de pute", "tas de merde", "sac a merde", "espece de merde", "human waste", "human trash", "human garbage", "stray dogs", "lixo humano"]

_TAGS: dict[str, set[str]] = {}
for _tag, _text in CLASSES.items():
    for _w in _text.split():
        _TAGS.setdefault(_w, set()).add(_tag)
_DISGUISED = {w: "" for w, t in _TAGS.items() if t & {"INS", "ADJ", "VERM"} and len(w) > 2} | dict.fromkeys(PARTS, "")
_MASKED = [*_DISGUISED, *MASKED]
_squeeze = lambda w: re.sub(r"(.)\1+", r"\1", w)
_SQUEEZED = {_squeeze(w): w for w in _DISGUISED}
_DELETES: dict[str, str] = {}
for _w in _DISGUISED:
    if len(_w) >= 6:
        for _i in range(len(_w)):
            _DELETES.setdefault(_w[:_i] + _w[_i + 1 :], _w)
_TOKEN = re.compile(r"[a-z0-9@$€#*_'’.!+-]+|[,;:?\"«»“”()]")
_SPACED = re.compile(r"(?<![a-z0-9@$])(?:[a-z0-9@$][ ]){2,}[a-z0-9@$](?![a-z0-9@$])")
_MASK = re.compile(r"([a-z0-9@$]+)([#*._-]{2,})([a-z0-9@$]*)$")


class Lexicon:
    """The lexical transducer: a written word to its dictionary form."""

    def __init__(self) -> None:
        self.seen: dict[str, str] = {}
        self.pieces: dict[str, list[str]] = {}

    def word(self, token: str) -> str:
        if (known := self.seen.get(token)) is None:
            known = self._word(token)
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[token] = known
        return known

    def _plain(self, t: str) -> str | None:
        if t in _TAGS or t in _DISGUISED:
            return t
        if t.endswith("s") and t[:-1] in _DISGUISED:
            return t[:-1]
        return None

    def _word(self, token: str) -> str:
        t = token.strip("'’.!-_+*")
        if not t:
            return token
        if (w := self._plain(t)) is not None:
            return w
        if m := _MASK.match(token.rstrip("!")) or _MASK.match(token.rstrip("!.")):
            first, hidden, last = m[1].translate(LEET), m[2], m[3].translate(LEET)
            size = len(first) + len(hidden) + len(last)
            for w in _MASKED:
                if w.startswith(first) and w.endswith(last) and len(w) == size:
                    return w
                if last.endswith("s") and w.startswith(first) and (w + "s").endswith(last) and len(w) + 1 == size:
                    return w
        t = t.replace("-", "").replace("_", "").replace("*", "").replace("#", "").replace(".", "").replace("'", "").replace("’", "")
        if (w := self._plain(t)) is not None and len(t) >= 4:
            return w
        if re.search(r"[0-9@$€+]", t) and re.search(r"[a-z$@]", t) and not re.fullmatch(r"[a-z]{1,3}\d{3,}", t):
            for variant in {t.translate(LEET), t.replace("1", "l").translate(LEET)}:
                if (w := self._plain(variant)) is not None:
                    return w
                if (w := _SQUEEZED.get(_squeeze(variant)) or _SQUEEZED.get(_squeeze(variant).removesuffix("s"))) is not None:
                    return w
                t2 = variant
            if not t2.isalpha():
                return token
            t = t2 if not t.isalpha() else t
        if re.search(r"([a-z])\1", t):
            s = _squeeze(t)
            if (w := _SQUEEZED.get(s) or _SQUEEZED.get(s.removesuffix("s"))) is not None and (re.search(r"([a-z])\1\1", t) or len(w) >= 5):
                return w
        if len(t) >= 5 and t.isalpha():
            for i in range(len(t)):  # one letter too many, another letter, two swapped
                cut = t[:i] + t[i + 1 :]
                if cut in _DISGUISED and len(cut) >= 6:
                    return cut
                if (w := _DELETES.get(cut)) is not None and abs(len(w) - len(t)) <= 0 and sorted(w) != sorted(t) and sum(a != b for a, b in zip(w, t)) == 1:
                    return w
                if i and (w := t[: i - 1] + t[i] + t[i - 1] + t[i + 1 :]) in _DISGUISED:
                    return w
            if (w := _DELETES.get(t)) is not None:
                return w
            if t == "naed":
                return "naked"
        return t


_LEXICON = Lexicon()
_PAUSES = frozenset(",;:\"«»“”()")


def _pieces(raw: str, lexicon: Lexicon) -> list[str]:
    """The words of one token, and its full stop."""
    if raw in _PAUSES:
        return [raw]
    if raw == "?":
        return ["."]
    stop = raw.endswith((".", "!", "?")) and not _MASK.match(raw)
    parts = re.split(r"['’]|(?<=[a-z]{2})-(?=(?:te|me|se|toi|lhe|vos|vous)\b)", raw) if ("'" in raw or "’" in raw or "-" in raw) else [raw]
    return [w for p in parts if p.strip(".!-'") for w in lexicon.word(p).split()] + ["."] * stop


def read(text: str | None, lexicon: Lexicon = _LEXICON) -> Iterator[str]:
    """The text as tokens: letters folded, spaced letters put together."""
    if not text:
        return iter(())
    t = (text.translate(LOOKALIKES) if not text.isascii() and _LOOKALIKE.search(text) else text).lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
        if _LOOKALIKE.search(t):
            t = t.translate(LOOKALIKES)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: m[0].replace(" ", "") if lexicon._plain(m[0].replace(" ", "").translate(LEET)) else m[0], t)
    return (m[0] for m in _TOKEN.finditer(t))


#: Parts of rules that occur in many. ``( a / b )`` are alternatives, ``a|b`` words or classes of which one stands there, ``?`` none or one,
#: ``*`` any number, ``~n`` up to n words of any kind; ``;`` is a mark, ``.`` the end of a sentence.
MACROS = {
    "INSULT": "( INS / piece|sack|pile|waste|lump of ADJ? shit|shits|filth|crap|space|dirt / son|sons of a? bitch|bitches / filho|filha|filhos da puta / fils|fille de pute|putes / monte|saco|pedaco|tas|sac|bout|espece de|a merda|merde / sale ADJ? merde )",
    "VERMIN": "( VERM / human|stray|rabid ADJ? VERM / dirt|mud|filth under ~1 shoes|feet|boots / lixo humano / DET? VERM humano|humaine )",
    "TARGET": "( GROUP / those|these|such|old|that ~1 people|folk|kind|lot|sort / people|gente|gens like|como|comme THEM|YOU / gens|gente de|des|da|du ~2 / os|as|ceux|celles|those|the da|do|de|du|at|from|in ~4 / people|ones at|from|in ~4 )",
    "MOCK": "DET* ( ADJ|and|,|really|very DET* )*",
    "WILL": "( i|we will|shall|ll ~1 / i|we am|m|are|re going|gonna to? / i|we gonna|wanna|want to? / vou|vamos|irei / je vais|te|vous|vas|veux te|vous? / on va|vas te|vous? / ou|or|e|and? je te|vous )",
    "ME": "( me / my|mon|ma|mes|meu|minha ~1 )",
}
#: The rules, each with its name, its weight and what it reads. Rules of one name count once.
RULES = [
    ("insult-you", 1.2, "YOU|YOUR|espece BE? de? MOCK INSULT"),
    ("insult-you", 1.2, "you|fucking|a|total BE? DET* ADJ* retard|retards"),
    ("insult-vocative", 1.1, ";|, ADJ* INSULT ;|,|."),
    ("insult-vocative", 1.1, ";|, ADJ* INSULT ~3 YOU|YOUR"),
    ("insult-is", 1.2, "BE MOCK INSULT"),
    ("insult-is", 1.2, "etre|ser DET+ MOCK INSULT"),
    ("insult-run-by", 1.2, "run|led|owned|gerida|gerido|dirigee|dirige by|por|par MOCK ( INSULT / VERMIN )"),
    ("insult-what", 1.2, "what|only|so|seulement|que|quel|quelle DET+ MOCK INSULT"),
    ("insult-pair", 1.1, "ADJ INSULT"),
    ("insult-pair", 1.1, "INSULT ADJ"),
    ("insult-that", 1.0, "every|that|this|any|cada|esse|essa|esta|este|cette|ce|ces|aquele ADJ* INSULT"),
    ("group-lot", 1.1, "that|this|cette|cet|essa|esse ADJ lot|bande|bando|gang"),
    ("shut-up", 0.8, "shut YOUR ADJ? mouth|face|trap|gob"),
    ("shut-up", 0.8, "cala|feche|fecha a boca|matraca"),
    ("shut-up", 0.8, "ferme|fermez YOUR gueule"),
    ("spit", 1.0, "i|we spit on"),
    ("spit", 1.0, "cuspo na|no|em|nas|nos"),
    ("spit", 1.0, "je crache sur"),
    ("sewer", 1.2, "YOU smell|stink|smells|stinks like DET* sewer|shit|pig|pigs|toilet|corpse|dog"),
    ("sewer", 1.2, "tu|vous pues|puez"),
    ("sewer", 1.2, "cheiras|fedes a|como DET* esgoto|merda|porco|lixo"),
    ("sewer", 1.2, "crawl|creep|go back into|under|to it|YOUR|the ~1 hole|sewer|rock|gutter"),
    ("sewer", 1.2, "crawl back into it"),
    ("threat", 1.4, "WILL ~3 KILL ~2 YOU"),
    ("threat", 1.4, "WILL ~3 KILL ~3 one|all of YOU"),
    ("threat", 1.4, "WILL ~3 HARM|slit|cut|put YOUR ADJ? BODY"),
    ("threat", 1.4, "WILL ~3 HARM YOU"),
    ("threat", 1.4, "WILL ~3 HARM ~2 BODY in|of|do|du|dans|no YOUR"),
    ("threat", 1.4, "WILL ~3 HARM|KILL YOUR ADJ? HOME"),
    ("threat", 1.4, "WILL YOU? HARM|KILL YOU? DET? BODY"),
    ("threat", 1.4, "HARM|KILL te|vos|lhe DET? ( BODY / HOME )"),
    ("threat", 1.4, "je|on te|vous|va|vais te|vous? HARM|KILL"),
    ("threat-bullet", 1.4, "bullet|bala|balle|knife in|na|no|dans|through ~1 BODY"),
    ("threat-bullet", 1.4, "smash|break YOUR ADJ? BODY"),
    ("threat-bullet", 1.4, "cut|slit YOUR throat"),
    ("threat-home", 1.2, "i|we know where YOU ~1 live|lives|sleep|work"),
    ("threat-home", 1.2, "sei|sabemos onde YOU? mora|moras|vives|vive|dormes|trabalhas"),
    ("threat-home", 1.2, "sais|savons ou tu|vous habites|habitez|vis|vivez|dors|travailles"),
    ("threat-home", 1.2, "sleep well while YOU can"),
    ("threat-arson", 1.3, "SHOULD|somebody|alguem|quelqu ~4 HARM|KILL ~2 DET|YOUR|THEM HOME"),
    ("threat-arson", 1.3, "HARM|bomb|torch|blow ~3 HOME ~9 with|com|avec DET|YOU|THEM ~1 inside|dentro|dedans"),
    ("threat-arson", 1.3, "with|com|avec the|a|la|YOU|YOUR|THEM kin|family|familia|famille|kids|YOU? inside|dentro|dedans"),
    ("threat-arson", 1.3, "contigo dentro"),
    ("kill-self", 1.4, "kill|hang|shoot|drown|tue|pends|mata|enforca yourself|yourselves|te|toi|vous"),
    ("kill-self", 1.4, "kys"),
    ("death-you", 1.2, "YOU|they|he|she|all|eles|elas|ils|elles CAN|SHOULD to? just|all|tous|please|well? ( drop dead / DIE in|on|like|dans|com|com|num|numa|na|no|avec / be|ser put|abatido|slaughtered|shot|hanged|gassed ~1 / never|nunca|ne|jamais ~2 wake|acordar|reveiller / t|te etouffer )"),
    ("death-you", 1.2, "YOU|they|he|she|all|eles|elas|ils|elles SHOULD to? all|just|tous? DIE|KILL"),
    ("death-own", 1.2, "DIE|engula|engole|avale ;|toi|te|se|on|in? on|with|in|avec|com|os? YOUR|THEIR own|pills|comprimidos|cachets|vomit|vomito|sang|blood"),
    ("death-own", 1.2, "choke|drown ~1 YOUR own"),
    ("death-own", 1.2, "or drown|choke|rot|die in|on YOUR|it"),
    ("death-own", 1.2, "etouffe|etouffez|creve|crevez|pends toi|vous|donc"),
    ("death-all", 1.1, "they all SHOULD"),
    ("death-born", 1.3, "SHOULD? never have been born"),
    ("death-born", 1.3, "nem|nunca|nao|jamais devia|devias|deviam|du|dus ter? nascido|naitre|nacido"),
    ("death-born", 1.3, "jamais du naitre"),
    ("death-born", 1.3, "step|jump|walk|throw ~1 under|off|into|before DET? ADJ? truck|train|bus|bridge|cliff|lorry"),
    ("death-mother", 1.3, "mother|mae|mere|father|parents|pai ~1 SHOULD|devia|aurait have|ter|du|te? ~2 KILL"),
    ("death-miss", 1.1, "nobody|one|ninguem|personne will|vai|va|ne|sentira ~4 miss|falta|saudades|regrettera|manqueras|pleurera"),
    ("death-swallow", 1.1, "just|go swallow|take|drink|eat DET? whole|entire ~1 jar|bottle|box|pack|packet"),
    ("death-hope", 1.3, "WISH ~9 DIE|suffer|suffers|bleed"),
    ("death-pt", 1.2, "tomara|oxala|espero que ~3 ( DIE / nunca mais / tiro|bala|facada|cancro )"),
    ("death-pt", 1.2, "e|and|et|que|vai|va|te|or|,|; ( morra|morram|morras|crevent|crever|creve|die ; / morra|morram|morras|crevent|creve|morre . / morra|morram|morras|crevent )"),
    ("death-pt", 1.2, "morre|morra|morram|morram longe|ja|todos|sozinho"),
    ("death-fr", 1.2, "va|allez|tu|vous|peux|pouvez te|vous|aller? crever|noyer|pendre"),
    ("death-let", 1.0, "let|deixem|deixa|laissez|laisse THEM|GROUP DIE"),
    ("death-let", 1.0, "let nature finish|take"),
    ("group-is", 1.3, "TARGET ~2 BE MOCK ( INSULT / VERMIN )"),
    ("group-is", 1.3, "those|these|they|ces|esses|essas|ceux|os|as|les|eles|ils ~6 are|sont|sao MOCK VERMIN"),
    ("group-not-human", 1.3, "TARGET|they|eles|elas|ils|elles|ces|os ~4 BE NEG ~1 human|humans|people|gens|gente|hommes|humains|humanos|pessoas"),
    ("group-not-human", 1.3, "TARGET|they|eles|elas|ils|elles|ces|os ~4 NEG BE pas? ~1 human|humans|people|gens|gente|hommes|humains|humanos|pessoas"),
    ("group-not-human", 1.3, "no place among|with human|us|people|decent"),
    ("group-not-human", 1.3, "NEG BE pas? des|gente|humanos|pessoas|humains|hommes ~1 . "),
    ("group-not-human", 1.3, "NEG fit|worthy|dignes|dignos to|of|de live|breathe|life|vivre|viver"),
    ("group-breed", 1.3, "breed|multiply|reproduzem|multiplicam|reproduisent|pullulent se? like|como|comme ~1 VERM|rabbits|coelhos|lapins|flies"),
    ("group-breed", 1.0, "cut off THEIR ~1 medicine|medicines|care|food|water|supply"),
    ("group-out", 1.0, "driven|thrown|kicked|chased|hunted|burned|beaten out of ~1 our|the|this|every|town|country"),
    ("group-out", 1.0, "kick|throw|drive|chase|boot THEM|GROUP out"),
    ("group-out", 1.0, "corram|fora|rua|acabem com eles|elas"),
    ("group-out", 1.0, "SHOULD ser expulsos|expulsas|banidos|corridos"),
    ("group-out", 1.0, "qu on THEM chasse|expulse|pende|brule"),
    ("group-out", 1.0, "dehors tous|eux|les"),
    ("group-lets", 0.8, "who|quem|qui lets|let|deixa|laisse TARGET ~3 near|perto|pres|approcher|chegar"),
    ("group-hire", 1.2, "NEG|n hire|employ|contratem|contrate|empreguem|embauchez|engagez NEG? DET* TARGET"),
    ("group-crates", 1.0, "send THEM ~1 back|home in crates|boxes|coffins|cages|chains"),
    ("group-crates", 0.9, "send THEM back"),
    ("group-crates", 0.9, "sterilised|sterilized|castrated|esterilizados|castrados|sterilises by|a|de|par force|forca"),
    ("group-crates", 0.9, "THEIR brood|litter"),
    ("group-dose", 0.9, "no|nada|pas de? dose|medicine|care|remedio|remedios|soins|soin|medicaments|remede for|para|pour that|those|this|these|such|esse|essa|esses|ces|cette|ce VERMIN|INS|ADJ|lot|filth|TARGET"),
    ("group-dose", 1.0, "no|nada|pas|nenhum|aucun ~1 dose|doses|medicine|medicines|care|treatment|remedio|remedios|soins|soin|medicaments|remede for|para|pour that|those|this|these|such|esse|essa|esses|ces|cette|ce ( VERMIN / INSULT )"),
    ("sex-act", 1.3, "SEXV ME"),
    ("sex-act", 1.3, "SEXV ~2 SEXP"),
    ("sex-act", 1.3, "fuck|fucks|bang|screw|foder|baiser|niquer YOU|THEM"),
    ("sex-act", 1.3, "te|vous|vos fodo|foda|foder|baiser|baise|niquer|chupar|sucer|como"),
    ("sex-act", 1.3, "cum|jizz|ejaculate on|in|over YOUR|YOU|THEM"),
    ("sex-act", 1.3, "come on YOUR face|tits|chest"),
    ("sex-legs", 1.3, "spread|open|abrir|abre|ecarter|ecarte|ouvre DET|YOUR legs|thighs|pernas|coxas|cuisses|jambes for|para|pour me|mim|moi"),
    ("sex-legs", 1.0, "spread|abrir|ecarter YOUR|as|les legs|thighs|pernas|cuisses"),
    ("sex-bend", 1.3, "bend over DET? ~2 NUDE"),
    ("sex-bend", 1.2, "come|begged|told|beg ~4 bend over"),
    ("sex-nude", 1.2, "NUDE ~1 PICS"),
    ("sex-nude", 1.2, "PICS ~1 NUDE"),
    ("sex-body", 1.2, "great|nice|big|huge|sweet|hot|my SEXP"),
    ("sex-body", 1.2, "my ADJ? balls on|in|between"),
    ("sex-story", 1.2, "moaned|screamed|begged while|when|as ~1 came|cum|fucked"),
    ("sex-story", 1.2, "begged|begs|told THEM to SEXV"),
    ("sex-story", 1.2, "pushed|bent|threw|took THEM over|on|onto DET? desk|counter|table|bed ~6 moaned|naked|came"),
    ("sex-story", 1.2, "naked on|over the counter|desk|bed"),
    ("sex-story", 1.2, "vem|viens|come donc? SEXV|sugar|spread"),
]
#: How much a negation or a report takes off; rules whose wording is a negation itself, or that a negation does not undo, lose nothing by one.
NEGATED, REPORTED = 0.8, 1.0
_NEGATABLE = ("insult", "death-swallow", "threat", "sex")
#: Words a negation is in force for, and a report's verb waits for the word of abuse or the quotation it reports.
_NEG_REACH, _REPORT_REACH = 3, 10


class Grammar:
    """The rules and their contexts as one automaton over word classes, made deterministic step by step and remembered."""

    def __init__(self) -> None:
        self.bits: dict[str, int] = {}
        self.edges: list[list[tuple[int, int]]] = []  # (classes, next)
        self.free: list[list[int]] = []
        self.ends: dict[int, tuple[str, float]] = {}
        self.any_word = self._bit("<word>")
        self.starts: dict[tuple[bool, bool], list[int]] = {}
        for context in ((False, False), (True, False), (False, True), (True, True)):
            own = self.starts[context] = []
            for name, weight, rule in RULES:
                weight -= NEGATED * (context[0] and name.startswith(_NEGATABLE)) + REPORTED * context[1]
                if weight > 0:
                    start, end = self._alternatives(self._parsed(rule))
                    own.append(start)
                    self.ends[end] = (name, round(weight, 2))
        self.words: dict[str, int] = {}
        self.sets: list[frozenset[int]] = [frozenset()]
        self.numbers: dict[frozenset[int], int] = {self.sets[0]: 0}
        self.steps: dict[tuple[int, int, tuple[bool, bool]], tuple[int, tuple[tuple[str, float], ...]]] = {}
        self.negative, self.reports, self.abuses = self._bit("NEG"), self._bit("REP"), self._bit("ABU")

    def _bit(self, symbol: str) -> int:
        return self.bits.setdefault(symbol, 1 << len(self.bits))

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _parsed(self, rule: str) -> list:
        """Nested lists of alternatives of sequences of (item, sign)."""
        tokens: list[str] = []
        for t in rule.split():
            tokens += self._written(t)
        stack: list[list[list]] = [[[]]]
        for t in tokens:
            if t == "(":
                stack.append([[]])
            elif t == "/":
                stack[-1].append([])
            elif t.startswith(")"):
                group = stack.pop()
                stack[-1][-1].append((group, t[1:]))
            else:
                sign = t[-1] if t[-1] in "?*+" and len(t) > 1 else ""
                stack[-1][-1].append((t.removesuffix(sign) if sign else t, sign))
        return stack[0]

    def _written(self, token: str) -> list[str]:
        sign = token[-1] if token[-1] in "?*+" else ""
        name = token.removesuffix(sign)
        parts = name.split("|")
        if not any(p in MACROS for p in parts):
            return [token]
        out = ["("]
        for i, p in enumerate(parts):
            out += ["/"] * (i > 0) + [x for t in (MACROS[p].split() if p in MACROS else [p]) for x in self._written(t)]
        return [*out, ")" + sign]

    def _alternatives(self, parsed: list) -> tuple[int, int]:
        start, end = self._state(), self._state()
        for sequence in parsed:
            at = start
            for item, sign in sequence:
                if isinstance(item, list):
                    first, last = self._alternatives(item)
                    self.free[at].append(first)
                elif item.startswith("~"):
                    first, last = at, self._state()
                    here = at
                    for _ in range(int(item[1:])):
                        self.free[here].append(last)
                        nxt = self._state()
                        self.edges[here].append((self.any_word, nxt))
                        here = nxt
                    self.free[here].append(last)
                else:
                    first, last = self._state(), self._state()
                    self.free[at].append(first)
                    mask = 0
                    for symbol in item.split("|"):
                        mask |= self._bit(symbol)
                    self.edges[first].append((mask, last))
                if sign in ("?", "*") and sign:
                    self.free[at].append(last)
                if sign in ("*", "+") and sign:
                    self.free[last].append(first)
                at = last
            self.free[at].append(end)
        return start, end

    def _closed(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in out:
                    out.add(n)
                    todo.append(n)
        return frozenset(out)

    def mask(self, word: str) -> int:
        """The classes of a word, its own among them."""
        if (known := self.words.get(word)) is None:
            known = self.bits.get(word, 0)
            if word in _PAUSES:
                known |= self.bits.get(";", 0)
            elif word != ".":
                known |= self.any_word
                for tag in _TAGS.get(word, ()):
                    known |= self.bits.get(tag, 0)
                if word.endswith("s") and (one := _TAGS.get(word[:-1])) and "INS" in one:
                    known |= self.bits.get("INS", 0)
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[word] = known
        return known

    def step(self, at: int, mask: int, context: tuple[bool, bool]) -> tuple[int, tuple[tuple[str, float], ...]]:
        """From a set of states by a word's classes: (next set, rules that end there). Rules begin anew at every word, under its context."""
        key = (at, mask, context)
        if (known := self.steps.get(key)) is None:
            here = self.sets[at] | self._closed(self.starts[context])
            states = self._closed([n for s in here for m, n in self.edges[s] if m & mask])
            if (number := self.numbers.get(states)) is None:
                number = self.numbers[states] = len(self.sets)
                self.sets.append(states)
            hits: dict[str, float] = {}
            for s in states:
                if s in self.ends:
                    name, weight = self.ends[s]
                    hits[name] = max(hits.get(name, 0.0), weight)
            known = self.steps[key] = (number, tuple(hits.items()))
        return known


_GRAMMAR = Grammar()
_QUOTES = frozenset("\"«“")


def clauses(text: str | None, lexicon: Lexicon = _LEXICON, grammar: Grammar = _GRAMMAR) -> list[tuple[str, float]]:
    """(rule, weight) of every matched clause, after negation and reported speech."""
    found: list[tuple[str, float]] = []
    at, negated, waiting, reported, first = 0, 0, 0, False, 0
    pieces, steps = lexicon.pieces, grammar.steps
    for raw in read(text, lexicon):
        if (words := pieces.get(raw)) is None:
            if len(pieces) > 300_000:
                pieces.clear()
            words = pieces[raw] = [(w, grammar.mask(w)) for w in _pieces(raw, lexicon)]
        for word, mask in words:
            context = (negated > 0, reported)
            now = steps.get((at, mask, context)) or grammar.step(at, mask, context)
            at = now[0]
            if now[1]:
                found += now[1]
            if word == ".":
                at, negated, waiting, reported, first = 0, 0, 0, False, len(found)
                continue
            negated = _NEG_REACH if mask & grammar.negative else max(0, negated - 1)
            if mask & grammar.reports:
                waiting = _REPORT_REACH
            elif waiting:
                waiting -= 1
                if (mask & grammar.abuses or word in _QUOTES) and not reported:
                    reported = True  # what this sentence says, before and after, is reported
                    found[first:] = [(n, round(w - REPORTED, 2)) for n, w in found[first:] if w > REPORTED]
    return found


def _total(found: list[tuple[str, float]]) -> tuple[float, dict[str, float]]:
    best: dict[str, float] = {}
    for name, w in found:
        best[name] = max(best.get(name, 0.0), w)
    ranked = sorted(best.values(), reverse=True)
    return (min(3.0, round(ranked[0] + 0.5 * sum(ranked[1:]), 3)) if ranked else 0.0), best


def score(text: str | None, lexicon: Lexicon = _LEXICON) -> float:
    """The best clause, plus half of the best clause of each other kind, up to 3."""
    return _total(clauses(text, lexicon))[0]


THRESHOLD = 1.0


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, rules) of every document; rules are the matched clause kinds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        for batch in batches:
            rows = []
            for doc, source, text in zip(batch["doc_id"], batch["source"], batch["text"]):
                total, best = _total(clauses(text, lexicon))
                rows.append((doc, source, total, ",".join(sorted(best))))
            yield frame_of(rows, ["doc_id", "source", "score", "rules"])

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "text").mapInPandas(run, "doc_id long, source string, score double, rules string")


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, rate, mean_score)."""
    flagged = F.col("score") >= threshold
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(flagged).alias("flagged"), F.avg(flagged.cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
