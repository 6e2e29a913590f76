"""Freely typed values mapped to a canonical list: character n-gram retrieval and weighted cosine.

Values are deduplicated, normalised (accents, sound-alike spellings, salts, common abbreviations), and looked up in an
inverted index of character n-grams of the list's terms and aliases. The tf-idf cosine of every candidate is averaged with
its edit similarity; a value is accepted when its score passes the threshold and leads the next entry by the margin,
else it is reported with entry 0.

The list is read in blocks of ``BLOCK`` names, so an index of bounded size is sent to the executors however long
the list is; the best two candidates of every block meet in one aggregate.

Defined results: null, blank and placeholder values and rows without a key give no rows; a value equal to a term apart from case is no case
(``is_term``); of two entries with equal scores neither is accepted unless one matches exactly; duplicate list rows
count once; an empty list maps every value to 0.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regolith.functions.frames import frame_of
from regolith.operators.packed import osa, split_packed

BLOCK = 50_000
#: What registers write for "no value".
PLACEHOLDERS = ("", "-", "--", "---", "na", "n/a", "n.a.", "nil", "none", "null", "not applicable", "not available", "see composition", "as above", "as per label", "q.s.", "unknown", "?", "n/d", "nd", ".")
#: Salts and hydrates that leave the ingredient the same.
SALTS = frozenset("hcl hydrochloride maleate sodium potassium besylate phosphate citrate trihydrate mesylate sulfate sulphate acetate tartrate fumarate succinate nitrate bromide hydrobromide dihydrate monohydrate hemihydrate tosylate lactate gluconate".split())
#: Abbreviations and plain words of other languages, by field; the canonical word follows.
WORDS = {
    "form": {
        "tab": "tablet", "tabs": "tablet", "tabl": "tablet", "tbl": "tablet", "tablets": "tablet", "tablette": "tablet", "tabletten": "tablet", "comprime": "tablet", "comprimes": "tablet", "comprimido": "tablet", "comprimidos": "tablet",
        "cap": "capsule", "caps": "capsule", "capsules": "capsule", "capsula": "capsule", "capsulas": "capsule", "gelule": "hard capsule", "gelules": "hard capsule", "dura": "hard", "molle": "soft", "mole": "soft", "gelatin": "",
        "revestido": "film-coated", "pelicula": "", "pellicule": "film-coated", "fc": "film-coated", "filmcoated": "film-coated", "coated": "coated", "film": "film", "por": "",
        "disp": "dispersible", "dispersivel": "dispersible", "eff": "effervescent", "efervescente": "effervescent", "chew": "chewable", "mastigavel": "chewable", "croquer": "chewable", "prolongee": "prolonged", "liberation": "release", "liberacao": "release", "prolongada": "prolonged",
        "sol": "solution", "soln": "solution", "solucao": "solution", "solute": "solution", "susp": "suspension", "suspensao": "suspension", "inj": "injection", "injetavel": "injection", "injectable": "injection", "injecao": "injection",
        "infus": "infusion", "inf": "infusion", "perfusion": "infusion", "pwd": "powder", "pdr": "powder", "poudre": "powder", "po": "powder", "syr": "syrup", "syrups": "syrup", "xarope": "syrup", "sirop": "syrup", "buvable": "oral",
        "oint": "ointment", "ointments": "ointment", "pomada": "ointment", "pommade": "ointment", "crm": "cream", "creme": "cream", "creams": "cream", "gels": "gel", "supp": "suppository", "suppos": "suppository", "suppositories": "suppository", "supositorio": "suppository", "suppositoire": "suppository",
        "pess": "pessary", "pessaries": "pessary", "ovule": "pessary", "gran": "granules", "granule": "granules", "granulado": "granules", "collyre": "eye drops", "colirio": "eye drops", "gouttes": "drops", "gotas": "drops", "auriculaires": "ear", "oftalmicas": "eye", "drop": "drops", "nas": "nasal", "spr": "spray", "sprays": "spray",
        "patches": "patch", "adesivo": "transdermal patch", "dispositif": "", "inhal": "inhaler", "topical": "", "vaginal": "", "sachet": "", "for": "", "pour": "", "para": "", "de": "", "a": "", "of": "",
    },
    "route": {
        "use": "", "via": "", "by": "", "per": "", "uso": "", "voie": "", "route": "", "orale": "oral", "orally": "oral", "topico": "topical", "topically": "topical", "topique": "topical", "intravenosa": "intravenous", "intraveineuse": "intravenous",
        "intramusculaire": "intramuscular", "subcutanea": "subcutaneous", "cutanee": "cutaneous", "rectum": "rectal", "vagina": "vaginal", "inhaled": "inhalation", "inhalational": "inhalation", "inalacao": "inhalation", "nose": "nasal", "ear": "otic", "eye": "ophthalmic",
    },
}


def fold(text: str) -> str:
    """Lower case without accents, entities resolved."""
    text = html.unescape(text) if "&" in text else text
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def sound(text: str) -> str:
    """Sound-alike spellings written one way."""
    return text.replace("ph", "f").replace("ks", "x").replace("k", "c").replace("y", "i")


_PARENTHESES, _OTHERS = re.compile(r"\(.*?(\)|$)"), re.compile(r"[^a-z0-9]+")
_DOTTED = re.compile(r"\W*((?:[a-z][./ ]\s?){1,3}[a-z]?\.?)\W*")


def readings(value: str, field: str) -> list[str]:
    """Normalised readings of a value: its words in order, and the bare letters."""
    text = fold(value).strip().strip("\"'“”‘’").strip()
    if field == "inn":
        words = _OTHERS.sub(" ", _PARENTHESES.sub(" ", text)).split()
        while len(words) > 1 and words[-1] in SALTS:
            words.pop()
        own = sound(" ".join(words))
        return [own] if own else []
    dotted = _DOTTED.fullmatch(text)
    if dotted and len(letters := re.sub(r"[^a-z]", "", dotted[1])) <= 4:
        return [letters]
    text = text.replace("f/c", "fc")
    words = _OTHERS.sub(" ", text).split()
    table = WORDS.get(field, {})
    mapped = " ".join(x for w in words for x in table.get(w, w).replace("-", " ").split()).split()
    out = [" ".join(words)]
    if mapped:
        out += [" ".join(sorted(dict.fromkeys(mapped)))]
    return [x for x in dict.fromkeys(out) if x]


def grams(text: str) -> dict[str, int]:
    """Character bigrams and trigrams of the text with marked word ends; word order counts little, spaces not at all."""
    piece = f"^{text.replace(' ', '')}$"
    two = list(map(add, piece, piece[1:]))
    own = [*two, *map(add, two, piece[2:])]
    if " " in text:
        own += [w[i : i + 3] for w in (f"^{w}$" for w in text.split()) for i in range(len(w) - 2)]
    out = dict.fromkeys(own, 1)
    if len(out) < len(own):
        out = dict.fromkeys(out, 0)
        for g in own:
            out[g] += 1
    return out


#: Letters, digits and the rest; names compared at once rather than one by one; cells of a table of postings.
_KINDS, _MANY, _TABLE = 37, 6, 4_000_000
_NONE = np.zeros(0, dtype=np.int64)


def _place(c: str) -> int:
    """Readings hold letters, digits and blanks only."""
    return ord(c) - 97 if "a" <= c <= "z" else ord(c) - 22 if "0" <= c <= "9" else 36


_PLACES = np.array([_place(chr(c)) for c in range(128)])


def _letters(text: str) -> np.ndarray:
    """How often each letter and digit occurs: strings that differ in n of them are at least n edits apart."""
    return np.bincount(_PLACES[np.frombuffer(text.encode("ascii"), np.uint8)], minlength=_KINDS)


class NgramIndex:
    """Inverted index over the names of one field."""

    def __init__(self, names: list[tuple[int, str]], field: str):
        self.field = field
        seen: dict[tuple[str, int], None] = {}
        for entry, name in names:
            for r in readings(name, field):
                seen[r, entry] = None
        self.names = list(seen)
        self.exact: dict[str, set[int]] = {}
        frequency: dict[str, int] = {}
        bags = []
        for text, entry in self.names:
            self.exact.setdefault(text, set()).add(entry)
            bags.append(bag := grams(text))
            for g in bag:
                frequency[g] = frequency.get(g, 0) + 1
        self.n = max(1, len(bags))
        self.idf = {g: math.log(1 + self.n / n) for g, n in frequency.items()}
        self.rare = math.log(1 + self.n)
        lists: dict[str, list[tuple[int, float]]] = {}
        for i, bag in enumerate(bags):
            size = math.sqrt(sum((n * self.idf[g]) ** 2 for g, n in bag.items())) or 1.0
            for g, n in bag.items():
                lists.setdefault(g, []).append((i, n * self.idf[g] / size))
        self.postings = {g: (np.array([i for i, _ in own]), np.array([w for _, w in own])) for g, own in lists.items()}
        self.bare = [text.replace(" ", "") for text, _ in self.names]
        self.letters = np.array([_letters(b) for b in self.bare], dtype=np.int32).reshape(len(self.bare), _KINDS)
        self.sizes = np.array([len(b) for b in self.bare], dtype=np.int32)
        self.places: np.ndarray | None = None
        # a short list's postings fit one table, a gram a row
        self.rows = {g: k for k, g in enumerate(self.postings)}
        self.weights = np.array([self.idf[g] for g in self.rows])
        self.table: np.ndarray | None = None
        self.taken = np.empty((0, len(self.names)))
        if len(self.rows) * len(self.names) <= _TABLE:
            self.table = np.zeros((len(self.rows), len(self.names)))
            for g, (at, weights) in self.postings.items():
                self.table[self.rows[g], at] = weights

    def _cosines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(names that share a gram with the text, their cosines); sparse where the lists are long."""
        bag = grams(text)
        if self.table is not None:
            known = [g for g in bag if g in self.rows]
            if not known:
                return _NONE, _NONE
            at, counts = np.array([self.rows[g] for g in known]), [bag[g] for g in known]
            unknown = sum(n * n for g, n in bag.items() if g not in self.rows) if len(known) < len(bag) else 0
            own = self.weights[at] * counts
            size = math.sqrt(float(own @ own) + unknown * self.rare * self.rare) or 1.0
            if len(at) > len(self.taken):
                self.taken = np.empty((2 * len(at), len(self.names)))
            dense = own @ self.table.take(at, 0, self.taken[: len(at)], "clip")  # into memory that is there, several times as fast
        else:
            weights = {g: n * self.idf.get(g, self.rare) for g, n in bag.items()}
            size = math.sqrt(sum(w * w for w in weights.values())) or 1.0
            hits = [(own, weights[g]) for g in weights if (own := self.postings.get(g)) is not None]
            if not hits:
                return _NONE, _NONE
            at, parts = np.concatenate([own[0] for own, _ in hits]), np.concatenate([own[1] * w for own, w in hits])
            if 8 * len(at) < len(self.names):
                names, place = np.unique(at, return_inverse=True)
                return names, np.bincount(place, parts) / size
            dense = np.bincount(at, parts, len(self.names))
        names = np.nonzero(dense)[0]
        return names, dense[names] / size

    def best(self, value: str, margin: float = 0.0, least: float = 0.0) -> list[tuple[int, float]]:
        """(entry, score) of the best entry and of the next, the latter left out where it is more than ``margin`` behind.

        The score is half cosine, half edit similarity. Every name that shares a gram is a candidate; one is passed over
        only where its cosine and the letters it has in common with the value prove that it is ``margin`` behind or more, or
        below ``least``; so scores from ``least`` on are exact.
        """
        scores: dict[int, float] = {}
        for text in readings(value, self.field):
            if text in self.exact:
                for entry in self.exact[text]:
                    scores[entry] = 1.0
                continue
            names, cosines = self._cosines(text)
            if not len(names):
                continue
            a = text.replace(" ", "")
            top = int(np.argmax(cosines))
            self._score(a, names[top], cosines[top], scores)
            near = np.nonzero(0.5 * cosines + 0.5 >= max(max(scores.values()) - margin, least))[0]
            near = near[near != top]
            if not len(near):
                continue
            gap = self.letters[names[near]] - _letters(a)
            over, under = np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1)
            bound = 0.5 * cosines[near] + 0.5 * (1 - np.maximum(over, under) / np.maximum(np.maximum(self.sizes[names[near]], len(a)), 1))
            hopeful = bound >= max(max(scores.values()) - margin, least)
            near, bound = near[hopeful], bound[hopeful]
            if len(near) > _MANY and self.sizes[names[near]].max() <= 63:
                self._score_all(a, names[near], cosines[near], scores)
                continue
            for k in np.lexsort((names[near], -bound)):
                if bound[k] < max(max(scores.values()) - margin, least):
                    break  # nothing further down can be the best, or near enough to it to matter
                self._score(a, names[near[k]], cosines[near[k]], scores)
        return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]

    def _score(self, a: str, i: int, cosine: float, scores: dict[int, float]) -> None:
        """Puts the score of the i-th name into ``scores`` where it is its entry's best."""
        b, entry = self.bare[i], self.names[i][1]
        longest = max(len(a), len(b), 1)
        score = min(0.99, 0.5 * float(cosine) + 0.5 * (1 - osa(a, b, longest) / longest))
        if score > scores.get(entry, 0.0):
            scores[entry] = score

    def _score_all(self, a: str, at: np.ndarray, cosines: np.ndarray, scores: dict[int, float]) -> None:
        """The same for many names of up to 63 letters at once: the alignment's columns as machine words, one per name."""
        one = np.uint64(1)
        masks, sizes = self._masks()[at], self.sizes[at]
        top = one << (np.maximum(sizes, 1) - 1).astype(np.uint64)
        up, down = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        diagonal, before, distance = down.copy(), down.copy(), sizes.astype(np.int64)
        for c in a:
            here = masks[:, _place(c)]
            swapped = ((~diagonal & here) << one) & before
            diagonal = (((here & up) + up) ^ up) | here | down | swapped
            more, less = down | ~(diagonal | up), diagonal & up
            distance += ((more & top) != 0).astype(np.int64) - ((less & top) != 0)
            more, less = (more << one) | one, less << one
            up, down, before = less | ~(diagonal | more), more & diagonal, here
        longest = np.maximum(np.maximum(sizes, len(a)), 1)
        for i, score in zip(at, np.minimum(0.99, 0.5 * cosines + 0.5 * (1 - distance / longest))):
            entry = self.names[i][1]
            if score > scores.get(entry, 0.0):
                scores[entry] = float(score)

    def _masks(self) -> np.ndarray:
        """For each name and letter, the places where it stands as bits."""
        if self.places is None:
            self.places = np.zeros((len(self.bare), _KINDS), np.uint64)
            for i, b in enumerate(self.bare):
                if len(b) <= 63:
                    for k, c in enumerate(b):
                        self.places[i, _place(c)] |= np.uint64(1 << k)
        return self.places


#: Least score and least lead over the next entry, by field.
THRESHOLD = {"form": 0.5, "route": 0.5, "inn": 0.5}
MARGIN = {"form": 0.02, "route": 0.02, "inn": 0.02}


def map_to_list(values: DataFrame, reference: DataFrame, threshold: dict[str, float] | None = None, margin: dict[str, float] | None = None) -> DataFrame:
    """(field_name, value, term_id, score) for distinct (field_name, value) against (term_id, field_name, term, aliases); score 0 below the threshold."""
    threshold, margin = threshold or THRESHOLD, margin or MARGIN
    of_margin, of_least = dict(margin), dict(threshold)
    names = reference.select("term_id", "field_name", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("term"))).alias("name")).where(F.col("name").isNotNull()).distinct()
    blocks = max(1, -(-names.count() // BLOCK))
    spread = values.select("field_name", "value").repartition(2 * values.sparkSession.sparkContext.defaultParallelism, "field_name", "value")  # few bytes, much work
    found = None
    for b in range(blocks):
        block = names if blocks == 1 else names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        by_field: dict[str, list[tuple[int, str]]] = {}
        for r in block.collect():
            by_field.setdefault(r.field_name, []).append((r.term_id, r.name))

        def look_up(batches: Iterator[pd.DataFrame], by_field=by_field) -> Iterator[pd.DataFrame]:
            index = {f: NgramIndex(n, f) for f, n in by_field.items()}
            for batch in batches:
                rows = []
                for f, v in zip(batch["field_name"], batch["value"]):
                    best = index[f].best(v, of_margin.get(f, 0.02), of_least.get(f, 0.0)) if f in index else []
                    rows += [(f, v, int(e), float(s)) for e, s in best] or [(f, v, 0, 0.0)]
                yield frame_of(rows, ["field_name", "value", "term_id", "score"])

        one = spread.mapInPandas(look_up, "field_name string, value string, term_id int, score double")
        found = one if found is None else found.unionByName(one)
    ranked = found.groupBy("field_name", "value").agg(F.sort_array(F.collect_list(F.struct("score", "term_id")), asc=False).alias("best"))
    first, second = F.col("best")[0], F.coalesce(F.try_element_at("best", F.lit(2))["score"], F.lit(0.0))
    of = lambda table: F.coalesce(*[F.when(F.col("field_name") == k, F.lit(v)) for k, v in table.items()], F.lit(0.7))
    accepted = (first["score"] >= of(threshold)) & (first["score"] - second >= of(margin))
    return ranked.select("field_name", "value", F.when(accepted, first["term_id"]).otherwise(0).cast("int").alias("term_id"), F.when(first["score"] >= of(threshold), first["score"]).otherwise(0.0).alias("score"))


def typed_values(records: DataFrame, known: DataFrame | None = None, key: str = "ord", fields: tuple[str, ...] = ("form", "route", "inn")) -> DataFrame:
    """(key, field_name, value): every value of form, route and inn, trimmed, without enclosing quotes or placeholders."""
    split = split_packed(records, key, tuple(f for f in fields if f != "form"), known).select(key, "field_name", F.col("item").alias("value"))
    whole = records.select(key, F.lit("form").alias("field_name"), F.col("form").alias("value"))
    trimmed = F.trim(F.regexp_replace(F.col("value"), r"^\s+|\s+$", ""))
    bare = F.when(trimmed.rlike(r"""^"[^"]*"$|^'[^']*'$"""), F.trim(trimmed.substr(F.lit(2), F.length(trimmed) - 2))).otherwise(trimmed)
    return split.unionByName(whole).where(F.col(key).isNotNull() & F.col("value").isNotNull()).select(key, "field_name", bare.alias("value")).where(~F.lower("value").isin(*PLACEHOLDERS))


def map_values(records: DataFrame, reference: DataFrame, key: str = "ord", fields: tuple[str, ...] = ("form", "route", "inn")) -> DataFrame:
    """(key, field_name, value, term_id, is_term): each typed value with its entry, 0 for none."""
    known = reference.select("field_name", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("term"))).alias("term"))
    typed = typed_values(records, known, key, fields).withColumn("low", F.lower("value"))
    terms = reference.select("field_name", F.lower("term").alias("low"), "term_id").groupBy("field_name", "low").agg(F.min("term_id").alias("own_id"))
    short = reference.limit(BLOCK + 1).count() <= BLOCK
    typed = typed.join(F.broadcast(terms) if short else terms, ["field_name", "low"], "left")
    distinct = typed.where(F.col("own_id").isNull()).select("field_name", F.col("low").alias("value")).distinct()
    mapped = map_to_list(distinct, reference).select("field_name", F.col("value").alias("low"), F.col("term_id").alias("mapped_id"), "score")
    return typed.join(mapped, ["field_name", "low"], "left").select(key, "field_name", "value", F.coalesce("own_id", "mapped_id").cast("int").alias("term_id"), F.col("own_id").isNotNull().alias("is_term"), F.when(F.col("own_id").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))
