"""Matching entities across sources without keys: soft-logic linkage.

Both sides are reduced to signatures: ingredient entries, strengths in milligrams, the kind of form, and the parsed
company name; every distinct value is mapped once, equal signatures are one class, and classes travel as hashes. Names of
companies that may be one are found first, by keys that provably meet within the distance accepted; candidate class pairs then
come from one equi-join on company, ingredients and strengths together, in which a field missing on one side drops out of the key.

Weighted rules over the candidates become a convex hinge-loss problem, min sum_k w_k max(0, l_k(x)), x in [0, 1]:

* evidence: what agrees says the pair matches, as far as ingredients, strengths, form and company do (Lukasiewicz
  conjunction of the similarities);
* prior: a pair does not match unless something says so;
* exclusivity: one record is one product, so the products it might be share at most one unit, and likewise for a listing;
* transitivity: listings of one product match a record alike, max(0, x - m) + max(0, m - x) with m the group's own variable.

Pairs without rivals have a closed form. The others are solved by consensus ADMM: pairs that hang together by a record or a
listing form parts, parts are solved side by side, and one too large for a task by rounds over the whole table, in which every step is
a sum over a group. Rounds go on until copies and variables agree. The value of x is the confidence.

Defined results: null, placeholder or unreadable ingredients, strengths and forms do not speak against a pair; a missing
company does; a pair that shares neither ingredients nor strengths needs one known kind of form on both sides and one product of the
company and kind; a pair that agrees in company alone is no candidate; repeated rows are paired each; empty sides give no pairs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regolith.functions.frames import frame, frame_of
from regolith.llm import canonical, mojibake, names
from regolith.operators.packed import FIELD_RULES, Segmenter, letter_bits, osa
from regolith.session import cut

#: The kind each form of the list belongs to.
KINDS = {
    "tablet": "tablet", "film-coated tablet": "tablet", "chewable tablet": "tablet", "dispersible tablet": "tablet", "effervescent tablet": "tablet", "prolonged-release tablet": "tablet",
    "hard capsule": "capsule", "soft capsule": "capsule", "solution for injection": "injection", "powder for injection": "injection", "solution for infusion": "injection", "suspension for injection": "injection",
    "syrup": "oral liquid", "oral suspension": "oral liquid", "oral solution": "oral liquid", "cream": "cream", "ointment": "cream", "gel": "cream", "eye drops": "drops", "ear drops": "drops",
    "nasal spray": "spray", "suppository": "suppository", "pessary": "suppository", "granules": "granules", "metered-dose inhaler": "inhaler", "transdermal patch": "patch",
}
_STRENGTH = re.compile(r"(\d+(?:[.,  ]\d{3})*(?:[.,]\d+)?)\s*(mg|mcg|µg|μg|ug|g|iu|%)(?![a-z])\.?(?:\s*/\s*(\d+(?:[.,]\d+)?)?\s*(ml|l)(?![a-z])\.?)?", re.I)
#: Weights of the rules, the ADMM step, and how far copies and variables may differ at the end.
EVIDENCE, PRIOR, EXCLUSIVE, ALIKE, STEP, TOLERANCE = 4.0, 0.6, 6.0, 1.0, 12.0, 0.01
#: Rounds between two looks at the difference, and rounds after which a problem that does not settle is an error.
CHECKED, MOST_ROUNDS = 2, 2000
#: Contested rows that hang together are solved in one task up to this number, by rounds over the table beyond it.
MEMBERS = 20_000


@functools.lru_cache(100_000)
def number(text: str) -> float | None:
    """A number with a decimal or thousands mark: three digits after a lone comma and no zero before it are thousands."""
    t = re.sub(r"[  ]", "", text)
    if re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", t):
        t = t.replace(",", "")
    try:
        return float(t.replace(",", "."))
    except ValueError:
        return None


def strengths(text: str | None) -> list[str]:
    """Every strength in the text, in milligrams (or the unit given), per millilitres where so written."""
    out = []
    for n, unit, per, volume in _STRENGTH.findall(text or ""):
        value, unit = number(n), unit.lower()
        if value is None:
            continue
        if unit == "g":
            value, unit = value * 1000, "mg"
        elif unit in ("mcg", "µg", "μg", "ug"):
            value, unit = value / 1000, "mg"
        own = f"{value:.6g}{unit}"
        if volume:
            per_value = (number(per) if per else 1.0) or 1.0
            own += f"/{per_value * (1000 if volume.lower() == 'l' else 1):.6g}ml"
        out.append(own)
    return out


#: Of a free text: salts in parentheses, a short form that holds a mark, the marks between its parts, words, and what a word must hold.
_SALT = re.compile(r"\((?=[^)]*[a-z])[^)|]*\)", re.I)
_COATED = re.compile(r"\bf/c\b", re.I)
_BETWEEN = re.compile(r"[;+/&|()]|,(?!\s*(?:micronised|hydrated|anhydrous|m\w{3,}nis\w*|h\w{2,}r\w*ted|an\w{2,}dr\w*s)\b)|\sand\s", re.I)
_WRITTEN, _MEANT = re.compile(r"[^\s,]+"), re.compile(r"[a-zà-ÿ0-9]")


class ListingParser:
    """Finds ingredients, strengths and the form in one free text, in any order."""

    def __init__(self, index: dict[str, canonical.NgramIndex], forms: list[tuple[int, str]]):
        self.index = index
        self.seen: dict[tuple[str, str], tuple[int, float, float]] = {}
        self.form_words: dict[str, bool] = {}
        written = {w for _, name in forms for w in re.findall(r"[a-z0-9]+", canonical.fold(name))}
        #: Words of forms by length, each with the letters it has as bits: an edit changes two of them at most.
        self.written: dict[int, list[tuple[int, str]]] = {}
        for v in sorted(written | {k for k in canonical.WORDS["form"] if len(k) > 1}):
            self.written.setdefault(len(v), []).append((letter_bits(v), v))

    def best(self, field: str, text: str, least: float = 0.0) -> tuple[int, float]:
        """(entry, score) of the best entry; a score below ``least`` is no more than known to be below it."""
        if not text:
            return 0, 0.0
        key = (field, text.lower())  # readings are in lower case
        own = self.seen.get(key)
        if own is None or own[1] < own[2] > least:
            found = self.index[field].best(text, 0.0, least)
            if len(self.seen) > 300_000:
                self.seen.clear()
            own = self.seen[key] = (*(found[0] if found else (0, 0.0)), least)
        return own[:2]

    def form_word(self, word: str) -> bool:
        """Whether a word is one of the words forms are made of, or nearly."""
        word = word.lower()
        if (known := self.form_words.get(word)) is None:
            w = re.sub(r"[^a-z0-9]", "", canonical.fold(word))
            most = 0 if len(w) < 4 else 1 if len(w) < 7 else 2
            bits = letter_bits(w)
            near = (v for n in range(len(w) - most, len(w) + most + 1) for own, v in self.written.get(n, ()) if (own ^ bits).bit_count() <= 2 * most) if w else ()
            known = any(osa(w, v, most) <= most for v in near)
            if len(self.form_words) > 300_000:
                self.form_words.clear()
            self.form_words[word] = known
        return known

    def chunk(self, words: list[str]) -> tuple[str, int, float]:
        """The cut of a chunk's words into an ingredient and a form, before or after it, that both fit best: (ingredient words, form, score).

        Where the words of forms stand together at one end, the cut is there; all cuts are tried only where that fits badly.
        """
        marks = [self.form_word(w) for w in words]
        n = len(words)
        ahead = next((i for i, m in enumerate(marks) if not m), n)
        behind = next((i for i, m in enumerate(reversed(marks)) if not m), n)
        floor = -1.0
        for form, inn in ((words[:ahead], words[ahead:]), (words[n - behind :], words[: n - behind])):
            if len(form) == sum(marks):
                f, fs = self.best("form", " ".join(form)) if form else (0, 0.0)
                i, s = self.best("inn", " ".join(inn)) if inn else (0, 0.0)
                total = (fs - 0.45) * len("".join(form)) * bool(form) + (s - 0.45) * len("".join(inn)) * bool(inn)
                if (not form or fs >= 0.8) and (not inn or s >= 0.7):
                    return " ".join(inn), f, total
                floor = max(floor, total)
        best = ("", 0, -1.0)
        for k in range(n + 1):
            for form, inn in ((words[:k], words[k:]), (words[n - k :], words[: n - k])):
                f_size, i_size = len("".join(form)), len("".join(inn))
                # what the one must score for the cut to win, though the other fit wholly, and then beside the other's score
                wanted = max(best[2], floor) - 1e-9
                least = 0.45 + (wanted - 0.55 * f_size) / i_size if inn else 0.0
                i, s = self.best("inn", " ".join(inn), max(0.0, least)) if inn else (0, 0.0)
                if inn and s < least:
                    continue
                least = 0.45 + (wanted - (s - 0.45) * i_size) / f_size if form else 0.0
                f, fs = self.best("form", " ".join(form), max(0.0, least)) if form and least <= 1.0 else (0, 0.0)
                if form and fs < least:
                    continue
                total = (fs - 0.45) * f_size * bool(form) + (s - 0.45) * i_size * bool(inn)
                if total > best[2]:
                    best = (" ".join(inn), f if fs >= canonical.THRESHOLD["form"] else 0, total)
        return best

    def parse(self, text: str | None) -> tuple[list[str], list[str], int]:
        """(ingredient entries, strengths, form entry)."""
        if not text:
            return [], [], 0
        strong = strengths(text)
        rest = _STRENGTH.sub(" | ", text)
        rest = _SALT.sub(" ", rest)
        ingredients, form, form_score = [], 0, 0.0
        for part in _BETWEEN.split(_COATED.sub("fc", rest)):
            words = [w for w in _WRITTEN.findall(part or "") if _MEANT.search(w.lower())]
            if not words:
                continue
            inn, f, score = self.chunk(words)
            if f and score > form_score:
                form, form_score = f, score
            if inn:
                entry, s = self.best("inn", inn, canonical.THRESHOLD["inn"])
                if entry and s >= canonical.THRESHOLD["inn"]:
                    ingredients.append(str(entry))
                elif not f and self.best("form", inn, canonical.THRESHOLD["form"])[1] < canonical.THRESHOLD["form"]:
                    ingredients.append("x:" + (canonical.readings(inn, "inn") or [inn])[0])
        return sorted(set(ingredients)), strong, form


def _names_of(reference: DataFrame) -> dict[str, list[tuple[int, str]]]:
    """Terms and aliases of ingredients and forms: a fixed list, refused beyond the block size the mapping works with."""
    flat = reference.where(F.col("field_name").isin("inn", "form")).select("term_id", "field_name", F.lower("term").alias("term"), F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("term"))).alias("name")).where(F.col("name").isNotNull())
    rows = flat.distinct().limit(canonical.BLOCK + 1).collect()
    if len(rows) > canonical.BLOCK:
        raise ValueError("the reference list is too long to send to every worker")
    out: dict[str, list[tuple[int, str]]] = {"inn": [], "form": [], "term": [], "kind": []}
    for r in rows:
        out[r.field_name].append((r.term_id, r.name))
        if r.term == r.name.lower():
            out["term"].append((r.term_id, f"{r.field_name}|{r.term}"))
            if r.field_name == "form" and r.term in KINDS:
                out["kind"].append((r.term_id, KINDS[r.term]))
    return out


class Signer:
    """Reduces single values of either side to what they mean; built once per task, what it has seen is kept."""

    def __init__(self, names_of: dict[str, list[tuple[int, str]]], model: tuple | None, added: Iterable[str] = ()):
        self.lexicon = names.Lexicon(added)
        self.index = {f: canonical.NgramIndex(names_of[f], f) for f in ("inn", "form")}
        self.terms = {key: entry for entry, key in sorted(names_of["term"], reverse=True)}
        self.kinds = dict(names_of["kind"])
        self.segments = Segmenter(FIELD_RULES["inn"], [n.lower() for _, n in names_of["inn"]])
        self.parser = ListingParser(self.index, names_of["form"])
        self.channel = mojibake.Channel(*model) if model else None
        self.items: dict[str, str] = {}
        self.companies: dict[str, tuple[str, str, str]] = {}

    def entry(self, field: str, value: str) -> int:
        """The list entry a value means, 0 for none."""
        low = value.lower()
        if (own := self.terms.get(f"{field}|{low}")) is not None:
            return own
        best = self.index[field].best(low, canonical.MARGIN[field], canonical.THRESHOLD[field])
        lead = best[0][1] - (best[1][1] if len(best) > 1 else 0.0) if best else 0.0
        return best[0][0] if best and best[0][1] >= canonical.THRESHOLD[field] and lead >= canonical.MARGIN[field] else 0

    @staticmethod
    def bare(value: str) -> str:
        v = value.strip()
        return v[1:-1].strip() if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v

    def ingredients(self, text: str) -> str:
        found = set()
        for item in self.segments.cut(text) if _PACKED.search(text) else [text]:
            v = self.bare(item).lower()
            if v not in canonical.PLACEHOLDERS:
                if (own := self.items.get(v)) is None:
                    e = self.entry("inn", v)
                    own = self.items[v] = str(e) if e else f"x:{v}"
                found.add(own)
        if len(self.items) > 400_000:
            self.items.clear()
        return "+".join(sorted(found))

    def kind(self, text: str) -> str:
        v = self.bare(text)
        return "" if v.lower() in canonical.PLACEHOLDERS else self.kinds.get(self.entry("form", v), "")

    def company(self, name: str) -> tuple[str, str, str]:
        if (own := self.companies.get(name)) is None:
            if len(self.companies) > 400_000:
                self.companies.clear()
            own = self.companies[name] = self._company(name)
        return own

    def _company(self, name: str) -> tuple[str, str, str]:
        if name.strip().lower() in canonical.PLACEHOLDERS:
            return "", "", ""
        if self.channel and not name.isascii():
            parts = mojibake._SPLIT.split(name)
            name = "".join(p if i % 2 or p.isascii() else self.channel.restore(p)[0] for i, p in enumerate(parts))
        return names.parse(name, self.lexicon)


_KEPT: dict[str, Signer] = {}


def _signer(name: str, fixed: Broadcast, model: Broadcast | None) -> Signer:
    """The worker's signer for one run: workers outlive tasks, and so does what they have seen; those of earlier runs are dropped."""
    if name not in _KEPT:
        _KEPT.clear()
        names_of, added = fixed.value
        _KEPT[name] = Signer(names_of, model.value if model is not None else None, added)
    return _KEPT[name]


_PACKED = re.compile(r"[;,+/&|\n\t\r]|\sand\s", re.I)
_PARTS = ("ing", "str", "kind", "company")
_TRIPLE = ("core", "extra", "trade")


def _code(*columns) -> Column:
    """Hash of what a field means, 0 where it is missing."""
    return F.when(F.coalesce(columns[0], F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(*columns))


def _values(rows: DataFrame, *fields: str) -> DataFrame:
    """(field, value): the distinct values of the fields."""
    return rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))).where(F.col("value").isNotNull()).distinct()


def _meant(values: DataFrame, reference: Broadcast, model: Broadcast | None) -> DataFrame:
    """(field, at, sign, core, extra, trade) of distinct values, mapped once; ``at`` is the value's hash."""
    run = uuid4().hex
    values = values.withColumn("at", F.xxhash64("field", "value"))  # as _at

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = _signer(run, reference, model)
        for batch in batches:
            out = []
            for field, value, place in zip(batch["field"], batch["value"], batch["at"]):
                if field == "company_raw":
                    out.append((field, place, None, *signer.company(value)))
                else:
                    sign = signer.ingredients(value) if field == "inn" else signer.kind(value) if field == "form" else "+".join(sorted(strengths(value)))
                    out.append((field, place, sign, None, None, None))
            yield frame_of(out, ("field", "at", "sign", *_TRIPLE))

    spread = values.repartition(4 * values.sparkSession.sparkContext.defaultParallelism, "at")  # few bytes, much work
    return cut(spread.mapInPandas(mean, "field string, at long, sign string, core string, extra string, trade string"))


def _at(field: str) -> Column:
    return F.xxhash64(F.lit(field), F.col(field))


def _codes(meant: DataFrame, field: str, name: str) -> DataFrame:
    """(<field>_at, name): the hash of what each value means; each value comes once, so rows find it in a hash table and need no order."""
    return meant.where(F.col("field") == field).select(F.col("at").alias(f"{field}_at"), (_code(*map(F.col, _TRIPLE)) if field == "company_raw" else _code(F.col("sign"))).alias(name)).hint("shuffle_hash")


def record_signatures(records: DataFrame, reference: Broadcast, listed: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, ing, str, kind, company) of records that may have a listing, as hashes, 0 where missing; and the pairs of companies that may be one.

    With each record, whether some listing its company may have is without ingredients (``bare``) or without strengths (``open``).

    Companies and strengths come first, as they are cheap: a record is left out where no listing has a company that may be its own
    with its strengths, or with either side's strengths missing. Only what is left has its ingredients and form mapped.
    """
    context = records.sparkSession.sparkContext
    written = cut(records.where(F.col("company_raw").isNotNull()).groupBy("company_raw").agg(F.count("*").alias("n"), (F.count("ord") > 0).alias("wanted")))
    tokens = mojibake.corpus_tokens(written, ("company_raw",), "n")
    model = mojibake.tokens_model(tokens)
    model = context.broadcast((*model, mojibake.restored_tokens(tokens, context.broadcast(model))))
    wanted = records.select("ord", "inn", "strength", "form", "company_raw").where(F.col("ord").isNotNull() & F.col("company_raw").isNotNull())
    meant = _meant(_values(wanted, "strength").unionByName(written.where("wanted").select(F.lit("company_raw").alias("field"), F.col("company_raw").alias("value"))), reference, model)
    companies = meant.where("field = 'company_raw' AND core <> ''").select(_code(*map(F.col, _TRIPLE)).alias("company"), *_TRIPLE).distinct()
    alike = cut(alike_companies(companies, others))
    reach = listed.groupBy(F.col("company").alias("company_c"), "str").agg(F.bool_or(F.col("ing") == 0).alias("bare"))
    reach = reach.join(alike.select(F.col("company_r").alias("company"), "company_c"), "company_c").groupBy("company", "str").agg(F.bool_or("bare").alias("bare"))
    near = _codes(meant, "company_raw", "company").join(reach.groupBy("company").agg(F.bool_or(F.col("str") == 0).alias("open"), F.bool_or("bare").alias("bare")), "company").hint("shuffle_hash")
    rows = wanted.select("ord", "inn", "form", _at("strength").alias("strength_at"), _at("company_raw").alias("company_raw_at")).join(near, "company_raw_at").drop("company_raw_at")
    rows = rows.join(_codes(meant, "strength", "str"), "strength_at", "left").drop("strength_at").na.fill(0, ["str"])
    rows = rows.join(reach.where("str <> 0").select("company", "str", F.lit(True).alias("met")).hint("shuffle_hash"), ["company", "str"], "left").where(F.col("open") | (F.col("str") == 0) | F.col("met"))
    rows = cut(rows.select("ord", "inn", "form", "str", "company", "bare", "open"))
    meant = _meant(_values(rows, "inn", "form"), reference, None)
    rows = rows.select("ord", "str", "company", "bare", "open", _at("inn").alias("inn_at"), _at("form").alias("form_at"))
    rows = rows.join(_codes(meant, "form", "kind"), "form_at", "left").join(_codes(meant, "inn", "ing"), "inn_at", "left")
    return rows.na.fill(0, ["kind", "ing"]).select("ord", *_PARTS, "bare", "open"), alike


def listing_signatures(listings: DataFrame, reference: Broadcast) -> tuple[DataFrame, DataFrame]:
    """(listing_id, ing, str, kind, company) of the other register's free texts, and their companies."""
    context, run = listings.sparkSession.sparkContext, uuid4().hex

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = _signer(run, reference, None)
        for batch in batches:
            out: list[tuple] = []
            for listing, generic, name in zip(batch["listing_id"], batch["generic_name"], batch["company_raw"]):
                triple = signer.company(name)
                if triple[0]:
                    ing, strong, form = signer.parser.parse(generic if isinstance(generic, str) else None)
                    out.append((listing, "+".join(ing), "+".join(sorted(strong)), signer.kinds.get(form, ""), *triple))
            yield frame_of(out, ("listing_id", "ing", "str", "kind", *_TRIPLE))

    flat = listings.select("listing_id", "generic_name", F.col("marketing_authorisation_holder.value").alias("company_raw")).where(F.col("company_raw").isNotNull() & F.col("listing_id").isNotNull())
    signed = cut(flat.repartition(4 * context.defaultParallelism).mapInPandas(mean, "listing_id long, ing string, str string, kind string, core string, extra string, trade string"))
    company = _code(*map(F.col, _TRIPLE)).alias("company")
    return signed.select("listing_id", *[_code(F.col(x)).alias(x) for x in ("ing", "str", "kind")], company), signed.select(company, *_TRIPLE).distinct()


def _classes(signatures: DataFrame, tag: str, *more: str) -> DataFrame:
    """Distinct signatures with their class number, columns tagged; ``more`` are columns that follow from the signature."""
    return signatures.select(*_PARTS, *more).distinct().select(F.xxhash64(*_PARTS).alias(tag), *[F.col(c).alias(f"{c}_{tag}") for c in _PARTS], *more)


def core_keys(core: str) -> list[str]:
    """Keys of which two cores share one wherever ``similar`` may hold.

    Cut both cores where the first five letters of one end: of up to three edits one part takes one at most, so the
    beginnings or the ends share what a single deletion leaves of them. Short cores within two edits share what two deletions
    leave; cores within three edits are similar only with the same first letter, so it is part of the key.
    """
    keys = {"p" + x for x in names._deletions(core[:5], 1)}
    if len(core) >= 9:
        keys |= {"s" + x for x in names._deletions(core[-5:], 1)} | {"e" + core[0] + x for x in names._deletions(core[-4:], 1)}
    if 6 <= len(core) <= 10:  # the longer of two gives two letters up, the shorter has at most eight
        keys |= {"d" + x for x in names._deletions(core, 2) if len(core) <= 8 or len(x) == len(core) - 2}
    return list(keys)


def similar(a: str = "core_r", b: str = "core_c") -> Column:
    """How alike two cores are: equal but for a typing error or a cut end 1, else less, 0 for different ones."""
    a, b = F.col(a), F.col(b)
    least = F.least(F.length(a), F.length(b))
    d = F.levenshtein(a, b)
    prefix = (F.startswith(a, b) | F.startswith(b, a)) & (least >= 5)
    cut_short = F.levenshtein(F.left(a, least), F.left(b, least)) <= 1
    return (
        F.when(a == b, 1.0)
        .when(prefix & (F.abs(F.length(a) - F.length(b)) <= 4), 1.0)
        .when((d <= 1) & (least >= 4), 1.0)
        .when((d <= 2) & (least >= 6), 0.95)
        .when((d == 3) & (least >= 9) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)), 0.8)
        .when(cut_short & (least >= 5), 0.85)
        .otherwise(0.0)
    )


def alike_companies(left: DataFrame, right: DataFrame) -> DataFrame:
    """(company_r, company_c, company): pairs of companies that may be one, with the similarity; each side is (company, core, extra, trade)."""

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame(core=batch["core"], key=[core_keys(c) for c in batch["core"]])

    def keyed(side: DataFrame, name: str) -> DataFrame:
        keys = side.select("core").distinct().mapInPandas(key, "core string, key array<string>")
        return keys.select(F.col("core").alias(name), F.explode("key").alias("key")).select(name, F.xxhash64("key").alias("key"))

    cores = keyed(left, "core_r").join(keyed(right, "core_c"), "key").select("core_r", "core_c").distinct().withColumn("near", similar()).where("near > 0")
    side = lambda df, t: df.select(*[F.col(c).alias(f"{c}_{t}") for c in ("company", *_TRIPLE)])
    extra, trade = names._fits("extra_r", "extra_c"), names._fits("trade_r", "trade_c")
    both = cores.join(side(left, "r"), "core_r").join(side(right, "c"), "core_c").where((extra >= 0) & (trade >= 0))
    near = F.col("near") - F.when(F.col("extra_r") == F.col("extra_c"), 0.0).otherwise(0.1) - F.when(F.col("trade_r") == F.col("trade_c"), 0.0).otherwise(0.05)
    return both.select("company_r", "company_c", near.alias("company")).where("company >= 0.6")


def candidates(left: DataFrame, right: DataFrame, alike: DataFrame) -> DataFrame:
    """(r, c, sim, ing_r, str_r, kind_r, ing_c, str_c, kind_c): class pairs whose known fields agree and whose companies may be one.

    One equi-join on company, ingredients and strengths together, so no pair is made only to be thrown away but for its kind of
    form. A side that knows a field offers its value and, where the other may lack it, a mark; a side that lacks it offers
    that mark: every pair meets under exactly one key. ``bare`` and ``open`` of the left say whether the listings of companies that may be
    its own lack ingredients or strengths at all. Pairs that share neither ingredients nor strengths must be of one known
    kind, and are made only where one product of that company and kind is there at all: where several would fit alike, none is it.
    """
    own, lacks, any_ = 0, 1, 2
    mark = lambda n, v=None: F.xxhash64(F.lit(n), v if v is not None else F.lit(0))
    without = {"ing_r": "bare", "str_r": "open"}
    ways_r = lambda x: F.when(F.col(x) == 0, F.array(mark(any_))).when(F.col(without[x]), F.array(mark(own, F.col(x)), mark(lacks))).otherwise(F.array(mark(own, F.col(x))))
    ways_c = lambda x: F.when(F.col(x) != 0, F.array(mark(own, F.col(x)), mark(any_))).otherwise(F.array(mark(lacks), mark(any_)))
    cross = lambda a, b: F.flatten(F.transform(a, lambda i: F.transform(b, lambda s: F.struct(i.alias("i"), s.alias("s")))))
    blank = [mark(lacks), mark(any_)]
    agree = lambda k: ~(k["i"].isin(*blank) & k["s"].isin(*blank))
    right = right.join(alike, "company_c")
    keys = lambda company, ways, a, b: F.transform(F.filter(cross(ways(a), ways(b)), agree), lambda k: F.xxhash64(F.col(company), k["i"], k["s"]))
    # a class goes into the join as its number alone, a class of listings with the similarity of the company it stands for
    met = left.select("r", F.explode(keys("company_r", ways_r, "ing_r", "str_r")).alias("key")).join(right.select("c", "company", F.explode(keys("company_r", ways_c, "ing_c", "str_c")).alias("key")), "key").select("r", "c", "company")
    # pairs that know nothing in common but the kind
    known = lambda t: (F.col(f"ing_{t}") != 0) | (F.col(f"str_{t}") != 0)
    poor_r, poor_c = (F.col("ing_r") == 0) | (F.col("str_r") == 0), (F.col("ing_c") == 0) | (F.col("str_c") == 0)
    place = ["company_r", "kind"]
    of_kind_r, of_kind_c = left.where("kind_r <> 0").withColumnRenamed("kind_r", "kind"), right.where("kind_c <> 0").withColumnRenamed("kind_c", "kind")
    product = lambda df, t: df.select(*place, F.lit(t).alias("t"), F.when(known(t), F.xxhash64(f"ing_{t}", f"str_{t}")).alias("p"), (poor_r if t == "r" else poor_c).alias("poor"))
    only = lambda t: F.coalesce(F.min(F.when(F.col("t") == t, F.col("p"))) == F.max(F.when(F.col("t") == t, F.col("p"))), F.lit(True))
    there = product(of_kind_r, "r").unionByName(product(of_kind_c, "c")).groupBy(*place)
    single = there.agg((only("r") & only("c") & F.bool_or("poor") & (F.min("t") != F.max("t"))).alias("single")).where("single")
    rest = of_kind_r.join(single.select(*place), place).join(of_kind_c.select("c", "company", "ing_c", "str_c", *place), place)
    rest = rest.where(((F.col("ing_r") == 0) | (F.col("ing_c") == 0)) & ((F.col("str_r") == 0) | (F.col("str_c") == 0)) & (known("r") | known("c"))).select("r", "c", "company")
    met = met.unionByName(rest)
    out = met.join(left.select("r", "ing_r", "str_r", "kind_r"), "r").join(right.select("c", "ing_c", "str_c", "kind_c").distinct(), "c")
    out = out.where((F.col("kind_r") == F.col("kind_c")) | (F.col("kind_r") == 0) | (F.col("kind_c") == 0))
    value = lambda x, miss: F.when((F.col(f"{x}_r") == 0) | (F.col(f"{x}_c") == 0), miss).otherwise(1.0)
    score = value("ing", 0.8) + value("str", 0.85) + value("kind", 0.95) + F.col("company") - 3
    return out.withColumn("sim", F.greatest(F.lit(0.0), score)).drop("company")


def infer(pairs: DataFrame) -> DataFrame:
    """(r, c, confidence): the least of the sum of all hinges.

    A pair without a rival product on either side is bound by evidence, prior and transitivity alone, and those have a closed
    form: x is the pair's similarity, raised to the point of its group where as much pulls up as down. The others go through
    consensus ADMM: exclusivity and transitivity hold copies of the variables, evidence and prior are solved in the variable's
    own step. Every step is an aggregate over a group, and rounds go on until copies and variables agree within ``TOLERANCE``.
    """
    # what a side lacks it takes from the other: candidates that differ in that are different products
    taken = lambda own, other: F.xxhash64(*[F.when(F.col(f"{x}_{own}") == 0, F.col(f"{x}_{other}")).otherwise(F.lit(0).cast("long")) for x in ("ing", "str", "kind")])
    pairs = pairs.select("r", "c", "sim", taken("c", "r").alias("kr"), taken("r", "c").alias("kc"))
    # of the candidates of one record that are one product, each counts its part, so that a product counts once; windows spill, and share their order
    alike_r, alike_c = W.partitionBy("r", "kc"), W.partitionBy("c", "kr")
    placed = pairs.withColumns({"n_r": F.count("*").over(alike_r), "rank": F.cume_dist().over(alike_r.orderBy("sim"))})
    placed = placed.withColumn("level", F.min(F.when(F.col("rank") >= ALIKE / (ALIKE + PRIOR), F.col("sim"))).over(alike_r)).drop("rank")
    placed = placed.withColumns({"k_r": F.round(F.sum(1.0 / F.col("n_r")).over(W.partitionBy("r"))), "aa_r": F.sum(1.0 / (F.col("n_r") * F.col("n_r"))).over(W.partitionBy("r"))})
    placed = placed.withColumn("n_c", F.count("*").over(alike_c))
    placed = placed.withColumns({"k_c": F.round(F.sum(1.0 / F.col("n_c")).over(W.partitionBy("c"))), "aa_c": F.sum(1.0 / (F.col("n_c") * F.col("n_c"))).over(W.partitionBy("c"))})
    contested = (F.col("k_r") > 1) | (F.col("k_c") > 1)
    placed = cut(placed.withColumn("open", F.bool_or(contested).over(alike_r)))
    settled = placed.where(~F.col("open")).select("r", "c", F.greatest("sim", "level").alias("confidence"))
    # one row holds a variable z, its group's m, and the scaled duals of the copies it has; a flag says which it has
    flags = {"r": F.col("k_r") > 1, "c": F.col("k_c") > 1, "t": F.col("n_r") > 1}
    state = placed.where("open").select(
        "r", "c", "kc", "sim", (1.0 / F.col("n_r")).alias("a_r"), (1.0 / F.col("n_c")).alias("a_c"), "aa_r", "aa_c",
        *[x.cast("double").alias(f"has_{k}") for k, x in flags.items()], "level", F.col("sim").alias("z"), F.col("level").alias("m"), *[F.lit(0.0).alias(f"u_{k}") for k in "rctm"], F.lit(1.0).alias("gap"),
    )
    state = _parts(state)
    sizes = state.groupBy("part").agg(F.count("*").alias("size"))
    kept = ["r", "c", "confidence"]
    most, total = sizes.agg(F.max("size"), F.sum("size")).first()
    if not most:
        return settled
    small = state if most <= MEMBERS else state.join(sizes.where(F.col("size") <= MEMBERS), "part", "left_semi")
    dealt = F.pmod(F.xxhash64("part"), F.lit(-(-total // MEMBERS)))  # parts by the lot, as a call costs more than a part
    solved = settled.unionByName(small.groupBy(dealt).applyInPandas(_solved, "r long, c long, confidence double"))
    return solved if most <= MEMBERS else solved.unionByName(_rounds(state.join(sizes.where(F.col("size") > MEMBERS), "part", "left_semi")).select(*kept))


def _parts(state: DataFrame) -> DataFrame:
    """The rows with ``part``: contested rows that hang together by a record or a listing have the same; a few steps nearly always suffice."""
    state = state.withColumn("part", F.least("r", "c"))
    while True:
        for k in "rcrc":
            state = state.withColumn("part", F.min("part").over(W.partitionBy(k)))
        state = cut(state)
        # after the step by listings only a record can still hold two parts
        if state.groupBy("r").agg((F.min("part") != F.max("part")).alias("split")).where("split").isEmpty():
            return state


def _rounds(state: DataFrame) -> DataFrame:
    """The confidences of contested rows by rounds over the whole table; for parts too large for one task."""
    columns = state.columns
    state = cut(state)
    rounds = 0
    while (state.agg(F.max("gap")).first()[0] or 0.0) > TOLERANCE:
        if rounds >= MOST_ROUNDS:
            raise RuntimeError(f"copies and variables still differ after {rounds} rounds")
        for _ in range(CHECKED):
            state = _round(state).select(*columns)
        rounds += CHECKED
        state = cut(state)
    return state.withColumnRenamed("z", "confidence")


def _solved(rows: pd.DataFrame) -> pd.DataFrame:
    """The same rounds over some parts in memory, for each part until it settles; no part touches another."""
    rows = rows.sort_values("part", kind="stable")
    number = {k: np.unique(rows[k].to_numpy(), return_inverse=True)[1] for k in ("r", "c", "kc", "part")}
    # (bins of a sum, per row; columns of the rows still at work)
    at = {"r": number["r"], "c": number["c"], "t": np.unique(number["r"] * len(rows) + number["kc"], return_inverse=True)[1]}
    twins = np.bincount(at["t"])[at["t"]]
    x = {c: rows[c].to_numpy(dtype=float) for c in ("has_r", "has_c", "has_t", "a_r", "a_c", "aa_r", "aa_c", "sim", "z", "m")}
    x |= {f"at_{k}": v for k, v in at.items()} | {f"u_{k}": np.zeros(len(rows)) for k in "rctm"} | {"twins": twins, "part": number["part"], "row": np.arange(len(rows))}
    x["copies"] = x["has_r"] + x["has_c"] + x["has_t"]
    confidence = np.zeros(len(rows))
    for _ in range(MOST_ROUNDS):
        y, z, m = {}, x["z"], x["m"]
        for k in "rc":
            q = z - x[f"u_{k}"]
            over = np.bincount(x[f"at_{k}"], x[f"a_{k}"] * q)[x[f"at_{k}"]] - 1.0
            y[k] = q - np.clip(over / x[f"aa_{k}"], 0.0, EXCLUSIVE / STEP) * x[f"a_{k}"]
        apart = np.clip((z - x["u_t"] - m + x["u_m"]) / 2, -ALIKE / STEP, ALIKE / STEP)
        y["t"], y_m = z - x["u_t"] - apart, m - x["u_m"] + apart
        mean = sum(x[f"has_{k}"] * (y[k] + x[f"u_{k}"]) for k in "rct") / x["copies"]
        up, down = mean + (EVIDENCE - PRIOR) / (x["copies"] * STEP), mean - PRIOR / (x["copies"] * STEP)
        new = np.clip(np.where(up < x["sim"], up, np.where(down > x["sim"], down, x["sim"])), 0.0, 1.0)
        m_new = np.bincount(x["at_t"], y_m + x["u_m"])[x["at_t"]] / x["twins"]
        gap = np.maximum.reduce([*[x[f"has_{k}"] * np.abs(y[k] - new) for k in "rct"], x["has_t"] * np.abs(y_m - m_new), np.abs(new - z)])
        for k in "rct":
            x[f"u_{k}"] = x[f"u_{k}"] + y[k] - new
        x["u_m"] = x["u_m"] + y_m - m_new
        x["z"], x["m"] = new, m_new
        starts = np.nonzero(np.diff(x["part"], prepend=-1))[0]
        ended = np.repeat(np.maximum.reduceat(gap, starts) <= TOLERANCE / 10, np.diff(starts, append=len(gap)))
        if ended.any():
            confidence[x["row"][ended]] = new[ended]
            if ended.all():
                return frame(r=rows["r"], c=rows["c"], confidence=confidence.tolist())
            x = {k: v[~ended] for k, v in x.items()}
    raise RuntimeError(f"copies and variables still differ after {MOST_ROUNDS} rounds")


def _round(state: DataFrame) -> DataFrame:
    """One round: copies of exclusivity and transitivity, then the variables, then the duals."""
    # windows spill, and what is contested is a few rows of a product: a join with itself would double the plan every time
    for k in "cr":
        state = state.withColumn(f"s_{k}", F.sum(F.col(f"a_{k}") * (F.col("z") - F.col(f"u_{k}"))).over(W.partitionBy(k)))

    def exclusive(k: str) -> Column:
        # the step of one member of w * max(0, sum - 1): where the hinge is flat stay, where it is steep move by w, else to the bend
        over, aa = F.col(f"s_{k}") - 1.0, F.col(f"aa_{k}")
        return F.col("z") - F.col(f"u_{k}") - F.least(F.greatest(over / aa, F.lit(0.0)), F.lit(EXCLUSIVE / STEP)) * F.col(f"a_{k}")

    most = F.lit(ALIKE / STEP)
    apart = F.greatest(-most, F.least(most, (F.col("z") - F.col("u_t") - F.col("m") + F.col("u_m")) / 2))
    state = state.withColumns({"y_r": exclusive("r"), "y_c": exclusive("c"), "y_t": F.col("z") - F.col("u_t") - apart, "y_m": F.col("m") - F.col("u_m") + apart})
    copies = F.col("has_r") + F.col("has_c") + F.col("has_t")
    mean = sum((F.col(f"has_{k}") * (F.col(f"y_{k}") + F.col(f"u_{k}")) for k in "rct"), F.lit(0.0)) / copies
    up, down = mean + (EVIDENCE - PRIOR) / (copies * STEP), mean - PRIOR / (copies * STEP)
    z = F.when(up < F.col("sim"), up).when(down > F.col("sim"), down).otherwise(F.col("sim"))
    state = state.withColumn("z_new", F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)))
    state = state.withColumn("m_new", F.avg(F.col("y_m") + F.col("u_m")).over(W.partitionBy("r", "kc")))
    moved = F.greatest(*[F.col(f"has_{k}") * F.abs(F.col(f"y_{k}") - F.col("z_new")) for k in "rct"], F.col("has_t") * F.abs(F.col("y_m") - F.col("m_new")), F.abs(F.col("z_new") - F.col("z")))
    state = state.withColumns({"gap": moved, **{f"u_{k}": F.col(f"u_{k}") + F.col(f"y_{k}") - F.col("z_new") for k in "rct"}, "u_m": F.col("u_m") + F.col("y_m") - F.col("m_new")})
    return state.drop("z", "m").withColumnsRenamed({"z_new": "z", "m_new": "m"})


def link_products(records: DataFrame, listings: DataFrame, reference: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(ord, listing_id, confidence) of pairs above the threshold by more than the tolerance to which confidences are solved."""
    # listings are typed from paper, so no damaged encoding tears their words apart
    holders = listings.select(F.col("marketing_authorisation_holder.value").alias("company_raw"))
    fixed = records.sparkSession.sparkContext.broadcast((_names_of(reference), names.added_words(holders)))
    right, others = listing_signatures(listings, fixed)
    left, alike = record_signatures(records, fixed, right, others)
    left = cut(left)
    pairs = cut(candidates(_classes(left, "r", "bare", "open"), _classes(right, "c"), alike))
    found = infer(pairs).where(F.col("confidence") > threshold + TOLERANCE)
    rows = left.select("ord", F.xxhash64(*_PARTS).alias("r"))
    listed = right.select("listing_id", F.xxhash64(*_PARTS).alias("c"))
    return found.join(rows, "r").join(listed, "c").select("ord", "listing_id", "confidence")
