"""Several values packed into one field: dictionary-guided segmentation.

A multi-pattern automaton finds known whole values (reference terms, descriptions that the corpus itself shows never to
stand alone, fixed two-word names) in the text; dynamic programming picks the best cover of the text by such values, and
every delimiter inside the cover, inside quotes, inside parentheses or inside a number is protected. What is left of
the delimiters cuts the field.

Defined results: null, empty and blank fields give no rows; blank pieces (doubled or trailing delimiters) have no
position; an opening quote or parenthesis that is never closed protects nothing; a placeholder such as ``N/A`` is one
value; repeated rows give repeated results; rows without a key give none; columns beyond the key and the fields are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.functions.frames import frame

#: Descriptions that follow a comma and belong to the value before it, by field.
INN_TAILS = ("micronised", "micronized", "hydrated", "anhydrous", "monohydrate", "dihydrate", "trihydrate", "hemihydrate", "hydrate", "purified", "dried")
NAME_TAILS = ("sugar-free", "sugar free", "junior", "crème", "creme", "tablets", "tablet", "capsules", "oral use", "old pack", "export only", "infantil", "forte", "adult")
#: Names that hold a delimiter.
FIXED_NAMES = ("n/a", "cough & cold", "hot & sweet", "day & night", "i/m", "i/v", "s/c", "p/o", "f/c tab")

_UNIT = r"(?:mg|mcg|µg|ug|g|iu|ml|l|%)"
_PER_VOLUME = re.compile(r"\s*(?:\d+(?:[.,]\d+)?\s*)?(?:ml|l|dose|doses|actuation|h|hour|day)\b|\s*(?:g|kg)\b", re.I)
_STRENGTH_TAIL = re.compile(r"\s+\d+(?:[.,]\d+)?\s*" + _UNIT + r"\.?(?:\s*/\s*(?:\d+(?:[.,]\d+)?\s*)?(?:ml|l|g)\.?)?$", re.I)
_NAME_TAIL_PATTERN = re.compile(r"(?:\d+|box of \d+|pack of \d+|n[^a-z0-9\s]{1,6}\s*\d+|cr[^a-z]{1,6}me)(?:\s.*)?$", re.I)
_GUARDS = re.compile("[\"'“‘(]")
#: Where one of these stands, what it protects must be looked at; elsewhere every delimiter cuts.
_CAREFUL = re.compile("[\"'“‘(,/]")
_WORD_DELIMITER = re.compile(r"\s(and)\s", re.I)


#: What may cut any field, and how many known values that hold such may be sent to every task.
DELIMITED = r"[;,+/&|\n\t\r]|(?i:\sand\s)"
MOST_KNOWN = 200_000


@dataclass(frozen=True)
class Rules:
    """What cuts a field, and what a comma may be followed by without cutting."""

    delimiters: str
    words: bool = False
    tails: tuple[str, ...] = ()
    tail_pattern: bool = False
    fuzzy_tails: bool = False
    slash_needs_words: bool = False
    per_volume: bool = False
    known: tuple[str, ...] = field(default=())


FIELD_RULES = {
    "inn": Rules(";,+/&|\n\t\r", words=True, tails=INN_TAILS, fuzzy_tails=True, known=FIXED_NAMES),
    "strength": Rules(";,+/&|\n\t\r", words=True, per_volume=True, known=("n/a",)),
    "product_name": Rules(";,/|\n\t\r", tails=NAME_TAILS, tail_pattern=True, slash_needs_words=True, per_volume=True, known=FIXED_NAMES),
    "route": Rules(";,+/&|\n\t\r", words=True, known=FIXED_NAMES),
}


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, ``most`` + 1 when larger; one column of the table is one machine word or big integer."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    size = len(a)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down, diagonal, before, distance = full, 0, 0, 0, size
    for y in b:
        here = places.get(y, 0)
        swapped = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swapped) & full
        more, less = (down | ~(diagonal | up)) & full, diagonal & up
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more, less = (more << 1) | 1, less << 1
        up, down, before = (less | ~(diagonal | more)) & full, more & diagonal & full, here
    return distance if distance <= most else most + 1


def letter_bits(word: str) -> int:
    """The letters of a word as a set of bits: an edit changes two of them at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 127)
    return bits


def _protected(text: str) -> bytearray:
    """Marks characters inside closed quotes (opened at the start of a piece) and closed parentheses."""
    safe = bytearray(len(text))
    if not _GUARDS.search(text):
        return safe
    i, fresh = 0, True
    while i < len(text):
        c = text[i]
        if c in "\"'“‘" and fresh:
            closing = {"“": "”", "‘": "’"}.get(c, c)
            j = text.find(closing, i + 1)
            while j != -1 and j + 1 < len(text) and text[j + 1].isalnum():
                j = text.find(closing, j + 1)
            if j > i:
                safe[i : j + 1] = b"\1" * (j + 1 - i)
                i, fresh = j + 1, False
                continue
        elif c == "(":
            j = text.find(")", i + 1)
            if j > i:
                safe[i : j + 1] = b"\1" * (j + 1 - i)
                i, fresh = j + 1, False
                continue
        fresh = c in ";,+/&|\n\t\r" or (fresh and (c.isspace() or c in "*#")) or text[max(0, i - 4) : i + 1].lower() == " and "
        i += 1
    return safe


class Segmenter:
    """Cuts the texts of one field; built once per task from the dictionary of known whole values."""

    def __init__(self, rules: Rules, known: Iterable[str] = (), tails: Iterable[str] = ()):
        import ahocorasick

        self.rules = rules
        self.cutters = frozenset(rules.delimiters)
        self.plain = re.compile("[" + re.escape(rules.delimiters) + "]" + (r"|(?i:(?<=\s)and(?=\s))" if rules.words else ""))
        self.tails = frozenset(rules.tails) | {t for t in tails if t}
        self.long_tails = tuple((letter_bits(t), t) for t in self.tails if len(t) >= 6) if rules.fuzzy_tails else ()
        self.automaton = ahocorasick.Automaton()
        self.any = False
        for value in {*rules.known, *known}:
            if value and (self.cutters & set(value) or (rules.words and " and " in value)):
                self.automaton.add_word(value, len(value))
                self.any = True
        if self.any:
            self.automaton.make_automaton()

    def _cover(self, low: str, safe: bytearray) -> None:
        """Weighted interval scheduling over the automaton's matches: the cover with most known characters."""
        found = []
        for end, size in self.automaton.iter(low):
            start = end - size + 1
            if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                found.append((start, end + 1))
        if not found:
            return
        found.sort(key=lambda m: m[1])
        best: list[tuple[int, int, int]] = [(0, -1, -1)]  # weight, match, cover before it
        ends = [0]
        import bisect

        for k, (start, end) in enumerate(found):
            before = bisect.bisect_right(ends, start) - 1
            weight = best[before][0] + (end - start)
            if weight > best[-1][0]:
                best.append((weight, k, before))
                ends.append(end)
        at = len(best) - 1
        while at > 0:
            start, end = found[best[at][1]]
            safe[start:end] = b"\1" * (end - start)
            at = best[at][2]

    def _is_tail(self, piece: str) -> bool:
        """Whether what follows a comma describes the value before it."""
        p = piece.strip().strip("\"'").strip().lower()
        if not p:
            return False
        if p in self.tails:
            return True
        short = _STRENGTH_TAIL.sub("", p)
        if short in self.tails or (self.rules.tail_pattern and _NAME_TAIL_PATTERN.match(p)):
            return True
        bits = letter_bits(p)
        return any((own ^ bits).bit_count() <= 4 and osa(p, t, 2) <= 2 for own, t in self.long_tails)

    def cut(self, text: str) -> list[str]:
        """The values in ``text``, in the order written."""
        rules, low = self.rules, text.lower()
        if not _CAREFUL.search(text) and not (self.any and next(self.automaton.iter(low), None)):
            return [p for p in map(str.strip, self.plain.split(text)) if p.strip("\"'*#").strip()]
        if len(low) != len(text):  # lower case changed the length: positions must agree
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        safe = _protected(text)
        if self.any:
            self._cover(low, safe)
        cuts: list[tuple[int, int]] = []
        for i, c in enumerate(text):
            if c not in self.cutters or safe[i]:
                continue
            before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
            if c in ",." and before.isdigit() and after.isdigit():
                continue
            if c == "/":
                if rules.per_volume and (before.isalnum() or before in ". %") and before != "/" and _PER_VOLUME.match(text, i + 1) and re.search(_UNIT + r"\.?\s*$", text[max(0, i - 8) : i], re.I):
                    continue
                if rules.slash_needs_words and before.isdigit() and after.isdigit():
                    continue
            cuts.append((i, i + 1))
        if rules.words:
            at = 0
            while m := _WORD_DELIMITER.search(text, at):
                if not safe[m.start(1)]:
                    cuts.append(m.span(1))
                at = m.end() - 1
        cuts.sort()
        pieces, start = [], 0
        bounds = [*cuts, (len(text), len(text))]
        for k, (a, b) in enumerate(bounds):
            if k < len(cuts) and text[a:b] == "," and self.tails:
                if text[start:a].strip() and self._is_tail(text[b : bounds[k + 1][0]]):
                    continue  # the description belongs to the value before the comma
            pieces.append(text[start:a])
            start = b
        return [p.strip() for p in pieces if p.strip().strip("\"'*#").strip()]


def _clean_tail(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"""^["'\s]+|["'\s]+$""", "")))


def learned_tails(df: DataFrame, fields: Sequence[str], least: int = 8, share: float = 2e-4) -> DataFrame:
    """Descriptions that the corpus shows never to stand alone: (field_name, tail).

    A piece after a comma counts when it follows at least ``least`` different first pieces, makes up at least ``share``
    of all such pieces of its field and (nearly) never stands first. At most 1/``share`` values per field can
    qualify, whatever the size of the corpus, so the result is small enough to broadcast.
    """
    pieces = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])))
    pieces = pieces.where(F.col("value").contains(",")).select("field_name", F.split("value", r"[;|\n\t]|//| / |\+").alias("parts"))
    pieces = pieces.select("field_name", F.explode("parts").alias("part")).select("field_name", F.split("part", ",").alias("p"))
    pieces = pieces.where(F.size("p") == 2).select("field_name", _clean_tail(F.col("p")[0]).alias("head"), _clean_tail(F.col("p")[1]).alias("tail"))
    pieces = pieces.where((F.col("tail") != "") & (F.col("head") != ""))
    tails = pieces.groupBy("field_name", F.col("tail").alias("piece")).agg(F.approx_count_distinct("head").alias("heads"), F.count("*").alias("as_tail"))
    heads = pieces.groupBy("field_name", F.col("head").alias("piece")).agg(F.count("*").alias("as_head"))
    total = pieces.groupBy("field_name").agg(F.count("*").alias("total"))
    return (
        tails.where(F.col("heads") >= least)
        .join(heads, ["field_name", "piece"], "left")
        .join(F.broadcast(total), "field_name")
        .where((F.col("as_tail") >= share * F.col("total")) & (F.coalesce("as_head", F.lit(0)) <= 0.02 * F.col("as_tail")))
        .select("field_name", F.col("piece").alias("tail"))
    )


def split_packed(df: DataFrame, key: str = "ord", fields: Sequence[str] = ("inn", "strength", "product_name"), known: DataFrame | None = None, rules: dict[str, Rules] | None = None, learn: bool = True) -> DataFrame:
    """One row per value of each field: (key, field_name, item_pos, item, n_items).

    ``known`` is a bounded table (field_name, term) of reference values. Texts without any delimiter never leave the
    JVM; only the others pass, as Arrow batches, through the segmenter.
    """
    rules = {f: (rules or FIELD_RULES)[f] for f in fields}
    terms: dict[str, list[str]] = {f: [] for f in fields}
    if known is not None:
        # a value without a delimiter needs no protection; the others are few, and must be to go to every task
        held = known.where(F.col("field_name").isin(*fields) & F.col("term").rlike(DELIMITED)).select("field_name", F.lower("term").alias("term")).distinct().limit(MOST_KNOWN + 1).collect()
        if len(held) > MOST_KNOWN:
            raise ValueError(f"more than {MOST_KNOWN} known values hold a delimiter; they cannot be sent to every task")
        for r in held:
            terms[r.field_name].append(r.term)
    tails: dict[str, list[str]] = {f: [] for f in fields}
    if learn and (learn_on := [f for f in fields if rules[f].tails]):
        for r in learned_tails(df, learn_on).collect():
            tails[r.field_name].append(r.tail)
    long = df.select(F.col(key).alias("_key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))).where(F.col("_key").isNotNull() & F.col("value").isNotNull() & (F.trim("value") != ""))
    packed = F.col("value").rlike(DELIMITED)
    out = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("field_name", T.StringType()), T.StructField("item_pos", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("n_items", T.IntegerType())])

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutters = {f: Segmenter(rules[f], terms[f], tails[f]) for f in rules}
        seen: dict[tuple[str, str], list[str]] = {}
        for batch in batches:
            keys, names, places, items, sizes = [], [], [], [], []
            for k, f, v in zip(batch["_key"], batch["field_name"], batch["value"]):
                if (parts := seen.get((f, v))) is None:
                    parts = cutters[f].cut(v)
                    if len(seen) < 50_000:
                        seen[f, v] = parts
                for n, item in enumerate(parts, 1):
                    keys.append(k)
                    names.append(f)
                    places.append(n)
                    items.append(item)
                    sizes.append(len(parts))
            yield frame(_key=keys, field_name=names, item_pos=places, item=items, n_items=sizes)

    whole = long.where(~packed).select("_key", "field_name", F.lit(1).alias("item_pos"), F.trim("value").alias("item"), F.lit(1).alias("n_items"))
    split = long.where(packed).mapInPandas(cut_all, out)
    return whole.unionByName(split).withColumnRenamed("_key", key)
