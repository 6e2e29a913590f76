"""Normalisation of register fields as native Column expressions.

Every function is null-safe and stays in whole-stage codegen; the only Arrow function is ``unescape_html``, for feeds that
carry entities beyond the XML ones.
"""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.functions import vocab

C = Column | str


def _c(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: C) -> Column:
    """Trimmed of all Unicode white space."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def collapse(c: C) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return strip(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def filled(c: C) -> Column:
    """The empty string as null."""
    return F.nullif(_c(c), F.lit(""))


def is_missing(c: C) -> Column:
    """Null, or a placeholder."""
    return _c(c).isNull() | F.lower(strip(c)).isin(vocab.MISSING)


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """All HTML5 and numeric entities resolved."""
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) and "&" in v else v)


def unescape_xml(c: C) -> Column:
    """The five XML entities, the numeric apostrophe and the hard blank, natively."""
    out = _c(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def clean(c: C) -> Column:
    """Entities resolved, lower case, white space collapsed; placeholders are null."""
    text = unescape_xml(c)
    return F.when(~is_missing(c) & ~is_missing(text), collapse(F.lower(text)))


def identifier(c: C) -> Column:
    """Collapsed, case kept; placeholders are null."""
    return F.when(~is_missing(c), collapse(c))


def _sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _bare(c: Column) -> Column:
    """Only letters, digits and ./%- of a-z kept; others become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\s./%-]", " "), r"\s+", " "))


def normalize_inn(c: C) -> Column:
    """Sorted set of ingredient names split at ; and +, parentheses dropped."""
    parts = F.transform(F.split(clean(c), r"[;+]"), lambda p: _bare(F.regexp_replace(p, r"\([^)]*\)", " ")))
    return F.coalesce(_sorted_set(F.filter(parts, lambda p: (p != "") & ~p.isin(vocab.MISSING))), _empty())


def render(number: Column) -> Column:
    """A double as plain digits without trailing zeros."""
    return F.regexp_replace(number.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def _number(text: Column) -> Column:
    """Digits with points as a double; a trailing point is dropped, two points are no number."""
    return F.regexp_replace(text, r"\.+$", "").try_cast("double")


def normalize_strength(c: C) -> Column:
    """Sorted set of strengths: g as mg, micrograms as mcg; a strength per volume keeps its units; what cannot be read is dropped."""
    unit = "mg|g|mcg|µg|ug|iu|ml"

    def one(part: Column) -> Column:
        p = F.replace(F.trim(part), F.lit(" "), F.lit(""))
        per = rf"^([0-9.]+)({unit})/([0-9.]+)(ml|l|g)$"
        top, bottom = _number(F.regexp_extract(p, per, 1)), _number(F.regexp_extract(p, per, 3))
        simple = rf"^([0-9.]+)({unit}|%)$"
        value, own = _number(F.regexp_extract(p, simple, 1)), F.regexp_extract(p, simple, 2)
        return F.when(p.rlike(per), F.concat(render(top), F.regexp_extract(p, per, 2), F.lit("/"), render(bottom), F.regexp_extract(p, per, 4))).when(
            p.rlike(simple), F.concat(render(F.when(own == "g", value * 1000).otherwise(value)), F.when(own == "g", F.lit("mg")).when(own.isin("µg", "ug"), F.lit("mcg")).otherwise(own))
        )

    return F.coalesce(_sorted_set(F.filter(F.transform(F.split(clean(c), r"[;+]"), one), lambda p: p.isNotNull())), _empty())


def normalize_form(c: C) -> Column:
    """The bucket of a dosage form: an exact variant, else the longest variant found as whole words (the first bucket of equals)."""
    exact: dict[str, str] = {}
    for variant, bucket in vocab.FORM_VARIANTS:
        exact.setdefault(variant, bucket)
    order = {b: i for i, b in enumerate(vocab.FORMS)}
    ranked = sorted(vocab.FORM_VARIANTS, key=lambda v: (-len(v[0]), order[v[1]]))
    table = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])

    def bucket(t: Column) -> Column:
        within = F.coalesce(*[F.when(t.rlike(rf"\b{v}\b"), F.lit(b)) for v, b in ranked])
        any_of = r"\b(?:" + "|".join(v for v, _ in ranked) + r")\b"
        return F.coalesce(F.try_element_at(table, t), F.when(t.rlike(any_of), within))

    # the cleaned text is bound once, not repeated in every branch
    return F.transform(F.array(_bare(clean(c))), bucket)[0]


def normalize_route(c: C) -> Column:
    """Sorted set of routes split at ; / and comma."""
    return F.coalesce(_sorted_set(F.filter(F.transform(F.split(clean(c), r"[;/,]"), _bare), lambda p: (p != "") & ~p.isin(vocab.MISSING))), _empty())


def company_tokens(c: C) -> Column:
    """Words of a company name in order, without legal forms and places."""
    text = _bare(F.regexp_replace(clean(c), r"\([^)]*\)", " "))
    drop = F.array(*[F.lit(w) for w in [*vocab.LEGAL, *vocab.PLACES]])
    return F.coalesce(F.filter(F.split(text, " "), lambda t: (t != "") & ~F.array_contains(drop, t)), _empty())


def company_key(c: C) -> Column:
    """The tokens joined, null where none is left."""
    return filled(F.array_join(company_tokens(c), " "))


def title_case(c: C) -> Column:
    """A capital after everything that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(_c(c), F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1)), lambda x: F.initcap(x)), "")


def parse_generic_name(c: C) -> Column:
    """struct(inn, strength, form) of a free-text description."""
    raw = F.trim(_c(c))
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(mg|g|mcg|µg|ug|iu|ml|%)(?![\p{L}\p{N}_])"
    amounts = F.arrays_zip(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)).alias("q"), F.regexp_extract_all(raw, F.lit(pattern), F.lit(2)).alias("u"))
    joined = F.array_join(F.transform(amounts, lambda x: F.concat(x["q"], F.lit(" "), x["u"])), "; ")
    rest = F.regexp_replace(raw, r"(?i)\d+(?:\.\d+)?\s*(mg|g|mcg|µg|ug|iu|ml|%)(?![\p{L}\p{N}_])", " ")
    rest = F.regexp_replace(rest, rf"(?i)\b(?:{vocab.DESCRIPTION_WORDS})\b", " ")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^[ \-,/&]+|[ \-,/&]+$", "")
    return F.struct(normalize_inn(rest).alias("inn"), normalize_strength(joined).alias("strength"), normalize_form(raw).alias("form"))


def parse_expiry(c: C) -> Column:
    """MMYYYY as YYYY-MM, null where month or year cannot be."""
    text = F.trim(_c(c))
    month, year = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 3, 4).try_cast("int")
    return F.when(text.rlike(r"^\d{6}$") & month.between(1, 12) & year.between(1990, 2100), F.concat(F.substring(text, 3, 4), F.lit("-"), F.substring(text, 1, 2)))


def split_holder(c: C) -> Column:
    """struct(cnpj, name) of "digits - name"; without digits the text is the name."""
    pattern = r"^\s*(\d{11,14})\s*-\s*(.+?)\s*$"
    has = _c(c).rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(_c(c), pattern, 1)).alias("cnpj"), F.when(has, F.regexp_extract(_c(c), pattern, 2)).otherwise(filled(F.trim(_c(c)))).alias("name"))


def br_date(c: C) -> Column:
    """dd/MM/yyyy as yyyy-MM-dd, by position."""
    text = F.trim(_c(c))
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1"))


def year_of(c: C) -> Column:
    """The first four characters as a number."""
    return F.substring(_c(c).cast("string"), 1, 4).try_cast("int")


def registration_year(c: C) -> Column:
    """The year in a Tanzanian registration number."""
    return (F.lit(2000) + F.regexp_extract(_c(c), r"\b(?:TAN|TZ)\s?(\d{2})\b", 1).try_cast("int")).cast("int")


def shift_months(day: str, months: int) -> str:
    """A yyyy-MM-dd date moved by months, the day kept even where the month has no such day."""
    year, month, rest = int(day[:4]), int(day[5:7]) + months, day[8:10]
    return f"{year + (month - 1) // 12:04d}-{(month - 1) % 12 + 1:02d}-{rest}"


def expiry_of(extras: C, fields: Sequence[str] = ("expiry", "expiry_date")) -> Column:
    """The first ten characters of the expiry: of ``expiry``, else of ``expiry_date``; ``fields`` are those the struct has."""
    held = [filled(_c(extras)[f]) for f in ("expiry", "expiry_date") if f in fields]
    return F.substring(F.coalesce(*held) if held else F.lit(None).cast("string"), 1, 10)


def structure_bucket(n: Column) -> Column:
    """How contested a market is, by its number of holders."""
    return F.when(n == 1, "sole holder").when(n == 2, "two holders").when(n <= 5, "contested").when(n <= 10, "crowded").otherwise("commodity")


def basename(c: C) -> Column:
    """A file name safe on disk: the last part of a path or URL, other signs as _."""
    return F.regexp_replace(F.element_at(F.split(F.rtrim(_c(c), F.lit("/")), "/"), -1), r"[^A-Za-z0-9._-]", "_")


def span_context(text: C, start: Column, end: Column, window: int = 60) -> Column:
    """The span with what surrounds it."""
    a, b = F.greatest(start - window, F.lit(0)), F.least(end + window, F.length(_c(text)))
    return F.concat(F.when(a > 0, "...").otherwise(""), F.substring(_c(text), a + 1, b - a), F.when(b < F.length(_c(text)), "...").otherwise(""))


def is_active(c: C) -> Column:
    """Status says active."""
    return F.lower(strip(F.coalesce(_c(c), F.lit("")))) == "active"


def is_medicine(c: C) -> Column:
    """Category is a medicine, or unknown."""
    return F.coalesce(F.lower(strip(_c(c))).isin(vocab.MEDICINES), F.lit(True))
