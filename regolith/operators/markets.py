"""Market structure, scoping index, gaps between markets and what lies outside a source's window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import text
from regolith.functions.frames import settled
from regolith.operators import resolve
from regolith.session import cut

RECENT = "2024-08-31"


def active_medicines(records: DataFrame) -> DataFrame:
    """Active medicines with a known ingredient."""
    return records.where(text.is_active("status") & text.is_medicine("category") & (F.size("inn") > 0))


def structure(records: DataFrame, recent: str = RECENT) -> DataFrame:
    """By country, ingredients and form: holders, the first twelve names, registrations, recent ones, first and last grant, bucket."""
    named = text.filled("company_raw")
    granted = F.substring(text.filled("approval_date"), 1, 10)
    out = active_medicines(records).groupBy("country", "inn", "form").agg(
        F.countDistinct(named).alias("holders"),
        F.slice(F.array_sort(F.collect_set(named)), 1, 12).alias("holder_names"),
        F.count(granted).alias("registrations"),
        F.count_if(granted >= recent).alias("recent_registrations"),
        F.min(granted).alias("first_grant"),
        F.max(granted).alias("latest_grant"),
    )
    return out.where("holders > 0").withColumn("structure", text.structure_bucket(F.col("holders"))).withColumn("label", text.title_case(F.array_join("inn", " + ")))


def view(records: DataFrame, molecule: str) -> DataFrame:
    """By market for one molecule: distinct names, bucket, the first four names."""
    own = active_medicines(records).where(F.array_contains("inn", molecule) & F.col("company_raw").isNotNull())
    return own.groupBy("country").agg(F.countDistinct("company_raw").alias("holders"), F.slice(F.array_sort(F.collect_set("company_raw")), 1, 4).alias("examples")).withColumn("structure", text.structure_bucket(F.col("holders")))


def scoping_index(records: DataFrame) -> DataFrame:
    """By country and single ingredient of five letters or more: distinct holders, named in first-seen order."""
    rows = records.where(text.is_active("status") & text.is_medicine("category") & text.filled("company_raw").isNotNull())
    single = rows.select("ord", "country", F.explode(F.filter("inn", lambda x: F.length(x) >= 5)).alias("ingredient"), "company_raw")
    firsts = single.groupBy("country", "ingredient", "company_raw").agg(F.min("ord").alias("ord"))
    return firsts.groupBy("country", "ingredient").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "company_raw"))), lambda x: x["company_raw"]).alias("who"))


def vocabulary(records: DataFrame) -> DataFrame:
    """Distinct ingredients of five letters or more."""
    return records.select(F.explode_outer(F.filter("inn", lambda x: F.length(x) >= 5)).alias("ingredient")).where("ingredient IS NOT NULL").distinct()


def presence_counts(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(representative, countries, records, dual): where each company group holds something."""
    joined = records.join(groups.select(F.col("name").alias("company_raw"), "representative"), "company_raw")
    return joined.groupBy("representative").agg(F.countDistinct("country").alias("countries"), F.count("*").alias("records")).withColumn("dual", F.col("countries") > 1)


def gaps(presences: DataFrame, records: DataFrame, coverage: DataFrame, group: str = "company", dated: DataFrame | None = None) -> DataFrame:
    """(group, presence, country, present_in, held_since, state, competitors, examples, tier) for each country a product was not found in.

    ``presences`` is (group, presence, inn, strength, form, country, ord), with approval_date or without, ``records`` the normalised register, in which
    a company is told by its name, ``dated`` the records presences point to where those are others, ``coverage``
    one row per country (country, coverage_end_year), a handful. ``state`` is ``out_of_window`` where the source ends before
    the product was first held, in the alphabetically first country it is held in, else ``gap``.
    """
    keys = [group, "presence"]
    by = _by_product(presences if "approval_date" in presences.columns else presences.join((records if dated is None else dated).select("ord", "approval_date"), "ord", "left"), keys)
    covered = _covered(coverage)
    others = records.where(text.is_active("status") & text.is_medicine("category") & text.filled("company_raw").isNotNull() & F.col("country").isin([c for c, _ in covered]))
    others = settled(others.select("country", "inn", "strength", "form", "company", "company_raw"), "inn", "strength", "form", "company").where(resolve.usable())
    others = others.select("country", F.col("inn").alias("o_inn"), F.col("strength").alias("o_strength"), F.col("form").alias("o_form"), F.col("company").alias("o_company"), "company_raw")
    cells = _competed(by, others, covered, keys)
    state = F.when(text.year_of("held_since") > F.col("end_year"), "out_of_window").otherwise("gap")
    cells = cells.withColumn("state", state)
    gap = F.col("state") == "gap"
    n = F.when(gap, F.col("n"))
    tier = F.when(n.isNull(), 2).when(n == 0, 1).when(n <= 3, 0).otherwise(3)
    return cells.select(*keys, "inn", "strength", "form", "country", "present_in", "state", F.substring("held_since", 1, 10).alias("held_since"), n.alias("competitors"), F.when(gap, F.col("examples")).otherwise(F.array().cast("array<string>")).alias("examples"), tier.alias("tier"))


def out_of_window(presences: DataFrame, coverage: DataFrame, group: str = "company") -> DataFrame:
    """(group, presence, country, held_since): the cells of ``gaps`` in that state, of presences with approval_date. Who else holds what decides nothing here, so the register is not met."""
    keys = [group, "presence"]
    ends = [F.struct(F.lit(c).alias("country"), F.lit(y).cast("int").alias("end_year")) for c, y in _covered(coverage) if c is not None and y is not None]
    by = _by_product(presences.select(*keys, "inn", "strength", "form", "country", "approval_date"), keys)
    late = F.filter(F.array(*ends), lambda e: (text.year_of("held_since") > e["end_year"]) & ~F.array_contains("present_in", e["country"])) if ends else F.array().cast("array<struct<country: string, end_year: int>>")
    return by.select(*keys, "held_since", F.explode(late).alias("e")).select(*keys, "e.country", F.substring("held_since", 1, 10).alias("held_since"))


def _by_product(held: DataFrame, keys: list[str]) -> DataFrame:
    """Products with the countries they are held in and the date of their first record in the alphabetically first of these."""
    return held.groupBy(*keys).agg(F.first("inn").alias("inn"), F.first("strength").alias("strength"), F.first("form").alias("form"), F.array_sort(F.collect_set("country")).alias("present_in"), F.min_by("approval_date", F.col("country")).alias("held_since"))


def _covered(coverage: DataFrame) -> list[tuple[str, int | None]]:
    return [(r.country, r.coverage_end_year) for r in coverage.select("country", "coverage_end_year").distinct().collect()]


def _competed(by: DataFrame, others: DataFrame, covered: list[tuple[str, int | None]], keys: list[str]) -> DataFrame:
    """The products by covered country they were not found in: (country, end_year, n, examples), n the names of other companies that hold something agreeing there.

    Products and names of equal ingredients meet in one pass over rows sorted by ingredients and profile: names are gathered once a
    profile (strength and form), whichever companies ask for it, so no pair of a product and a name is ever a row.
    """
    group = keys[0]
    kinds = dict(by.dtypes)
    offers = others.select(F.col("o_inn").alias("inn"), F.col("o_strength").alias("strength"), F.col("o_form").alias("form"), F.lit(0).alias("asks"), "country", F.col("o_company").alias("company_"), "company_raw", *[F.lit(None).cast(kinds[c]).alias(c) for c in (*keys, "present_in", "held_since")])
    wanted = by.select("inn", "strength", "form", F.lit(1).alias("asks"), *[F.lit(None).cast("string").alias(c) for c in ("country", "company_", "company_raw")], *keys, "present_in", "held_since")
    rows = offers.unionByName(wanted).repartition("inn").sortWithinPartitions("inn", "asks", "strength", "form")
    out = [*keys, "inn", "strength", "form", "present_in", "held_since"]
    countries, years = [c for c, _ in covered], [y for _, y in covered]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inn, offered, profile, there = None, {}, None, {}
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("inn", "strength", "form", "asks", "country", "company_", "company_raw", group, "present_in")]
            row, where, number, ends, texts = [], [], [], [0], []
            for i, (its, strength, form, asks, country, company, raw, own, present) in enumerate(zip(*lists)):
                strength = tuple(strength or ())
                if its != inn:
                    inn, offered, profile = its, {}, None
                if not asks:
                    offered.setdefault((strength, form), set()).add((country, raw, company))
                    continue
                if profile != (strength, form):
                    profile, there = (strength, form), _there(offered, strength, form)
                for j, target in enumerate(countries):
                    if target is None or target in present:
                        continue
                    names, by_company = there.get(target, ((), {}))
                    row.append(i)
                    where.append(j)
                    number.append(len(names) - (by_company.get(own, 0) if own is not None else 0))
                    texts.extend(islice((x for x, c in names if c is None or c != own), 4))
                    ends.append(len(texts))
            if row:
                kept = batch.select(out).take(pa.array(row, pa.int64()))
                at = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(countries, pa.string()).take(at), pa.array(years, pa.int32()).take(at), pa.array(number, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts, pa.string()))],
                    [*out, "country", "end_year", "n", "examples"],
                )

    return rows.mapInArrow(meet, ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", country string, end_year int, n long, examples array<string>")


def _there(offered: dict, strength: tuple[str, ...], form: str | None) -> dict:
    """By country the sorted names, each with its company, that hold something agreeing with a profile, and how many each company has.

    Equal strengths or equal forms must be known on both sides, and neither may differ. A name of several companies has None.
    """
    if strength and form is not None:
        found = [offered.get(k, ()) for k in ((strength, form), (strength, None), ((), form))]
    elif strength or form is not None:
        found = [v for (s, f), v in offered.items() if (s == strength if strength else f == form)]
    else:
        found = []
    names: dict[str, dict[str, str | None]] = {}
    for country, raw, company in chain.from_iterable(found):
        own = names.setdefault(country, {})
        own[raw] = company if own.get(raw, company) == company else None
    return {country: (sorted(own.items(), key=itemgetter(0)), Counter(own.values())) for country, own in names.items()}


def matrix(presences: DataFrame, countries: list[str], group: str = "company") -> DataFrame:
    """Product by country, true where held."""
    label = F.concat_ws(" ", F.array_join("inn", " + "), F.array_join("strength", " + "), F.col("form"))
    held = lambda c: F.coalesce(F.bool_or(F.col("country") == c), F.lit(False)).alias(c)
    return presences.where(F.col("ord").isNotNull()).groupBy(group, "presence", label.alias("label")).agg(*[held(c) for c in countries])


def source_coverage(records: DataFrame, counted: dict[str, str]) -> DataFrame:
    """(source_id, country, record_count, with_expiry, coverage_end_year); ``counted`` says by country whether all, active or attributed records count."""
    rule = F.coalesce(*[F.when(F.col("country") == c, F.lit(r)) for c, r in counted.items()], F.lit("all"))
    counts = F.when(rule == "active", text.is_active("status")).when(rule == "attributed", F.col("company_raw").isNotNull()).otherwise(True)
    return records.where(counts).groupBy("source_id", "country").agg(F.count("*").alias("record_count"), F.count("expiry").alias("with_expiry"), F.max(text.year_of("approval_date")).alias("coverage_end_year"))


def not_found_phrase(authority: str, retrieved: str) -> Column:
    """What may be said of a product that did not appear in a source."""
    return F.concat(F.lit("not found in "), F.col(authority), F.lit(" source, retrieved "), F.col(retrieved))


def reading(n: str) -> Column:
    """How a number of other holders is put in words."""
    count = F.col(n).cast("string")
    return F.when(F.col(n) == 0, F.lit("no holder found in this source")).when(F.col(n) <= 2, F.concat(count, F.lit(" other holder(s) found"))).when(F.col(n) > 2, F.concat(count, F.lit(" other holders found")))


def absences(records: DataFrame, coverage: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(ingredient, country, phrase): ingredients of the whole register that are active in no record of a source's country.

    ``coverage`` is one row per country (country, authority, retrieved), a handful; ``listed`` the ingredients asked about, all where not given.
    """
    wanted = vocabulary(records) if listed is None else listed
    covered = [(r.country, r.authority, r.retrieved) for r in coverage.select("country", "authority", "retrieved").distinct().collect()]
    places = F.array(*[F.struct(F.lit(c).alias("country"), F.lit(a).alias("authority"), F.lit(d).alias("retrieved")) for c, a, d in covered])
    held = active_medicines(records).select("country", F.explode("inn").alias("ingredient")).groupBy("ingredient").agg(F.collect_set("country").alias("held"))  # at most one entry a country
    cells = wanted.join(held, "ingredient", "left").select("ingredient", F.explode(F.filter(places, lambda p: ~F.coalesce(F.array_contains("held", p["country"]), F.lit(False)))).alias("p"))
    return cells.select("ingredient", "p.*").select("ingredient", "country", not_found_phrase("authority", "retrieved").alias("phrase"))


def portfolio(records: DataFrame, query: str, coverage: DataFrame, active_only: bool = True) -> dict[str, DataFrame]:
    """What the company a query names holds and where its products were not found: entities, presences, matrix and cells.

    Groups of spellings, then products, then gaps; entities are those of all records, the rest of active medicines, or of all
    records where ``active_only`` is off.
    """
    own = cut(resolve.group_records(records, query))
    kept = own.where(text.is_active("status") & text.is_medicine("category")) if active_only else own
    held = cut(resolve.presences(kept.select("ord", "country", "inn", "strength", "form", "representative"), "representative"))
    entities = own.groupBy("representative", "country").agg(F.array_sort(F.collect_set("company_raw")).alias("names"), F.count("*").alias("records"))
    countries = [r.country for r in coverage.select("country").distinct().orderBy("country").collect()]
    # competitors are told by company key; the group's own keys are left out
    names = own.select("company").where(F.col("company").isNotNull()).distinct()
    others = records.join(names, "company", "left_anti")
    return {"entities": entities, "presences": held, "matrix": matrix(held, countries, "representative"), "cells": gaps(held, others.unionByName(own.where(F.col("company").isNull()).drop("representative")), coverage, "representative", own)}
