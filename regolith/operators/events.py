"""Dated events of one register snapshot, and their summary by account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import text, vocab


def detect(records: DataFrame, as_of: str, ahead: int = 12, back: int = 12) -> DataFrame:
    """(ord, emit, kind, severity, date, source_id, company, country, product, registration_number).

    ``records`` has ord, source_id, company_raw, country, product_name, inn, status, approval_date, expiry and
    registration_number, with dates as strings. Dates compare as strings: a month without a day sorts before its days.
    Registers are looked at one by one: a company known in one enters another when it is first registered there.
    """
    horizon, since = text.shift_months(as_of, ahead), text.shift_months(as_of, -back)
    granted = F.substring(text.filled("approval_date"), 1, 10)
    base = records.where(F.col("company_raw").isNotNull() & (F.col("company_raw") != "")).select("*", granted.alias("granted"), text.is_active("status").alias("active"))
    # of each company in each register: when it was first seen, and the first active record of that day; one aggregate with map-side combine
    holder = ["source_id", "company_raw"]
    fresh = F.col("active") & (F.col("granted") >= since)
    days = base.groupBy(*holder, "granted").agg(F.min(F.when(fresh, F.col("ord"))).alias("first_ord")).where(F.col("granted").isNotNull())
    firsts = days.groupBy(*holder).agg(F.min_by("first_ord", "granted").alias("first_ord")).where(F.col("first_ord").isNotNull())
    base = base.join(firsts, holder, "left")
    event = lambda kind, emit, date: F.struct(F.lit(kind).alias("kind"), F.lit(vocab.SEVERITY[kind]).alias("severity"), F.lit(emit).alias("emit"), F.col(date).alias("date"))
    events = F.array(
        F.when(~F.col("active") & F.col("expiry").between(since, as_of), event("lapsed", 0, "expiry")),
        F.when(F.col("active") & F.col("expiry").between(as_of, horizon), event("renewal_due", 0, "expiry")),
        F.when(F.col("active") & (F.col("granted") >= since), event("newly_granted", 1, "granted")),
        F.when(F.col("active") & (F.col("ord") == F.col("first_ord")), event("first_entry", 2, "granted")),
    )
    product = F.coalesce(text.filled("product_name"), text.filled(text.title_case(F.array_join("inn", " + "))), F.lit("(unnamed)"))
    flat = base.select("ord", "source_id", F.col("company_raw").alias("company"), "country", product.alias("product"), "registration_number", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return flat.select("ord", "e.emit", "e.kind", "e.severity", "e.date", "source_id", "company", "country", "product", "registration_number")


def evidence(authority: str, retrieved: str) -> Column:
    """The sentence that supports an event, of columns that hold the authority and the day."""
    d, where, day = F.col("date"), F.col(authority), F.col(retrieved)
    tail = F.concat(where, F.lit(", retrieved "), day)
    return (
        F.when(F.col("kind") == "lapsed", F.concat(F.lit("registration expired "), d, F.lit("; recorded inactive in "), tail))
        .when(F.col("kind") == "renewal_due", F.concat(F.lit("registration expires "), d, F.lit(" per "), tail))
        .when(F.col("kind") == "newly_granted", F.concat(F.lit("registration granted "), d, F.lit(" per "), tail))
        .otherwise(F.concat(F.lit("earliest registration found in "), where, F.lit(" is "), d, F.lit(", retrieved "), day))
    )


def ordered(events: DataFrame) -> DataFrame:
    """Events gravest first, then by date, in the order of the records."""
    return events.orderBy("severity", "date", "ord", "emit")


def by_account(events: DataFrame) -> DataFrame:
    """One row per company and country: the register of its first event, counts by kind, the gravest kind and the next date."""
    kind = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    next_date = F.coalesce(F.min(F.when(F.col("kind") == "renewal_due", F.col("date"))), F.max("date"))
    order = F.struct("severity", "date", "ord", "emit")
    return events.groupBy("company", "country").agg(F.min_by("source_id", order).alias("source_id"), *[kind(k) for k in vocab.SEVERITY], F.count("*").alias("total"), F.min("severity").alias("severity"), F.min_by("kind", order).alias("top_kind"), next_date.alias("next_date"))


def ranked(accounts: DataFrame) -> DataFrame:
    """Accounts gravest first, then by number of events and date."""
    return accounts.orderBy("severity", F.desc("total"), "next_date", "company", "country")


def summarise(events: DataFrame) -> DataFrame:
    """Events by kind."""
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def feed(records: DataFrame, events: DataFrame) -> DataFrame:
    """(source_id, country, records, retrieved, triggers, accounts): each register with all it holds and the events found in it."""
    held = records.groupBy("source_id", "country").agg(F.count("*").alias("records"), F.max("retrieved_date").alias("retrieved"))
    found = events.groupBy("source_id", "country").agg(F.count("*").alias("triggers"), F.count_distinct("company").alias("accounts"))
    return held.join(found, ["source_id", "country"], "left").na.fill(0, ["triggers", "accounts"])


def filtered(accounts: DataFrame, part: str = "", kinds: tuple[str, ...] = (), most: int = 300) -> DataFrame:
    """The first ``most`` ranked accounts whose company holds ``part``, in any case, and that have an event of one of ``kinds``."""
    hit = F.contains(F.lower("company"), F.lit(part.lower()))
    if kinds:
        any_of = F.lit(False)
        for k in kinds:
            any_of = any_of | (F.col(f"n_{k}") > 0)
        hit = hit & any_of
    return ranked(accounts.where(hit)).limit(most)
