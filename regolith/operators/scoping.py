"""Facts said in conversation notes, verified by their spans, matched to the register, and crossed into scope lines and open questions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regolith.functions import text, vocab
from regolith.operators.resolve import with_verdict

KINDS = ("market", "product", "service", "product_type", "volume", "timing", "constraint")


def _escape(term: str) -> str:
    return term.replace("-", r"\-").replace("(", r"\(")


def terms() -> list[tuple[str, str, list[str], float]]:
    """(kind, value, words, confidence): the synonyms of each value in order of preference."""
    out = []
    for group, values in vocab.SPOKEN.items():
        for value, words in values.items():
            kind = "market" if group == "region" else group
            out.append((kind, f"region:{value}" if group == "region" else value, words, vocab.CONFIDENCE[group]))
    return out + [("constraint", c, [c], vocab.CONFIDENCE["constraint"]) for c in vocab.CONSTRAINTS]


def propose(notes: DataFrame, ingredients: DataFrame | None = None, key: str = "note_id") -> DataFrame:
    """(key, kind, value, quote, start, confidence): what a note says; per value only its first matching synonym counts.

    ``start`` counts from 0. ``ingredients`` is a table (ingredient) of any size: single words of the note are joined to it,
    names of several words by their first.
    """
    low = F.col("low")
    hits = []
    for kind, value, words, confidence in terms():
        # a word is looked for as letters first, which is far cheaper than its pattern
        at = lambda w: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.expr(f"regexp_instr(low, '\\\\b{_escape(w)}\\\\b')").alias("at"), F.lit(len(w)).alias("size"), F.lit(confidence).alias("confidence"))
        hits.append(F.coalesce(*[F.when(low.contains(w) & low.rlike(rf"\b{_escape(w)}\b"), at(w)) for w in words]))
    # generators of the outer kind throughout: of the others Spark infers filters that evaluate what they generate from once more
    said = notes.select(key, "text", F.lower("text").alias("low")).select(key, "text", F.inline_outer(F.filter(F.array(*hits), lambda h: h.isNotNull()))).where("kind IS NOT NULL")
    facts = said.select(key, "kind", "value", F.substring(F.col("text"), F.col("at"), F.col("size")).alias("quote"), (F.col("at") - 1).alias("start"), "confidence")
    for kind, pattern in (("volume", vocab.VOLUME), ("timing", vocab.TIMING)):
        whole = F.explode_outer(F.arrays_zip(F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(0)).alias("quote"), F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(1)).alias("value"))).alias("m")
        rows = notes.select(key, "text", whole).where("m IS NOT NULL")
        facts = facts.unionByName(rows.select(key, F.lit(kind).alias("kind"), F.trim("m.value").alias("value"), F.col("m.quote").alias("quote"), (F.instr("text", F.col("m.quote")) - 1).alias("start"), F.lit(vocab.CONFIDENCE[kind]).alias("confidence")))
    if ingredients is not None:
        named = _named(notes, ingredients, key)
        facts = facts.unionByName(named.select(key, F.lit("product").alias("kind"), F.col("ingredient").alias("value"), "quote", "start", F.lit(vocab.CONFIDENCE["product"]).alias("confidence")))
    return facts


def _named(notes: DataFrame, ingredients: DataFrame, key: str) -> DataFrame:
    """(key, ingredient, quote, start): the ingredients of five letters or more a note names, the last word's beginning being enough.

    A name's head is its first run of letters and digits, a whole run in the note. Only where a note has a head does it say on
    what follows, as far as the head's longest name goes; names and what is said meet in one order (``_begun``), so no name
    is searched for in a text and none is spelled out that is not there.
    """
    names = ingredients.where(F.length("ingredient") >= 5).select("ingredient", F.regexp_extract("ingredient", r"[a-z0-9]+", 0).alias("head")).where("head <> ''").distinct()
    rest = F.expr("substring(ingredient, instr(ingredient, head))")
    sizes = names.groupBy("head").agg(F.max(F.length(rest)).alias("size"))
    runs = notes.select(key, F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+)"), F.lit(1)))).alias("head"))
    heads = runs.join(sizes, "head").groupBy(key).agg(F.collect_set(F.struct("head", "size")).alias("shapes"))
    low = F.lower("text")
    flat = F.concat(F.lit(" "), F.regexp_replace(low, r"[^a-z0-9./%-]", " "), F.lit(" "))
    beside = F.col(f"t.{key}").eqNullSafe(F.col(f"h.{key}"))
    texts = notes.select(key, "text", low.alias("low"), flat.alias("flat")).alias("t")

    # what stands at each head of a note
    pattern = F.concat(F.lit("(?<![a-z0-9])(?=((?:"), F.array_join("shapes.head", "|"), F.lit(")(?![a-z0-9]).{0,"), F.array_max("shapes.size").cast("string"), F.lit("}))"))
    placed = texts.join(heads.alias("h"), beside).select(f"t.{key}", F.explode_outer(F.array_distinct(F.regexp_extract_all("flat", pattern, F.lit(1)))).alias("said")).where("said IS NOT NULL")
    there = _begun(names.select("head", rest.alias("said"), "ingredient"), placed.withColumn("head", F.regexp_extract("said", "^[a-z0-9]+", 0)), key)
    met = there.groupBy(key).agg(F.collect_set("ingredient").alias("met"))
    place = lambda x: F.instr(F.col("low"), x)
    whole = lambda x: F.col("flat").contains(F.concat(F.lit(" "), x))
    said = F.transform(F.filter("met", whole), lambda x: F.struct(x.alias("ingredient"), place(x).alias("at")))
    found = texts.join(met.alias("h"), beside).select(f"t.{key}", "text", F.inline_outer(F.filter(said, lambda x: x["at"] > 0))).where("ingredient IS NOT NULL")
    return found.select(key, "ingredient", F.substring(F.col("text"), F.col("at"), F.length("ingredient")).alias("quote"), (F.col("at") - 1).alias("start"))


def _begun(names: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """(key, ingredient): the names (head, said, ingredient) each text (head, said, key) of the same head begins with.

    In the order of letters whatever begins with a name follows it directly, so one pass that remembers the names the last row
    begins with finds them all; a task holds no more than these.
    """
    kind = dict(said.dtypes)[key]
    rows = names.select("head", "said", F.lit(0).alias("asks"), "ingredient", F.lit(None).cast(kind).alias(key)).unionByName(said.select("head", "said", F.lit(1).alias("asks"), F.lit(None).cast("string").alias("ingredient"), key))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun = None, []
        for batch in batches:
            row, found = [], []
            for i, (head, text_, asks, name) in enumerate(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("head", "said", "asks", "ingredient")])):
                if head != last:
                    last, begun = head, []
                while begun and not text_.startswith(begun[-1][0]):
                    begun.pop()
                if asks:
                    for _, its in begun:
                        row.extend([i] * len(its))
                        found.extend(its)
                elif begun and begun[-1][0] == text_:
                    begun[-1][1].append(name)
                else:
                    begun.append((text_, [name]))
            if row:
                keys = batch.column(batch.schema.get_field_index(key)).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string())], [key, "ingredient"])

    return rows.repartition("head").sortWithinPartitions("head", "said", "asks").mapInArrow(meet, f"`{key}` {kind}, ingredient string")


def verified(proposals: DataFrame, notes: DataFrame, key: str = "note_id") -> tuple[DataFrame, DataFrame]:
    """(facts, rejected) of (key, kind, value, quote, confidence): a fact's quote must stand in its note.

    An exact find comes first, else one tolerant of white space and case. Facts are deduplicated by kind, value and place,
    their confidence held within 0.01 and 1; a proposal without quote, kind or value, of an unknown kind, or with a
    confidence that is no number is rejected with the reason.
    """
    joined = proposals.join(notes.select(key, "text"), key)
    quote = F.trim(F.coalesce("quote", F.lit("")))
    exact = F.instr("text", quote)
    loose = F.concat(F.lit("(?i)"), F.array_join(F.transform(F.split(quote, r"\s+"), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+"))
    found = F.when(quote == "", F.lit("")).when(exact > 0, quote).otherwise(F.regexp_substr("text", loose))
    start = F.when(exact > 0, exact - 1).otherwise(F.instr("text", found) - 1)
    checked = joined.withColumns({"span": found, "start": start, "confidence": F.col("confidence").cast("double")})
    reason = (
        F.when(quote == "", "no supporting quote")
        .when(F.coalesce(F.col("span"), F.lit("")) == "", "quote not found in source")
        .when(F.trim(F.coalesce("kind", F.lit(""))) == "", "no kind")
        .when(F.trim(F.coalesce("value", F.lit(""))) == "", "no value")
        .when(~F.col("kind").isin(*KINDS), "unknown kind")
        .when(F.col("confidence").isNull() | F.isnan("confidence"), "no confidence")
    )
    checked = checked.withColumn("reason", reason)
    rejected = checked.where(F.col("reason").isNotNull()).select(key, "kind", "value", "quote", "reason")
    once = W.partitionBy(key, "kind", F.lower("value"), "start").orderBy(F.desc("confidence"), "value")
    facts = checked.where(F.col("reason").isNull()).withColumn("n", F.row_number().over(once)).where("n = 1")
    return facts.select(key, "kind", "value", F.col("span").alias("quote"), "start", F.least(F.greatest("confidence", F.lit(0.01)), F.lit(1.0)).alias("confidence")), rejected


def resolve_facts(facts: DataFrame, markets: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Facts with the entity they mean: a covered market, a known ingredient; other kinds mean themselves."""
    m = markets.select(F.col("country").alias("value"), F.lit(True).alias("covered")).distinct()
    i = ingredients.select(F.col("ingredient").alias("low"), F.lit(True).alias("known")).distinct()
    joined = facts.join(m, "value", "left").withColumn("low", F.lower("value")).join(i, "low", "left")
    region = F.startswith("value", F.lit("region:"))
    entity = F.when(F.col("kind") == "market", F.when(~region & F.col("covered"), F.col("value"))).when(F.col("kind") == "product", F.when(F.col("known"), F.col("low"))).otherwise(F.col("value"))
    return joined.withColumn("entity", entity).withColumn("certainty", F.when(F.col("entity").isNotNull(), F.col("confidence")).when((F.col("kind") == "market") & region, 0.5).otherwise(0.0)).drop("low", "covered", "known")


def _distinct(resolved: DataFrame, kind: str, key: str) -> DataFrame:
    return resolved.where((F.col("kind") == kind) & F.col("entity").isNotNull()).select(key, F.col("entity").alias(kind))


def scope_lines(resolved: DataFrame, holders: DataFrame, client: str | None = None, key: str = "note_id") -> DataFrame:
    """(key, product, market, service, already_held, holder, competitors, observed_timeline): what was asked, crossed within each note.

    ``holders`` is (country, ingredient, company_raw, ord) of active registrations.
    """
    lines = _distinct(resolved, "product", key).join(_distinct(resolved, "market", key), key).join(_distinct(resolved, "service", key).distinct(), key)
    # only who holds what was asked for is looked at
    asked = lines.select(F.col("market").alias("country"), F.col("product").alias("ingredient")).distinct()
    holders = holders.join(asked, ["country", "ingredient"], "left_semi")
    names = holders.select("company_raw").distinct()
    names = names.withColumn("own", F.lit(False)) if client is None else with_verdict(names, F.lit(client), F.col("company_raw")).select("company_raw", (F.col("verdict.verdict") == "match").alias("own"))
    by = holders.select("country", "ingredient", "company_raw", "ord").join(names, "company_raw").groupBy("country", "ingredient").agg(F.min_by(F.when(F.col("own"), F.col("company_raw")), F.when(F.col("own"), F.col("ord"))).alias("holder"), F.countDistinct("company_raw").alias("names"))
    joined = lines.join(by, (F.col("market") == F.col("country")) & (F.col("product") == F.col("ingredient")), "left")
    held = F.when(F.col("names").isNotNull() & F.lit(client is not None), F.col("holder").isNotNull())
    return joined.select(key, "product", "market", "service", held.alias("already_held"), "holder", (F.coalesce("names", F.lit(0)) - F.col("holder").isNotNull().cast("int")).cast("long").alias("competitors"), F.lit(None).cast("string").alias("observed_timeline"))


def open_questions(resolved: DataFrame, lines: DataFrame, notes: DataFrame, client: str | None = None, key: str = "note_id") -> DataFrame:
    """(key, kind, about, impact): what is still unknown about each note."""
    present = resolved.where(F.col("entity").isNotNull()).select(key, "kind").distinct()
    ask = lambda kind, about, impact: F.struct(F.lit(kind).alias("kind"), about.alias("about") if isinstance(about, Column) else F.lit(about).alias("about"), F.lit(impact).alias("impact"))
    needed = notes.select(key, F.inline(F.array(*[ask(k, "", i) for k, i in vocab.REQUIRED.items()]))).join(present, [key, "kind"], "left_anti")
    open_ = resolved.where(F.col("entity").isNull())
    region = F.startswith("value", F.lit("region:"))
    market = (F.col("kind") == "market")
    unmet = open_.where(market | (F.col("kind") == "product")).select(key, "kind", F.when(region, F.substring_index("value", ":", -1)).otherwise(F.col("value")).alias("about"), F.when(market & region, "high").otherwise("medium").alias("impact"))
    dossier = lines.where(F.col("service") == "dossier_preparation").select(key).distinct().withColumn("dossier", F.lit(True))
    unasked = [ask("regulatory", "reference approval", "high"), ask("regulatory", "local representative", "medium")]
    if client is None:
        unasked += [ask("regulatory", "existing registrations", "high"), ask("client", "legal entity", "high")]
    format_ = F.when(F.col("dossier").isNull(), ask("regulatory", "dossier format", "high"))
    rest = notes.join(dossier, key, "left").select(key, F.inline(F.filter(F.array(*unasked, format_), lambda q: q.isNotNull())))
    return needed.unionByName(unmet).unionByName(rest)


def quotable(questions: DataFrame, key: str = "note_id") -> DataFrame:
    """(key, questions, can_be_quoted): no question of high impact is open."""
    return questions.groupBy(key).agg(F.count("*").alias("questions"), (~F.bool_or(F.col("impact") == "high")).alias("can_be_quoted"))
