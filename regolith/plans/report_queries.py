"""Mappers, scalar functions and report queries over the driver's tables, each with the same result in SQL.

Tables of another shape than a source's own are first put into that shape, so that the mapper under test does all the work back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import similarity, text, vocab
from regolith.operators import diffing, documents, events, markets, scoping
from regolith.plans import register_queries as rq
from regolith.sources import registers
from regolith.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_bar = rq._bar
#: The sources of the driver's tables: what each is called, and what kind of source it is.
SOURCES = [
    ("greenleaf_list", "NG", "Greenleaf List", "register"), ("consulta_aberta", "BR", "Consulta Aberta", "register"), ("registo_costa", "MZ", "Registo Costa", "register"),
    ("highland_roll", "KE", "Highland Roll", "register"), ("liste_sahel", "SN", "Liste Sahel", "register"), ("lakeside_register", "TZ", "Lakeside Register", "register"),
]
_VALUES = "(VALUES " + ", ".join("('" + "', '".join(row) + "')" for row in SOURCES) + ") AS k(source_id, country, authority, kind)"


@_query(f"SELECT * FROM {_VALUES}")
def source_registry(spark, sf_dir):
    """The sources known."""
    return registers.registry(spark, SOURCES)


def _coverage(spark, sf_dir):
    held = table(spark, sf_dir, "product_record").groupBy("source_id").agg(F.date_format(F.max("retrieved_at"), "yyyy-MM-dd").alias("retrieved"))
    return registers.registry(spark, SOURCES).join(held, "source_id").select("country", "authority", "retrieved")


_COVERAGE_SQL = f"cov AS (SELECT k.country, k.authority, strftime(max(p.retrieved_at), '%Y-%m-%d') AS retrieved FROM product_record p JOIN {_VALUES} ON k.source_id = p.source_id GROUP BY 1, 2)"


@_query(rq._REG + f""", {_COVERAGE_SQL}, v AS (SELECT DISTINCT i AS ingredient FROM (SELECT unnest(inn) AS i FROM reg) WHERE length(i) >= 5), h AS (SELECT DISTINCT country, unnest(inn) AS ingredient FROM reg WHERE {rq._ACTIVE})
SELECT v.ingredient, cov.country, 'not found in ' || authority || ' source, retrieved ' || retrieved AS phrase FROM v CROSS JOIN cov WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.country = cov.country AND h.ingredient = v.ingredient)""")
def ingredient_absences(spark, sf_dir):
    """Every ingredient and market in which it was not found, in the words allowed."""
    return markets.absences(rq.register(spark, sf_dir), _coverage(spark, sf_dir))


@_query(rq._REG + f""", m AS (SELECT country, array_to_string(inn, '|') AS inn, count(DISTINCT company) AS n FROM reg WHERE {rq._ACTIVE} GROUP BY 1, 2)
SELECT country, inn, n, CASE n WHEN 0 THEN 'no holder found in this source' WHEN 1 THEN '1 other holder(s) found' WHEN 2 THEN '2 other holder(s) found' ELSE n || ' other holders found' END AS reading FROM m""")
def market_readings(spark, sf_dir):
    """Q11: the number of holders of each market in words."""
    own = markets.active_medicines(rq.register(spark, sf_dir)).groupBy("country", "inn").agg(F.count_distinct("company").alias("n"))
    return own.select("country", _bar("inn"), "n", markets.reading("n").alias("reading"))


_SERIES = f"""se AS (SELECT s.source_id, s.section_no, k.authority, count(*) AS snapshots, max(strftime(retrieved_at, '%Y-%m-%d')) FILTER (WHERE recency = 2) AS before_date, max(strftime(retrieved_at, '%Y-%m-%d')) FILTER (WHERE recency = 1) AS after_date
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, section_no ORDER BY snapshot_id DESC) AS recency FROM register_snapshot) s JOIN {_VALUES} ON k.source_id = s.source_id GROUP BY 1, 2, 3),
sh AS (SELECT *, row_number() OVER (PARTITION BY source_id, section_no ORDER BY kind, record_key) AS n FROM ch)"""


@_query(rq._WATCH + f""", {_SERIES}
SELECT se.source_id, se.section_no, snapshots >= 2 AS has_history, kind, record_key, before, after,
  CASE kind WHEN 'appeared' THEN 'not present in the ' || authority || ' snapshot of ' || before_date || '; present in ' || after_date WHEN 'disappeared' THEN 'present in the ' || authority || ' snapshot of ' || before_date || '; not found in ' || after_date
    WHEN 'status_changed' THEN 'status recorded as ' || COALESCE(before, 'None') || ' in the ' || authority || ' snapshot of ' || before_date || ' and ' || COALESCE(after, 'None') || ' in ' || after_date
    WHEN 'expiry_changed' THEN 'expiry recorded as ' || before || ' in the ' || authority || ' snapshot of ' || before_date || ' and ' || after || ' in ' || after_date END AS evidence,
  CASE WHEN snapshots < 2 THEN 'Only one snapshot so far. Nothing to compare against yet.' END AS note
FROM se LEFT JOIN sh ON se.source_id = sh.source_id AND se.section_no = sh.section_no AND sh.n <= 300 WHERE snapshots < 2 OR kind IS NOT NULL""")
def change_export(spark, sf_dir):
    """The changes of every series with their evidence, series without history noted."""
    pair = ["source_id", "section_no"]
    m = table(spark, sf_dir, "register_snapshot").withColumn("day", F.date_format("retrieved_at", "yyyy-MM-dd"))
    counted = m.groupBy(*pair).agg(F.count("*").alias("snapshots"))
    two = diffing.latest(m, 2, tuple(pair), "snapshot_id")
    days = two.groupBy(*pair).agg(F.max(F.when(F.col("recency") == 2, F.col("day"))).alias("before_date"), F.max(F.when(F.col("recency") == 1, F.col("day"))).alias("after_date"))
    series = counted.join(days, pair).join(registers.registry(spark, SOURCES).select("source_id", "authority"), "source_id")
    return diffing.export(rq._watch(spark, sf_dir)[0], series, pair)


@_query(rq._EVENTS + f""", {_COVERAGE_SQL}
SELECT ord, kind, CASE kind WHEN 'lapsed' THEN 'registration expired ' || date || '; recorded inactive in ' || authority || ', retrieved ' || retrieved WHEN 'renewal_due' THEN 'registration expires ' || date || ' per ' || authority || ', retrieved ' || retrieved
  WHEN 'newly_granted' THEN 'registration granted ' || date || ' per ' || authority || ', retrieved ' || retrieved ELSE 'earliest registration found in ' || authority || ' is ' || date || ', retrieved ' || retrieved END AS evidence FROM ev JOIN cov ON cov.country = ev.country""")
def trigger_evidence(spark, sf_dir):
    """the sentence that supports each event."""
    found = events.detect(rq.register(spark, sf_dir), rq.AS_OF).join(_coverage(spark, sf_dir), "country")
    return found.select("ord", "kind", events.evidence("authority", "retrieved").alias("evidence"))


@_query("""WITH d AS (SELECT DISTINCT regexp_replace(regexp_extract(rtrim(COALESCE(document_url, local_path), '/'), '[^/]*$'), '[^A-Za-z0-9._-]', '_', 'g') AS local_name FROM listing_extract WHERE COALESCE(document_url, local_path) IS NOT NULL),
l AS (SELECT regexp_replace(regexp_extract(rtrim(local_path, '/'), '[^/]*$'), '[^A-Za-z0-9._-]', '_', 'g') AS local_name, max_by(struct_pack(p := product_name, g := generic_name, u := document_url), listing_id) AS v FROM listing_extract WHERE local_path IS NOT NULL GROUP BY 1)
SELECT d.local_name, v.p AS product_name, v.g AS generic_name, v.u AS document_url FROM d LEFT JOIN l ON d.local_name = l.local_name""")
def documents_with_listing(spark, sf_dir):
    """Every document with the listing row of its file, if it has one."""
    listing = table(spark, sf_dir, "listing_extract").withColumn("ord", F.col("listing_id"))
    files = listing.select(text.basename(F.coalesce("document_url", "local_path")).alias("local_name")).where(F.col("local_name").isNotNull()).distinct()
    return registers.with_listing(files, listing)


_NG = rq._REG + """, x AS (SELECT ord, nullif(trim(regexp_replace(COALESCE(product_name, ''), '[#*]', '', 'g'), ' '), NULL) AS product_name FROM product_record)
SELECT r.ord, x.product_name, array_to_string(r.inn, '|') AS inn, array_to_string(r.strength, '|') AS strength, r.form, array_to_string(r.route, '|') AS route, NULLIF(r.company_raw, '') AS company_raw, r.company, r.approval_date, r.status, NULLIF(r.category, '') AS category,
  p.extras.expiry_date AS expiry_date, 'f#product_id=' || COALESCE(p.extras.record_id, 'None') AS source_ref FROM reg r JOIN x ON x.ord = r.ord JOIN product_record p ON p.ord = r.ord"""


@_query(_NG)
def green_book_records(spark, sf_dir):
    """product_record put into the shape of a feed with nested holders and categories, and mapped back."""
    raw = table(spark, sf_dir, "product_record")
    even = F.col("ord") % 2 == 0
    named = lambda c: (F.when(even, F.col(c)), F.when(~even, F.struct(F.col(c).alias("name"))))
    applicant, category = named("company_raw"), named("category")
    feed = raw.select(
        "ord", F.lit("f").alias("ref"), F.col("extras.record_id").alias("product_id"), "product_name", F.col("inn").alias("ingredient_name"), "strength", F.col("form").alias("form_name"), F.col("route").alias("route_name"), "atc",
        applicant[0].alias("applicant_name"), applicant[1].alias("applicant"), category[0].alias("category_name"), category[1].alias("product_category"), F.col("registration_number").alias("NAFDAC"), "approval_date", F.col("extras.expiry_date").alias("expiry_date"), "status",
    )
    out = registers.GreenBook().to_records(feed)
    return out.select("ord", "product_name", _bar("inn"), _bar("strength"), "form", _bar("route"), text.filled("company_raw").alias("company_raw"), "company", "approval_date", "status", text.filled("category").alias("category"), F.col("extras.expiry_date").alias("expiry_date"), "source_ref")


_DAY = "regexp_matches(substr({c}, 1, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')"
_BR = rq._REG + f"""SELECT r.ord, array_to_string(r.inn, '|') AS inn, NULLIF(trim(r.company_raw, ' '), '') AS company_raw, '12345678901234' AS cnpj, CASE WHEN {_DAY.format(c='r.approval_date')} THEN substr(r.approval_date, 1, 10) END AS approval_date,
  CASE WHEN {_DAY.format(c='p.extras.expiry_date')} AND TRY_CAST(substr(p.extras.expiry_date, 1, 4) AS INT) BETWEEN 1990 AND 2100 AND TRY_CAST(substr(p.extras.expiry_date, 6, 2) AS INT) BETWEEN 1 AND 12 THEN substr(p.extras.expiry_date, 1, 7) END AS expiry, CASE WHEN r.active THEN 'Active' ELSE 'Inactive' END AS status
FROM reg r JOIN product_record p ON p.ord = r.ord WHERE r.medicine AND NOT regexp_matches(COALESCE(r.company_raw, ''), '^\\s|\\s$|[\\n\\r]') AND r.company_raw <> ''"""


@_query(_BR)
def open_data_records(spark, sf_dir):
    """Medicines put into the shape of an open-data table (holder with its number, month of expiry, day first), and mapped back."""
    raw = table(spark, sf_dir, "product_record").where(F.col("company_raw").isNotNull() & (F.col("company_raw") != "") & ~F.col("company_raw").rlike(r"^\s|\s$|[\n\r]"))
    day = lambda c: F.substring(c, 1, 10)
    dated = lambda c: day(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
    expiry = F.col("extras.expiry_date")
    rows = raw.select(
        "ord", F.lit("f").alias("ref"), F.when(text.is_medicine("category"), "Similar").otherwise("Cosmético").alias("CATEGORIA_REGULATORIA"), F.concat(F.lit("12345678901234 - "), "company_raw").alias("EMPRESA_DETENTORA_REGISTRO"),
        F.when(dated(expiry), F.concat(F.substring(expiry, 6, 2), F.substring(expiry, 1, 4))).alias("DATA_VENCIMENTO_REGISTRO"), F.col("product_name").alias("NOME_PRODUTO"), F.col("inn").alias("PRINCIPIO_ATIVO"), F.col("registration_number").alias("NUMERO_REGISTRO_PRODUTO"),
        F.when(dated("approval_date"), F.concat_ws("/", F.substring("approval_date", 9, 2), F.substring("approval_date", 6, 2), F.substring("approval_date", 1, 4))).alias("DATA_FINALIZACAO_PROCESSO"),
        F.when(text.is_active("status"), "Ativo").otherwise(F.col("status")).alias("SITUACAO_REGISTRO"), F.col("extras.therapeutic_class").alias("CLASSE_TERAPEUTICA"), F.col("extras.process_number").alias("NUMERO_PROCESSO"),
    )
    out = registers.OpenData().to_records(rows)
    return out.select("ord", _bar("inn"), "company_raw", "extras.cnpj", "approval_date", "extras.expiry", "status")


_UNITS = "mg|g|mcg|µg|ug|iu|ml|%"
_GENERIC = f"""WITH g0 AS (SELECT listing_id, trim(generic_name, ' ') AS raw FROM listing_extract),
g1 AS (SELECT listing_id, raw, regexp_extract_all(raw, '(?i)(\\d+(?:\\.\\d+)?)\\s*({_UNITS})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) AS q, regexp_extract_all(raw, '(?i)(\\d+(?:\\.\\d+)?)\\s*({_UNITS})(?:[^\\p{{L}}\\p{{N}}_]|$)', 2) AS u,
  regexp_replace(raw, '(?i)\\d+(?:\\.\\d+)?\\s*(?:{_UNITS})([^\\p{{L}}\\p{{N}}_]|$)', ' \\1', 'g') AS rest FROM g0),
g2 AS (SELECT listing_id, raw, array_to_string(list_transform(list_zip(q, u), lambda x: x[1] || ' ' || x[2]), '; ') AS strength, regexp_replace(regexp_replace(regexp_replace(rest, '(?i)\\b(?:{vocab.DESCRIPTION_WORDS})\\b', ' ', 'g'), '\\s+', ' ', 'g'), '^[ \\-,/&]+|[ \\-,/&]+$', '', 'g') AS inn, raw AS form FROM g1),
gx AS (SELECT *, {rq._bare(rq._clean("form"))} AS f FROM g2)
SELECT listing_id, array_to_string({rq._INN}, '|') AS inn, array_to_string({rq._STRENGTH}, '|') AS strength, {rq._form_case()} AS form FROM gx"""


@_query(_GENERIC)
def listing_records(spark, sf_dir):
    """The listing's free texts mapped to records without holders."""
    rows = table(spark, sf_dir, "listing_extract").select(F.col("listing_id").alias("ord"), "product_name", "generic_name", "document_url", F.lit("f").alias("ref"))
    out = registers.watch_records(rows)
    return out.select(F.col("ord").alias("listing_id"), _bar("inn"), _bar("strength"), "form")


SQL["generic_names"] = _GENERIC  # of the query in register_queries, which maps the same texts


@_query("SELECT ord, CAST(2000 + TRY_CAST(NULLIF(regexp_extract(registration_number, '\\b(?:TAN|TZ)\\s?(\\d{2})\\b', 1), '') AS INT) AS INT) AS year, substr(registration_number, 1, 4) AS head FROM (SELECT ord, CASE ord % 3 WHEN 0 THEN 'TAN ' || substr(approval_date, 3, 2) || ' ' || registration_number WHEN 1 THEN registration_number ELSE 'TZ' || substr(approval_date, 3, 2) END AS registration_number FROM product_record)")
def registration_years(spark, sf_dir):
    """the year in registration numbers, plain and with a country's mark."""
    year = F.substring("approval_date", 3, 2)
    number = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("TAN "), year, F.lit(" "), "registration_number")).when(F.col("ord") % 3 == 1, F.col("registration_number")).otherwise(F.concat(F.lit("TZ"), year))
    return table(spark, sf_dir, "product_record").select("ord", number.alias("n")).select("ord", text.registration_year("n").alias("year"), F.substring("n", 1, 4).alias("head"))


@_query("SELECT doc_id, sha256(text) AS digest, CASE WHEN strpos(text, 'mg') > 0 THEN CASE WHEN strpos(text, 'mg') - 61 > 0 THEN '...' ELSE '' END || substr(text, greatest(strpos(text, 'mg') - 60, 1), least(strpos(text, 'mg') + 61, length(text)) - greatest(strpos(text, 'mg') - 60, 1) + 1) || CASE WHEN strpos(text, 'mg') + 61 < length(text) THEN '...' ELSE '' END END AS context FROM documents WHERE text IS NOT NULL")
def text_contexts(spark, sf_dir):
    """each text's hash, and the first amount in it with what stands around it."""
    at = F.instr("text", "mg")
    found = F.when(at > 0, text.span_context("text", at - 1, at + 1))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("digest"), found.alias("context"))


def _masks(a: str, b: str) -> str:
    return f"list_transform(list_filter(string_split({b}, ''), lambda y: y <> ''), lambda y: list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = y THEN (1::HUGEINT << (i - 1)::HUGEINT) ELSE 0::HUGEINT END))::HUGEINT)"


def _lcs(a: str, b: str) -> str:
    """The longest common subsequence by the recurrence over bits, texts of up to 100 letters."""
    full = f"((1::HUGEINT << length({a})::HUGEINT) - 1)"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce({_masks(a, b)}, lambda s, m: (((s + (s & m)) | (s - (s & m))) & {full})::HUGEINT, {full}::HUGEINT)) END"


def _key_of(c: str) -> str:
    return rq._KEY_TOKENS.replace("company_raw", c)


_PAIR = f"""WITH t AS (SELECT match_id, COALESCE({_key_of('left_name')}, []) AS a, COALESCE({_key_of('right_name')}, []) AS b FROM company_match),
s AS (SELECT match_id, array_to_string(list_sort(a), ' ') AS x, array_to_string(list_sort(b), ' ') AS y FROM t)"""
SQL["company_similarity"] = f"{_PAIR} SELECT match_id, round(CASE WHEN x = '' OR y = '' THEN 0.0 ELSE 100.0 - 100.0 * (length(x) + length(y) - 2 * ({_lcs('x', 'y')})) / (length(x) + length(y)) END, 6)::DOUBLE AS likeness FROM s"
_SETS = f"""{_PAIR}, u AS (SELECT match_id, a, b, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ' ') AS common, array_to_string(list_sort(list_distinct(list_filter(a, lambda v: NOT list_contains(b, v)))), ' ') AS x, array_to_string(list_sort(list_distinct(list_filter(b, lambda v: NOT list_contains(a, v)))), ' ') AS y FROM t),
w AS (SELECT *, length(common) AS li, length(x) AS la, length(y) AS lb, {_lcs('x', 'y')} AS l FROM u),
r AS (SELECT *, li + CASE WHEN la > 0 AND li > 0 THEN 1 ELSE 0 END + la AS ia, li + CASE WHEN lb > 0 AND li > 0 THEN 1 ELSE 0 END + lb AS ib FROM w),
q AS (SELECT *, CASE WHEN ia + ib = 0 THEN 100.0 ELSE 100.0 - 100.0 * (la + lb - 2 * l) / (ia + ib) END AS rest FROM r),
v AS (SELECT match_id, a, b, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 WHEN li > 0 AND (la = 0 OR lb = 0) THEN 100.0 WHEN li > 0 THEN greatest(rest, 100.0 - 100.0 * (la + 1) / (li + ia), 100.0 - 100.0 * (lb + 1) / (li + ib)) ELSE rest END AS score,
  CASE WHEN length(a[1]) < 3 AND len(a) > 1 THEN a[1] || ' ' || a[2] ELSE a[1] END AS da, CASE WHEN length(b[1]) < 3 AND len(b) > 1 THEN b[1] || ' ' || b[2] ELSE b[1] END AS db FROM q)"""
SQL["company_verdicts"] = f"{_SETS} SELECT match_id, round(score, 6)::DOUBLE AS score, COALESCE(da = db, false) AS first_token_match, CASE WHEN NOT COALESCE(da = db, false) THEN 'no-match' WHEN score >= 80 THEN 'match' WHEN score >= 60 THEN 'review' ELSE 'no-match' END AS verdict FROM v"


@_query()
def company_gaps(spark, sf_dir):
    """Where the products of the company a query names were not found, its groups and products resolved first."""
    parts = markets.portfolio(rq.register(spark, sf_dir), "Talabulub Pharmaceuticals", spark.createDataFrame(rq.COVERAGE, "country string, coverage_end_year int"))
    return parts["cells"].select("representative", "presence", _bar("inn"), _bar("strength"), "form", "country", "state", "competitors", markets.reading("competitors").alias("reading"), "tier")


@_query(rq._EVENTS + ", t AS (SELECT count(*) AS triggers FROM ev), c AS (SELECT count(*) AS accounts FROM (SELECT DISTINCT company, country FROM ev)), r AS (SELECT count(*) AS n FROM reg) SELECT 'records' AS part, n FROM r UNION ALL SELECT 'triggers', triggers FROM t UNION ALL SELECT 'accounts', accounts FROM c UNION ALL SELECT 'markets', count(*) FROM (SELECT DISTINCT country, inn, form FROM reg WHERE " + rq._ACTIVE + " AND company_raw <> '') UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM reg")
def payload_totals(spark, sf_dir):
    """Q16: the totals of a payload's parts."""
    r = rq.register(spark, sf_dir)
    found = events.detect(r, rq.AS_OF)
    size = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    parts = {"records": r, "triggers": found, "accounts": events.by_account(found), "markets": markets.structure(r), "sources": r.select("source_id").distinct()}
    out = None
    for name, df in parts.items():
        out = size(name, df) if out is None else out.unionByName(size(name, df))
    return out


@_query()
def notes_quotable(spark, sf_dir):
    """Which notes leave no question of high impact open."""
    return scoping.quotable(rq.QUERIES["scope_gaps"](spark, sf_dir))


#: Sentences a report may and may not hold, one of which follows every product's name.
_SAID = ["was not registered in", "not found in", "is unregistered in", "failed to register in", "is held in", "has no registration in"]


@_query("WITH t AS (SELECT ord, regexp_replace(product_name, '\\s', ' ', 'g') || ' ' || [" + ", ".join(f"'{x}'" for x in _SAID) + "][1 + CAST(ord % 6 AS INT)] || ' ' || country AS line FROM product_record) SELECT ord, 1 AS line_no, rule, regexp_extract(line, pattern, 0) AS matched FROM t CROSS JOIN (VALUES " + ", ".join(f"({n}, '(?i){p}')" for n, p in vocab.FORBIDDEN) + ") AS v(rule, pattern) WHERE regexp_matches(line, pattern)")
def report_lint(spark, sf_dir):
    """Forbidden phrases in a sentence on every product."""
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("ord") % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "product_record").select("ord", F.concat(F.regexp_replace("product_name", r"\s", " "), F.lit(" "), said, F.lit(" "), F.col("country")).alias("text"))
    return documents.lint(named, "ord", "text")


@_query("SELECT listing_id, upper('tan ' || lpad(CAST(listing_id % 30 AS VARCHAR), 2, '0') || ' hm ' || lpad(CAST(listing_id % 10000 AS VARCHAR), 4, '0')) AS value, 2 AS page, 'Number: ' || 'tan ' || lpad(CAST(listing_id % 30 AS VARCHAR), 2, '0') || ' hm ' || lpad(CAST(listing_id % 10000 AS VARCHAR), 4, '0') AS quote FROM listing_extract WHERE listing_id % 2 = 0")
def registration_mentions(spark, sf_dir):
    """The registration number of every document made of listing rows; every other one names none."""
    number = F.concat(F.lit("tan "), F.lpad((F.col("listing_id") % 30).cast("string"), 2, "0"), F.lit(" hm "), F.lpad((F.col("listing_id") % 10000).cast("string"), 4, "0"))
    second = F.when(F.col("listing_id") % 2 == 0, F.concat(F.lit("Listing\n Number: "), number, F.lit("\nTAN 99 ZZ 99999"))).otherwise(F.lit("No number: TAN 1 HM 1"))
    pages = table(spark, sf_dir, "listing_extract").select("listing_id", F.array(F.coalesce("product_name", F.lit("")), second).alias("pages"))
    return documents.registration_numbers(pages, "listing_id")
