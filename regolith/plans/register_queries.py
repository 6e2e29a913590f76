"""The register operators over the driver's tables, each with the same result in SQL.

Every query reads its whole tables. Arrays come out joined by ``|``, dates as strings, the clock is pinned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import similarity, text, vocab
from regolith.functions.frames import settled
from regolith.operators import diffing, documents, events, markets, resolve, scoping
from regolith.operators.snapdiff import record_key
from regolith.session import cut, table

AS_OF = "2026-08-31"
COVERAGE = [("BR", 2026), ("KE", 2024), ("MZ", 2026), ("NG", 2026), ("SN", 2025), ("TZ", 2023)]
_bar = lambda c: F.array_join(c, "|").alias(c)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_record with its fields normalised, the canonical shape every operator takes."""
    raw = table(spark, sf_dir, "product_record")
    return raw.select(
        "ord", "source_id", "country", "product_name", text.normalize_inn("inn").alias("inn"), text.normalize_strength("strength").alias("strength"), text.normalize_form("form").alias("form"), text.normalize_route("route").alias("route"),
        "atc", "company_raw", text.company_key("company_raw").alias("company"), text.identifier("registration_number").alias("registration_number"), "approval_date", "status", "category", "source_ref", text.expiry_of("extras", raw.schema["extras"].dataType.names).alias("expiry"), F.date_format("retrieved_at", "yyyy-MM-dd").alias("retrieved_date"),
    )


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_MISSING = _list(vocab.MISSING)
_ws = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _unescape(c: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "''"), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


_WHITE = r"^[\s\x{00A0}\x{0085}]+|[\s\x{00A0}\x{0085}]+$"


def _clean(c: str) -> str:
    u = _unescape(c)
    return f"CASE WHEN {c} IS NOT NULL AND lower(trim({c}, E' \\t\\n\\r')) NOT IN {_MISSING} AND lower(trim({u}, E' \\t\\n\\r')) NOT IN {_MISSING} THEN trim(regexp_replace(lower({u}), '\\s+', ' ', 'g')) END"


def _bare(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[^a-z0-9\\s./%-]', ' ', 'g'), '\\s+', ' ', 'g'))"


_INN = f"COALESCE(list_sort(list_distinct(list_filter(list_transform(string_split_regex({_clean('inn')}, '[;+]'), lambda p: {_bare(chr(39).join(['regexp_replace(p, ', '\\([^)]*\\)', ', ', ' ', ', ', 'g', ')']))}), lambda p: p <> '' AND p NOT IN {_MISSING}))), [])"
_ROUTE = f"COALESCE(list_sort(list_distinct(list_filter(list_transform(string_split_regex({_clean('route')}, '[;/,]'), lambda p: {_bare('p')}), lambda p: p <> '' AND p NOT IN {_MISSING}))), [])"
_render = lambda n: f"regexp_replace(CAST(CAST({n} AS DECIMAL(38,12)) AS VARCHAR), '\\.?0+$', '')"
_num = lambda s: f"TRY_CAST(regexp_replace({s}, '\\.+$', '') AS DOUBLE)"
_U = "mg|g|mcg|µg|ug|iu|ml"
_PER, _SIMPLE = f"^([0-9.]+)({_U})/([0-9.]+)(ml|l|g)$", f"^([0-9.]+)({_U}|%)$"
_STRENGTH_ONE = (
    f"CASE WHEN regexp_matches(p, '{_PER}') THEN {_render(_num(f'regexp_extract(p, {chr(39)}{_PER}{chr(39)}, 1)'))} || regexp_extract(p, '{_PER}', 2) || '/' || {_render(_num(f'regexp_extract(p, {chr(39)}{_PER}{chr(39)}, 3)'))} || regexp_extract(p, '{_PER}', 4) "
    f"WHEN regexp_matches(p, '{_SIMPLE}') THEN {_render(f'({_num(f'regexp_extract(p, {chr(39)}{_SIMPLE}{chr(39)}, 1)')} * CASE WHEN regexp_extract(p, {chr(39)}{_SIMPLE}{chr(39)}, 2) = {chr(39)}g{chr(39)} THEN 1000 ELSE 1 END)')} || "
    f"CASE regexp_extract(p, '{_SIMPLE}', 2) WHEN 'g' THEN 'mg' WHEN 'µg' THEN 'mcg' WHEN 'ug' THEN 'mcg' ELSE regexp_extract(p, '{_SIMPLE}', 2) END END"
)
_STRENGTH = f"COALESCE(list_sort(list_distinct(list_filter(list_transform(list_transform(string_split_regex({_clean('strength')}, '[;+]'), lambda q: replace(trim(q), ' ', '')), lambda p: {_STRENGTH_ONE}), lambda p: p IS NOT NULL))), [])"


def _form_case() -> str:
    order = {b: i for i, b in enumerate(vocab.FORMS)}
    exact = " ".join(f"WHEN f = '{v}' THEN '{b}'" for v, b in vocab.FORM_VARIANTS)
    words = " ".join(f"WHEN regexp_matches(f, '\\b{v}\\b') THEN '{b}'" for v, b in sorted(vocab.FORM_VARIANTS, key=lambda v: (-len(v[0]), order[v[1]])))
    return f"CASE {exact} {words} END"


_KEY_TOKENS = f"list_filter(string_split({_bare(chr(39).join(['regexp_replace(' + _clean('company_raw') + ', ', '\\([^)]*\\)', ', ', ' ', ', ', 'g', ')']))}, ' '), lambda t: t <> '' AND t NOT IN {_list([*vocab.LEGAL, *vocab.PLACES])})"
_REG = f"""
WITH f0 AS (SELECT *, {_bare(_clean('form'))} AS f FROM product_record),
reg AS MATERIALIZED (SELECT ord, source_id, country, product_name, {_INN} AS inn, {_STRENGTH} AS strength, {_form_case()} AS form, {_ROUTE} AS route, company_raw,
  NULLIF(array_to_string({_KEY_TOKENS}, ' '), '') AS company, NULLIF(registration_number, '') AS registration_number, approval_date, status, category, substr(NULLIF(extras.expiry_date, ''), 1, 10) AS expiry,
  lower(trim(COALESCE(status, ''))) = 'active' AS active, COALESCE(lower(trim(category)) IN {_list(vocab.MEDICINES)}, true) AS medicine, NULLIF(substr(NULLIF(approval_date, ''), 1, 10), '') AS granted FROM f0)
"""


@_query(_REG + "SELECT ord, array_to_string(inn, '|') AS inn, array_to_string(strength, '|') AS strength, form, array_to_string(route, '|') AS route, company FROM reg")
def register_normalised(spark, sf_dir):
    """Every record's ingredients, strengths, form, routes and company key."""
    r = register(spark, sf_dir)
    return r.select("ord", _bar("inn"), _bar("strength"), "form", _bar("route"), "company")


@_query("SELECT ord, company AS company_key FROM product_record WHERE company_raw IS NOT NULL")
def company_key(spark, sf_dir):
    """F8, F9 against the keys the table brings along (damaged and escaped names included)."""
    raw = table(spark, sf_dir, "product_record").where(F.col("company_raw").isNotNull())
    return raw.select("ord", text.company_key("company_raw").alias("company_key"))


@_query("SELECT snapshot_id, row_no, COALESCE(source_id || ':id:' || NULLIF(record_id, ''), source_id || ':reg:' || NULLIF(registration_number, ''), source_id || ':proc:' || NULLIF(process_number, ''), source_id || ':doc:' || NULLIF(document_url, '')) AS record_key FROM snapshot_row")
def record_keys(spark, sf_dir):
    """Q3: the key by which a record is told across snapshots."""
    return table(spark, sf_dir, "snapshot_row").select("snapshot_id", "row_no", record_key().alias("record_key"))


_PAT = r"(\d+(?:\.\d+)?)\s*(mg|g|mcg|µg|ug|iu|ml|%)"


@_query()
def generic_names(spark, sf_dir):
    """ingredient, strength and form parsed from the listing's free text."""
    rows = table(spark, sf_dir, "listing_extract").withColumn("p", text.parse_generic_name("generic_name"))
    return rows.select("listing_id", F.array_join("p.inn", "|").alias("inn"), F.array_join("p.strength", "|").alias("strength"), F.col("p.form").alias("form"))


#: A capital after everything that is no letter, letter by letter.
_TITLE = "list_reduce(string_split(array_to_string(inn, ' + '), ''), lambda s, x: s || CASE WHEN regexp_matches(s, '[a-z]$', 'i') THEN lower(x) ELSE upper(x) END, '')"
_EVENTS = _REG + f""", b AS (SELECT *, COALESCE(NULLIF(product_name, ''), NULLIF({_TITLE}, ''), '(unnamed)') AS product, min(granted) OVER (PARTITION BY source_id, company_raw) AS first_seen FROM reg WHERE company_raw <> ''),
e AS (SELECT *, CASE WHEN active AND granted >= '{text.shift_months(AS_OF, -12)}' AND granted = first_seen THEN row_number() OVER (PARTITION BY source_id, company_raw, active AND granted >= '{text.shift_months(AS_OF, -12)}' AND granted = first_seen ORDER BY ord) END AS n FROM b),
ev AS (SELECT ord, 0 AS emit, 'lapsed' AS kind, 0 AS severity, expiry AS date, source_id, company_raw AS company, country, product FROM e WHERE NOT active AND expiry BETWEEN '{text.shift_months(AS_OF, -12)}' AND '{AS_OF}'
  UNION ALL SELECT ord, 0, 'renewal_due', 1, expiry, source_id, company_raw, country, product FROM e WHERE active AND expiry BETWEEN '{AS_OF}' AND '{text.shift_months(AS_OF, 12)}'
  UNION ALL SELECT ord, 1, 'newly_granted', 2, granted, source_id, company_raw, country, product FROM e WHERE active AND granted >= '{text.shift_months(AS_OF, -12)}'
  UNION ALL SELECT ord, 2, 'first_entry', 3, granted, source_id, company_raw, country, product FROM e WHERE n = 1)
"""


@_query(_EVENTS + "SELECT ord, emit, kind, severity, date, source_id, company, country, product FROM ev")
def triggers_detail(spark, sf_dir):
    """Dated events of every record, gravest first."""
    return events.ordered(events.detect(register(spark, sf_dir), AS_OF)).select("ord", "emit", "kind", "severity", "date", "source_id", "company", "country", "product")


@_query(_EVENTS + "SELECT kind, count(*) AS n FROM ev GROUP BY 1")
def triggers_summary(spark, sf_dir):
    """A5: events by kind."""
    return events.summarise(events.detect(register(spark, sf_dir), AS_OF))


@_query(_EVENTS + """SELECT company, country, first(source_id ORDER BY severity, date, ord, emit) AS source_id, count(*) FILTER (WHERE kind = 'lapsed') AS n_lapsed, count(*) FILTER (WHERE kind = 'renewal_due') AS n_renewal_due, count(*) FILTER (WHERE kind = 'newly_granted') AS n_newly_granted,
  count(*) FILTER (WHERE kind = 'first_entry') AS n_first_entry, count(*) AS total, min(severity) AS severity, first(kind ORDER BY severity, date, ord, emit) AS top_kind, COALESCE(min(date) FILTER (WHERE kind = 'renewal_due'), max(date)) AS next_date FROM ev GROUP BY 1, 2""")
def trigger_accounts(spark, sf_dir):
    """A1-A4: events by account, ranked."""
    return events.ranked(events.by_account(events.detect(register(spark, sf_dir), AS_OF)))


@_query(_EVENTS + """, h AS (SELECT source_id, country, count(*) AS records, strftime(max(retrieved_at), '%Y-%m-%d') AS retrieved FROM product_record GROUP BY 1, 2), f AS (SELECT source_id, country, count(*) AS triggers, count(DISTINCT company) AS accounts FROM ev GROUP BY 1, 2)
SELECT h.source_id, h.country, records, retrieved, COALESCE(triggers, 0) AS triggers, COALESCE(accounts, 0) AS accounts FROM h LEFT JOIN f ON h.source_id = f.source_id AND h.country = f.country""")
def feed_by_market(spark, sf_dir):
    """Every register with all it holds and the events found in it."""
    r = register(spark, sf_dir)
    return events.feed(r, events.detect(r, AS_OF))


_ACCOUNTS = """SELECT company, country, count(*) FILTER (WHERE kind = 'lapsed') AS n_lapsed, count(*) FILTER (WHERE kind = 'renewal_due') AS n_renewal_due, count(*) FILTER (WHERE kind = 'newly_granted') AS n_newly_granted, count(*) FILTER (WHERE kind = 'first_entry') AS n_first_entry,
  count(*) AS total, min(severity) AS severity, COALESCE(min(date) FILTER (WHERE kind = 'renewal_due'), max(date)) AS next_date FROM ev GROUP BY 1, 2"""


@_query(_EVENTS + f"SELECT company, country, total, next_date FROM ({_ACCOUNTS}) WHERE lower(company) LIKE '%pharma%' AND (n_renewal_due > 0 OR n_first_entry > 0) ORDER BY severity, total DESC, next_date, company, country LIMIT 300")
def accounts_filtered(spark, sf_dir):
    """The first accounts that hold a word in their name and have an event of the kinds asked for."""
    accounts = events.by_account(events.detect(register(spark, sf_dir), AS_OF))
    return events.filtered(accounts, "Pharma", ("renewal_due", "first_entry")).select("company", "country", "total", "next_date")


_ACTIVE = "active AND medicine AND len(inn) > 0"
_BUCKET = "CASE WHEN {n} = 1 THEN 'sole holder' WHEN {n} = 2 THEN 'two holders' WHEN {n} <= 5 THEN 'contested' WHEN {n} <= 10 THEN 'crowded' ELSE 'commodity' END"


@_query(_REG + f""", m AS (SELECT country, array_to_string(inn, '|') AS inn, form, count(DISTINCT NULLIF(company_raw, '')) AS holders, array_to_string(list_slice(list_sort(list_distinct(list(NULLIF(company_raw, '')) FILTER (WHERE company_raw <> ''))), 1, 12), '|') AS holder_names,
  count(granted) AS registrations, count(*) FILTER (WHERE granted >= '{markets.RECENT}') AS recent_registrations, min(granted) AS first_grant, max(granted) AS latest_grant FROM reg WHERE {_ACTIVE} GROUP BY 1, 2, 3)
SELECT *, {_BUCKET.format(n='holders')} AS structure FROM m WHERE holders > 0""")
def market_structure(spark, sf_dir):
    """How contested each market is."""
    return markets.structure(register(spark, sf_dir)).select("country", _bar("inn"), "form", "holders", _bar("holder_names"), "registrations", "recent_registrations", "first_grant", "latest_grant", "structure")


@_query(_REG + f""", m AS (SELECT country, count(DISTINCT company_raw) AS holders, array_to_string(list_slice(list_sort(list_distinct(list(company_raw))), 1, 4), '|') AS examples FROM reg WHERE {_ACTIVE} AND list_contains(inn, 'momofibrane') AND company_raw IS NOT NULL GROUP BY 1)
SELECT *, {_BUCKET.format(n='holders')} AS structure FROM m""")
def market_view(spark, sf_dir):
    """Q13: one molecule by market."""
    return markets.view(register(spark, sf_dir), "momofibrane").select("country", "holders", _bar("examples"), "structure")


@_query(_REG + """, s AS (SELECT country, unnest(inn) AS ingredient, company_raw, ord FROM reg WHERE active AND medicine AND company_raw <> ''), d AS (SELECT country, ingredient, company_raw, min(ord) AS ord FROM s WHERE length(ingredient) >= 5 GROUP BY 1, 2, 3)
SELECT country, ingredient, count(*) AS n, string_agg(company_raw, '|' ORDER BY ord, company_raw) AS who FROM d GROUP BY 1, 2""")
def scoping_index(spark, sf_dir):
    """Holders by market and ingredient in first-seen order."""
    return markets.scoping_index(register(spark, sf_dir)).select("country", "ingredient", "n", _bar("who"))


@_query(_REG + "SELECT DISTINCT ingredient FROM (SELECT unnest(inn) AS ingredient FROM reg) WHERE length(ingredient) >= 5")
def ingredient_vocabulary(spark, sf_dir):
    """Distinct ingredients."""
    return markets.vocabulary(register(spark, sf_dir))


#: What a register's coverage counts: all its records, the active ones, or those with a holder.
COUNTED = {"NG": "all", "KE": "all", "BR": "active", "MZ": "all", "SN": "all", "TZ": "attributed"}


@_query(_REG + """, v AS (SELECT * FROM reg WHERE CASE WHEN country = 'BR' THEN active WHEN country = 'TZ' THEN company_raw IS NOT NULL ELSE true END)
SELECT source_id, country, count(*) AS record_count, count(expiry) AS with_expiry, max(TRY_CAST(substr(approval_date, 1, 4) AS INT)) AS coverage_end_year FROM v GROUP BY 1, 2""")
def source_coverage(spark, sf_dir):
    """What each register held, counted by its own rule."""
    return markets.source_coverage(register(spark, sf_dir), COUNTED)


@_query()
def company_verdicts(spark, sf_dir):
    """Verdicts on the pairs of names of an older run."""
    pairs = table(spark, sf_dir, "company_match")
    return resolve.with_verdict(pairs.select("match_id", "left_name", "right_name"), F.col("left_name"), F.col("right_name"), "v").select("match_id", F.round("v.score", 6).alias("score"), "v.first_token_match", "v.verdict")


@_query()
def company_similarity(spark, sf_dir):
    """token-sort likeness of the same pairs."""
    pairs = table(spark, sf_dir, "company_match")
    joined = lambda c: F.array_join(text.company_tokens(c), " ")
    return pairs.select("match_id", F.round(similarity.token_sort_ratio(joined("left_name"), joined("right_name")), 6).alias("likeness"))


@_query()
def company_groups(spark, sf_dir):
    """Each company name of the register with the representative of its group."""
    return resolve.group_companies(table(spark, sf_dir, "product_record"))


@_query()
def group_presence(spark, sf_dir):
    """Where each group holds something."""
    records = table(spark, sf_dir, "product_record")
    return markets.presence_counts(records, resolve.group_companies(records))


@_query()
def company_portfolio(spark, sf_dir):
    """Active medicines of the group a query names."""
    found = resolve.group_records(register(spark, sf_dir).where(text.is_active("status") & text.is_medicine("category")), "Talabulub Pharmaceuticals")
    return found.select("ord", "country", "company_raw", "representative")


@_query(_REG + """, h AS (SELECT array_to_string(inn, '|') AS k, min(ord) AS head FROM reg WHERE len(inn) > 0 AND (len(strength) > 0 OR form IS NOT NULL) GROUP BY 1), p AS (SELECT r.ord, r.inn, r.strength AS s1, r.form AS f1, l.strength AS s0, l.form AS f0, (len(r.strength) > 0 OR r.form IS NOT NULL) AS usable FROM reg r JOIN h ON array_to_string(r.inn, '|') = h.k JOIN reg l ON l.ord = h.head)
SELECT ord, CASE WHEN NOT usable THEN 'no-match' WHEN (len(s0) > 0 AND len(s1) > 0 AND s0 <> s1) OR (f0 IS NOT NULL AND f1 IS NOT NULL AND f0 <> f1) THEN 'no-match' WHEN NOT (len(s0) > 0 AND len(s1) > 0) AND NOT (f0 IS NOT NULL AND f1 IS NOT NULL) THEN 'review' ELSE 'match' END AS verdict FROM p""")
def product_verdicts(spark, sf_dir):
    """compare_products: each record against the first record of its ingredients."""
    r = register(spark, sf_dir).select("ord", "inn", "strength", "form").where(F.size("inn") > 0)
    first = r.where(resolve.usable()).groupBy("inn").agg(F.min_by(F.struct("strength", "form"), "ord").alias("h"))
    pairs = r.join(first, "inn").select("ord", F.col("inn").alias("l_inn"), F.col("h.strength").alias("l_strength"), F.col("h.form").alias("l_form"), F.col("inn").alias("r_inn"), F.col("strength").alias("r_strength"), F.col("form").alias("r_form"))
    return pairs.select("ord", resolve.product_verdict()["verdict"].alias("verdict"))


def _presences(r: DataFrame, *also: str) -> DataFrame:
    held = r.where(text.is_active("status") & text.is_medicine("category")).select("ord", "country", "inn", "strength", "form", "company", *also)
    return resolve.presences(settled(held, "inn", "strength", "form", "company").where(F.col("company").isNotNull()))


def _dated_presences(r: DataFrame) -> DataFrame:
    return _presences(r, "approval_date")


@_query()
def product_presences(spark, sf_dir):
    """Products of each company and the first record per country."""
    p = _presences(register(spark, sf_dir))
    return p.select("company", "presence", _bar("inn"), _bar("strength"), "form", "country", "ord")


def _exact_presences(r: DataFrame) -> DataFrame:
    held = r.where(text.is_active("status") & text.is_medicine("category") & F.col("company").isNotNull() & resolve.usable())
    placed = held.withColumn("presence", F.xxhash64("inn", "strength", "form")).select("company", "presence", "inn", "strength", "form", "country", "ord", "approval_date")
    # one exchange for this grouping and that of gaps()
    return placed.repartition("company", "presence").groupBy("company", "presence", "inn", "strength", "form", "country").agg(F.min("ord").alias("ord"), F.min_by("approval_date", "ord").alias("approval_date"))


def _coverage(spark):
    return spark.createDataFrame(COVERAGE, "country string, coverage_end_year int")


def _gaps(spark, sf_dir, presences=_exact_presences):
    r = register(spark, sf_dir)
    return markets.gaps(presences(r), r, _coverage(spark))



_GAP_SQL = (
    _REG
    + f""", u AS (SELECT company, array_to_string(inn, '|') AS i, array_to_string(strength, '|') AS s, form, country, min(ord) AS ord FROM reg WHERE active AND medicine AND company IS NOT NULL AND len(inn) > 0 AND (len(strength) > 0 OR form IS NOT NULL) GROUP BY 1, 2, 3, 4, 5),
by_product AS (SELECT company, i, s, form, list_sort(list(country)) AS present_in, first(held ORDER BY country) AS held_since FROM (SELECT u.*, r.approval_date AS held FROM u JOIN reg r ON r.ord = u.ord) GROUP BY 1, 2, 3, 4),
c AS MATERIALIZED (SELECT p.*, v.country, CASE WHEN TRY_CAST(substr(held_since, 1, 4) AS INT) > v.end_year THEN 'out_of_window' ELSE 'gap' END AS state FROM by_product p CROSS JOIN (VALUES {', '.join(f"('{c}', {y})" for c, y in COVERAGE)}) AS v(country, end_year) WHERE NOT list_contains(present_in, v.country)),
o AS MATERIALIZED (SELECT DISTINCT country, array_to_string(inn, '|') AS i, array_to_string(strength, '|') AS s, form, company, company_raw FROM reg WHERE active AND medicine AND len(inn) > 0 AND company_raw <> '' AND (len(strength) > 0 OR form IS NOT NULL)),
x AS (SELECT c.company, c.i, c.s, c.form, c.country, count(DISTINCT o.company_raw) AS n, array_to_string(list_slice(list_sort(list(DISTINCT o.company_raw)), 1, 4), '|') AS ex FROM c JOIN o ON c.country = o.country AND c.i = o.i
  WHERE state = 'gap' AND (c.s = '' OR o.s = '' OR c.s = o.s) AND (c.form IS NULL OR o.form IS NULL OR c.form = o.form) AND ((c.s <> '' AND o.s <> '') OR (c.form IS NOT NULL AND o.form IS NOT NULL)) AND NOT COALESCE(o.company = c.company, false) GROUP BY 1, 2, 3, 4, 5)
"""
)


@_query(_GAP_SQL + """SELECT c.company, c.i AS inn, c.s AS strength, c.form, c.country, array_to_string(present_in, '|') AS present_in, COALESCE(n, 0) AS competitors, COALESCE(ex, '') AS examples, CASE WHEN COALESCE(n, 0) = 0 THEN 1 WHEN n <= 3 THEN 0 ELSE 3 END AS tier
FROM c LEFT JOIN x ON c.company = x.company AND c.i = x.i AND c.s = x.s AND c.form IS NOT DISTINCT FROM x.form AND c.country = x.country WHERE state = 'gap'""")
def whitespace_cells(spark, sf_dir):
    """Countries in which a company's product, by exact identity, was not found, with the others who hold it there."""
    return _gaps(spark, sf_dir).where("state = 'gap'").select("company", _bar("inn"), _bar("strength"), "form", "country", _bar("present_in"), "competitors", _bar("examples"), "tier")


@_query(_GAP_SQL + "SELECT country, count(*) AS n, min(substr(held_since, 1, 10)) AS held_since FROM c WHERE state = 'out_of_window' GROUP BY 1")
def out_of_window(spark, sf_dir):
    """Gaps, by exact identity, that the end of a source's window explains."""
    return _gaps(spark, sf_dir).where("state = 'out_of_window'").groupBy("country").agg(F.count("*").alias("n"), F.min("held_since").alias("held_since"))


@_query(_REG + ", u AS (SELECT DISTINCT company, array_to_string(inn, '|') AS inn, array_to_string(strength, '|') AS strength, form, country FROM reg WHERE active AND medicine AND company IS NOT NULL AND len(inn) > 0 AND (len(strength) > 0 OR form IS NOT NULL)) SELECT company, inn, strength, form, " + ", ".join(f"bool_or(country = '{c}') AS {c.lower()}" for c, _ in COVERAGE) + " FROM u GROUP BY 1, 2, 3, 4")
def presence_matrix(spark, sf_dir):
    """Q10: product, by exact identity, by country."""
    held = _exact_presences(register(spark, sf_dir))
    m = held.groupBy("company", "inn", "strength", "form").pivot("country", [c for c, _ in COVERAGE]).agg(F.count("ord") > 0).na.fill(False)
    return m.select("company", _bar("inn"), _bar("strength"), "form", *[F.col(c).alias(c.lower()) for c, _ in COVERAGE])


@_query()
def product_gaps(spark, sf_dir):
    """Q7, Q8: whitespace_cells of whole products, records of other spellings and with missing fields included."""
    found = _gaps(spark, sf_dir, _dated_presences).where("state = 'gap'")
    return found.select("company", "presence", _bar("inn"), _bar("strength"), "form", "country", _bar("present_in"), "competitors", _bar("examples"), "tier")


@_query()
def product_out_of_window(spark, sf_dir):
    """out_of_window of whole products."""
    cells = markets.out_of_window(_dated_presences(register(spark, sf_dir)), _coverage(spark))
    return cells.groupBy("country").agg(F.count("*").alias("n"), F.min("held_since").alias("held_since"))


@_query()
def product_matrix(spark, sf_dir):
    """Q10: whole product by country."""
    m = markets.matrix(_presences(register(spark, sf_dir)), [c for c, _ in COVERAGE])
    return m.select("company", "presence", "label", *[F.col(c).alias(c.lower()) for c, _ in COVERAGE])


def _last_two(spark, sf_dir):
    m = table(spark, sf_dir, "register_snapshot").withColumn("ord", F.col("snapshot_id"))
    return diffing.latest(m, 2, ("source_id", "section_no"), "ord")


def _watch(spark, sf_dir):
    rows = table(spark, sf_dir, "snapshot_row").select("snapshot_id", F.col("row_no").alias("ord"), record_key().alias("record_key"), "status", F.substring("expiry_date", 1, 10).alias("expiry"))
    two = _last_two(spark, sf_dir).select("snapshot_id", "source_id", "section_no", "recency")
    placed = rows.join(two, "snapshot_id").drop("snapshot_id")
    pair = ["source_id", "section_no"]
    return diffing.guarded_diff(placed.where("recency = 2").drop("recency"), placed.where("recency = 1").drop("recency"), pair)


_WATCH = """WITH t AS (SELECT snapshot_id, source_id, section_no, row_number() OVER (PARTITION BY source_id, section_no ORDER BY snapshot_id DESC) AS recency FROM register_snapshot),
k AS (SELECT t.source_id, t.section_no, recency, row_no, COALESCE(r.source_id || ':id:' || NULLIF(record_id, ''), r.source_id || ':reg:' || NULLIF(registration_number, ''), r.source_id || ':proc:' || NULLIF(process_number, ''), r.source_id || ':doc:' || NULLIF(document_url, '')) AS record_key, status, substr(expiry_date, 1, 10) AS expiry FROM snapshot_row r JOIN t USING (snapshot_id) WHERE recency <= 2),
d AS (SELECT source_id, section_no, recency, record_key, max_by(struct_pack(s := status, e := expiry), row_no) AS v FROM k WHERE record_key IS NOT NULL GROUP BY 1, 2, 3, 4),
o AS (SELECT * FROM d WHERE recency = 2), n AS (SELECT * FROM d WHERE recency = 1),
j AS (SELECT COALESCE(o.source_id, n.source_id) AS source_id, COALESCE(o.section_no, n.section_no) AS section_no, COALESCE(o.record_key, n.record_key) AS record_key, o.record_key IS NOT NULL AS in0, n.record_key IS NOT NULL AS in1, o.v.s AS s0, n.v.s AS s1, o.v.e AS e0, n.v.e AS e1 FROM o FULL JOIN n ON o.source_id = n.source_id AND o.section_no = n.section_no AND o.record_key = n.record_key),
st AS (SELECT source_id, section_no, count(*) FILTER (WHERE in0) AS keys_before, count(*) FILTER (WHERE in1) AS keys_after, count(*) AS compared FROM j GROUP BY 1, 2),
u AS (SELECT source_id, section_no, count(*) FILTER (WHERE recency = 2) AS unkeyed_before, count(*) FILTER (WHERE recency = 1) AS unkeyed_after FROM k WHERE record_key IS NULL GROUP BY 1, 2),
s AS (SELECT st.*, COALESCE(unkeyed_before, 0) AS unkeyed_before, COALESCE(unkeyed_after, 0) AS unkeyed_after, CASE WHEN keys_before = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, (keys_before - keys_after)::DOUBLE / keys_before) END AS shrink FROM st LEFT JOIN u USING (source_id, section_no)),
ch AS (SELECT source_id, section_no, record_key, 'appeared' AS kind, s0 AS before, s1 AS after FROM j WHERE NOT in0
  UNION ALL SELECT source_id, section_no, record_key, 'status_changed', s0, s1 FROM j WHERE in0 AND in1 AND COALESCE(s0, '') <> COALESCE(s1, '')
  UNION ALL SELECT source_id, section_no, record_key, 'expiry_changed', e0, e1 FROM j WHERE in0 AND in1 AND e0 <> '' AND e1 <> '' AND e0 <> e1
  UNION ALL SELECT j.source_id, j.section_no, record_key, 'disappeared', s0, s1 FROM j JOIN s ON s.source_id = j.source_id AND s.section_no = j.section_no WHERE NOT in1 AND shrink <= 0.2)
"""


@_query(_WATCH + "SELECT * FROM ch")
def snapshot_diff(spark, sf_dir):
    """Changes between the two latest snapshots of each series, disappearances guarded."""
    return _watch(spark, sf_dir)[0]


@_query(_WATCH + "SELECT source_id, section_no, keys_before, keys_after, compared, unkeyed_before, unkeyed_after, round(shrink, 6) AS shrink, shrink <= 0.2 AS reported FROM s")
def diff_statistics(spark, sf_dir):
    """What each comparison rests on."""
    return _watch(spark, sf_dir)[1].withColumn("shrink", F.round("shrink", 6))


@_query(_WATCH + "SELECT source_id, section_no, kind, count(*) AS n FROM ch GROUP BY 1, 2, 3")
def diff_counts(spark, sf_dir):
    """Changes by kind."""
    return diffing.by_kind(_watch(spark, sf_dir)[0], ["source_id", "section_no"])


@_query("SELECT source_id, section_no, snapshot_id, recency::INT AS recency FROM (SELECT *, row_number() OVER (PARTITION BY source_id, section_no ORDER BY snapshot_id DESC) AS recency FROM register_snapshot) WHERE recency <= 2")
def latest_two_snapshots(spark, sf_dir):
    """The two latest snapshots of each series."""
    return _last_two(spark, sf_dir).select("source_id", "section_no", "snapshot_id", "recency")


@_query("SELECT listing_id, CASE WHEN local_path IS NULL THEN NULL ELSE regexp_replace(regexp_extract(rtrim(local_path, '/'), '[^/]*$'), '[^A-Za-z0-9._-]', '_', 'g') END AS local_name, CASE WHEN document_url IS NULL THEN NULL ELSE regexp_replace(regexp_extract(rtrim(document_url, '/'), '[^/]*$'), '[^A-Za-z0-9._-]', '_', 'g') END AS url_name FROM listing_extract")
def document_names(spark, sf_dir):
    """File names of documents."""
    return table(spark, sf_dir, "listing_extract").select("listing_id", text.basename("local_path").alias("local_name"), text.basename("document_url").alias("url_name"))


_LOOSE = "regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '\\s*([,:;])\\s*', '\\1', 'g')"


@_query(f"SELECT listing_id, m.page BETWEEN 1 AND page_count AS page_in_range, contains({_LOOSE.format(c='m.quote')}, {_LOOSE.format(c='m.value')}) AS value_in_quote FROM (SELECT *, marketing_authorisation_holder AS m FROM listing_extract) WHERE m IS NOT NULL")
def citation_check(spark, sf_dir):
    """Whether each holder's quote and page hold."""
    flat = lambda c: F.regexp_replace(F.lower(text.collapse(c)), r"\s*([,:;])\s*", "$1")
    m = F.col("marketing_authorisation_holder")
    return table(spark, sf_dir, "listing_extract").where(m.isNotNull()).select("listing_id", m["page"].cast("int").between(1, F.col("page_count")).alias("page_in_range"), F.contains(flat(m["quote"]), flat(m["value"])).alias("value_in_quote"))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"(?m)^Page \d+ of \d+$").alias("pages"))


@_query()
def holder_extraction(spark, sf_dir):
    """The holder named in each document, with page, quote and method."""
    return documents.extract_holders(_pages(spark, sf_dir)).select("doc_id", "page_count", "error", "holder.value", "holder.page", "holder.quote", "holder.method", "holder.confidence")


@_query()
def holder_citations(spark, sf_dir):
    """X5 on the extracted holders: every quote is on its page."""
    pages = _pages(spark, sf_dir)
    return documents.verify_citations(documents.extract_holders(pages), pages)


@_query()
def registration_numbers(spark, sf_dir):
    """The first registration number of each document."""
    return documents.registration_numbers(_pages(spark, sf_dir))


@_query("SELECT doc_id, line_no::INT AS line_no, rule, regexp_extract(line, pattern, 0) AS matched FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) CROSS JOIN (VALUES " + ", ".join(f"({n}, '(?i){p}')" for n, p in vocab.FORBIDDEN) + ") AS v(rule, pattern) WHERE regexp_matches(line, pattern)")
def language_lint(spark, sf_dir):
    """Forbidden phrases by line."""
    return documents.lint(table(spark, sf_dir, "documents"))


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'call_note' AND text IS NOT NULL").select(F.col("doc_id").alias("note_id"), "text")


def _vocabulary(spark, sf_dir):
    """The ingredients of the register, each spelling normalised once."""
    # few bytes, much work: adaptive execution would leave it to a task or two
    spelled = table(spark, sf_dir, "product_record").select("inn").distinct().repartition(2 * spark.sparkContext.defaultParallelism)
    return markets.vocabulary(spelled.select(text.normalize_inn("inn").alias("inn")))


def _facts(spark, sf_dir):
    """(facts, rejected, notes, ingredients); notes and ingredients are read in several places, so they are cut."""
    notes, ingredients = cut(_notes(spark, sf_dir)), cut(_vocabulary(spark, sf_dir))
    return *scoping.verified(scoping.propose(notes, ingredients), notes), notes, ingredients


_TERM_SQL = " UNION ALL ".join(
    "SELECT note_id, '{k}' AS kind, '{v}' AS value FROM notes WHERE {w}".format(k=k, v=v, w=" OR ".join(f"regexp_matches(lower(text), '\\b{w.replace('-', chr(92) + '-')}\\b')" for w in words)) for k, v, words, _ in scoping.terms()
)


@_query(f"WITH notes AS (SELECT doc_id AS note_id, text FROM documents WHERE source = 'call_note' AND text IS NOT NULL) {_TERM_SQL}")
def vocabulary_match(spark, sf_dir):
    """Markets, services, kinds of product and constraints named in call notes."""
    facts = scoping.propose(_notes(spark, sf_dir))
    return facts.where(~F.col("kind").isin("volume", "timing", "product")).select("note_id", "kind", "value")


@_query()
def verified_facts(spark, sf_dir):
    """V1-V3: everything said in call notes with the place it was said."""
    return _facts(spark, sf_dir)[0]


def _resolved(spark, sf_dir):
    """(resolved facts, notes)."""
    facts, _, notes, ingredients = _facts(spark, sf_dir)
    countries = table(spark, sf_dir, "product_record").select("country").where(F.col("country").isNotNull()).distinct()
    return cut(scoping.resolve_facts(facts, countries, ingredients)), notes


@_query()
def scope_lines(spark, sf_dir):
    """V5-V7, V9: products by market and service asked for, and who holds them."""
    r = register(spark, sf_dir).where(text.is_active("status") & text.is_medicine("category") & F.col("company_raw").isNotNull())
    holders = r.select("country", F.explode_outer("inn").alias("ingredient"), "company_raw", "ord").where("ingredient IS NOT NULL")
    return scoping.scope_lines(_resolved(spark, sf_dir)[0], holders, "Talabulub Pharmaceuticals Limited")


@_query()
def scope_gaps(spark, sf_dir):
    """What each note leaves open."""
    resolved, notes = _resolved(spark, sf_dir)
    lines = scoping._distinct(resolved, "service", "note_id").select("note_id", "service")
    return scoping.open_questions(resolved, lines, notes)
