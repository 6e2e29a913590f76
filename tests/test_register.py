"""Resolution, events, comparison, markets, documents, scoping, sources and the snapshot store on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from regolith.functions import text
from regolith.operators import diffing, documents, events, markets, resolve, scoping
from regolith.operators.graph import components
from regolith.sources import registers, snapshots


def verdict(spark, a, b):
    return resolve.with_verdict(spark.createDataFrame([(a, b)], "a string, b string"), F.col("a"), F.col("b")).first().verdict


@pytest.mark.parametrize("a,b,expected", [("Ranbaxy Nigeria Limited", "Ranbaxy Laboratories", "match"), ("Sun Pharmaceutical Industries", "Anisun Pharmaceutical Company", "no-match"), ("S Kant Nigeria", "S Kant Healthcare", "match"), ("", "x", "no-match"), ("De Big Dan Concept", "De - Godstime Industry", "no-match")])
def test_company_verdict(spark, a, b, expected):
    assert verdict(spark, a, b).verdict == expected


def test_micro_is_no_match(spark):
    assert verdict(spark, "Micro Labs", "Micro Nova Pharmaceuticals").verdict != "match"


def test_groups_equal_an_unblocked_run(spark):
    import random

    rng = random.Random(5)
    words = ["micro", "nova", "labs", "pharmaceuticals", "health", "de", "big"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(120)} | {"ltd"})
    tokens = {r.n: r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.company_tokens("n").alias("t")).collect()}
    disc = lambda t: " ".join(t[:2]) if len(t[0]) < 3 and len(t) > 1 else t[0]
    leaders, expected = [], {}
    for n in sorted(names, key=lambda n: (len(n), n)):
        t = tokens[n]
        for leader in leaders:
            s = tokens[leader]
            if t and s and disc(t) == disc(s) and resolve.tokens_ratio(s, t) >= 80:
                expected[n] = leader
                break
        else:
            leaders.append(n)
            expected[n] = n
    df = spark.createDataFrame([(n,) for n in names] * 2 + [(None,), ("",)], "company_raw string")
    assert {r.name: r.representative for r in resolve.group_companies(df).collect()} == expected


def rec(ord, company="Acme Pharma Ltd", country="NG", inn=("amoxicillin",), strength=("500mg",), form="capsule", status="Active", approval="2020-01-01", expiry=None, category=None, name="Testomycin"):
    return (ord, "test", country, name, list(inn), list(strength), form, company, company.split()[0].lower() if company else None, status, category, approval, expiry, f"R{ord}")


SCHEMA = "ord long, source_id string, country string, product_name string, inn array<string>, strength array<string>, form string, company_raw string, company string, status string, category string, approval_date string, expiry string, registration_number string"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_product_verdict(spark):
    def v(a, b):
        row = spark.createDataFrame([(*a, *b)], "l_inn array<string>, l_strength array<string>, l_form string, r_inn array<string>, r_strength array<string>, r_form string")
        return row.select(resolve.product_verdict().alias("v")).first().v

    assert v((["amlodipine"], ["10mg"], "tablet"), (["amlodopine"], ["10mg"], "tablet")).verdict == "match"
    assert v((["amoxicillin"], ["500mg"], "capsule"), (["amoxicillin"], ["250mg"], "capsule")).verdict == "no-match"
    assert v((["amoxicillin"], ["500mg"], None), (["amoxicillin"], [], "capsule")).verdict == "review"
    assert v(([], ["500mg"], None), (["amoxicillin"], [], "capsule")).verdict == "no-match"
    assert v((["amoxicillin"], ["500mg"], None), (["amoxicillin"], ["500mg"], "capsule")).score == pytest.approx(90.0)


def test_events(spark):
    df = records(spark, rec(1, status="Inactive", expiry="2026-05-01", approval="2019-01-01"), rec(2, expiry="2026-12-01", approval="2026-01-10"), rec(3, company="New Co", approval="2026-03-01"), rec(4, company="New Co", approval="2026-03-01"), rec(5, company=None), rec(6, expiry="2026-08", approval=None), rec(7, status=" ACTIVE ", expiry=None, approval="2030-01-01", name="", inn=("a-b", "c")))
    got = {(r.ord, r.kind) for r in events.detect(df, "2026-08-31").collect()}
    assert got == {(1, "lapsed"), (2, "renewal_due"), (2, "newly_granted"), (3, "newly_granted"), (3, "first_entry"), (4, "newly_granted"), (7, "newly_granted")}
    assert events.detect(df, "2026-08-31").where("ord = 7").first().product == "A-B + C"
    accounts = {r.company: r for r in events.by_account(events.detect(df, "2026-08-31")).collect()}
    assert accounts["Acme Pharma Ltd"].top_kind == "lapsed" and accounts["Acme Pharma Ltd"].next_date == "2026-12-01"
    said = events.detect(df, "2026-08-31").where("ord = 1").select("*", F.lit("X").alias("a"), F.lit("2026-08-30").alias("d")).select(events.evidence("a", "d").alias("e")).first().e
    assert said == "registration expired 2026-05-01; recorded inactive in X, retrieved 2026-08-30"


def test_guarded_diff(spark):
    schema = "s string, record_key string, ord long, status string, expiry string"
    before = spark.createDataFrame([("a", f"k{i}", i, "Active", "2030-01-01") for i in range(10)] + [("a", None, 99, None, None)], schema)
    for gone, reported in ((2, True), (3, False)):
        after = spark.createDataFrame([("a", f"k{i}", i, "Gone" if i == 9 else "Active", "2031-01-01" if i == 9 else None) for i in range(gone, 10)] + [("a", "k9", 0, "Active", None)], schema)
        changes, stats = diffing.guarded_diff(before, after, ["s"])
        kinds = sorted(r.kind for r in changes.collect())
        assert kinds == ["disappeared"] * (gone if reported else 0) + ["expiry_changed", "status_changed"]
        assert stats.first().reported is reported and stats.first().unkeyed_before == 1


def test_structure_and_index(spark):
    df = records(spark, *[rec(i, company=f"C{i} Ltd", approval="2025-01-01") for i in range(4)], rec(9, status="Inactive"), rec(10, category="Medical devices"), rec(11, company=None))
    row = markets.structure(df).first()
    assert (row.holders, row.structure, row.registrations, row.recent_registrations) == (4, "contested", 5, 4)
    assert markets.scoping_index(df).first().who == ["C0 Ltd", "C1 Ltd", "C2 Ltd", "C3 Ltd"]
    assert markets.view(df, "amoxicillin").first().examples == ["C0 Ltd", "C1 Ltd", "C2 Ltd", "C3 Ltd"]


def test_presences_and_gaps(spark):
    df = records(spark, rec(1), rec(2, country="TZ", inn=("amoxicilin",)), rec(3, inn=("ibuprofen",), strength=(), form=None), rec(4, inn=("ibuprofen",), strength=("200mg",), form="tablet"), rec(5, company="Rival Ltd", country="BR"), rec(6, approval="2024-05-05", inn=("late",)))
    p = resolve.presences(df.where("company = 'acme'").select("ord", "country", "inn", "strength", "form", "company"))
    got = {(r.presence, r.country, r.ord) for r in p.collect()}
    assert got == {(0, "NG", 1), (0, "TZ", 2), (1, "NG", 4), (2, "NG", 6)}
    cells = markets.gaps(p, df, spark.createDataFrame([("NG", 2026), ("TZ", 2023), ("BR", None)], "country string, coverage_end_year int"))
    by = {(r.presence, r.country): r for r in cells.collect()}
    assert set(by) == {(0, "BR"), (1, "TZ"), (1, "BR"), (2, "TZ"), (2, "BR")}
    assert by[0, "BR"].competitors == 1 and by[0, "BR"].tier == 0 and by[1, "BR"].tier == 1
    assert by[2, "TZ"].state == "out_of_window" and by[2, "TZ"].held_since == "2024-05-05"
    assert {r.presence: (r.NG, r.TZ) for r in markets.matrix(p, ["NG", "TZ"]).collect()} == {0: (True, True), 1: (True, False), 2: (True, False)}


def test_holders(spark):
    docs = [
        (1, ["7. Marketing Authorisation Holder\n12\nName and address of marketing authorization holder\nAddress:\nPlot 5, Road 3\nDafra Pharma GmbH, Mühlenberg 7, 4052 Basel,"]),
        (2, ["Marketing Authorization Holder Beta Drugs Ltd"]),
        (3, ["x", "the marketing authorisation holder: Cipla Limited"]),
        (4, ["report to the marketing authorisation holder of any event that may seem to be related. Thanks"]),
        (5, ["", None]),
        (6, None),
        (7, ["7. MARKETING AUTHORISATION HOLDER\n8. Shelf Life"]),
    ]
    df = spark.createDataFrame(docs, "doc_id long, pages array<string>")
    found = documents.extract_holders(df)
    got = {r.doc_id: r for r in found.collect()}
    assert (got[1].holder.value, got[1].holder.method, got[1].holder.confidence) == ("Dafra Pharma GmbH, Mühlenberg 7", "rule:heading", 0.95)
    assert (got[2].holder.value, got[2].holder.method) == ("Beta Drugs Ltd", "rule:heading-inline")
    assert (got[3].holder.value, got[3].holder.page, got[3].holder.method) == ("Cipla Limited", 2, "rule:inline")
    assert got[4].holder is None and got[5].error and got[6].page_count == 0 and got[7].holder is None
    checks = documents.verify_citations(found, df).collect()
    assert len(checks) == 3 and all(c.page_in_range and c.quote_on_page and c.value_in_quote for c in checks)
    number = documents.registration_numbers(spark.createDataFrame([(1, ["none", "Reg no: tz 17 h 0290 of"])], "doc_id long, pages array<string>")).first()
    assert (number.value, number.page, number.quote) == ("TZ 17 H 0290", 2, "Reg no: tz 17 h 0290 of")


def test_lint(spark):
    bad = ["It is not registered there.", "an UNREGISTERED product", "they failed to  register", "illegally sold", "noncompliant", "in violation of"]
    good = ["did not appear in NAFDAC source", "failed to renew", "registration expired", ""]
    df = spark.createDataFrame([(i, "fine\n" + t) for i, t in enumerate(bad + good)], "doc_id long, text string")
    assert {r.doc_id for r in documents.lint(df).collect()} == set(range(len(bad)))
    assert {r.line_no for r in documents.lint(df).collect()} == {2}
    with pytest.raises(ValueError):
        documents.assert_clean(bad[0])


def test_scoping(spark):
    notes = spark.createDataFrame([(1, "They want registration of 14 generic products in Nigeria and east africa by Q3 2026, amlodipine first.\nCTD and dossier preparation."), (2, None), (3, "")], "note_id long, text string")
    ingredients = spark.createDataFrame([("amlodipine",), ("row",)], "ingredient string")
    facts, rejected = scoping.verified(scoping.propose(notes, ingredients), notes)
    got = {(r.kind, r.value) for r in facts.collect()}
    assert {("market", "NG"), ("market", "region:africa"), ("service", "registration"), ("service", "dossier_preparation"), ("product_type", "generic"), ("volume", "14"), ("timing", "Q3 2026"), ("product", "amlodipine")} <= got
    assert rejected.count() == 0
    text_of = notes.first().text
    assert all(text_of[r.start : r.start + len(r.quote)] == r.quote for r in facts.collect())
    resolved = scoping.resolve_facts(facts, spark.createDataFrame([("NG",)], "country string"), ingredients)
    holders = spark.createDataFrame([("NG", "amlodipine", "Acme Ltd", 5), ("NG", "amlodipine", "Beta Ltd", 2)], "country string, ingredient string, company_raw string, ord long")
    lines = {r.service: r for r in scoping.scope_lines(resolved, holders, "Acme Limited").collect()}
    assert set(lines) == {"registration", "dossier_preparation"} and lines["registration"].holder == "Acme Ltd" and lines["registration"].competitors == 1 and lines["registration"].already_held
    open_ = scoping.open_questions(resolved, scoping.scope_lines(resolved, holders), notes.where("note_id = 1"))
    asked = {(r.kind, r.about) for r in open_.collect()}
    assert ("market", "africa") in asked and ("regulatory", "dossier format") not in asked and ("client", "legal entity") in asked and not any(k == "volume" for k, _ in asked)
    assert scoping.quotable(open_).first().can_be_quoted is False


def test_proposals_are_verified(spark):
    notes = spark.createDataFrame([(1, "grow a row\nof  beans")], "note_id long, text string")
    p = spark.createDataFrame([(1, "service", "a", "row", "0.5"), (1, "service", "b", "ROW OF", "7"), (1, "service", "c", "absent", "0.5"), (1, "odd", "d", "row", "0.5"), (1, "service", "e", None, "0.5"), (1, "service", "f", "row", "x"), (1, "service", "A", "row", "0.4")], "note_id long, kind string, value string, quote string, confidence string")
    with_numbers = p.withColumn("confidence", F.col("confidence").try_cast("double"))
    facts, rejected = scoping.verified(with_numbers, notes)
    assert {(r.value, r.start, r.confidence) for r in facts.collect()} == {("a", 1, 0.5), ("b", 7, 1.0)}
    assert {r.value: r.reason for r in rejected.collect()} == {"c": "quote not found in source", "d": "unknown kind", "e": "no supporting quote", "f": "no confidence"}


def test_sources(spark, tmp_path):
    ng = [{"product_id": "1", "product_name": "#Tab*", "ingredient_name": "A &amp; B; C", "strength": "1 g", "form_name": "Tablets", "route_name": "Oral", "applicant": {"name": "Acme Ltd"}, "applicant_name": "", "product_category": {"name": "Drugs"}, "NAFDAC": " A4-1 ", "status": "Active", "expiry_date": "2027-01-01"}, {"product_id": "1", "product_name": "again"}, {"product_id": None}]
    (tmp_path / "ng.json").write_text(json.dumps(ng))
    g = registers.GreenBook().load(spark, str(tmp_path / "ng.json")).orderBy("ord").collect()
    assert len(g) == 2 and g[0].product_name == "Tab" and g[0].inn == ["a b", "c"] and g[0].company_raw == "Acme Ltd" and g[0].registration_number == "A4-1" and g[0].extras.record_id == "1" and g[0].category == "Drugs"
    csv = "CATEGORIA_REGULATORIA;EMPRESA_DETENTORA_REGISTRO;DATA_VENCIMENTO_REGISTRO;NOME_PRODUTO;PRINCIPIO_ATIVO;NUMERO_REGISTRO_PRODUTO;DATA_FINALIZACAO_PROCESSO;SITUACAO_REGISTRO;CLASSE_TERAPEUTICA;NUMERO_PROCESSO\nGenérico;12345678901234 - ACME S/A;082027;\"Um\nDois\";DIPIRONA;123;31/12/2020;Ativo;X;9\nFitoterápico;x;;y;z;1;;Ativo;;\n"
    (tmp_path / "br.csv").write_bytes(csv.encode("latin-1"))
    b = registers.OpenData().load(spark, str(tmp_path / "br.csv")).collect()
    assert len(b) == 1 and b[0].approval_date == "2020-12-31" and b[0].extras.expiry == "2027-08" and b[0].status == "Active" and b[0].extras.cnpj == "12345678901234"
    html = "<table><tr><th>SN</th><th>Product name</th><th>Generic</th></tr><tr><td>1</td><td> Des  X</td><td>Desloratadine 5 mg film coated tablets<a href='http://x/a.pdf'>d</a></td></tr><tr><td>2</td><td>Y</td><td>z</td><td><a href=\"http://x/a.pdf\">d</a></td></tr><tr><td>3</td><td>W</td><td>v</td></tr></table>"
    (tmp_path / "tz.html").write_text(html)
    listing = registers.ListingPage().read(spark, str(tmp_path / "tz.html"))
    assert [(r.product_name, r.local_name) for r in listing.orderBy("ord").collect()] == [("Des X", "a.pdf"), ("W", None)]
    found = spark.createDataFrame([("cache/a.pdf", "Old", None, 1), ("cache/a.pdf", "Beta Ltd", "TZ 1", 2)], "local_path string, holder string, registration_number string, ord long")
    t = registers.ListingPage().to_records(registers.attach_holders(listing, found)).collect()
    assert len(t) == 1 and t[0].company == "beta" and t[0].form == "tablet" and t[0].extras.document_url == "http://x/a.pdf"
    both = registers.union_records(registers.GreenBook().load(spark, str(tmp_path / "ng.json")), registers.watch_records(listing))
    assert both.select("ord").distinct().count() == 4
    cov = registers.OpenData().coverage(registers.OpenData().load(spark, str(tmp_path / "br.csv")), "2026-01-01").first()
    assert cov.record_count == 1 and cov.coverage_end_year == 2020 and cov.with_expiry == 1
    with pytest.raises(ValueError):
        registers.GreenBook().refuse_empty(listing.limit(0))


def test_snapshot_store(spark, tmp_path):
    first = snapshots.write_snapshot([{"b": 1, "a": "é"}], str(tmp_path), "s", "u", "2026-01-01T00:00:00")
    second = snapshots.write_snapshot([], str(tmp_path), "s", "u", "2025-01-01T00:00:00", "older date, later line")
    m = snapshots.load_manifest(spark, str(tmp_path / "manifest.jsonl"))
    assert snapshots.latest_snapshot(m).first().path == second["path"]
    assert {r.intact for r in snapshots.verify(m).collect()} == {True}
    open(first["path"], "a").write(" ")
    import os

    os.remove(second["path"])
    assert {(r.exists, r.intact) for r in snapshots.verify(m).collect()} == {(True, False), (False, False)}
    df = spark.createDataFrame([("s", 1, ["x"])], "source_id string, n int, a array<string>")
    snapshots.write_partitioned(df, str(tmp_path / "p"), "2026-01-01")
    assert len(spark.read.parquet(str(tmp_path / "p")).first().row_hash) == 64


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 10)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[11] == 10 and {got[100 + i] for i in range(41)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stream(spark, tmp_path):
    from regolith.streaming.watch import arrivals, watch

    rows_schema = "snapshot_id long, row_no int, source_id string, record_id string, registration_number string, process_number string, document_url string, status string, expiry_date string, delivered_at timestamp"
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(1, 1, "s", "a", None, None, None, "Active", None, t), (2, 1, "s", "a", None, None, None, "Gone", None, t), (2, 2, "s", "b", None, None, None, "Active", None, t)]
    spark.createDataFrame(rows, rows_schema).write.parquet(str(tmp_path / "rows"))
    manifest = spark.createDataFrame([(1, "s", 1, t, 1), (2, "s", 1, t + dt.timedelta(days=1), 2)], "snapshot_id long, source_id string, section_no long, retrieved_at timestamp, record_count long")
    got = []
    watch(spark, str(tmp_path / "rows"), rows_schema, lambda: manifest, str(tmp_path / "ck"), lambda df, n: got.extend((r.record_key, r.kind) for r in df.collect())).awaitTermination(120)
    assert sorted(got) == [("s:id:a", "status_changed"), ("s:id:b", "appeared")]
    assert arrivals(spark.createDataFrame(rows, rows_schema)).first()["rows"] == 3


def test_sinks(spark, tmp_path):
    from regolith.sources import sinks

    df = spark.createDataFrame([(i, "a|b", ["x", "y"], True) for i in range(3)], "n int, t string, l array<string>, b boolean")
    text_ = sinks.report("T", {"S": df}, {"S": "note"}, most=2)
    assert "| 0 | a\\|b | x, y | yes |" in text_ and "… and 1 more" in text_ and "note" in text_
    with pytest.raises(ValueError):
        sinks.report("T", {"S": spark.createDataFrame([("is not registered",)], "t string")})
    assert json.loads(sinks.small_payload({"p": df.select("n")}))["p"] == [{"n": 0}, {"n": 1}, {"n": 2}]
    with pytest.raises(ValueError):
        sinks.small_payload({"p": df}, most=2)
    sinks.payload({"Part one": df}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "part-one")).count() == 3
    assert sinks.slug("Acme & Co. Ltd") == "acme-co-ltd"
    r = records(spark, rec(1), rec(2, company="Rival Ltd", country="TZ"))
    p = resolve.presences(r.where("company = 'acme'").select("ord", "country", "inn", "strength", "form", "company"))
    cov = spark.createDataFrame([("NG", 2026), ("TZ", 2026)], "country string, coverage_end_year int")
    sheet = sinks.portfolio_report("Acme", cov, r.select("country", "company_raw").distinct(), markets.matrix(p, ["NG", "TZ"]), markets.gaps(p, r, cov))
    assert "Rival Ltd" in sheet and "## Not found" in sheet


def _same_product(a, b):
    """The verdict of two usable identities, word for word."""
    (x, s0, f0), (y, s1, f1) = a, b
    if (s0 and s1 and s0 != s1) or (f0 and f1 and f0 != f1) or not ((s0 and s1) or (f0 and f1)):
        return False
    x, y = (" ".join(sorted(" ".join(v).split())) for v in (x, y))
    row = [0] * (len(y) + 1)
    for c in x:
        row, up = [0], row
        for j, d in enumerate(y):
            row.append(up[j] + 1 if c == d else max(up[j + 1], row[j]))
    return 200 * row[-1] / (len(x) + len(y)) >= 85


def test_gaps_and_matrix_of_whole_products(spark, tmp_path):
    from regolith.plans import register_queries as rq

    given = spark.read.parquet("/root/testdata/sf0.001/product_record.parquet")
    as_typed = lambda ord, country, inn, strength: given.limit(1).select(*[{"ord": F.lit(ord), "country": F.lit(country), "inn": F.lit(inn), "strength": F.lit(strength), "form": F.lit("tablet"), "company_raw": F.lit("Zyx Planted Ltd"), "status": F.lit("Active"), "category": F.lit("Drugs")}[f.name].cast(f.dataType).alias(f.name) if f.name in ("ord", "country", "inn", "strength", "form", "company_raw", "status", "category") else F.col(f.name) for f in given.schema])
    rows = given.unionByName(as_typed(10**6, "BR", "glimepirideone", "5 mg")).unionByName(as_typed(10**6 + 1, "KE", "glimepiridone", "5 mg")).unionByName(as_typed(10**6 + 2, "MZ", "glimepirideone", None))
    rows.write.parquet(str(tmp_path / "product_record.parquet"))

    held = rq.register(spark, str(tmp_path)).where(text.is_active("status") & text.is_medicine("category") & F.col("company").isNotNull()).orderBy("ord").collect()
    heads, first = {}, {}
    for r in held:
        one = (r.inn, r.strength, r.form)
        if not r.inn or not (r.strength or r.form):
            continue
        own = heads.setdefault(r.company, [])
        i = next((i for i, h in enumerate(own) if _same_product(h, one)), len(own))
        if i == len(own):
            own.append(one)
        first.setdefault((r.company, i), {}).setdefault(r.country, r.approval_date)
    matrix = {(r.company, r.presence): {c for c, _ in rq.COVERAGE if r[c.lower()]} for r in rq.product_matrix(spark, str(tmp_path)).collect()}
    assert matrix == {k: set(v) for k, v in first.items()}
    assert {frozenset(v) for (c, _), v in matrix.items() if "zyx" in c.lower()} == {frozenset({"BR", "KE", "MZ"})}

    gaps, late = set(), {}
    for (company, i), by in first.items():
        since = by[min(by)]
        for c, end in rq.COVERAGE:
            if c not in by:
                if since and since[:4].isdigit() and int(since[:4]) > end:
                    late[c] = late.get(c, 0) + 1
                else:
                    gaps.add((company, i, c, "|".join(sorted(by))))
    found = rq.product_gaps(spark, str(tmp_path)).collect()
    assert len(found) == len(gaps) and {(r.company, r.presence, r.country, r.present_in) for r in found} == gaps
    assert {r.country: r.n for r in rq.product_out_of_window(spark, str(tmp_path)).collect()} == late
    assert not {"product_gaps", "product_out_of_window", "product_matrix"} & set(rq.SQL)


def test_first_entry_is_per_register(spark):
    rows = [rec(1, approval="2010-01-01"), rec(2, approval="2026-03-01"), rec(3, approval="2026-03-01", country="TZ"), rec(4, approval="2026-04-01", country="TZ"), rec(5, approval=None, country="KE")]
    df = records(spark, *rows).withColumn("source_id", F.concat(F.lit("s"), "country"))
    assert {r.ord for r in events.detect(df, "2026-08-31").where("kind = 'first_entry'").collect()} == {3}


def test_feed_and_filter(spark):
    df = records(spark, rec(1, expiry="2026-12-01"), rec(2, company="Other", country="TZ", status="Inactive", expiry="2026-05-01"), rec(3, country="KE")).withColumn("retrieved_date", F.lit("2026-08-30"))
    found = events.detect(df, "2026-08-31")
    feed = {r.country: (r.records, r.triggers, r.accounts) for r in events.feed(df, found).collect()}
    assert feed == {"NG": (1, 1, 1), "TZ": (1, 1, 1), "KE": (1, 0, 0)}
    accounts = events.by_account(found)
    assert [r.company for r in events.filtered(accounts, "PHARMA", ("renewal_due",)).collect()] == ["Acme Pharma Ltd"]
    assert events.filtered(accounts, "", ("first_entry",)).count() == 0


def test_expiry_field_order(spark):
    row = spark.sql("SELECT named_struct('expiry', '2027-08', 'expiry_date', '2026-01-01') AS a, named_struct('expiry', '', 'expiry_date', '2026-01-01T00') AS b, named_struct('record_id', 'x') AS c")
    got = row.select(text.expiry_of("a").alias("a"), text.expiry_of("b").alias("b"), text.expiry_of("c", ["record_id"]).alias("c")).first()
    assert (got.a, got.b, got.c) == ("2027-08", "2026-01-01", None)


def test_export_and_phrases(spark):
    changes = spark.createDataFrame([("a", f"k{i}", "appeared", None, "Active") for i in range(5)] + [("a", "k9", "status_changed", "Active", None)], "s string, record_key string, kind string, before string, after string")
    series = spark.createDataFrame([("a", "X", 2, "2026-01-01", "2026-02-01"), ("b", "Y", 1, None, "2026-02-01"), ("c", "Z", 2, "2026-01-01", "2026-02-01")], "s string, authority string, snapshots int, before_date string, after_date string")
    got = diffing.export(changes, series, ["s"], 4).collect()
    assert sorted((r.s, r.kind or "") for r in got) == [("a", "appeared")] * 4 + [("b", "")]
    assert {r.note for r in got if r.s == "b"} == {"Only one snapshot so far. Nothing to compare against yet."}
    said = spark.createDataFrame([(0,), (2,), (3,), (None,)], "n int").select(markets.reading("n").alias("r")).collect()
    assert [r.r for r in said] == ["no holder found in this source", "2 other holder(s) found", "3 other holders found", None]


def test_with_listing_and_numbering(spark):
    listing = spark.createDataFrame([(1, "A", "a 5 mg", "u1", "c/x.pdf"), (2, "B", "b 5 mg", "u2", "d/x.pdf"), (3, "C", "c", "u3", None)], "ord int, product_name string, generic_name string, document_url string, local_path string")
    docs = spark.createDataFrame([("x.pdf",), ("y.pdf",)], "local_name string")
    assert {r.local_name: r.product_name for r in registers.with_listing(docs, listing).collect()} == {"x.pdf": "B", "y.pdf": None}
    rows = spark.range(100, numPartitions=7)
    assert [r.ord for r in registers.numbered(rows).orderBy("id").collect()] == list(range(100))
    with pytest.raises(ValueError):
        registers.GreenBook().refuse_empty(rows.limit(0))


def test_portfolio(spark):
    df = records(spark, rec(1), rec(2, company="Acme Pharma", country="TZ", inn=("amoxicilin",)), rec(3, company="Rival Ltd", country="KE"), rec(4, status="Inactive", inn=("old",)))
    coverage = spark.createDataFrame([("NG", 2026), ("TZ", 2026), ("KE", 2026)], "country string, coverage_end_year int")
    cells = markets.portfolio(df, "Acme Pharma Limited", coverage)["cells"].collect()
    assert [(r.country, r.state, r.competitors) for r in cells] == [("KE", "gap", 1)]
    every = markets.portfolio(df, "Acme Pharma Limited", coverage, active_only=False)["presences"]
    assert every.select("inn").distinct().count() == 2


def test_gaps_gather_names_once_a_profile(spark):
    import random

    rng = random.Random(7)
    profiles = [((), "tablet"), (("5mg",), None), (("5mg",), "tablet"), (("5mg",), "capsule"), (("9mg",), "tablet"), (("9mg",), None)]
    rows = []
    for i in range(260):
        strength, form = rng.choice(profiles)
        rows.append(rec(i, company=f"{rng.choice(['acme', 'beta', 'core', 'dune'])} {rng.choice('abcdef')}", country=rng.choice(["NG", "TZ", "BR"]), inn=(rng.choice(["rareone", "usual", "usual"]),), strength=strength, form=form))
    rows += [rec(900, company="", inn=("usual",)), rec(901, inn=("alone",), approval="2025-01-01"), rec(902, country="XX")]
    df = records(spark, *rows)
    held = df.where("company IS NOT NULL").withColumn("presence", F.xxhash64("inn", "strength", "form")).groupBy("company", "presence", "inn", "strength", "form", "country").agg(F.min("ord").alias("ord"), F.min_by("approval_date", "ord").alias("approval_date"))
    cells = markets.gaps(held, df, spark.createDataFrame([("NG", 2026), ("TZ", 2023), ("BR", None)], "country string, coverage_end_year int"))
    data = df.collect()
    agree = lambda a, b: a.inn == b.inn and not (a.strength and b.strength and a.strength != b.strength) and not (a.form and b.form and a.form != b.form) and bool((a.strength and b.strength) or (a.form and b.form))
    products = {(r.company, tuple(r.inn), tuple(r.strength), r.form): r for r in data if r.company}
    expected = {}
    for key, r in products.items():
        present = {x.country for x in data if x.company == r.company and (x.inn, x.strength, x.form) == (r.inn, r.strength, r.form)}
        for country in {"NG", "TZ", "BR"} - present:
            names = sorted({x.company_raw for x in data if x.country == country and x.company_raw and x.company != r.company and agree(r, x)})
            late = country == "TZ" and r.approval_date > "2024"
            expected[*key, country] = (None, []) if late else (len(names), names[:4])
    found = cells.collect()
    assert len(found) == len(expected) and {(c.company, tuple(c.inn), tuple(c.strength), c.form, c.country): (c.competitors, c.examples) for c in found} == expected
    assert any(n and n > 4 for n, _ in expected.values())
    # no row for a pair of a product and a name
    assert "Join" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_products_of_a_large_company_are_found_by_their_letters():
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(3, 7))) for _ in range(150)]

    def typed(x):
        i = rng.randrange(len(x))
        return rng.choice([x, x, x, x[:i] + x[i + 1 :], x[:i] + rng.choice("xyzé") + x[i:], x[:i] + "q" + x[i + 1 :], "", "aaaaaaaa" + x])

    identities = [(sorted(typed(x) for x in rng.sample(names, rng.choice([1, 1, 2]))), rng.choice([[], ["5mg"], ["5mg", "9mg"], ["9mg"]]), rng.choice([None, "tablet", "capsule", ""])) for _ in range(2500)]
    identities = list({(tuple(a), tuple(b), c): (a, b, c) for a, b, c in identities}.values())
    heads, expected = [], []
    for one in identities:
        i = next((i for i, h in enumerate(heads) if "".join(one[0]).strip() and "".join(h[0]).strip() and _same_product(h, one)), len(heads))
        if i == len(heads):
            heads.append(one)
        expected.append(i)
    products, pairs = resolve._Products(), []
    alike = products.alike
    products.alike = lambda x, y: pairs.append((x, y)) or alike(x, y)
    assert [products.place(*one) for one in identities] == expected
    assert products.heads == heads and len(heads) > 1000
    # nearly all products are told apart by their letters, not by comparing their texts
    assert len(pairs) < 20 * len(identities)


def test_names_in_notes_are_looked_up_by_length(spark):
    import re

    names = ["zinc sulphate", "zinc sulphate mono", "zinc", "calci", "calcium carbonate", "calcium carbonate 500", "carbonate", "-calcium carb", "sul phate", "vitamin b.12/x", "a  b cde", "café au lait"]
    names += [f"zinc salt {i:03}" for i in range(300)]
    texts = ["Zinc  sulphate, zinc\nsulphate monohydrate.", "CALCIUM CARBONATE 5000 mg; x-calci", "say -calcium carbonate", "é calcium carbonaté, zinc salt 042 and zinc salt 1", "Vitamin B.12/x twice, vitamin b.12/xy", "calcium", "café au lait, a  b cdef", None]
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, "again zinc sulphate")], "note_id long, text string")
    expected = []
    for note, t in [(r.note_id, r.text) for r in notes.collect() if r.text]:
        low = t.lower()
        flat = " " + re.sub(r"[^a-z0-9./%-]", " ", low) + " "
        for n in names:
            if len(n) >= 5 and re.search("[a-z0-9]+", n)[0] in re.findall("[a-z0-9]+", low) and n in low and " " + n in flat:
                expected.append((note, n, t[low.index(n) :][: len(n)], low.index(n)))
    facts = scoping.propose(notes, spark.createDataFrame([(n,) for n in names], "ingredient string")).where("kind = 'product'")
    assert sorted((r.note_id, r.value, r.quote, r.start) for r in facts.collect()) == sorted(expected) and len(expected) > 8
    # names come to the notes by what is written there, not by their heads alone
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "shapes" in plan


def _reads(monkeypatch, query, spark, folder):
    """The tables a query reads, one entry a read."""
    from regolith.plans import register_queries as rq

    read = []
    monkeypatch.setattr(rq, "table", lambda s, d, name, f=rq.table: read.append(name) or f(s, d, name))
    return sorted(query(spark, folder).collect()), read


def test_notes_and_ingredients_are_read_once(spark, monkeypatch):
    from regolith.plans import report_queries

    rows, read = _reads(monkeypatch, report_queries.QUERIES["notes_quotable"], spark, "/root/testdata/sf0.001")
    assert rows and read.count("documents") == 1 and read.count("product_record") <= 2


def test_names_in_notes_of_one_key(spark):
    # notes of one key share their heads; a run longer than any name is no other name's head
    notes = spark.createDataFrame([(1, "zinc sulphate"), (1, "zincsulphatehydrate zinc oxide"), (None, "zinc oxide")], "note_id long, text string")
    names = spark.createDataFrame([("zinc sulphate",), ("zinc oxide",), ("zincs",)], "ingredient string")
    found = scoping.propose(notes, names).where("kind = 'product'").collect()
    assert sorted((str(r.note_id), r.value, r.start) for r in found) == [("1", "zinc oxide", 20), ("1", "zinc sulphate", 0), ("None", "zinc oxide", 0)]


def _plan(spark, df):
    """The steps of a query's plan, whole."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(2**24))
    return [line.strip(" :+-") for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n")]


def test_presences_compute_fields_once(spark):
    from regolith.plans import register_queries as rq

    folder = "/root/testdata/sf0.001"
    plan = _plan(spark, rq.product_matrix(spark, folder))
    # by identity and the matrix; no filter evaluates what ingredients and companies are made of
    assert sum(x.startswith("Aggregate") for x in plan) == 2 and not any("split(" in x for x in plan if x.startswith("Filter"))
    found = rq._dated_presences(rq.register(spark, folder)).collect()
    dates = {r.ord: r.approval_date for r in rq.table(spark, folder, "product_record").select("ord", "approval_date").collect()}
    assert found and all(r.approval_date == dates[r.ord] for r in found)
    assert len({(r.company, r.presence, r.country) for r in found}) == len(found)


def test_gaps_of_whole_products_take_dates_along(spark):
    from regolith.plans import register_queries as rq

    plan = _plan(spark, rq.product_gaps(spark, "/root/testdata/sf0.001"))
    assert sum(x.startswith("Relation") for x in plan) == 2 and not any(x.startswith("Join") for x in plan)
    # names of others are normalised once a record as well
    assert not any("split(" in x for x in plan if x.startswith("Filter"))


def test_out_of_window_does_not_meet_the_register(spark):
    from regolith.plans import register_queries as rq

    # the register is read once, and only for who holds what
    plan = _plan(spark, rq.product_out_of_window(spark, "/root/testdata/sf0.001"))
    assert sum(x.startswith("Relation") for x in plan) == 1 and sum(x.startswith("MapInArrow") for x in plan) == 1
    held = [("a", 0, "NG", "2024-05-05"), ("a", 1, "NG", "2026-01-01T00"), ("a", 1, "KE", "2025-02-02"), ("a", 2, "TZ", "2024"), ("b", 0, None, "2025-01-01"), ("b", 1, "NG", None), ("b", 2, "BR", "soon"), ("b", 3, "BR", "2026-01-01"), ("b", 3, "NG", "2000-01-01")]
    p = spark.createDataFrame([(c, i, ["x"], ["1mg"], "gel", n, k, d) for k, (c, i, n, d) in enumerate(held)], "company string, presence int, inn array<string>, strength array<string>, form string, country string, ord long, approval_date string")
    coverage = spark.createDataFrame([("NG", 2025), ("TZ", 2023), ("KE", 2024), ("BR", None), (None, 2000), ("TZ", 2024)], "country string, coverage_end_year int")
    both = lambda df: sorted((r.company, r.presence, r.country, r.held_since) for r in df.collect())
    expected = [("a", 0, "TZ", "2024-05-05"), ("a", 1, "TZ", "2025-02-02"), ("a", 1, "TZ", "2025-02-02"), ("b", 3, "KE", "2026-01-01"), ("b", 3, "TZ", "2026-01-01"), ("b", 3, "TZ", "2026-01-01")]
    found = both(markets.out_of_window(p, coverage))
    others = records(spark, rec(1))
    assert found == expected == both(markets.gaps(p, others, coverage).where("state = 'out_of_window'"))


def test_names_are_met_in_order_of_letters(spark):
    import random

    rng = random.Random(3)
    words = ["zinc", "zin", "zinc ", "oxide", "ox", " ", "-", "5"]
    text_of = lambda: rng.choice(("zinc", "zin", "ox")) + " " + "".join(rng.choice(words) for _ in range(rng.randrange(5)))
    head = lambda t: t.split(" ")[0]
    names = sorted({(head(t), t, lead + t) for t in (text_of() for _ in range(400)) for lead in ("", "-")})
    said = [(head(t), t, i % 90 or None) for i, t in enumerate(text_of() + text_of() for _ in range(300))]
    got = scoping._begun(spark.createDataFrame(names, "head string, said string, ingredient string"), spark.createDataFrame(said, "head string, said string, note_id long"), "note_id")
    # names of another head that is the same but for its end are none
    expected = [(str(k), n) for h, t, k in said for g, s, n in names if g == h and t.startswith(s)]
    assert sorted((str(r.note_id), r.ingredient) for r in got.collect()) == sorted(expected) and len(expected) > 300
    # no name is spelled out for a note in each length its head has: one join brings heads to notes, two bring texts
    notes = spark.createDataFrame([(1, "zinc oxide")], "note_id long, text string")
    plan = _plan(spark, scoping._named(notes, spark.createDataFrame([("zinc oxide",)], "ingredient string"), "note_id"))
    assert sum(x.startswith("Join") for x in plan) == 3 and sum(x.startswith("MapInArrow") for x in plan) == 1


def test_scope_lines_look_at_asked_products_only(spark):
    resolved = spark.createDataFrame([(1, "product", "zinc"), (1, "market", "NG"), (1, "service", "renewal"), (2, "product", "iron")], "note_id long, kind string, entity string")
    holders = spark.createDataFrame([("NG", "zinc", "Own Ltd", 3), ("NG", "zinc", "Other Ltd", 1), ("NG", "iron", "Third Ltd", 2), ("KE", "zinc", "Fourth Ltd", 4)], "country string, ingredient string, company_raw string, ord long")
    lines = scoping.scope_lines(resolved, holders, "Own Limited")
    assert [(r.product, r.market, r.service, r.already_held, r.holder, r.competitors) for r in lines.collect()] == [("zinc", "NG", "renewal", True, "Own Ltd", 1)]
    assert any(x.startswith("Join LeftSemi") for x in _plan(spark, lines))


def test_scope_gaps_read_each_table_once(spark, monkeypatch):
    from regolith.plans import register_queries as rq

    rows, read = _reads(monkeypatch, rq.QUERIES["scope_gaps"], spark, "/root/testdata/sf0.001")
    assert rows and read.count("documents") == 1 and read.count("product_record") <= 2
