"""Register sources: each reads its own raw shape and maps it to the canonical record."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regolith.functions import text

#: The canonical record's columns, in order.
RECORD = ["ord", "source_id", "country", "product_name", "inn", "strength", "form", "route", "atc", "company_raw", "company", "registration_number", "approval_date", "status", "category", "source_ref", "extras"]
EXTRAS = ["expiry", "expiry_date", "record_id", "cnpj", "expiry_raw", "regulatory_category", "therapeutic_class", "process_number", "generic_name", "document_url"]

NG_SCHEMA = "product_id string, product_name string, ingredient_name string, strength string, form_name string, route_name string, atc string, applicant_name string, applicant struct<name:string>, category_name string, product_category struct<name:string>, NAFDAC string, approval_date string, expiry_date string, status string"
TZ_SCHEMA = "product_name string, generic_name string, document_url string, local_path string"
BR_COLUMNS = "CATEGORIA_REGULATORIA EMPRESA_DETENTORA_REGISTRO DATA_VENCIMENTO_REGISTRO NOME_PRODUTO PRINCIPIO_ATIVO NUMERO_REGISTRO_PRODUTO DATA_FINALIZACAO_PROCESSO SITUACAO_REGISTRO CLASSE_TERAPEUTICA NUMERO_PROCESSO".split()
# The regulatory categories of conventional medicines.
BR_CONVENTIONAL = ["Genérico", "Similar", "Novo", "Biológico", "Específico"]


def extras(**fields: Column) -> Column:
    """The struct of a source's further fields; those it lacks are null."""
    return F.struct(*[fields.get(k, F.lit(None)).cast("string").alias(k) for k in EXTRAS])


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of JSON array files with their place: (path, ord, row)."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return whole.select("path", F.posexplode(F.from_json("value", f"array<struct<{_as_struct(schema)}>>")).alias("ord", "row"))


def _as_struct(schema: str) -> str:
    depth, out, start = 0, [], 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = schema[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


def first_per_key(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key in file order, as paged feeds repeat rows; rows without key are all kept."""
    seen = F.row_number().over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", F.when(F.col(key).isNotNull(), seen).otherwise(1)).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, name: str = "ord") -> DataFrame:
    """The rows with their place in file order, from 0: each partition's rows are counted first, so none goes through one task."""
    at = rows.withColumn("_id", F.monotonically_increasing_id())
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.p: r.n for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one number a partition
    start, before = {}, 0
    for p in sorted(sizes):
        start[p] = before
        before += sizes[p]
    if not start:
        return rows.withColumn(name, F.lit(0).cast("long"))
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in start.items() for x in pair])
    return at.withColumn(name, F.element_at(offsets, part) + within).drop("_id")


class RegisterSource(ABC):
    """One register: how it is read, mapped and described. A new market is one such class."""

    source_id: str
    country: str
    authority: str
    limitation: str = ""

    @abstractmethod
    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Raw rows with ``ord`` and ``ref``."""

    @abstractmethod
    def to_records(self, rows: DataFrame) -> DataFrame:
        """Canonical records."""

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        """Records of the snapshot at a path; an empty retrieval is refused."""
        return self.to_records(self.refuse_empty(self.read(spark, path)))

    def refuse_empty(self, rows: DataFrame) -> DataFrame:
        """The rows, or an error where there are none."""
        if rows.isEmpty():
            raise ValueError(f"{self.source_id}: an empty retrieval is not stored")
        return rows

    def coverage(self, records: DataFrame, retrieved: str) -> DataFrame:
        """What the source held: (source_id, country, authority, record_count, with_expiry, coverage_end_year, retrieved_date, limitation)."""
        counted = self.counted(records)
        return counted.agg(F.count("*").alias("record_count"), F.count_if(F.coalesce(F.col("extras.expiry"), F.col("extras.expiry_date")).isNotNull()).alias("with_expiry"), F.max(text.year_of("approval_date")).alias("coverage_end_year")).select(
            F.lit(self.source_id).alias("source_id"), F.lit(self.country).alias("country"), F.lit(self.authority).alias("authority"), "record_count", "with_expiry", "coverage_end_year", F.lit(retrieved).alias("retrieved_date"), F.lit(self.limitation).alias("limitation")
        )

    def counted(self, records: DataFrame) -> DataFrame:
        """The records a source's coverage counts."""
        return records


class GreenBook(RegisterSource):
    """Nigeria: JSON rows with dedicated fields."""

    source_id, country, authority, limitation = "nafdac_greenbook", "NG", "NAFDAC Greenbook", "Full published register"

    def read(self, spark, path):
        rows = read_json_rows(spark, path, NG_SCHEMA)
        return first_per_key(rows.select("ord", F.col("path").alias("ref"), "row.*"), "product_id")

    def to_records(self, rows):
        falsy = lambda a, b: F.coalesce(text.filled(a), F.col(b))
        applicant, category = falsy("applicant_name", "applicant.name"), falsy("category_name", "product_category.name")
        name = F.trim(F.regexp_replace(F.coalesce("product_name", F.lit("")), "[#*]", ""))
        rows = rows.withColumns({"ingredient_name": text.unescape_html("ingredient_name"), "_applicant": applicant})
        return rows.select(
            "ord", F.lit(self.source_id).alias("source_id"), F.lit(self.country).alias("country"), name.alias("product_name"), text.normalize_inn("ingredient_name").alias("inn"), text.normalize_strength("strength").alias("strength"),
            text.normalize_form("form_name").alias("form"), text.normalize_route("route_name").alias("route"), text.clean("atc").alias("atc"), F.col("_applicant").alias("company_raw"), text.company_key("_applicant").alias("company"),
            text.identifier("NAFDAC").alias("registration_number"), "approval_date", "status", category.alias("category"), F.concat("ref", F.lit("#product_id="), F.coalesce("product_id", F.lit("None"))).alias("source_ref"),
            extras(expiry_date=F.col("expiry_date"), record_id=F.col("product_id")).alias("extras"),
        )


class OpenData(RegisterSource):
    """Brazil: a semicolon CSV in Latin-1 of all categories, of which conventional medicines are kept."""

    source_id, country, authority, limitation = "anvisa_medicamentos", "BR", "ANVISA open data", "Strength, form and route are not published"

    def read(self, spark, path):
        raw = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1", multiLine=True, escape='"', inferSchema=False)
        trimmed = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns if c and not c.startswith("_c")])
        missing = [F.lit(None).cast("string").alias(c) for c in BR_COLUMNS if c not in trimmed.columns]
        return numbered(trimmed.select("*", *missing)).withColumn("ref", F.lit(path))

    def to_records(self, rows):
        kept = rows.where(F.col("CATEGORIA_REGULATORIA").isin(BR_CONVENTIONAL)).withColumn("h", text.split_holder("EMPRESA_DETENTORA_REGISTRO"))
        empty = F.array().cast("array<string>")
        return kept.select(
            "ord", F.lit(self.source_id).alias("source_id"), F.lit(self.country).alias("country"), F.coalesce("NOME_PRODUTO", F.lit("")).alias("product_name"), text.normalize_inn("PRINCIPIO_ATIVO").alias("inn"), empty.alias("strength"), F.lit(None).cast("string").alias("form"), empty.alias("route"),
            F.lit(None).cast("string").alias("atc"), F.col("h.name").alias("company_raw"), text.company_key("h.name").alias("company"), text.identifier("NUMERO_REGISTRO_PRODUTO").alias("registration_number"), text.br_date("DATA_FINALIZACAO_PROCESSO").alias("approval_date"),
            F.when(F.col("SITUACAO_REGISTRO") == "Ativo", "Active").otherwise("Inactive").alias("status"), F.lit("Drugs").alias("category"), F.concat("ref", F.lit("#row="), F.col("ord")).alias("source_ref"),
            extras(expiry=text.parse_expiry("DATA_VENCIMENTO_REGISTRO"), expiry_raw=F.col("DATA_VENCIMENTO_REGISTRO"), cnpj=F.col("h.cnpj"), regulatory_category=F.col("CATEGORIA_REGULATORIA"), therapeutic_class=F.col("CLASSE_TERAPEUTICA"), process_number=F.col("NUMERO_PROCESSO")).alias("extras"),
        )

    def counted(self, records):
        return records.where(text.is_active("status"))


class ListingPage(RegisterSource):
    """Tanzania: an HTML table of products with linked documents; the holder comes from the documents."""

    source_id, country, authority, limitation = "tmda_approved_products", "TZ", "TMDA", "Published SmPC subset, not the full register"

    def read(self, spark, path):
        return parse_listing(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("ref")))

    def to_records(self, rows):
        """``rows`` may carry holder and registration_number, joined from the documents by ``attach_holders``."""
        have = set(rows.columns)
        holder = F.col("holder") if "holder" in have else F.lit(None).cast("string")
        number = F.col("registration_number") if "registration_number" in have else F.lit(None).cast("string")
        p = text.parse_generic_name("generic_name")
        rows = rows.withColumns({"_p": p, "_h": holder, "_r": number})
        return rows.select(
            "ord", F.lit(self.source_id).alias("source_id"), F.lit(self.country).alias("country"), F.trim(F.coalesce("product_name", F.lit(""))).alias("product_name"), F.col("_p.inn").alias("inn"), F.col("_p.strength").alias("strength"), F.col("_p.form").alias("form"), F.array().cast("array<string>").alias("route"),
            F.lit(None).cast("string").alias("atc"), F.col("_h").alias("company_raw"), text.company_key("_h").alias("company"), text.identifier("_r").alias("registration_number"), F.lit(None).cast("string").alias("approval_date"), F.lit("Active").alias("status"), F.lit(None).cast("string").alias("category"),
            F.col("ref").alias("source_ref"), extras(generic_name=F.col("generic_name"), document_url=F.col("document_url")).alias("extras"),
        )

    def counted(self, records):
        return records.where(F.col("company_raw").isNotNull())


def parse_listing(pages: DataFrame) -> DataFrame:
    """(ref, ord, product_name, generic_name, document_url, local_name) of the table rows in (value, ref) pages.

    Rows of under three cells, headings and nameless rows are left out; of rows with one document the first holds.
    """
    cell = lambda c: F.trim(F.regexp_replace(text.unescape_xml(F.regexp_replace(c, r"(?s)<[^>]+>", " ")), r"(?U)\s+", " "))
    rows = pages.select("ref", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("ord", "tr"))
    cells = rows.withColumn("td", F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).where(F.size("td") >= 3)
    url = text.filled(F.regexp_extract("tr", r"""(?i)href\s*=\s*["']([^"']+\.pdf[^"']*)["']""", 1))
    named = cells.select("ref", "ord", cell(F.col("td")[1]).alias("product_name"), cell(F.col("td")[2]).alias("generic_name"), url.alias("document_url"), F.lower(cell(F.col("td")[0])).alias("first"))
    named = named.where((F.col("product_name") != "") & (F.lower("product_name") != "product name") & (F.col("first") != "sn"))
    return first_per_key(named, "document_url").select("ref", "ord", "product_name", "generic_name", "document_url", text.basename("document_url").alias("local_name"))


def attach_holders(listing: DataFrame, extractions: DataFrame) -> DataFrame:
    """Listing rows with the holder found in their document: equi-join on the file's name, the last extraction of a file holds."""
    last = extractions.withColumn("local_name", text.basename("local_path")).groupBy("local_name").agg(F.max_by(F.struct("holder", "registration_number"), "ord").alias("x")).select("local_name", "x.*")
    return listing.join(last, "local_name").where(F.col("holder").isNotNull())


def watch_records(listing: DataFrame) -> DataFrame:
    """Listing rows as records for comparison over time: no holder, keyed by document."""
    return ListingPage().to_records(listing)


def union_records(*sources: DataFrame) -> DataFrame:
    """All sources' records with one order: source by source, in file order."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(*RECORD).withColumn("ord", F.lit(i * 10**12) + F.col("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def with_listing(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents (local_name, …) left-joined to the listing row of their file, the last row of a file holding; documents without one are kept."""
    last = listing.withColumn("local_name", text.basename("local_path")).where(F.col("local_name").isNotNull()).groupBy("local_name")
    rows = last.agg(F.max_by(F.struct("product_name", "generic_name", "document_url"), "ord").alias("l")).select("local_name", "l.*")
    return documents.join(rows, "local_name", "left")


def registry(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """(source_id, country, authority, kind): the sources a deployment knows, registers and others, as configured."""
    return spark.createDataFrame(entries, "source_id string, country string, authority string, kind string")
