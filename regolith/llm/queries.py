"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm import abuse, canonical, leakage, linkage, mojibake, names, packing
from regolith.session import table


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values decoded with a wrong encoding, as they stand and as first entered."""
    return mojibake.restore_text(table(spark, sf_dir, "product_record"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in which a character is not the one first entered."""
    return p2_restored(spark, sf_dir).select("ord", "field_name").distinct()


def p4_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value with its entry, its score and whether it is a term as it stands."""
    return canonical.map_values(table(spark, sf_dir, "product_record"), table(spark, sf_dir, "ref_term"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are not terms, with the entry they mean or 0."""
    return p4_mapped(spark, sf_dir).where(~F.col("is_term")).select("ord", "field_name", "term_id").distinct()


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the cluster of its company."""
    return names.link_names(table(spark, sf_dir, "company_spelling"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one company."""
    return names.name_pairs(p5_clusters(spark, sf_dir)).distinct()


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored, "p4_found": p4_found, "p4_mapped": p4_mapped, "p5_found": p5_found, "p5_clusters": p5_clusters}
SQL: dict[str, str] = {}


def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records and listings of one product, each with a confidence."""
    return linkage.link_products(table(spark, sf_dir, "product_record"), table(spark, sf_dir, "listing_extract"), table(spark, sf_dir, "ref_term"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records and listings of one product."""
    return p6_linked(spark, sf_dir).select("ord", "listing_id").distinct()


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers, by run."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_run"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each run are."""
    return packing.fill_rates(p7_packing(spark, sf_dir), table(spark, sf_dir, "packing_run"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give evaluation items away, with the share and place of what leaked."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they give away."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked spans."""
    return leakage.remove_leaks(table(spark, sf_dir, "documents"), p8_leaks(spark, sf_dir))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return abuse.score_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or explicit passage."""
    return p9_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of such documents by source."""
    return abuse.source_rates(p9_scores(spark, sf_dir))


QUERIES |= {"p6_found": p6_found, "p6_linked": p6_linked, "p7_packing": p7_packing, "p7_fill": p7_fill, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_clean": p8_clean, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
