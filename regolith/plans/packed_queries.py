"""Problem 1: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators.packed import split_packed
from regolith.session import table


def known_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and aliases of the fixed reference list, as (field_name, term)."""
    ref = table(spark, sf_dir, "ref_term")
    return ref.select("field_name", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("term"))).alias("term")).where(F.col("term").isNotNull())


def p1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every packed field with its place."""
    items = split_packed(table(spark, sf_dir, "product_record"), known=known_terms(spark, sf_dir))
    return items.where("n_items >= 2").select("ord", "field_name", "item_pos", "item")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold two or more values, one row per value."""
    return p1_items(spark, sf_dir).select("ord", "field_name", "item_pos").distinct()


QUERIES = {"p1_found": p1_found, "p1_items": p1_items}
