"""Comparison of two snapshots by full outer join, with a guard against incomplete retrievals, and the watch over a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MOST_SHRINK = 0.20


def latest(manifest: DataFrame, keep: int = 2, by: tuple[str, ...] = ("source_id",), order: str = "ord") -> DataFrame:
    """The last snapshots of each source in file order, numbered from 1 for the latest."""
    return manifest.withColumn("recency", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("recency") <= keep)


def last_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, keyless rows dropped."""
    values = [c for c in rows.columns if c not in key]
    return rows.where(F.col(key[-1]).isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*values), F.col(order)).alias("v")).select(*key, "v.*")


def guarded_diff(before: DataFrame, after: DataFrame, pair: list[str], most: float = MOST_SHRINK) -> tuple[DataFrame, DataFrame]:
    """(changes, statistics) of snapshot pairs.

    Both sides are (pair…, record_key, ord, status, expiry). Statistics are one row per pair: distinct keys, keyless rows,
    compared keys, shrink and whether disappearances are reported; they are suppressed where keys shrank by more than ``most``.
    """
    old, new = last_by_key(before, [*pair, "record_key"], "ord"), last_by_key(after, [*pair, "record_key"], "ord")
    o = old.select(*pair, "record_key", F.col("status").alias("s0"), F.col("expiry").alias("e0"), F.lit(True).alias("in0"))
    n = new.select(*pair, "record_key", F.col("status").alias("s1"), F.col("expiry").alias("e1"), F.lit(True).alias("in1"))
    both = o.join(n, [*pair, "record_key"], "full_outer").withColumns({"in0": F.coalesce("in0", F.lit(False)), "in1": F.coalesce("in1", F.lit(False))})
    stats = both.groupBy(*pair).agg(F.count_if("in0").alias("keys_before"), F.count_if("in1").alias("keys_after"), F.count("*").alias("compared"))
    keyless = lambda side, name: side.where(F.col("record_key").isNull()).groupBy(*pair).agg(F.count("*").alias(name))
    stats = stats.join(keyless(before, "unkeyed_before"), pair, "left").join(keyless(after, "unkeyed_after"), pair, "left").na.fill(0, ["unkeyed_before", "unkeyed_after"])
    shrink = F.when(F.col("keys_before") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col("keys_before") - F.col("keys_after")) / F.col("keys_before")))
    stats = stats.withColumn("shrink", shrink).withColumn("reported", F.col("shrink") <= most)
    kept, full = F.col("in0") & F.col("in1"), lambda c: F.coalesce(c, F.lit(""))
    change = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("before"), F.col(b).alias("after"))
    kinds = F.array(
        F.when(~F.col("in0"), change("appeared", "s0", "s1")),
        F.when(kept & (full("s0") != full("s1")), change("status_changed", "s0", "s1")),
        F.when(kept & (full("e0") != "") & (full("e1") != "") & (F.col("e0") != F.col("e1")), change("expiry_changed", "e0", "e1")),
        F.when(~F.col("in1") & F.col("reported"), change("disappeared", "s0", "s1")),
    )
    changes = both.join(stats.select(*pair, "reported"), pair).select(*pair, "record_key", F.inline(F.filter(kinds, lambda x: x.isNotNull())))
    return changes, stats


def by_kind(changes: DataFrame, pair: list[str]) -> DataFrame:
    """Changes by pair and kind."""
    return changes.groupBy(*pair, "kind").agg(F.count("*").alias("n"))


def export(changes: DataFrame, series: DataFrame, pair: list[str], most: int = 300) -> DataFrame:
    """(pair…, has_history, kind, record_key, before, after, evidence, note): the first ``most`` changes of each series, and a row for each that has but one snapshot.

    ``series`` is (pair…, authority, snapshots, before_date, after_date), one row each.
    """
    shown = changes.withColumn("_n", F.row_number().over(W.partitionBy(*pair).orderBy("kind", "record_key"))).where(F.col("_n") <= most).drop("_n")
    old, new, where = F.col("before_date"), F.col("after_date"), F.col("authority")
    said = lambda c: F.coalesce(F.col(c), F.lit("None"))
    evidence = (
        F.when(F.col("kind") == "appeared", F.concat(F.lit("not present in the "), where, F.lit(" snapshot of "), old, F.lit("; present in "), new))
        .when(F.col("kind") == "disappeared", F.concat(F.lit("present in the "), where, F.lit(" snapshot of "), old, F.lit("; not found in "), new))
        .when(F.col("kind").isNotNull(), F.concat(F.regexp_replace("kind", "_changed", ""), F.lit(" recorded as "), said("before"), F.lit(" in the "), where, F.lit(" snapshot of "), old, F.lit(" and "), said("after"), F.lit(" in "), new))
    )
    joined = series.join(shown, pair, "left").where((F.col("snapshots") < 2) | F.col("kind").isNotNull())
    note = F.when(F.col("snapshots") < 2, F.lit("Only one snapshot so far. Nothing to compare against yet."))
    return joined.select(*pair, (F.col("snapshots") >= 2).alias("has_history"), "kind", "record_key", "before", "after", evidence.alias("evidence"), note.alias("note"))
