"""Problem 3: what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators.snapdiff import snapshot_changes
from regolith.session import table


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with the values before and after."""
    return snapshot_changes(table(spark, sf_dir, "register_snapshot"), table(spark, sf_dir, "snapshot_row"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between consecutive complete snapshots of each series."""
    return p3_changes(spark, sf_dir).select("snapshot_id", "record_key", "kind")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by snapshot and kind."""
    return p3_found(spark, sf_dir).groupBy("snapshot_id", "kind").agg(F.count("*").alias("n"))


QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p3_counts": p3_counts}

_BASE = """
WITH k AS (
  SELECT snapshot_id, row_no,
    COALESCE(source_id || ':id:' || NULLIF(record_id, ''), source_id || ':reg:' || NULLIF(registration_number, ''),
             source_id || ':proc:' || NULLIF(process_number, ''), source_id || ':doc:' || NULLIF(document_url, '')) AS record_key,
    lower(trim(COALESCE(status, ''))) AS status, substr(COALESCE(expiry_date, ''), 1, 10) AS expiry
  FROM snapshot_row),
d AS (SELECT snapshot_id, record_key, arg_max(status, row_no) AS status, arg_max(expiry, row_no) AS expiry
      FROM k WHERE record_key IS NOT NULL GROUP BY 1, 2),
held AS (SELECT snapshot_id, count(DISTINCT record_key) + count(*) FILTER (WHERE record_key IS NULL) AS held FROM k GROUP BY 1),
c AS (SELECT s.* FROM register_snapshot s LEFT JOIN held h USING (snapshot_id)
      WHERE COALESCE(h.held, 0) >= COALESCE(s.record_count, 0)),
p AS (SELECT lag(snapshot_id) OVER (PARTITION BY source_id, section_no ORDER BY retrieved_at, snapshot_id) AS b, snapshot_id AS a FROM c),
pp AS (SELECT * FROM p WHERE b IS NOT NULL),
o AS (SELECT a, record_key, status, expiry FROM pp JOIN d ON d.snapshot_id = b),
n AS (SELECT a, record_key, status, expiry FROM pp JOIN d ON d.snapshot_id = a),
j AS (SELECT COALESCE(o.a, n.a) AS snapshot_id, COALESCE(o.record_key, n.record_key) AS record_key,
        o.status AS s0, n.status AS s1, o.expiry AS e0, n.expiry AS e1
      FROM o FULL JOIN n ON o.a = n.a AND o.record_key = n.record_key),
ch AS (
  SELECT snapshot_id, record_key, 'appeared' AS kind, s0 AS value_before, s1 AS value_after FROM j WHERE s0 IS NULL
  UNION ALL SELECT snapshot_id, record_key, 'disappeared', s0, s1 FROM j WHERE s1 IS NULL
  UNION ALL SELECT snapshot_id, record_key, 'status_changed', s0, s1 FROM j WHERE s0 <> s1
  UNION ALL SELECT snapshot_id, record_key, 'expiry_changed', e0, e1 FROM j WHERE e0 <> '' AND e1 <> '' AND e0 <> e1)
"""

SQL = {
    "p3_found": _BASE + "SELECT snapshot_id, record_key, kind FROM ch",
    "p3_changes": _BASE + "SELECT snapshot_id, record_key, kind, value_before, value_after FROM ch",
    "p3_counts": _BASE + "SELECT snapshot_id, kind, count(*) AS n FROM ch GROUP BY 1, 2",
}
