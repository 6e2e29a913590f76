"""What changed between full snapshots: Merkle-tree comparison of hashed key ranges.

Every record of a snapshot falls, by a hash of its key, into one of 2^(4*depth) leaf ranges. A leaf's digest is the
order-free sum of its records' hashes, an inner node's the sum over its children. Consecutive complete snapshots are
compared from the root down: only children of differing nodes are looked at, and rows are compared only inside leaf
ranges whose digests differ. Everything is joins and aggregates with map-side combine; nothing is collected.

Defined results: rows without any key are not compared but count for completeness; of several rows of one key in one
snapshot the highest row_no holds; an incomplete snapshot is passed over; a series with fewer than two complete
snapshots gives no rows; null status equals empty; an expiry date missing on either side is no change; a null
record_count (or one below the rows held) never makes a snapshot incomplete; rows of unlisted snapshots are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FANOUT_BITS = 4
#: Rows of a snapshot in a leaf range.
LEAF_ROWS = 32


def filled(name: str) -> Column:
    """The column, with the empty string as null."""
    return F.nullif(F.col(name), F.lit(""))


def record_key() -> Column:
    """``source:id:…``, else ``source:reg:…``, else ``source:proc:…``, else ``source:doc:…``; null where none is filled."""
    parts = [("id", "record_id"), ("reg", "registration_number"), ("proc", "process_number"), ("doc", "document_url")]
    return F.coalesce(*[F.concat(F.col("source_id"), F.lit(f":{tag}:"), filled(c)) for tag, c in parts])


def keyed_rows(rows: DataFrame) -> DataFrame:
    """(snapshot_id, record_key, status, expiry): one row per key and snapshot, the highest row_no; keyless rows kept one by one under a null key."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    expiry = F.substring(F.coalesce("expiry_date", F.lit("")), 1, 10)
    flat = rows.select("snapshot_id", record_key().alias("record_key"), F.struct(F.col("row_no").alias("row_no"), status.alias("status"), expiry.alias("expiry")).alias("v"))
    return flat.where(F.col("record_key").isNotNull()).groupBy("snapshot_id", "record_key").agg(F.max("v").alias("v")).select("snapshot_id", "record_key", "v.status", "v.expiry")


def snapshot_pairs(manifest: DataFrame, rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """(before_id, after_id) of each series' consecutive complete snapshots."""
    keyless = rows.where(record_key().isNull()).groupBy("snapshot_id").agg(F.count("*").alias("n"))
    held = keyed.groupBy("snapshot_id").agg(F.count("*").alias("n")).unionByName(keyless).groupBy("snapshot_id").agg(F.sum("n").alias("held"))
    series = W.partitionBy("source_id", "section_no").orderBy("retrieved_at", "snapshot_id")
    complete = (
        manifest.select("snapshot_id", "source_id", "section_no", "retrieved_at", "record_count")
        .dropDuplicates(["snapshot_id"])
        .join(held, "snapshot_id", "left")
        .where(F.coalesce("held", F.lit(0)) >= F.coalesce("record_count", F.lit(0)))
    )
    return complete.select(F.lag("snapshot_id").over(series).alias("before_id"), F.col("snapshot_id").alias("after_id")).where(F.col("before_id").isNotNull())


def _digests(leaves: DataFrame, level: int, depth: int) -> DataFrame:
    """Digests of the nodes of one level (0 is the root): sums of the leaves' order-free sums."""
    node = F.shiftright("leaf", FANOUT_BITS * (depth - level))
    return leaves.groupBy("snapshot_id", node.alias("node")).agg(F.sum("n").alias("n"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))


def _differing(pairs: DataFrame, digests: DataFrame, parents: DataFrame | None) -> DataFrame:
    """(before_id, after_id, node) whose digests differ, among children of ``parents``."""
    wanted = pairs if parents is None else parents.select("before_id", "after_id", F.explode(F.sequence(F.shiftleft("node", FANOUT_BITS), F.shiftleft("node", FANOUT_BITS) + F.lit((1 << FANOUT_BITS) - 1))).alias("node"))
    if parents is None:
        wanted = pairs.withColumn("node", F.lit(0).cast("long"))
    side = lambda s: digests.select(F.col("snapshot_id").alias(f"{s}_id"), "node", F.struct("n", "lo", "hi").alias(f"{s}_digest"))
    both = wanted.join(side("before"), ["before_id", "node"], "left").join(side("after"), ["after_id", "node"], "left")
    return both.where(~F.col("before_digest").eqNullSafe(F.col("after_digest"))).select("before_id", "after_id", "node")


def tree_depth(rows: DataFrame) -> int:
    """Levels of sixteen children that leave about ``LEAF_ROWS`` rows of the largest snapshot in a leaf range, one at least."""
    most = rows.groupBy("snapshot_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = 1
    while most > LEAF_ROWS << (FANOUT_BITS * depth):
        depth += 1
    return depth


def snapshot_changes(manifest: DataFrame, rows: DataFrame, depth: int | None = None) -> DataFrame:
    """Change rows (snapshot_id, record_key, kind, value_before, value_after) of every pair of consecutive complete snapshots.

    ``depth`` levels of sixteen children each, by default as many as the largest snapshot needs: a tree with more leaves than
    rows would cost more than the comparison it saves.
    """
    depth = tree_depth(rows) if depth is None else depth
    keyed = keyed_rows(rows)
    pairs = snapshot_pairs(manifest, rows, keyed)
    top = (1 << (FANOUT_BITS * depth)) - 1
    placed = keyed.withColumn("leaf", F.xxhash64("record_key").bitwiseAND(F.lit(top)))
    content = F.xxhash64("record_key", "status", "expiry")
    leaves = placed.groupBy("snapshot_id", "leaf").agg(
        F.count("*").alias("n"),
        F.sum(content.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
        F.sum(F.shiftrightunsigned(content, 32)).alias("hi"),
    )
    open_nodes = None
    for level in range(depth + 1):
        open_nodes = _differing(pairs, _digests(leaves, level, depth), open_nodes)
    side = lambda s: placed.select(F.col("snapshot_id").alias(f"{s}_id"), F.col("leaf").alias("node"), "record_key", F.lit(s == "before").alias("old"), "status", "expiry")
    inside = side("before").join(open_nodes, ["before_id", "node"]).select("after_id", "record_key", "old", "status", "expiry")
    inside = inside.unionByName(side("after").join(open_nodes, ["after_id", "node"]).select("after_id", "record_key", "old", "status", "expiry"))
    value = lambda old, c: F.max(F.when(F.col("old") == F.lit(old), F.col(c)))
    both = inside.groupBy("after_id", "record_key").agg(value(True, "status").alias("s0"), value(False, "status").alias("s1"), value(True, "expiry").alias("e0"), value(False, "expiry").alias("e1"))
    change = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("value_before"), F.col(b).alias("value_after"))
    kept = F.col("s0").isNotNull() & F.col("s1").isNotNull()
    kinds = F.filter(
        F.array(
            F.when(F.col("s0").isNull(), change("appeared", "s0", "s1")),
            F.when(F.col("s1").isNull(), change("disappeared", "s0", "s1")),
            F.when(kept & (F.col("s0") != F.col("s1")), change("status_changed", "s0", "s1")),
            F.when(kept & (F.col("e0") != "") & (F.col("e1") != "") & (F.col("e0") != F.col("e1")), change("expiry_changed", "e0", "e1")),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select(F.col("after_id").alias("snapshot_id"), "record_key", F.inline(kinds))
