"""The snapshot store: hashed files, an append-only manifest, and their verification."""

from __future__ import annotations

import json
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MANIFEST = "source_id string, url string, retrieved_at string, sha256 string, record_count long, path string, note string"


def write_snapshot(records: list[dict], folder: str, source_id: str, url: str, retrieved_at: str, note: str | None = None) -> dict:
    """Stores fetched rows as canonical JSON named by date and hash, and appends a manifest line; what a fetch holds is in hand already."""
    body = json.dumps(records, sort_keys=True, indent=2, ensure_ascii=False).encode()
    digest = sha256(body).hexdigest()
    path = Path(folder) / source_id / f"{retrieved_at[:10]}_{digest[:12]}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    line = {"source_id": source_id, "url": url, "retrieved_at": retrieved_at, "sha256": digest, "record_count": len(records), "path": str(path), "note": note}
    with (Path(folder) / "manifest.jsonl").open("a") as f:
        f.write(json.dumps(line) + "\n")
    return line


def write_partitioned(records: DataFrame, folder: str, retrieved_date: str) -> None:
    """Stores a distributed snapshot as Parquet by source and date, with a content hash for each row."""
    plain = [F.coalesce(F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string"), F.lit("\u0000")) for c, t in records.dtypes]
    records.withColumn("row_hash", F.sha2(F.concat_ws("\u0001", *plain), 256)).withColumn("retrieved_date", F.lit(retrieved_date)).write.mode("append").partitionBy("source_id", "retrieved_date").parquet(folder)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines with their place in the file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("ord", "line"))
    return lines.select("ord", F.from_json("line", MANIFEST).alias("m")).select("ord", "m.*").withColumn("retrieved_date", F.substring("retrieved_at", 1, 10))


def latest_snapshot(manifest: DataFrame) -> DataFrame:
    """The last line of each source, in file order."""
    return manifest.withColumn("_n", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("ord")))).where("_n = 1").drop("_n")


def verify(manifest: DataFrame) -> DataFrame:
    """(path, exists, intact): each stored file hashed again by the executors; a missing file is not intact."""
    spark = manifest.sparkSession
    paths = [r.path for r in manifest.select("path").where(F.col("path").isNotNull()).distinct().toLocalIterator()]
    there = [p for p in paths if Path(p).exists()]
    name = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    if there:
        files = spark.read.format("binaryFile").load(there).select(name(F.col("path")).alias("path"), F.sha2("content", 256).alias("now"))
    else:
        files = spark.createDataFrame([], "path string, now string")
    return manifest.select(name(F.col("path")).alias("path"), "sha256").join(files, "path", "left").select("path", F.col("now").isNotNull().alias("exists"), F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)).alias("intact"))
