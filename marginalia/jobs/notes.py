"""A folder of notes as a table that follows its files.

A scan looks at sizes and times first, and reads only files that are new or look different; of those, only the
ones with another hash have changed.  A file that can't be read is a row with a reason, and no other file
suffers; what was known of it before stays.

Sections lie in buckets by the hash of their path.  A scan writes the buckets of changed and removed files anew,
beside the old ones; a generation lists which version of each bucket holds, and counts once that list is written.
So a scan that fails leaves the generation before in place, and a reader never sees half of one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import vault
from marginalia.sources.store import discard, materialised

BUCKETS = 64
#: Changed files up to which they are read by name; beyond it, the folder is read and the others are left out.
BY_NAME = 10_000
FILES = "path string, length long, modified timestamp, content_hash string, failed string"


@dataclass(frozen=True)
class Notes:
    spark: SparkSession
    folder: str
    generation: int

    @property
    def files(self) -> DataFrame:
        """(path, length, modified, content_hash, failed): the files as they were at the last look."""
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/files/generation={self.generation}")

    @property
    def versions(self) -> DataFrame:
        """(bucket, version) of the sections that count."""
        return self.spark.read.schema("bucket int, version string").parquet(f"{self.folder}/buckets/generation={self.generation}")

    @property
    def sections(self) -> DataFrame:
        schema = f"{vault.SECTIONS}, version string, bucket int"
        places = [f"{self.folder}/sections/version={r.version}/bucket={r.bucket}" for r in self.versions.collect()]  # BUCKETS at most
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/sections").parquet(*places) if places else self.spark.createDataFrame([], schema)
        return rows.drop("version", "bucket")


def _bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def latest(spark: SparkSession, folder: str) -> Notes | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/buckets")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    done = [str(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = [int(n.split("=")[1]) for n in done if n.startswith("generation=")]
    return Notes(spark, folder, max(numbers)) if numbers else None


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(file, path, length, modified) of the Markdown files below a root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return files.select(F.col("path").alias("file"), vault.below(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _read(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, content, content_hash, failed) of wanted files (file, path)."""
    named = [r.file for r in wanted.select("file").limit(BY_NAME + 1).collect()]
    source = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    if len(named) <= BY_NAME:
        files = source.load(named)
    else:
        files = source.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).join(wanted.select(F.col("file").alias("path")), "path", "left_semi")
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    return files.select(vault.below(F.col("path"), root).alias("path"), F.when(good, text).alias("content"), F.sha2("content", 256).alias("content_hash"), F.when(~good, "it is no UTF-8").alias("failed"))


def scan(spark: SparkSession, root: str, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[Notes, DataFrame]:
    """(the notes after a scan, one row (indexed, unchanged, removed, failed)): what the files below a root are now, against the last scan.

    A failed file counts again at each scan until it can be read; it keeps the sections it had.
    """
    before = latest(spark, folder)
    known = before.files if before else spark.createDataFrame([], FILES)
    listed = vault.accepted(_listed(spark, root), include or [], exclude or [])
    was = known.select("path", *[F.col(c).alias(f"was_{c}") for c in ("length", "modified", "content_hash", "failed")])
    both = listed.join(was, "path", "full")
    same = F.col("was_failed").isNull() & (F.col("length") == F.col("was_length")) & (F.col("modified") == F.col("was_modified"))
    gate = F.when(F.col("file").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("look")
    gated = materialised(both.withColumn("gate", gate), "gated")
    looked = materialised(_read(spark, root, gated.filter("gate = 'look'")), "looked")
    rows = gated.join(looked.drop("content"), "path", "left")
    gone = F.col("content_hash").isNull()  # it went away between the listing and the reading
    equal = F.col("content_hash") == F.col("was_content_hash")
    state = F.when(F.col("gate") != "look", F.col("gate")).when(gone | F.col("failed").isNotNull(), "failed").when(F.coalesce(equal, F.lit(False)), "unchanged").otherwise("indexed")
    rows = materialised(rows.withColumn("failed", F.when((F.col("gate") == "look") & gone, "it is gone").otherwise(F.col("failed"))).withColumn("state", state), "states")
    states = ["indexed", "unchanged", "removed", "failed"]
    summary = rows.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    number, version = (before.generation if before else 0) + 1, uuid.uuid4().hex
    dirty = rows.filter("state IN ('indexed', 'removed')")
    touched = materialised(dirty.select(_bucket(F.col("path")).alias("bucket")).distinct(), "touched")
    fresh = vault.sections(looked.join(dirty.filter("state = 'indexed'").select("path"), "path", "left_semi"))
    if before:
        old = before.sections.withColumn("bucket", _bucket(F.col("path"))).join(F.broadcast(touched), "bucket", "left_semi")
        fresh = fresh.unionByName(old.drop("bucket").join(dirty.select("path"), "path", "left_anti"))
    fresh.withColumn("bucket", _bucket(F.col("path"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/sections/version={version}")
    kept = rows.filter("state <> 'removed'")
    stay = F.col("state") == "failed"  # a failed file keeps the hash of its sections
    now = kept.select("path", "length", "modified", F.when((F.col("gate") == "look") & ~stay, F.col("content_hash")).otherwise(F.col("was_content_hash")).alias("content_hash"), "failed")
    now.write.mode("overwrite").parquet(f"{folder}/files/generation={number}")
    written = spark.read.schema(vault.SECTIONS + ", bucket int").parquet(f"{folder}/sections/version={version}").select("bucket").distinct().withColumn("version", F.lit(version))
    if before:
        written = written.unionByName(before.versions.join(touched, "bucket", "left_anti"))
    written.coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets/generation={number}")
    summary = materialised(summary, "summary")
    discard(gated, looked, rows, touched)
    return Notes(spark, folder, number), summary
