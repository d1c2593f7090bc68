"""The four stored tables: targets, source files, assets, findings.

Ids are hashes of the natural key, so a re-run after a lost executor gives the same rows. What is deleted is noted and left out when
read; no table is written anew from itself, so a driver that is lost in between loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsift.functions import text as T

TABLES = {
    "targets": "target_id BIGINT, domain STRING, created_at TIMESTAMP",
    "source_files": "hash STRING, content STRING, created_at TIMESTAMP",
    "assets": "asset_id BIGINT, target_id BIGINT, url STRING, source_hash STRING",
    "findings": "finding_id BIGINT, asset_id BIGINT, type STRING, severity STRING, evidence STRING, "
    "line INT, created_at TIMESTAMP",
}
PARTITIONS = {"targets": ["bucket"], "source_files": ["bucket"], "assets": ["scan_id"], "findings": ["scan_id", "severity"]}
#: The key that a row is looked up and deleted by.
KEYS = {"targets": "target_id", "source_files": "hash", "assets": "asset_id", "findings": "finding_id"}
DELETED = "id STRING, deleted_at TIMESTAMP"
NO_SOURCE = (
    "// Source code not found in database.\n"
    "// It may have been cleaned up or the scan failed."
)


def _digits(name: str, key: Column) -> Column:
    """A key as evenly spread hexadecimal digits: texts are known by such a hash, targets by a number that is one."""
    return key if name == "source_files" else F.lower(F.lpad(F.hex(key), 16, "0"))


class Store:
    """The tables as Parquet folders under one path.

    Targets and source files lie in buckets by the first ``prefix`` digits of their key (256 buckets for two), so what a batch
    has to be compared with is read from the buckets it touches. A store that has rows keeps the prefix it began with.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: int = 2):
        self.spark, self.path, self._given = spark, path.rstrip("/"), prefix

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, name: str) -> DataFrame:
        """A table without what has been deleted; empty if nothing has been written yet."""
        return self._current(name, self._stored(name)).select(*self.columns(name))

    def near(self, name: str, keys: DataFrame) -> DataFrame:
        """The part of a bucketed table in which the keys (the only column of ``keys``) are, if they are stored.

        Only numbers of buckets come to the driver, at most 16 ** prefix.
        """
        key = _digits(name, F.col(keys.columns[0]))
        bucket = F.substring(key, 1, self.prefix(name)).alias("bucket")
        touched = [r.bucket for r in keys.select(bucket).distinct().collect() if r.bucket is not None]
        rows = self._stored(name).filter(F.col("bucket").isin(touched))
        return self._current(name, rows).select(*self.columns(name))

    def prefix(self, name: str) -> int:
        """The length of the names of the table's buckets."""
        names = [n for n in self._listed(name) if n.startswith("bucket=")]
        return len(names[0].removeprefix("bucket=")) if names else self._given

    def _listed(self, name: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(name))
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []

    def _stored(self, name: str) -> DataFrame:
        """All rows of a table, with the columns it is partitioned by and the time at which they were written."""
        parts = [c for c in PARTITIONS[name] if c not in self.columns(name)]
        schema = ", ".join([TABLES[name], "written_at TIMESTAMP", *[f"{c} STRING" for c in parts]])
        if not self._listed(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder(name))

    def _current(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that were written after they were last deleted."""
        notes = f"deleted/{name}"
        if not self._listed(notes):
            return rows
        gone = self.spark.read.schema(DELETED).parquet(self.folder(notes))
        last = gone.groupBy("id").agg(F.max("deleted_at").alias("deleted_at"))
        wiped = last.filter("id IS NULL").select("deleted_at").scalar()
        rows = rows.filter(wiped.isNull() | (F.col("written_at") > wiped))
        by_id = (F.col(KEYS[name]).cast("string") == last["id"]) & (F.col("written_at") <= last["deleted_at"])
        return rows.join(last, by_id, "left_anti")

    def columns(self, name: str) -> list[str]:
        return [f.split()[0] for f in TABLES[name].split(", ")]

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows into their buckets; each bucket gets few files, large ones are written by several tasks."""
        bucket = F.substring(_digits(name, F.col(KEYS[name])), 1, self.prefix(name))
        placed = self._timed(name, rows).withColumn("bucket", bucket).hint("rebalance", "bucket")
        placed.write.mode("append").partitionBy("bucket").parquet(self.folder(name))

    def write_scan(self, name: str, rows: DataFrame, scan_id: str) -> None:
        """Assets or findings of one scan, in place of those of an earlier run of the same scan."""
        placed = self._timed(name, rows).withColumn("scan_id", F.lit(scan_id))
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*PARTITIONS[name]).parquet(self.folder(name))

    def delete(self, name: str, ids: DataFrame | None = None) -> None:
        """Leave out rows whose key is in the only column of ``ids``, all rows if it is None.

        Rows that are written later are read again, also under the same key.
        """
        if ids is None:
            keys = self.spark.range(1).select(F.lit(None).cast("string").alias("id"))
        else:
            keys = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).filter("id IS NOT NULL")
        noted = keys.withColumn("deleted_at", F.current_timestamp())
        noted.write.mode("append").parquet(self.folder(f"deleted/{name}"))

    def _timed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns(name)).withColumn("written_at", F.current_timestamp())


def hashed(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("hash", F.sha2("code", 256))


def store_sources(submissions: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts that are not stored yet, each once: (hash, content).

    Texts that are stored already go before any is grouped; of many copies each task sends one.
    """
    fresh = hashed(submissions).join(stored.select("hash"), "hash", "left_anti")
    return fresh.groupBy("hash").agg(F.first("code").alias("content"))


def upsert_targets(submissions: DataFrame, stored: DataFrame) -> DataFrame:
    """Domains that are not stored yet: (target_id, domain)."""
    return (
        submissions.select("domain")
        .distinct()
        .join(stored.select("domain"), "domain", "left_anti")
        .select(F.xxhash64("domain").alias("target_id"), "domain")
    )


def link_assets(submissions: DataFrame, scan_id: str) -> DataFrame:
    """One asset per submission and scan: (asset_id, target_id, url, source_hash).

    The ids of target and source are hashes of columns of the row, so no join is needed.
    """
    return hashed(submissions).select(
        F.xxhash64(F.lit(scan_id), "domain", "filename", "hash").alias("asset_id"),
        F.xxhash64("domain").alias("target_id"),
        F.col("filename").alias("url"),
        F.col("hash").alias("source_hash"),
    )


def finding_rows(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings with an ``asset_id`` as rows of the stored table, without a time.

    The id is of the whole evidence, also where only its first ``limit`` characters are stored.
    """
    return findings.select(
        F.xxhash64("asset_id", "type", "line", "evidence").alias("finding_id"),
        "asset_id", "type", "severity", T.shown(F.col("evidence"), limit).alias("evidence"), "line",
    )


def write_findings(store: Store, findings: DataFrame, scan_id: str) -> None:
    """Findings with an ``asset_id`` into the store, partitioned by scan and severity."""
    store.write_scan(
        "findings", finding_rows(findings).withColumn("created_at", F.current_timestamp()), scan_id
    )


def write_report(findings: DataFrame, path: str) -> None:
    """All findings as JSON lines."""
    findings.write.mode("overwrite").json(path)


def target_findings(findings: DataFrame, assets: DataFrame, target_id: int | None = None) -> DataFrame:
    """Findings with the URL of their asset; of one target if asked."""
    if target_id is not None:
        assets = assets.filter(F.col("target_id") == target_id)
    return findings.join(assets.select("asset_id", "target_id", "url"), "asset_id")


def newest(rows: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Rows by falling key, the first ``k`` of them if asked."""
    ordered = rows.orderBy(F.col(key).desc())
    return ordered if k is None else ordered.limit(k)


def source_lookup(sources: DataFrame, assets: DataFrame, targets: DataFrame) -> DataFrame:
    """(domain, url, content) of the newest asset of every domain and URL."""
    latest = (
        assets.join(targets.select("target_id", "domain"), "target_id")
        .groupBy("domain", "url")
        .agg(F.max_by("source_hash", "asset_id").alias("hash"))
    )
    return latest.join(sources.select("hash", "content"), "hash").select("domain", "url", "content")


def fetch_source(sources: DataFrame, assets: DataFrame, targets: DataFrame, domain: str, url: str) -> DataFrame:
    """One row: the text of one asset, or a fixed message."""
    wanted = targets.filter(F.col("domain") == domain)
    found = source_lookup(sources, assets.filter(F.col("url") == url), wanted)
    return found.agg(F.coalesce(F.max("content"), F.lit(NO_SOURCE)).alias("content"))


def duplicate_sources(assets: DataFrame) -> DataFrame:
    """How many assets share a text: (source_hash, copies, first_url, last_url).

    Counts and ends only: the URLs of a much-copied text are not put into one row.
    """
    return assets.groupBy("source_hash").agg(
        F.count("*").alias("copies"), F.min("url").alias("first_url"), F.max("url").alias("last_url")
    )


def delete_finding(findings: DataFrame, finding_id: int) -> DataFrame:
    return findings.filter(F.col("finding_id") != finding_id)


def findings_of_target_semi(findings: DataFrame, assets: DataFrame, target_id: int) -> DataFrame:
    """Findings whose asset belongs to the target."""
    return findings.join(assets.filter(F.col("target_id") == target_id), "asset_id", "left_semi")


def clear_target(findings: DataFrame, assets: DataFrame, target_id: int) -> DataFrame:
    """Findings that remain when those of a target are dropped."""
    return findings.join(assets.filter(F.col("target_id") == target_id), "asset_id", "left_anti")


def delete_from(store: Store, finding_ids: DataFrame) -> None:
    """Single findings out of the store."""
    store.delete("findings", finding_ids)


def clear_target_from(store: Store, target_id: int) -> None:
    """All findings of a target out of the store."""
    theirs = findings_of_target_semi(store.read("findings"), store.read("assets"), target_id)
    store.delete("findings", theirs.select("finding_id"))


def wipe(store: Store) -> None:
    """Empty targets, assets and findings; the source files stay."""
    for name in ("targets", "assets", "findings"):
        store.delete(name)
