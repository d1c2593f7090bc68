"""Submissions and findings as streams.

A source arrives as one row, so the scans run as batch code on each micro-batch; what a batch writes
is keyed by its number, so a batch that is repeated after a failure writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernsift.operators.findings import target_metrics
from fernsift.plans.scan import run_job
from fernsift.sources.store import TABLES, Store
from fernsift.sources.submissions import SUBMISSION


def read_submission_stream(spark: SparkSession, path: str, format: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Submissions from files as they appear in a folder."""
    reader = spark.readStream.schema(SUBMISSION).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_ingest(
    submissions: DataFrame, store: Store, checkpoint: str, engine: str = "live", new_only: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scan and store every submission of a stream."""

    def take(batch: DataFrame, number: int) -> None:
        run_job(batch, store, f"batch-{number}", engine, new_only)

    writer = submissions.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_new_sources(
    submissions: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """As stream_ingest, but a text is scanned only when it is not stored yet.

    The store is the memory of what has been seen: no state grows in the stream.
    """
    return stream_ingest(submissions, store, checkpoint, new_only=True, trigger=trigger)


def read_finding_stream(spark: SparkSession, store: Store) -> DataFrame:
    """Stored findings as a stream, in the order in which scans add them."""
    columns = TABLES["findings"] + ", scan_id STRING"
    return spark.readStream.schema(columns).parquet(store.folder("findings"))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batch folders that are whole, found by listing."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [f.getPath().getName() for f in files.listStatus(root)]
    done = [n for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BUCKETS = 64


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, list[int]]:
    """bucket -> the whole batches that hold it, rising. Found by listing at most a few names per bucket."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    held: dict[int, list[int]] = {}
    for batch in _batches(spark, folder):
        if below is not None and batch >= below:
            continue
        names = [f.getPath().getName() for f in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"batch={batch}"))]
        for name in names:
            if name.startswith("_bucket="):
                held.setdefault(int(name.removeprefix("_bucket=")), []).append(batch)
    return held


def _newest(spark: SparkSession, folder: str, held: dict[int, list[int]], schema) -> DataFrame:
    paths = [f"{folder}/batch={batches[-1]}/_bucket={bucket}" for bucket, batches in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _merge_metrics(batch: DataFrame, number: int, folder: str, by: list[str]) -> None:
    """The rows of a batch in place of their earlier ones; only the buckets it touches are written, below its number."""
    spark = batch.sparkSession
    batch.limit(0).write.mode("ignore").parquet(f"{folder}/schema")
    placed = batch.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int")).persist()
    touched = [r[0] for r in placed.select("_bucket").distinct().collect()]  # at most BUCKETS
    before = {b: n for b, n in _versions(spark, folder, number).items() if b in touched}
    old = _newest(spark, folder, before, batch.schema).withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"))
    changed = placed.select(*[F.col(c).alias(f"_new_{i}") for i, c in enumerate(by)])
    same = [F.col(c).eqNullSafe(F.col(f"_new_{i}")) for i, c in enumerate(by)]
    rows = placed.unionByName(old.join(changed, same, "left_anti"))
    writer = rows.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket")
    writer.parquet(f"{folder}/batch={number}")
    placed.unpersist()
    # a repeat of this batch needs the version before its own, nothing needs the ones before that
    for bucket, batches in before.items():
        for n in batches[:-1]:
            _drop(spark, f"{folder}/batch={n}/_bucket={bucket}")
    kept = {n for batches in _versions(spark, folder).values() for n in batches}
    for n in _batches(spark, folder):
        if n not in kept and n < number:
            _drop(spark, f"{folder}/batch={n}")


def stream_target_metrics(
    findings: DataFrame, folder: str, checkpoint: str, by: list[str], trigger: dict | None = None
) -> StreamingQuery:
    """Running dashboard counts, kept below ``folder`` in buckets of targets.

    A batch brings the targets that changed (update mode), which take the place of their earlier rows. It writes the buckets of
    those targets into a folder of its own, which counts once it is whole; the others stay where they are. A batch that is
    repeated starts from the versions before its own. Of each bucket the last two versions are kept; the state is one row per target.
    """

    def keep(batch: DataFrame, number: int) -> None:
        _merge_metrics(batch, number, folder, by)

    counts = target_metrics(findings, by)
    writer = counts.writeStream.outputMode("update").foreachBatch(keep)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The counts after the last batch that stream_target_metrics has written."""
    return _newest(spark, folder, _versions(spark, folder), spark.read.parquet(f"{folder}/schema").schema)
