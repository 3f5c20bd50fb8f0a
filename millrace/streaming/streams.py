"""Structured Streaming: sources, windows, late data and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.operators.sizing import measured_bytes
from millrace.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", *, max_files: int | None = None, **options) -> DataFrame:
    """File stream. ``max_files`` bounds how much one micro-batch takes in."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.options(**options).load(path)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark; columns without time zone are turned into timestamps first, as Spark requires."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def windowed(df: DataFrame, ts: str, duration: str, aggregations: Sequence[Column], *, slide: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Tumbling (no ``slide``) or sliding windows, for batch and stream alike."""
    spec = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    grouped = df.groupBy(spec.alias("w"), *keys).agg(*aggregations)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, aggregations: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    grouped = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregations)
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in grouped.columns if c != "w"])


def flag_late(df: DataFrame, event_ts: str, arrival_ts: str, allowed: str, alias: str = "is_late") -> DataFrame:
    """Mark rows that arrive later than ``allowed`` after their event time (interval text)."""
    return df.withColumn(alias, F.col(arrival_ts) > F.col(event_ts) + F.expr(f"INTERVAL {allowed}"))


def _trigger(writer, every: str | None, available_now: bool, continuous: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    if continuous:
        return writer.trigger(continuous=continuous)
    return writer.trigger(processingTime=every) if every else writer


def start(df: DataFrame, path: str, *, checkpoint: str | None = None, format: str = "parquet", mode: str = "append",
          every: str | None = None, available_now: bool = False, continuous: str | None = None, **options) -> StreamingQuery:
    """Start a file sink; there is always a checkpoint, in the shared folder unless given."""
    where = checkpoint or scratch_path(df.sparkSession, "stream-checkpoint")
    writer = df.writeStream.format(format).outputMode(mode).option("checkpointLocation", where).options(**options)
    return _trigger(writer, every, available_now, continuous).start(path)


def start_foreach(df: DataFrame, handle: Callable[[DataFrame, int], None], *, checkpoint: str | None = None, mode: str = "update",
                  every: str | None = None, available_now: bool = False) -> StreamingQuery:
    where = checkpoint or scratch_path(df.sparkSession, "stream-checkpoint")
    writer = df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", where)
    return _trigger(writer, every, available_now, None).start()


def run_to_table(df: DataFrame, *, mode: str = "append") -> DataFrame:
    """Process everything available and read the result back from the shared folder.

    Append goes to a file sink. Complete and update results are written per micro-batch under
    their batch number, and the last (complete) or all (update) batches are returned.
    """
    spark = df.sparkSession
    out = scratch_path(spark, "stream-out")
    if mode == "append":
        start(df, out, available_now=True).awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    start_foreach(df, store, mode=mode, available_now=True).awaitTermination()
    stored = spark.read.parquet(out)
    if mode == "complete":
        stored = stored.filter(F.col("batch") == stored.agg(F.max("batch")).scalar()).drop("batch")
    return stored


class VersionedTable:
    """A parquet table replaced as a whole: each version is a new folder, and a pointer row is
    appended after the version is complete, so readers never see a half-written table. Writing a
    version twice (a replayed micro-batch) overwrites the same folder with the same rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _latest(self) -> str:
        pointers = self.spark.read.parquet(f"{self.path}/_versions")
        return pointers.agg(F.max("version").alias("v")).first()["v"]

    def version(self) -> int:
        return self._latest()

    def read(self) -> DataFrame:
        return self.at(self._latest())

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version}").select("*")

    def write(self, df: DataFrame, version: int, stream: str | None = None, batch: int | None = None) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self._point(version, stream, batch)

    def _point(self, version: int, stream: str | None, batch: int | None) -> None:
        pointer = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(stream).cast("string").alias("stream"), F.lit(batch).cast("bigint").alias("batch"))
        pointer.write.mode("append").parquet(f"{self.path}/_versions")

    def upsert(self, merge: Callable[[DataFrame, DataFrame], DataFrame], changes: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        latest = self.version()
        self.write(merge(self.at(latest), changes), latest + 1, stream, batch)

    def holds(self, stream: str, batch: int) -> bool:
        """Whether a version made from this batch of this stream is complete."""
        pointers = self.spark.read.parquet(f"{self.path}/_versions")
        return bool(pointers.filter((F.col("stream") == stream) & (F.col("batch") == batch)).take(1))


class KeyedTable(VersionedTable):
    """A parquet table in hash buckets of its keys; an upsert rewrites only the buckets its batch touches.

    ``data/v=N/bucket=B`` holds the bucket as version N left it. A version's manifest names, for each bucket,
    the version whose folder is valid, so all earlier versions stay readable and nothing is copied. A version counts
    once its pointer row is appended: a batch that is cut off leaves folders which nothing names, and its replay writes
    the same folders anew. One writer at a time, as with any plain folder.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path)
        own = spark.read.parquet(f"{path}/_settings").first()
        self.keys, self.buckets, self.schema = list(own["keys"]), own["buckets"], StructType.fromJson(json.loads(own["schema"]))

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None, bucket_bytes: int = 256 << 20) -> KeyedTable:
        """Version 0 from ``df``. Without ``buckets`` their number follows from the measured size and the size of
        text a bucket should have; it is fixed from then on, so leave room for growth."""
        if not keys or set(keys) - set(df.columns):
            raise ValueError(f"the keys {list(keys)} must be columns of the table")
        if "bucket" in [c.lower() for c in df.columns]:
            raise ValueError("a column named bucket stands in the way of the bucket folders")
        spark = df.sparkSession
        buckets = buckets or max(1, -(-measured_bytes(df) // bucket_bytes))
        own = spark.range(1).select(F.array(*[F.lit(k) for k in keys]).alias("keys"), F.lit(buckets).cast("int").alias("buckets"), F.lit(df.schema.json()).alias("schema"))
        own.write.parquet(f"{path}/_settings")
        table = cls(spark, path)
        table.write(df, 0)
        return table

    def bucket(self) -> Column:
        """Bucket of a row's keys; NULL keys have one too."""
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> DataFrame:
        """(bucket, written): one row per bucket that has rows, and the version that wrote it."""
        return self.spark.read.schema("bucket INT, written BIGINT").parquet(f"{self.path}/_manifest/v={version}")

    def at(self, version: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows of a version, or those of some buckets. The driver sees one path per bucket."""
        named = self.manifest(version)
        if buckets is not None:
            named = named.filter(F.col("bucket").isin(list(buckets)))
        paths = [f"{self.path}/data/v={r['written']}/bucket={r['bucket']}" for r in named.collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, stream: str | None = None, batch: int | None = None) -> None:
        """A version made of ``df`` alone."""
        self._commit(df, version, None, self.spark.createDataFrame([], "bucket INT, written BIGINT"), stream, batch)

    def upsert(self, merge: Callable[[DataFrame, DataFrame], DataFrame], changes: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """The next version: the buckets of the keys in ``changes`` are merged with them, the others stay as they are."""
        latest = self.version()
        touched = [r["b"] for r in changes.select(self.bucket().alias("b")).distinct().collect()]       # at most ``buckets``
        kept = self.manifest(latest).filter(~F.col("bucket").isin(touched))
        merged = merge(self.at(latest, touched), changes) if touched else self.spark.createDataFrame([], self.schema)
        self._commit(merged, latest + 1, touched, kept, stream, batch)

    def _commit(self, df: DataFrame, version: int, touched: Sequence[int] | None, kept: DataFrame, stream: str | None, batch: int | None) -> None:
        data = f"{self.path}/data/v={version}"
        if touched is not None:
            stray = F.raise_error(F.lit("the merge made a row whose keys are not in the batch's buckets"))
            df = df.filter(F.when(self.bucket().isin(list(touched)), True).otherwise(stray))
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields], self.bucket().alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        # Only the folder names are read: a bucket that lost all its rows has none and leaves the manifest.
        found = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(data).select("bucket").distinct()
        named = kept.unionByName(found.withColumn("written", F.lit(version).cast("bigint")))
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest/v={version}")
        self._point(version, stream, batch)

    def unused(self, keep: int) -> list[str]:
        """Bucket folders that none of the last ``keep`` versions names; their owner may remove them."""
        versions = [r["version"] for r in self.spark.read.parquet(f"{self.path}/_versions").select("version").distinct().orderBy(F.desc("version")).collect()]
        read = lambda some: reduce(DataFrame.unionAll, [self.manifest(v) for v in some])
        if len(versions) <= keep:
            return []
        gone = read(versions[keep:]).distinct().join(read(versions[:keep]).distinct(), ["bucket", "written"], "left_anti")
        return sorted(f"{self.path}/data/v={r['written']}/bucket={r['bucket']}" for r in gone.collect())


def stream_upsert(df: DataFrame, table: VersionedTable, merge: Callable[[DataFrame, DataFrame], DataFrame], *, checkpoint: str | None = None) -> StreamingQuery:
    """Merge each micro-batch into the latest version of the table, which makes the next one; a ``KeyedTable``
    hands ``merge`` only the buckets that the batch touches.

    A version records the stream (its checkpoint folder) and batch it came from, so a batch that is
    replayed after a failure is merged once, and streams may follow one another on the same table.
    """
    stream = checkpoint or scratch_path(df.sparkSession, "stream-checkpoint")

    def apply(batch: DataFrame, number: int) -> None:
        if not table.holds(stream, number):
            table.upsert(merge, batch, stream, number)

    return start_foreach(df, apply, checkpoint=stream, mode="append", available_now=True)
