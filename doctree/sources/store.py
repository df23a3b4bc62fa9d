"""A catalog and its nodes as stored tables, whose documents can be replaced without writing the rest anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .files import left_anti_docs
from .scratch import cut, delete, scope

#: Folders that documents are dealt over by hash. One is the least that an upsert rewrites, and the work of one task.
BUCKETS = 64


class Store:
    """Tables `catalog` and `nodes` below a path, in folders bucket=N.

    An upsert rewrites the buckets of the documents it brings, nodes first and the catalog last. Each table's new
    files stand aside until all are written. A run that fails between the two leaves entries with an old digest;
    the same upsert, made again, gives the state that it would have given.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int").alias("bucket")

    def _exists(self, table: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, table: str) -> DataFrame | None:
        """catalog or nodes with bucket, as they stand; None before the first upsert."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}") if self._exists(table) else None

    def upsert(self, entries: DataFrame, nodes: DataFrame) -> list[int]:
        """Replaces the documents of entries (doc_id, ..) and all their nodes; returns the buckets that were written.

        Documents of nodes must be among those of entries; one without nodes loses the old ones. Doing it twice changes nothing.
        """
        with scope(self.spark):
            entries = cut(entries.withColumn("bucket", self._bucket()))
            nodes = nodes.withColumn("bucket", self._bucket())
            touched = [r["bucket"] for r in entries.select("bucket").distinct().orderBy("bucket").collect()]  # `buckets` at most
            if touched:
                self._replace("nodes", nodes, entries, touched)
                self._replace("catalog", entries, entries, touched)
        return touched

    def _replace(self, table: str, rows: DataFrame, entries: DataFrame, touched: list[int]) -> None:
        old = self.read(table)
        if old is not None:
            stay = left_anti_docs(old.filter(F.col("bucket").isin(touched)), entries)
            rows = stay.unionByName(rows, allowMissingColumns=True)
        # What is read from the buckets is written elsewhere before they are replaced.
        rows = cut(rows.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "doc_id"))
        filled = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        out = rows.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "doc_id")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{table}")
        for bucket in set(touched) - filled:  # a bucket without rows is not among those that Spark replaces
            delete(self.spark, f"{self.path}/{table}/bucket={bucket}")


def digests(pages: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest) of what a document is built from: its pages, and the responses told (doc_id, request_id, response) about it.

    The order of rows plays no part. A digest has 64 bits of an exclusive or and 40 of a sum, of different hashes, besides the counts.
    """

    def summed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        one, two = F.xxhash64(*columns), F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1 << 40))
        parts = [F.count("*"), F.hex(F.bit_xor(one)), F.hex(F.sum(two))]
        return df.groupBy("doc_id").agg(F.concat_ws("-", *[p.cast("string") for p in parts]).alias(name))

    out = summed(pages, ["page", "text"], "digest")
    if told is not None:
        answered = summed(told.select("doc_id", "request_id", "response"), ["request_id", "response"], "_told")
        out = out.join(answered, "doc_id", "left").withColumn("digest", F.concat_ws("/", "digest", "_told")).drop("_told")
    return out


def changed(found: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Rows of found (doc_id, digest) that the catalog lacks or has with another digest."""
    if catalog is None:
        return found
    known = catalog.select("doc_id", F.col("digest").alias("_was"))
    return found.join(known, "doc_id", "left").filter(~F.col("digest").eqNullSafe(F.col("_was"))).drop("_was")
