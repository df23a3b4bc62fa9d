"""Sources and sinks: page tables, directories of sources, index files, catalogs and run reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import doc_name, doc_stem, safe_name
from .books import with_tokens
from .scratch import cut
from .sink import FilesSink, listed, qualified, reached, whole_files


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A page table (doc_id, page, text) with token counts."""
    return with_tokens(spark.read.format(fmt).load(path))


def list_sources(spark: SparkSession, path: str, glob: str = "*.pdf", out_dir: str = "", recursive: bool = False) -> DataFrame:
    """S3: (path, name, stem, bytes, output) of the files that match, by path; file contents are not read.

    Executors list the folders in path, if pyarrow reaches it and the glob has no other signs than * and ?; else the driver lists
    all files, by Spark's reader of binary files.
    """
    path = qualified(spark, path)
    if reached(path) and not re.search(r"[\[\]{}\\]", glob):
        like = "".join({"*": ".*", "?": "."}.get(x) or re.escape(x) for x in glob)
        files = listed(spark, path, recursive).filter(doc_name("path").rlike(f"(?s)^{like}$"))
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
        files = found.select("path", F.col("length").alias("bytes"))
    stem = F.regexp_replace(doc_name("path"), r"\.[^.]*$", "")
    return files.select("path", doc_name("path").alias("name"), stem.alias("stem"), "bytes", F.concat(F.lit(out_dir.rstrip("/") + "/" if out_dir else ""), stem, F.lit("_structure.json")).alias("output")).orderBy("path")


def index_json(index_docs: DataFrame) -> DataFrame:
    """index_docs with value: the index of each document as one JSON object, doc_name, doc_description and the nested structure."""
    head = F.to_json(F.struct(*[c for c in ("doc_id", "doc_name", "doc_description") if c in index_docs.columns]))
    structure = F.coalesce("structure_json", F.lit("[]"))
    return index_docs.withColumn("value", F.concat(F.left(head, F.length(head) - 1), F.lit(',"structure":'), structure, F.lit("}")))


#: Bytes that file systems let a name have, less what file_names adds.
_LONGEST = 200


def file_names(index_docs: DataFrame) -> DataFrame:
    """index_docs with name, the file of its own that each document gets: `<stem>_structure.json`.

    Documents whose stems are equal, case aside, also get `-` and 24 hexadecimal digits of the SHA-256 of their doc_id, and so
    does a stem that ends so itself or is too long, which is cut. No two doc_ids have one name.
    """
    stem = F.regexp_replace(safe_name(F.coalesce("doc_name", "doc_id")), r"\.[^.]*$", "")
    clean = F.regexp_replace(stem, r"[\x00-\x1f/:*?\"<>|\\\\]", "-")
    named = index_docs.withColumn("_stem", F.when(clean.rlike(r"^[._]|^$"), F.concat(F.lit("-"), clean)).otherwise(clean))
    shared = named.groupBy(F.lower("_stem").alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1")
    joined = named.join(shared, F.lower("_stem") == F.col("_key"), "left")
    long = F.octet_length("_stem") > _LONGEST
    own = F.col("_n").isNull() & ~F.col("_stem").rlike("-[0-9a-f]{24}$") & ~long
    digest = F.concat(F.lit("-"), F.left(F.sha2("doc_id", 256), F.lit(24)))
    short = F.when(long, F.left("_stem", F.lit(_LONGEST // 4))).otherwise(F.col("_stem"))
    return joined.withColumn("name", F.concat(short, F.when(own, "").otherwise(digest), F.lit("_structure.json"))).select(*index_docs.columns, "name")


def write_index(index_docs: DataFrame, path: str, mode: str = "overwrite", a_file_each: bool = False) -> None:
    """The nested JSON of each document, a line each; or with a_file_each in files of their own below path, named by `file_names`.

    mode is overwrite or append. Either way all files appear or none, and task attempts that fail leave nothing (see FilesSink).
    A line each suits corpora: millions of small files suit no store. Page text is written only where nodes hold it.
    """
    made = index_json(index_docs)
    if a_file_each:
        index_docs.sparkSession.dataSource.register(FilesSink)
        file_names(made).select("name", "value").write.format(FilesSink.name()).mode(mode).save(qualified(index_docs.sparkSession, path))
    else:
        made.select("value").write.mode(mode).text(path)


_INDEX = "doc_id string, doc_name string, doc_description string, structure string"


def parse_index(values: DataFrame) -> DataFrame:
    """Index rows (doc_id, doc_name, doc_description, structure_json) from JSON text in `value`.

    Broken JSON and objects without a name or a structure are left out. Without a doc_id, the name stands for it.
    """
    whole = values.filter(F.get_json_object("value", "$").isNotNull()).select(F.from_json("value", _INDEX).alias("x")).select("x.*")
    known = whole.filter("doc_name is not null and structure is not null")
    return known.select(F.coalesce("doc_id", "doc_name").alias("doc_id"), "doc_name", "doc_description", F.col("structure").alias("structure_json"))


def read_index(spark: SparkSession, path: str, a_file_each: bool = False) -> DataFrame:
    """The indexes below path, without what is broken: one a line, or with a_file_each one a file, pretty-printed or not.

    Files of one index each are listed and read by executors, once: the result is written. Only where pyarrow does not reach
    path the driver lists them, and Spark reads some tens a task.
    """
    path = qualified(spark, path)
    if a_file_each and reached(path):
        return cut(parse_index(whole_files(spark, path)))
    return parse_index(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=a_file_each).select("value"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Current with the rows of every key of incoming replaced by those of incoming. Upserting twice changes nothing."""
    return left_anti_docs(current, incoming, key).unionByName(incoming)


def left_anti_docs(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a whose key b does not have; null keys are never in b."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def rebuild_catalog(index_docs: DataFrame, page_counts: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """A catalog entry for each stored index; what is missing is empty, or 0 pages."""
    out = index_docs.join(page_counts.select("doc_id", "page_count"), "doc_id", "left")
    if paths is not None:
        out = out.join(paths.select("doc_id", "path"), "doc_id", "left")
    else:
        out = out.withColumn("path", F.lit(""))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("doc_id", F.lit("pdf").alias("type"), empty("doc_name"), empty("doc_description"), empty("path"), F.coalesce("page_count", F.lit(0)).cast("int").alias("page_count"))


def run_report(sources: DataFrame, index_docs: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, output, status) of each source: ok if it has an index, else failed; with failures (doc_id, error) also why."""
    done = index_docs.select("doc_id", F.lit(True).alias("_done")).distinct()
    out = sources.join(done, "doc_id", "left").withColumn("status", F.when(F.col("_done"), "ok").otherwise("failed"))
    if failures is None:
        return out.select("doc_id", "name", "output", "status")
    why = F.when(F.col("status") == "failed", F.coalesce("error", F.lit("not indexed")))
    return out.drop("error").join(failures.select("doc_id", "error"), "doc_id", "left").select("doc_id", "name", "output", "status", why.alias("error"))


def run_failed(report: DataFrame) -> DataFrame:
    """One row: numbers of documents and failures, and whether any failed."""
    failed = F.col("status") == "failed"
    return report.agg(F.count("*").alias("documents"), F.count_if(failed).alias("failures"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("failed"))


__all__ = ["doc_stem", "index_json", "left_anti_docs", "list_sources", "load_pages", "parse_index", "read_index", "rebuild_catalog", "run_failed", "run_report", "upsert", "write_index"]
