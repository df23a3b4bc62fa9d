"""Many small files. A sink that writes one for each row, all of them or none: tasks write aside, and the driver moves in what has
succeeded. And a way to list and read them by tasks, without a list of all in the driver."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "doctree_files"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark takes it to be on; one that names a scheme stays as it is."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it, as it is spelled; a path without a scheme is a local one."""
    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), re.sub("^(file:)?/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own below `_staging-<job>`, which readers pass over."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        fs, root = _store(self.path)
        task = TaskContext.get()
        own = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job[:8]}"
        folder, files = f"{root}/_staging-{self.job}/{own}", 0
        for batch in iterator:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                if not files:
                    fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/{name}") as out:
                    out.write((value or "").encode())
                files += 1
        return _Written(own, files)

    def commit(self, messages) -> None:
        """One move for each task that has written. What stood there before goes just before that, and `_SUCCESS` comes last."""
        fs, root = _store(self.path)
        staging = f"{root}/_staging-{self.job}"
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pyarrow.fs.FileSelector(root)):
                if old.path.rsplit("/", 1)[-1] != f"_staging-{self.job}":
                    (fs.delete_dir if old.type == pyarrow.fs.FileType.Directory else fs.delete_file)(old.path)
        for m in messages:
            if m is not None and m.files:
                fs.move(f"{staging}/{m.folder}", f"{root}/{m.folder}")
        self.abort(messages)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        fs, root = _store(self.path)
        staging = f"{root}/_staging-{self.job}"
        if fs.get_file_info(staging).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(staging)


class FilesSink(DataSource):
    """df (name, value) as files: df.write.format("doctree_files").mode("overwrite" or "append").save(path).

    A file has the name of its row and the value as UTF-8; names differ. Files of one task share a folder below path.
    path is on a file system that pyarrow reaches from all executors. An attempt that fails, or a job that does, leaves
    what was there before.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass a name over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def reached(path: str) -> bool:
    """Whether path is a folder on a file system that it names and that pyarrow reaches; without a scheme only Spark knows where it is."""
    if not path.startswith("file:/") and "://" not in path:
        return False
    try:
        fs, root = _store(path)
        return path.rstrip("/").endswith(root.rstrip("/")) and fs.get_file_info(root).type == pyarrow.fs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def listed(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """(path, bytes) of the files in a `reached` path, or below it, that Spark's readers would not pass over.

    The driver lists the folders in path only; a task lists each of them with all below, and one the files of path itself.
    """
    path = path.rstrip("/")
    fs, root = _store(path)
    folders = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(root)) if x.type == pyarrow.fs.FileType.Directory and not _hidden(x.base_name)] if recursive else []
    before = "file:" if path.startswith("file:") else path.removesuffix(root)

    def run(batches):
        fs, _ = _store(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                todo = [folder]
                while todo:
                    found = [x for x in fs.get_file_info(pyarrow.fs.FileSelector(todo.pop())) if not _hidden(x.base_name)]
                    todo += [x.path for x in found if x.type == pyarrow.fs.FileType.Directory and folder != root]
                    files = [x for x in found if x.type == pyarrow.fs.FileType.File]
                    for low in range(0, len(files), 4096):
                        part = files[low : low + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array([before + x.path for x in part]), pa.array([x.size for x in part], pa.int64())], names=["path", "bytes"])

    parts = [(x,) for x in (root, *folders)]
    return spark.createDataFrame(parts, "folder string").repartition(len(parts)).mapInArrow(run, "path string, bytes bigint")


#: Bytes of text in a batch of `whole_files`, about.
_BATCH = 8 << 20


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of each file below a `reached` path. Files are dealt over tasks one by one, four tasks a core."""
    path = path.rstrip("/")
    found = listed(spark, path, True).select("path").repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        fs, root = _store(path)
        held, size = [], 0
        for batch in batches:
            for file in batch.column("path").to_pylist():
                with fs.open_input_stream(file[file.index(root) :]) as source:
                    held.append(source.read().decode(errors="replace"))
                size += len(held[-1])
                if size > _BATCH or len(held) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return found.mapInArrow(run, "value string")
