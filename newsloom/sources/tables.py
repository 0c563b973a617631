"""The article table on shared storage.

Plain Parquet has no row updates, so a merge writes a new version, or the touched partitions of
a partitioned table, and an insert appends files.

A versioned table is a folder of data folders, each written once under a name of its own, and a file
per version that lists the data folders the version is made of. A version becomes real when its file
gets its number as a name, which fails if another writer took the number first: no writer overwrites
another's work, and readers see a version whole or not at all. The store must refuse to rename over an
existing file, as HDFS does; on local disks a link is made instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import materialize

VERSIONS = "_versions"


class VersionTaken(RuntimeError):
    """Another writer committed the version this one was made for."""


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_rows(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in ``folder``; none where it does not exist."""
    fs, path = file_system(spark, folder)
    return sorted(status.getPath().getName() for status in fs.listStatus(path)) if fs.exists(path) else []


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file together with its content, in one step; False if it exists already."""
    fs, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return bool(fs.rename(draft, target))  # false where the name is taken
        # a local rename would replace the file; a second link to the same name fails
        local = [spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (target, draft)]
        try:
            spark._jvm.java.nio.file.Files.createLink(*local)
            return True
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
    finally:
        fs.delete(draft, False)


def read_small(spark: SparkSession, path: str) -> str:
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _version_file(base: str, version: int) -> str:
    return f"{base}/{VERSIONS}/{version:012d}.json"


def latest_version(spark: SparkSession, base: str) -> int:
    """Highest committed version below ``base``; 0 when there is none."""
    numbers = [n.removesuffix(".json") for n in names_in(spark, f"{base}/{VERSIONS}") if n.endswith(".json")]
    return max([0, *(int(n) for n in numbers if n.isdigit())])


def _manifest(spark: SparkSession, base: str, version: int) -> dict:
    if not version:
        raise ValueError(f"no version below {base}")
    return json.loads(read_small(spark, _version_file(base, version)))


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    manifest = _manifest(spark, base, version or latest_version(spark, base))
    schema = T.StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(*[f"{base}/{folder}" for folder in manifest["folders"]])


def _commit(rows: DataFrame, base: str, expected: int | None, append: bool) -> int:
    """Write ``rows`` to a folder of their own, then claim the next version number for them."""
    spark = rows.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/{folder}")
    while True:
        current = latest_version(spark, base) if expected is None else expected
        before = _manifest(spark, base, current) if append and current else {"folders": [], "schema": json.loads(rows.schema.json())}
        manifest = before | {"folders": [*before["folders"], folder]}
        if create_exclusively(spark, _version_file(base, current + 1), json.dumps(manifest)):
            return current + 1
        if expected is not None:
            fs, unused = file_system(spark, f"{base}/{folder}")
            fs.delete(unused, True)
            raise VersionTaken(f"{base} has a version {expected + 1}, the rows were made from version {expected}")


def write_version(rows: DataFrame, base: str, expected: int | None = None) -> int:
    """Commit ``rows`` as the whole table and return the version.

    With ``expected``, the version the rows were made from, a commit by anyone else since then raises
    :class:`VersionTaken`; without it the rows become the latest version whatever came before.
    """
    return _commit(rows, base, expected, append=False)


def append_version(rows: DataFrame, base: str, expected: int | None = None) -> int:
    """Commit a version that also has ``rows``; only they are written."""
    return _commit(rows, base, expected, append=True)


def change_table(spark: SparkSession, base: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
    """Read the latest version, commit ``change`` of it; done again when another writer was faster."""
    for attempt in range(attempts):
        version = latest_version(spark, base)
        try:
            return write_version(change(read_version(spark, base, version)), base, expected=version)
        except VersionTaken:
            if attempt == attempts - 1:
                raise


def replace_partitions(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that ``rows`` holds; they may derive from the same table.

    The rows are first written to the shared folder, so nothing is read from the partitions
    while they are replaced.
    """
    staged = materialize(rows, "partitions")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def touched_rows(articles: DataFrame, updates: DataFrame, partition_column: str, key: str = "id") -> DataFrame:
    """Rows of the partitions that hold a row to be updated.

    Only the key and the partition column are read to find them. ``updates`` should be a stored
    frame, because it is read again by the merge.
    """
    keys = updates.select(key)
    hit = articles.join(keys, key, "left_semi").select(partition_column).distinct()
    # as many rows as there are touched partitions
    values = [r[0] for r in hit.collect()]
    known = [v for v in values if v is not None]
    chosen = F.col(partition_column).isin(known) if known else F.lit(False)
    if len(known) < len(values):
        chosen = chosen | F.col(partition_column).isNull()
    return articles.where(chosen)
