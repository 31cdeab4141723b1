"""Files as a table: listing, classification and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.hashing import quick_fingerprint
from frameloom.functions.names import file_kind


def list_files(spark: SparkSession, *folders: str, content: bool = False) -> DataFrame:
    """The files under folders: path, length, modified_unix_ms, kind and failure; with ``content`` also the bytes.

    Without the content only the listing is read. Files of no supported kind stay in the table with the failure
    ``unsupported``, and folders that aren't there come out as rows with the failure ``missing``. Empty files have the
    failure ``empty`` where the listing shows them; the same file under two folders comes once.
    """
    context = spark.sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    there = {f: path_of(f).getFileSystem(context._jsc.hadoopConfiguration()).exists(path_of(f)) for f in folders}
    absent = [(f, None, None, None, "missing") + ((None,) if content else ()) for f, found in there.items() if not found]
    schema = "path string, length bigint, modified_unix_ms bigint, kind string, failure string" + (", content binary" if content else "")
    lost = spark.createDataFrame(sorted(set(absent)), schema)
    if not any(there.values()):
        return lost
    folders = tuple(f for f in folders if there[f])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    failure = F.when(file_kind(F.col("path")) == "unsupported", "unsupported").when(F.col("length") == 0, "empty")
    columns = ["path", "length", F.unix_millis("modificationTime").alias("modified_unix_ms"), file_kind(F.col("path")).alias("kind"), failure.alias("failure")]
    return files.select(*columns, *(["content"] if content else [])).dropDuplicates(["path"]).unionByName(lost)


def fingerprints(files: DataFrame) -> DataFrame:
    """Add the digest of the whole content and the quick fingerprint of size and edges; the content is dropped."""
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("quick_fingerprint", quick_fingerprint(F.col("content"))).drop("content")
