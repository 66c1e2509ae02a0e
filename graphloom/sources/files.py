"""Source trees as DataFrames: scans, archives, snapshots and deltas, and what each file is."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Largest member of an archive that is read.
MEMBER_BYTES = 100 << 20

# Languages by file extension; .sql is told apart by its content.
LANGUAGES = {
    "sql": "sql", "asp": "asp", "aspx": "asp", "ascx": "asp", "pas": "delphi", "dpr": "delphi", "dpk": "delphi", "dfm": "dfm", "java": "java", "cs": "csharp", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "inc": "asp",
}


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, size_bytes, hash of every file below ``path``; unreadable files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").load(path)
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("hash"))


def archive_members(archives: DataFrame, most_bytes: int = MEMBER_BYTES) -> DataFrame:
    """path, content, size_bytes, hash of the files in zip archives (path, content).

    Members whose name leads out of the archive, folders and members above the cap are left out, as are broken archives.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            name = m.filename.replace("\\", "/")
                            if m.is_dir() or m.file_size > most_bytes or name.startswith("/") or ".." in name.split("/"):
                                continue
                            yield pd.DataFrame({"path": [name], "content": [z.read(m)]})
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    continue

    return archives.select("content").mapInPandas(run, "path string, content binary").select("path", "content", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("hash"))


def with_language(files: DataFrame) -> DataFrame:
    """Files of a known language, by lower-cased extension, SQL scripts by dialect."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    language = None
    for ext, name in LANGUAGES.items():
        language = F.when(extension == ext, name) if language is None else language.when(extension == ext, name)
    text = F.decode("content", "UTF-8")
    return files.withColumn("language", language).where("language is not null").withColumn("language", F.when(F.col("language") == "sql", X.dialect(text)).otherwise(F.col("language")))


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (ADDED, MODIFIED, DELETED) between two (path, hash) snapshots."""
    a, b = old.select("path", F.col("hash").alias("old")), new.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "DELETED").otherwise("MODIFIED")
    return a.join(b, "path", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", status.alias("status"))


def changed_files(files: DataFrame, delta: DataFrame) -> DataFrame:
    return files.join(delta.where("status <> 'DELETED'").select("path"), "path", "left_semi")


def repository_and_branch(uri) -> tuple:
    """Columns of ``repo@branch``; an @ before the last slash or colon belongs to the address, and main is the default."""
    branch = F.regexp_extract(uri, r"@([^@/:]+)$", 1)
    return F.regexp_replace(uri, r"@[^@/:]+$", ""), F.when(branch == "", "main").otherwise(branch)
