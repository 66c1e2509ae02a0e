"""Work tables in the folder that driver and executors share, and upserts of Parquet tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where a session on one machine names none (as in tests) a temporary folder is made and set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    sc.setCheckpointDir(own)
    return own


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/work/{tag}-{uuid.uuid4().hex}"


#: Spark takes a query's shuffle files away at its end, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is made and run in here are deleted as soon as it is done."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def materialise(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: its lineage ends there, and no lost executor takes it along.

    With ``release`` the shuffle files of the writing are deleted as soon as it is done.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    with released(spark) if release else contextlib.nullcontext():
        df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(df: DataFrame) -> list[str]:
    """Paths of the files that ``df`` reads."""
    jvm = df.sparkSession._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in df.inputFiles()]  # they come as encoded URIs


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table, or of what is read of one, that nothing reads any more."""
    spark, folders = df.sparkSession, {}
    for f in files(df):
        folder, name = f.rsplit("/", 1)
        folders.setdefault(folder, set()).add(name)
    path = spark._jvm.org.apache.hadoop.fs.Path
    work = path(f"{shared_dir(spark)}/work/").toUri().getPath() + "/"
    for folder, names in folders.items():
        at = path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not at.toUri().getPath().startswith(work) or not fs.exists(at):
            continue
        there = {s.getPath().getName() for s in fs.listStatus(at)}
        if any(n[0] not in "._" for n in there - names):
            for n in names & there:
                fs.delete(path(at, n), False)
        else:
            fs.delete(at, True)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by ``order`` (columns or sort expressions)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: list | None = None) -> DataFrame:
    """``new`` over ``old`` by key; ``keep`` columns stay those of the old row where there is one.

    Of new rows with one key the first by ``order`` wins; without ``order`` keys of ``new`` must be distinct.
    """
    new = latest(new, keys, order) if order else new
    new = new.select(*old.columns)
    if keep:
        held = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in keep), F.lit(True).alias("__there"))
        joined = new.join(held, keys, "left")
        new = joined.select(*(F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns))
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new``, one for each key, whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def merge_maps(old: str, new: str):
    """Shallow merge of two map columns; the new one's entries win."""
    a, b = F.coalesce(F.col(old), F.create_map().cast("map<string,string>")), F.coalesce(F.col(new), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def delete_cascade(files: DataFrame, symbols: DataFrame, edges: DataFrame, embeddings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the files of ``gone`` (file_id) and all that hangs on them."""
    dead = symbols.join(gone.select("file_id"), "file_id", "left_semi").select(F.col("id").alias("__dead"))
    return (
        files.join(gone.select(F.col("file_id").alias("__f")), F.col("id") == F.col("__f"), "left_anti"),
        symbols.join(gone.select("file_id"), "file_id", "left_anti").select(*symbols.columns),
        edges.join(dead, F.col("src") == F.col("__dead"), "left_anti").join(dead, F.col("tgt") == F.col("__dead"), "left_anti"),
        embeddings.join(dead, F.col("symbol_id") == F.col("__dead"), "left_anti"),
    )
