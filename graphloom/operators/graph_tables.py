"""The symbol graph as DataFrames, and its view of the driver's tables.

symbols: id, name, qualified_name, kind, language, file_id, source_id. edges: src, tgt, edge_type, confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(df: DataFrame, id_, name, qualified, kind, language, file_id, source_id) -> DataFrame:
    values = dict(id=id_, name=name, qualified_name=qualified, kind=F.lit(kind), language=language, file_id=file_id, source_id=source_id)
    return df.select(*(v.cast("string").alias(k) for k, v in values.items()))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as packages, modules, classes, interfaces and tables."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = F.col
    of = lambda prefix, key: F.concat(F.lit(prefix + ":"), c(key).cast("string"))
    customer = table(spark, sf_dir, "customer").join(place, c("c_nationkey") == c("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(place, c("s_nationkey") == c("n_nationkey"))
    part = table(spark, sf_dir, "part")
    part_name = F.concat(c("p_name"), F.lit("_"), c("p_partkey").cast("string"))
    frames = [
        _symbol(region, of("R", "r_regionkey"), c("r_name"), c("r_name"), "package", F.lit("geo"), of("F", "r_regionkey"), c("r_name")),
        _symbol(place, of("N", "n_nationkey"), c("n_name"), F.concat_ws(".", "r_name", "n_name"), "module", F.lit("geo"), of("N", "n_nationkey"), c("r_name")),
        _symbol(customer, of("C", "c_custkey"), c("c_name"), F.concat_ws(".", "r_name", "n_name", "c_name"), "class", F.lower("c_mktsegment"), of("N", "n_nationkey"), c("r_name")),
        _symbol(supplier, of("S", "s_suppkey"), c("s_name"), F.concat_ws(".", "r_name", "n_name", "s_name"), "interface", F.lit("supply"), of("N", "n_nationkey"), c("r_name")),
        _symbol(part, of("P", "p_partkey"), part_name, F.concat_ws(".", c("p_brand"), c("p_type"), part_name), "table", F.lower("p_type"), c("p_brand"), F.lit("parts")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _edge_frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    c = F.col
    key = lambda prefix, k: F.concat(F.lit(prefix + ":"), c(k).cast("string"))
    none = F.lit(None).cast("double")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    uses = line.join(order, c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.round(F.avg("l_quantity") / 50, 4).alias("confidence"))
    return [
        table(spark, sf_dir, "nation").select(key("N", "n_nationkey"), key("R", "n_regionkey"), F.lit("contains"), none),
        table(spark, sf_dir, "customer").select(key("C", "c_custkey"), key("N", "c_nationkey"), F.lit("references"), none),
        table(spark, sf_dir, "supplier").select(key("S", "s_suppkey"), key("N", "s_nationkey"), F.lit("references"), none),
        uses.select(key("C", "o_custkey"), key("P", "l_partkey"), F.lit("uses_table"), c("confidence")),
        line.select("l_partkey", "l_suppkey").distinct().select(key("P", "l_partkey"), key("S", "l_suppkey"), F.lit("depends_on"), none),
    ]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames).toDF("src", "tgt", "edge_type", "confidence")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations contain into regions; customers and suppliers reference nations; customers use parts; parts depend on suppliers."""
    return _union(_edge_frames(spark, sf_dir))


def edge_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The rows of ``edges`` in two parts: what customers use, which needs the most room while it is found, and all others."""
    contains, customers, suppliers, uses, depends = _edge_frames(spark, sf_dir)
    return [_union([uses]), _union([contains, customers, suppliers, depends])]
