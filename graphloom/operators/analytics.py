"""Degrees, centrality, communities, layers and summaries of the symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import vocabulary as V
from ..storage import materialise
from .propagation import propagate

ITERATIONS, DAMPING = 20, 0.85
ROUNDS, LEAST_MEMBERS = 20, 3


def degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every symbol; parallel edges of different types count each.

    Both ends are counted in one pass over the edges, so there is one shuffle and one join instead of two.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("tgt").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum("e.i").cast("int").alias("in_degree"), F.sum("e.o").cast("int").alias("out_degree"))
    return symbols.select("id").join(counts, "id", "left").fillna(0, ["in_degree", "out_degree"])


def pagerank(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, digits: int | None = 6) -> DataFrame:
    """id, pagerank of every end of an edge, after a fixed number of rounds; parallel edges weigh each.

    Nodes are numbered once and edges carry the numbers, grouped to one row for each pair with its weight. A round is one join
    and one aggregation; the ranks of nodes without outgoing edges meet in the group of edges without target, whose sum is
    spread evenly. Each round's ranks are a table in the shared folder.
    """
    names = edges.select(F.col("src").alias("id")).union(edges.select("tgt")).distinct()
    nodes = materialise(names.select("id", F.xxhash64("id").alias("n")), "nodes")
    total = nodes.count()
    if not total:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    pairs = edges.groupBy(F.xxhash64("src").alias("s"), F.xxhash64("tgt").alias("t")).agg(F.count("*").alias("w"))
    out = pairs.groupBy("s").agg(F.sum("w").alias("out"))
    weighted = pairs.join(out, "s").select("s", "t", (F.col("w") / F.col("out")).alias("share"))
    sinks = nodes.join(weighted.select(F.col("s").alias("n")).distinct(), "n", "left_anti").select(F.col("n").alias("s"), F.lit(None).cast("long").alias("t"), F.lit(1.0).alias("share"))
    links = materialise(weighted.union(sinks).repartition("s"), "links")
    ranks = nodes.select("n", F.lit(1.0 / total).alias("rank"))
    for _ in range(iterations):
        sums = materialise(links.join(ranks, F.col("s") == F.col("n")).groupBy("t").agg(F.sum(F.col("rank") * F.col("share")).alias("got")), "sums")
        lost = sums.where("t is null").select("got").first()
        base = (1 - damping) / total + damping * (lost[0] if lost else 0.0) / total
        ranks = nodes.select("n").join(sums.where("t is not null"), F.col("n") == F.col("t"), "left").select("n", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
    value = F.round("rank", digits) if digits is not None else F.col("rank")
    return nodes.join(ranks, "n").select("id", value.alias("pagerank"))


def label_propagation(symbols: DataFrame, edges: DataFrame | list[DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """id, label: every symbol takes the commonest label among its neighbours and itself, the smallest of equals, all at once.

    The result is that of ``rounds`` rounds; of those that would only repeat labels, or swap them to and fro, none is run.
    Edges may come in parts, which are read one after another, so that the room each needs on disk is free before the next.
    """
    return propagate(symbols, edges, rounds)


def clusters(symbols: DataFrame, edges: DataFrame | list[DataFrame], rounds: int = ROUNDS, least: int = LEAST_MEMBERS) -> DataFrame:
    """id, cluster_id: communities of at least ``least`` members numbered from 1 by their smallest member, 0 for all others."""
    labels = label_propagation(symbols, edges, rounds)
    groups = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)
    numbered = groups.withColumn("cluster_id", F.row_number().over(W.orderBy("first")))  # one row for each community
    return labels.join(numbered.select("label", "cluster_id"), "label", "left").select("id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


def layers(symbols: DataFrame) -> DataFrame:
    return symbols.select("*", X.layer(F.col("kind"), F.col("qualified_name"), F.col("name")).alias("layer"))


def layer_counts(symbols: DataFrame) -> DataFrame:
    """layer, cnt, all six layers."""
    every = symbols.sparkSession.createDataFrame([(x,) for x in V.LAYERS], "layer string")
    return every.join(layers(symbols).groupBy("layer").count(), "layer", "left").select("layer", F.coalesce("count", F.lit(0)).cast("long").alias("cnt"))


def with_ends(symbols: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """Edges with the given columns of both ends, as s_... and t_...; edges with an unknown end are left out."""
    one = lambda p, key: symbols.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    return edges.join(one("s", "src"), "src").join(one("t", "tgt"), "tgt")


def bridges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between languages by pair and type: their count and the symbols at either end."""
    crossing = with_ends(symbols, edges, "language").where("s_language <> t_language")
    return crossing.groupBy(F.col("s_language").alias("source_language"), F.col("t_language").alias("target_language"), "edge_type").agg(
        F.count("*").alias("edge_count"), F.array_sort(F.collect_set("src")).alias("source_symbol_ids"), F.array_sort(F.collect_set("tgt")).alias("target_symbol_ids")
    )


def bridge_coverage(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    crossing = with_ends(symbols, edges, "language").where("s_language <> t_language")
    return crossing.agg(
        F.count("*").alias("total_edges"), F.count("confidence").alias("with_confidence"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"),
        F.count_if(F.col("confidence") < 0.8).alias("low_confidence"),
    )


def project_stats(symbols: DataFrame) -> DataFrame:
    return symbols.agg(
        F.count("*").alias("total_symbols"), F.countDistinct("language").alias("language_count"), F.countDistinct("kind").alias("kind_count"), F.countDistinct("file_id").alias("file_count")
    )


def counts_by(symbols: DataFrame, column: str) -> DataFrame:
    return symbols.groupBy(column).agg(F.count("*").alias("cnt"))


def source_stats(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("source_id").agg(
        F.count("*").alias("symbol_count"), F.countDistinct("file_id").alias("file_count"), F.countDistinct("language").alias("language_count"),
        F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("kind")).alias("kinds"),
    )


def namespace_stats(symbols: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` largest namespaces of at least two symbols."""
    by = symbols.groupBy(X.namespace(F.col("qualified_name"), F.col("name")).alias("namespace")).agg(
        F.count("*").alias("symbol_count"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("language")).alias("languages")
    )
    return by.where("symbol_count >= 2").orderBy(F.desc("symbol_count"), "namespace").limit(limit)


def file_coverage(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """source_id, total_files, parsed_files, coverage (percent) of (id, source_id) files and (file_id) parsed ones."""
    hit = parsed.select(F.col("file_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    by = files.join(hit, "id", "left").groupBy("source_id").agg(F.countDistinct("id").alias("total_files"), F.countDistinct(F.when(F.col("hit") == 1, F.col("id"))).alias("parsed_files"))
    return by.withColumn("coverage", F.round(100 * F.col("parsed_files") / F.col("total_files")).cast("long"))


def summary_text(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a sentence on size, languages and kinds, five of each and how many more."""

    def listed(column: str):
        by = counts_by(symbols, column)
        w = W.orderBy(F.desc("cnt"), column)  # over one row for each language or kind
        ranked = by.withColumn("r", F.row_number().over(w))
        text = F.concat(F.col(column), F.lit(" ("), F.col("cnt").cast("string"), F.lit(")"))
        return ranked.agg(
            F.concat(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", text.alias("t"))))), lambda x: x["t"]), ", "),
                F.when(F.count("*") > 5, F.concat(F.lit(", and "), (F.count("*") - 5).cast("string"), F.lit(" more"))).otherwise(""),
            ).alias(f"{column}_text")
        )

    stats = project_stats(symbols).crossJoin(edges.agg(F.count("*").alias("edge_count"))).crossJoin(listed("language")).crossJoin(listed("kind"))  # one row each
    return stats.select(
        F.concat(
            F.lit("This project contains "), F.col("total_symbols").cast("string"), F.lit(" symbols across "), F.col("file_count").cast("string"), F.lit(" files with "), F.col("edge_count").cast("string"),
            F.lit(" edges. Languages: "), "language_text", F.lit(". Primary symbol kinds: "), "kind_text", F.lit("."),
        ).alias("summary")
    )


def top_by_degree(symbols: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` symbols that most edges point to."""
    return symbols.join(degrees(symbols, edges), "id").where("in_degree > 0").orderBy(F.desc("in_degree"), "id").limit(k).select("id", "name", "kind", "language", "in_degree")


def analytics_table(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, scope_id, analytics (JSON), summary: one row for the project, each layer, source, namespace and bridge.

    Bridges are keyed by both languages and the edge type, so no row overwrites another.
    """

    def packed(df: DataFrame, scope: str, key, *columns: str, summary=None) -> DataFrame:
        text = F.lit(None).cast("string") if summary is None else summary
        return df.select(F.lit(scope).alias("scope"), key.alias("scope_id"), F.to_json(F.struct(*columns)).alias("analytics"), text.alias("summary"))

    c = F.col
    overview = project_stats(symbols).crossJoin(summary_text(symbols, edges))  # one row each
    crossing = bridges(symbols, edges)
    coverage = bridge_coverage(symbols, edges)
    share = F.concat(F.round(100 * c("with_confidence") / F.greatest(c("total_edges"), F.lit(1))).cast("long").cast("string"), F.lit("% of bridging edges carry a confidence"))
    parts = [
        packed(overview, "project", F.lit("overview"), "total_symbols", "language_count", "kind_count", "file_count", summary=c("summary")),
        packed(coverage, "project", F.lit("bridge_coverage"), "total_edges", "with_confidence", "avg_confidence", "low_confidence", summary=share),
        packed(layer_counts(symbols), "layer", c("layer"), "cnt"),
        packed(source_stats(symbols), "source", c("source_id"), "symbol_count", "file_count", "languages", "kinds"),
        packed(namespace_stats(symbols), "namespace", c("namespace"), "symbol_count", "kinds", "languages"),
        packed(crossing, "bridge", F.concat_ws("->", "source_language", "target_language", "edge_type"), "edge_count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def compute_all(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols with in_degree, out_degree, pagerank and layer; the analytics table). Both inputs are written once and reused."""
    s, e = materialise(symbols, "symbols"), materialise(edges, "edges")
    enriched = layers(s).join(degrees(s, e), "id").join(pagerank(e), "id", "left")
    return enriched, analytics_table(s, e)
