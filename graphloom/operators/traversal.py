"""Walks over the typed edges: lineage, impact, cross-language traces and subgraphs.

All of them are level by level: a round joins the frontier with the edges and keeps what is new, so no path is enumerated
and the work of a round follows the frontier. Each round's result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import vocabulary as V
from ..storage import materialise


def _depth(depth: int, default: int) -> int:
    return depth if 1 <= depth <= 10 else default


def reach(edges: DataFrame, roots: DataFrame, depth: int, outgoing: bool) -> DataFrame:
    """node, depth, via, edge_type, confidence: nodes within ``depth`` hops of the roots (column node), the roots at 0.

    ``via`` is the neighbour through which a node is first found: smallest id, then edge type.
    """
    near, far = ("src", "tgt") if outgoing else ("tgt", "src")
    seen = roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("edge_type"), F.lit(None).cast("double").alias("confidence"))
    frontier = seen = materialise(seen, "reach")
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias(near)), near).groupBy(F.col(far).alias("node")).agg(F.min(F.struct(F.col(near).alias("via"), "edge_type", "confidence")).alias("m"))
        new = step.join(seen.select("node"), "node", "left_anti")
        frontier = materialise(new.select("node", F.lit(d).alias("depth"), "m.via", "m.edge_type", "m.confidence"), "reach")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def lineage_edges(edges: DataFrame, root: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """Distinct edges on some trail of at most ``depth`` hops into (upstream), out of (downstream) the root, or either.

    An edge u -> v lies on such a trail into the root exactly if v is within ``depth`` - 1 hops of it.
    """
    depth, parts = _depth(depth, 3), []
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    for name, end, outgoing in (("upstream", "tgt", False), ("downstream", "src", True)):
        if direction in (name, "both"):
            within = reach(edges, start, depth - 1, outgoing).select(F.col("node").alias(end))
            parts.append(edges.join(within, end, "left_semi").select("src", "tgt", "edge_type", "confidence"))
    return (parts[0] if len(parts) == 1 else parts[0].union(parts[1])).distinct()


def lineage_nodes(symbols: DataFrame, found: DataFrame) -> DataFrame:
    ends = found.select(F.col("src").alias("id")).union(found.select("tgt")).distinct()
    return symbols.join(ends, "id", "left_semi").select("id", "name", "qualified_name", "kind", "language")


def column_lineage(symbols: DataFrame, edges: DataFrame, root: str, direction: str = "both", depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes with their table's name, edges) of the column edges."""
    found = lineage_edges(edges.where(F.col("edge_type").isin(*V.COLUMN_EDGES)), root, direction, _depth(depth, 5))
    nodes = lineage_nodes(symbols, found).withColumn("table_name", X.parent_name(F.col("qualified_name")))
    return nodes, found


def impact(symbols: DataFrame, edges: DataFrame, root: str, change: str = "modify", depth: int = 5) -> DataFrame:
    """What depends on the root: id, depth, edge_type, severity, path (root first), is_direct."""
    depth = _depth(depth, 5)
    spark = edges.sparkSession
    seen = frontier = materialise(spark.createDataFrame([(root, 0, None, [root])], "node string, depth int, edge_type string, path array<string>"), "impact")
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("tgt"), "path"), "tgt").groupBy(F.col("src").alias("node")).agg(F.min(F.struct("path", "edge_type")).alias("m"))
        new = step.join(seen.select("node"), "node", "left_anti")
        frontier = materialise(new.select("node", F.lit(d).alias("depth"), "m.edge_type", F.concat("m.path", F.array("node")).alias("path")), "impact")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    hit = seen.where("depth > 0").join(symbols.select(F.col("id").alias("node"), "name", "kind"), "node")
    return hit.select(F.col("node").alias("id"), "name", "kind", "depth", "edge_type", X.severity(change, F.col("depth"), F.col("edge_type")).alias("severity"), "path", (F.col("depth") == 1).alias("is_direct"))


def impact_outgoing(symbols: DataFrame, edges: DataFrame, root: str, change: str = "modify", depth: int = 3) -> DataFrame:
    """The tool's view: what the root reaches (role dependency), and its callers that are not among it (role caller)."""
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    down = materialise(reach(edges, start, _depth(depth, 3), True), "down")
    direct = X.direct_severity(change, F.col("edge_type"))
    deps = down.where("depth > 0").select(F.col("node").alias("id"), F.lit("dependency").alias("role"), "depth", "edge_type", "confidence", F.when(F.col("depth") == 1, direct).alias("severity"))
    callers = reach(edges, start, 1, False).where("depth = 1").join(down.select("node"), "node", "left_anti")
    callers = callers.select(F.col("node").alias("id"), F.lit("caller").alias("role"), "depth", "edge_type", "confidence", F.lit(None).cast("string").alias("severity"))
    return deps.union(callers).join(symbols.select("id", "name"), "id").select("id", "name", "role", "depth", "edge_type", "confidence", "severity")


def trace(symbols: DataFrame, edges: DataFrame, root: str, direction: str = "full", depth: int = 5) -> DataFrame:
    """A walk either way from the root: id, side, depth, via, edge_type, confidence, from_language, language, layer, transition."""
    start, parts = edges.sparkSession.createDataFrame([(root,)], "node string"), []
    for side, outgoing in (("upstream", False), ("downstream", True)):
        if direction in (side, "full"):
            parts.append(reach(edges, start, _depth(depth, 5), outgoing).where("depth > 0").withColumn("side", F.lit(side)))
    walked = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    known = symbols.select(F.col("id").alias("node"), "language", X.layer(F.col("kind"), F.col("qualified_name"), F.col("name")).alias("layer"))
    before = symbols.select(F.col("id").alias("via"), F.col("language").alias("from_language"))
    return walked.join(known, "node").join(before, "via").select(F.col("node").alias("id"), "side", "depth", "via", "edge_type", "confidence", "from_language", "language", "layer", (F.col("from_language") != F.col("language")).alias("transition"))


def trace_summary(traced: DataFrame) -> DataFrame:
    """transitions, and the mean confidence of those that have one above 0, to two places."""
    sure = F.when(F.col("transition") & (F.col("confidence") > 0), F.col("confidence"))
    return traced.agg(F.count_if("transition").alias("transitions"), F.round(F.coalesce(F.avg(sure), F.lit(0.0)), 2).alias("avg_confidence"))


def trace_groups(traced: DataFrame) -> DataFrame:
    """Nodes by layer and language in the order of first sight."""
    return traced.groupBy("layer", "language").agg(F.count("*").alias("nodes"), F.min("depth").alias("first_depth"))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src, tgt, edge_type) with both ends in ``nodes`` (id)."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("tgt"))
    return edges.join(a, "src", "left_semi").join(b, "tgt", "left_semi").groupBy("src", "tgt", "edge_type").agg(F.max("confidence").alias("confidence"))


def subgraph(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 50, ranks: DataFrame | None = None) -> DataFrame:
    """id, depth, rank: nodes around the seeds (id), both ways, at most ``most``, in order of discovery.

    The order is depth, the discoverer's rank, outgoing before incoming, id. Beyond the first hop columns of low rank are left out.
    A level is at most ``most`` rows: the number of nodes is what is asked for.
    """
    info = symbols.select("id", "kind")
    info = info.join(ranks.select("id", "pagerank"), "id", "left") if ranks is not None else info.withColumn("pagerank", F.lit(None).cast("double"))
    first = seeds.select("id").distinct().orderBy("id").limit(most)
    frontier = materialise(first.select("id", F.lit(0).alias("depth"), F.row_number().over(W.orderBy("id")).alias("rank")), "subgraph")
    found, n = frontier, frontier.count()
    for d in range(1, depth + 1):
        if n >= most:
            break
        f = frontier.select(F.col("id").alias("from"), "rank")
        out = edges.join(F.broadcast(f), F.col("src") == F.col("from")).select(F.col("tgt").alias("id"), "rank", F.lit(0).alias("way"))
        back = edges.join(F.broadcast(f), F.col("tgt") == F.col("from")).select(F.col("src").alias("id"), "rank", F.lit(1).alias("way"))
        new = out.union(back).groupBy("id").agg(F.min(F.struct("rank", "way")).alias("m")).join(found.select("id"), "id", "left_anti").join(info, "id")
        if d > 1:
            new = new.where(~X.is_low_value(F.col("kind"), F.col("pagerank")))
        taken = new.orderBy("m.rank", "m.way", "id").limit(most - n)
        order = W.orderBy("m.rank", "m.way", "id")  # over at most ``most`` rows
        frontier = materialise(taken.select("id", F.lit(d).alias("depth"), (F.row_number().over(order) + n).alias("rank")), "subgraph")
        n += frontier.count()
        found = found.union(frontier)
    return found


def within_budget(nodes: DataFrame, budget: int, cost: str = "cost", order: tuple = ("pagerank",)) -> DataFrame:
    """The longest prefix, by falling order and id, whose costs sum to at most ``budget``.

    ``nodes`` is a subgraph, bounded by its own limit, so its running sum is one task's work.
    """
    w = W.orderBy(*(F.desc(c) for c in order), "id").rowsBetween(W.unboundedPreceding, 0)
    return nodes.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def edge_histogram(edges: DataFrame, samples: int = 10) -> DataFrame:
    """edge_type, cnt, samples: the counts and the first ``samples`` edges of each type, by their ends."""
    w = W.partitionBy("edge_type").orderBy("src", "tgt")
    first = edges.withColumn("n", F.row_number().over(w)).where(F.col("n") <= samples).groupBy("edge_type").agg(F.array_sort(F.collect_list(F.concat_ws("->", "src", "tgt"))).alias("samples"))
    return edges.groupBy("edge_type").agg(F.count("*").alias("cnt")).join(first, "edge_type")


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 10) -> list[str] | None:
    """The ids of a shortest directed path of at most ``most`` hops, the smallest by predecessor ids; None if there is none."""
    start = edges.sparkSession.createDataFrame([(source,)], "node string")
    seen = materialise(reach(edges, start, most, True), "path")
    path, node = [], target
    while node is not None:
        row = seen.where(F.col("node") == node).select("via").first()
        if row is None:
            return None
        path.append(node)
        node = row.via
    return path[::-1]
