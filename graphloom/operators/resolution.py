"""From references to edges: tiered joins in place of look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import vocabulary as V


def first_match(candidates: DataFrame, key: str, order: list) -> DataFrame:
    """The best candidate of each key: smallest by ``order`` (column names), by aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in candidates.columns if c != key]
    best = candidates.groupBy(key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("m"))
    return best.select(key, *(f"m.{c}" for c in rest))


def suffix_index(symbols: DataFrame) -> DataFrame:
    """suffix, id, qualified_name: every dotted suffix, so that "ends with" is an equality."""
    return symbols.select(F.explode(X.dotted_suffixes(F.lower("qualified_name"))).alias("suffix"), "id", "qualified_name")


def suffix_resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref, id: the symbol, smallest by qualified name, that a partly qualified name ends."""
    found = references.select("ref", F.lower("ref").alias("suffix")).distinct().join(suffix_index(symbols), "suffix")
    return first_match(found.select("ref", "qualified_name", "id"), "ref", ["qualified_name", "id"]).select("ref", "id")


def resolve_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of raw references (ref_id, path, language, from_symbol, to_name, to_qualified, reference_type, confidence).

    ``symbols`` has id, name, qualified_name, kind, language, path, start_line. Sources: the file's own symbol, any symbol, or, for table use
    without a source, the file's first symbol. Targets in order: exact name, the file's own by short or qualified name, the only symbol of
    that short name, any by short name whatever the case, then the bridge rules between languages. References to oneself are dropped.
    """
    s = symbols.select("id", F.col("qualified_name").alias("qn"), X.short_name(F.col("qualified_name")).alias("short"), "language", "path", F.coalesce("start_line", F.lit(0)).alias("start_line"))
    r = refs.select("ref_id", "path", F.col("language").alias("from_language"), F.coalesce("from_symbol", F.lit("")).alias("from_symbol"), "to_name", F.coalesce(F.nullif("to_qualified", F.lit("")), "to_name").alias("to_q"), "reference_type", "confidence")

    def tier(left: DataFrame, right: DataFrame, on: Column, n: int, strategy: str | None = None) -> DataFrame:
        return left.join(right, on).select("ref_id", F.lit(n).alias("tier"), F.col("qn"), F.col("id"), F.lit(strategy).cast("string").alias("match_strategy"))

    own = s.select("id", "qn", "short", "start_line", F.col("path").alias("s_path"))
    source = [
        tier(r, own, (F.col("from_symbol") == F.col("qn")) & (F.col("path") == F.col("s_path")), 0),
        tier(r, own, (F.col("from_symbol") == F.col("short")) & (F.col("path") == F.col("s_path")), 1),
        tier(r, s.drop("path"), F.col("from_symbol") == F.col("qn"), 2),
    ]
    firsts = own.groupBy("s_path").agg(F.min(F.struct("start_line", "qn", "id")).alias("f")).select("s_path", "f.qn", "f.id")
    source.append(tier(r.where("from_symbol = '' and reference_type = 'uses_table'"), firsts, F.col("path") == F.col("s_path"), 3))
    sources = first_match(reduce(DataFrame.union, source), "ref_id", ["tier", "qn", "id"]).select("ref_id", F.col("id").alias("src"))

    names = s.groupBy("short").agg(F.min(F.struct("qn", "id")).alias("m"), F.countDistinct("id").alias("n"))
    only = names.where("n = 1").select("short", "m.qn", "m.id")
    low = s.groupBy(F.lower("short").alias("low")).agg(F.min(F.struct("qn", "id")).alias("m")).select("low", "m.qn", "m.id")
    target = [
        tier(r, s.drop("path"), F.col("to_q") == F.col("qn"), 0),
        tier(r, own, (F.col("to_name") == F.col("short")) & (F.col("path") == F.col("s_path")), 1),
        tier(r, own, (F.col("to_q") == F.col("short")) & (F.col("path") == F.col("s_path")), 2),
        tier(r, only, F.col("to_name") == F.col("short"), 3),
        tier(r, low, F.lower("to_name") == F.col("low"), 4),
    ]
    for n, (source_language, target_language, strategy) in enumerate(V.BRIDGE_RULES, 5):
        mine = r.where(F.col("from_language") == source_language)
        if strategy == "schema_qualified":
            keys = F.array(F.lower("to_q"), F.concat(F.lit("dbo."), F.lower("to_name")), F.lower("to_name"))
            right = s.select("id", "qn", F.lower("qn").alias("key"))
        else:
            one = {"case_insensitive": F.array(F.col("to_name")), "strip_prefix": F.array(X.strip_type_prefix(F.col("to_name"))), "orm_convention": X.orm_variants(F.col("to_name"))}[strategy]
            keys = F.transform(one, F.lower)
            right = s if strategy == "strip_prefix" else s.where(F.col("language") == target_language)
            right = right.select("id", "qn", F.lower("short").alias("key"))
        left = mine.select("ref_id", F.explode(keys).alias("k"))
        target.append(tier(left, right, F.col("k") == F.col("key"), n, f"{strategy}|{source_language}→{target_language}"))
    targets = first_match(reduce(DataFrame.union, target), "ref_id", ["tier", "qn", "id"]).select("ref_id", F.col("id").alias("tgt"), F.col("tier"), "match_strategy")
    strategy = F.substring_index("match_strategy", "|", 1)
    sure = reduce(lambda a, kv: a.when(strategy == kv[0], kv[1]), V.STRATEGY_CONFIDENCE.items(), F.when(F.lit(False), 0.0))
    joined = r.join(sources, "ref_id").join(targets, "ref_id").where("src <> tgt")
    return joined.select("ref_id", "src", "tgt", F.col("reference_type").alias("edge_type"), X.combined_confidence(F.col("confidence"), sure).alias("confidence"), strategy.alias("match_strategy"), F.when(F.contains("match_strategy", F.lit("|")), F.substring_index("match_strategy", "|", -1)).alias("bridge"), "tier")


def column_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of column references (ref_id, source_column, target_column, derivation_type, expression, context).

    Either end: exact column, exact symbol, column by suffix, symbol by suffix, column by short name, whatever the case. A target that is
    not found falls back to its table, a source to the context. Unresolved and self references are dropped.
    """
    s = symbols.select("id", "kind", F.lower("qualified_name").alias("qn"), F.lower(X.short_name(F.col("qualified_name"))).alias("short"))
    columns = s.where("kind = 'column'")
    suffixes = s.select("id", "kind", "qn", F.explode(X.dotted_suffixes(F.col("qn"))).alias("suffix"))

    def resolve(name: Column, fallback: Column, out: str) -> DataFrame:
        r = refs.select("ref_id", F.lower(name).alias("name"), F.lower(fallback).alias("fallback"))
        pick = lambda left, right, on, n: left.join(right, on).select("ref_id", F.lit(n).alias("tier"), "qn", "id")
        tiers = [
            pick(r, columns, F.col("name") == F.col("qn"), 0), pick(r, s, F.col("name") == F.col("qn"), 1),
            pick(r, suffixes.where("kind = 'column'"), F.col("name") == F.col("suffix"), 2), pick(r, suffixes, F.col("name") == F.col("suffix"), 3),
            pick(r, columns, F.col("name") == F.col("short"), 4), pick(r, s, F.col("fallback") == F.col("qn"), 5), pick(r, suffixes, F.col("fallback") == F.col("suffix"), 6),
        ]
        return first_match(reduce(DataFrame.union, tiers), "ref_id", ["tier", "qn", "id"]).select("ref_id", F.col("id").alias(out))

    src = resolve(F.col("source_column"), F.col("context"), "src")
    tgt = resolve(F.col("target_column"), X.parent_name(F.col("target_column")), "tgt")
    kind = F.col("derivation_type")
    return refs.join(src, "ref_id").join(tgt, "ref_id").where("src <> tgt").select("ref_id", "src", "tgt", X.derivation_edge(kind).alias("edge_type"), kind.alias("derivation_type"), X.derivation_confidence(kind).alias("confidence"), "expression")


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The shortest range of (file_id, start_line, end_line, id) around each point (file_id, line, point_id).

    An equality on the file and a range condition; the best range of a point is found by aggregation. Of ranges with the same
    lines only the smallest id can be the best one, and points on one line share theirs, so each is joined once.
    """
    distinct = ranges.groupBy("file_id", "start_line", "end_line").agg(F.min("id").alias("id"))
    lines = points.select("file_id", "line").distinct()
    hit = lines.join(distinct, "file_id").where("start_line <= line and line <= end_line")
    best = hit.groupBy("file_id", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id")).alias("best"))
    return first_match(points.join(best, ["file_id", "line"]).select("point_id", "best.*"), "point_id", ["span", "id"]).select("point_id", "id")


def positional_pairs(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Elements of two array columns by position, as far as both reach."""
    n = F.least(F.size(left), F.size(right))
    both = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return df.where(n > 0).select(key, F.posexplode(both).alias("pos", "p")).select(key, "pos", "p.left", "p.right")


def intra_file_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct edges of references whose both ends are symbols of their own file, by qualified name or, for targets, name."""
    source = symbols.select(F.col("path").alias("s_path"), F.col("qualified_name").alias("s_qn"), F.col("id").alias("src"))
    target = symbols.select(F.col("path").alias("t_path"), F.explode(F.array_distinct(F.array("qualified_name", "name"))).alias("t_name"), F.col("qualified_name").alias("t_qn"), F.col("id").alias("tgt"))
    named = refs.withColumn("want", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("to_qualified").alias("n")), F.struct(F.lit(1).alias("o"), F.col("to_name").alias("n")))))
    hit = named.join(source, (F.col("path") == F.col("s_path")) & (F.col("from_symbol") == F.col("s_qn"))).join(target, (F.col("path") == F.col("t_path")) & (F.col("want.n") == F.col("t_name")))
    best = hit.select("ref_id", F.col("want.o").alias("o"), "t_qn", "tgt", "src", "reference_type")
    return first_match(best, "ref_id", ["o", "t_qn", "tgt"]).where("src <> tgt").select("src", "tgt", F.col("reference_type").alias("edge_type")).distinct()


def keep_latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
