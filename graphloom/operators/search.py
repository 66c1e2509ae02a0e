"""Text search, ranking and vector search over symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import vocabulary as V


def is_in(column: str, values: list[str] | None) -> Column:
    """Membership; null or no values mean no filter."""
    return F.col(column).isin(*values) if values else F.lit(True)


def search(symbols: DataFrame, query: str, kinds: list[str] | None = None, languages: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Symbols whose name or qualified name contains the query, whatever the case, by name; % and _ are wildcards."""
    hit = F.col("name").ilike(f"%{query}%") | F.col("qualified_name").ilike(f"%{query}%")
    return symbols.where(hit & is_in("kind", kinds) & is_in("language", languages)).orderBy("name", "id").limit(limit)


def ranked_search(symbols: DataFrame, query: str, kinds: list[str] | None = None, languages: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Exact name first, then exact qualified name, prefix, any other hit; then by in_degree (a column)."""
    low = query.lower()
    tier = F.when(F.lower("name") == low, 0).when(F.lower("qualified_name") == low, 1).when(F.lower("name").startswith(low), 2).otherwise(3)
    hit = F.col("name").ilike(f"%{query}%") | F.col("qualified_name").ilike(f"%{query}%")
    found = symbols.where(hit & is_in("kind", kinds) & is_in("language", languages)).withColumn("tier", tier)
    return found.orderBy("tier", F.desc("in_degree"), "id").limit(limit)


def rank(symbols: DataFrame, query: str | None, seen: list[str] | None = None, focused: list[str] | None = None, weights: dict | None = None, common_substring: bool = True) -> DataFrame:
    """``symbols`` (with pagerank and in_degree) and their composite score."""
    w = weights or V.RANK_WEIGHTS
    parts = {
        "relevance": X.relevance(F.col("name"), F.col("qualified_name"), query, common_substring) if query else F.lit(0.5),
        "centrality": X.centrality(F.col("pagerank"), F.col("in_degree")),
        "focus": X.focus(F.col("id"), focused),
        "kind": X.kind_priority(F.col("kind")),
        "novelty": X.novelty(F.col("id"), seen),
    }
    return symbols.withColumn("score", sum((w[k] * v for k, v in parts.items()), F.lit(0.0)))


def semantic_symbols(symbols: DataFrame, embeddings: DataFrame, vector: list[float], k: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """The ``k`` symbols of some kinds whose embedding (symbol_id, embedding) is nearest by cosine, exactly, with distance and score."""
    near = X.cosine_distance(F.col("embedding"), F.lit([float(v) for v in vector]))
    found = symbols.where(is_in("kind", kinds)).join(embeddings.select(F.col("symbol_id").alias("id"), near.alias("distance")), "id")
    return found.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k).withColumn("score", 1 - F.col("distance"))


def semantic_search(embeddings: DataFrame, vector: list[float], k: int = 20, kinds: list | None = None) -> DataFrame:
    """vec_id, distance, score of the ``k`` nearest by cosine, exactly; the query vector is a literal, so nothing is shuffled but k rows of each task."""
    wanted = embeddings.where(F.col("label").isin(*kinds)) if kinds else embeddings
    return wanted.select("vec_id", X.cosine_distance(F.col("embedding"), F.lit([float(v) for v in vector])).alias("distance")).orderBy(F.col("distance").asc_nulls_last(), "vec_id").limit(k).withColumn("score", 1 - F.col("distance"))


def without_embeddings(symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    return symbols.join(embeddings.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic unit vector of a text for work without a model: words add +1 or -1 at their hash's place."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("at"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    spread = lambda ps: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.when(p["at"] == i, p["v"]).otherwise(0.0)))
    raw = F.element_at(F.transform(F.array(places), spread), 1)  # places and raw are bound, not computed again for each of their uses
    return F.element_at(F.transform(F.array(raw), _unit), 1)


def _unit(raw: Column) -> Column:
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(raw, lambda v: (v / F.greatest(norm, F.lit(1e-12))).cast("float"))


def filter_and_rank(symbols: DataFrame, query: str | None, kinds: list[str] | None = None, seen: list[str] | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the best symbols of the kinds, one row of total and seen counts)."""
    own = symbols.where(is_in("kind", kinds))
    counts = own.agg(F.count("*").alias("total"), F.count_if(F.col("id").isin(*(seen or [""]))).alias("seen"))
    return rank(own, query, seen).orderBy(F.desc("score"), "id").limit(limit), counts


def embed_missing(symbols: DataFrame, embeddings: DataFrame, embed=hash_embedding) -> DataFrame:
    """``embeddings`` (symbol_id, embedding) and a vector for each symbol that has none, of its describing text."""
    column = lambda c: F.col(c) if c in symbols.columns else F.lit(None).cast("string")
    text = X.embedding_text(F.col("kind"), F.col("qualified_name"), column("signature"), column("doc_comment"))
    new = without_embeddings(symbols, embeddings).select(F.col("id").alias("symbol_id"), embed(text).alias("embedding"))
    return embeddings.select("symbol_id", "embedding").unionByName(new)
