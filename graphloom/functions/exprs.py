"""Scalar functions as Spark columns, inside code generation wherever Spark allows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _lookup(key: Column, table: dict, other) -> Column:
    """``table[key]`` as a chain of conditions, which stays in generated code."""
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain.otherwise(other)


# -- names -----------------------------------------------------------------------------------------------------------


def namespace(qualified_name: Column, name: Column) -> Column:
    """What stands before the name, ``(root)`` without a dot."""
    cut = F.length(qualified_name) - F.length(name) - 1
    return F.when(F.contains(qualified_name, F.lit(".")), F.substring(qualified_name, F.lit(1), F.greatest(cut, F.lit(0)))).otherwise("(root)")


def short_name(qualified_name: Column) -> Column:
    return F.substring_index(qualified_name, ".", -1)


def parent_name(qualified_name: Column) -> Column:
    """Without the last segment; a name of one segment stays."""
    return F.regexp_replace(qualified_name, r"\.[^.]*$", "")


def segments(qualified_name: Column) -> Column:
    """The parts between dots and slashes that are not empty."""
    return F.filter(F.split(qualified_name, r"[./\\]"), lambda x: x != "")


def dotted_suffixes(qualified_name: Column) -> Column:
    """The name and every part of it behind a dot."""
    parts = F.split(qualified_name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def orm_variants(name: Column) -> Column:
    """The name, its plural and, where it looks like a plural, its singular."""
    low, n = F.lower(name), F.length(name)
    cut = lambda k: F.substring(name, F.lit(1), n - k)
    ends = lambda *s: _any(F.endswith(low, F.lit(x)) for x in s)
    plural = F.when(ends("y") & ~ends("ey", "ay", "oy"), F.concat(cut(1), F.lit("ies"))).when(ends("s", "x", "ch", "sh"), F.concat(name, F.lit("es"))).otherwise(F.concat(name, F.lit("s")))
    single = F.when(ends("ies"), F.concat(cut(3), F.lit("y"))).when(ends("es"), cut(2)).when(ends("s") & ~ends("ss"), cut(1))
    return F.array_compact(F.array(name, plural, single))


def strip_type_prefix(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("T")) & (F.length(name) > 1), F.substring(name, F.lit(2), F.length(name))).otherwise(name)


def expand_templates(text: Column) -> Column:
    """Owner and qualifier placeholders of database scripts."""
    return F.replace(F.replace(text, F.lit("{databaseOwner}"), F.lit("dbo.")), F.lit("{objectQualifier}"), F.lit(""))


def scope_id(source: Column, target: Column) -> Column:
    return F.concat_ws("->", source, target)


# -- classification --------------------------------------------------------------------------------------------------


def layer(kind: Column, qualified_name: Column, name: Column) -> Column:
    """Kind, then segments of the name, then the suffix of class and type names, then other kinds."""
    own = segments(F.lower(qualified_name))
    low = F.lower(name)
    out = F.when(kind.isin(*V.DATA_KINDS), "data")
    for key in ("api", "data", "business", "infrastructure"):
        out = out.when(F.arrays_overlap(own, F.lit(V.LAYER_SEGMENTS[key])), key)
    for key in ("api", "data", "business", "infrastructure"):
        out = out.when(kind.isin("class", "type") & _any(F.endswith(low, F.lit(s)) for s in V.LAYER_SUFFIXES[key]), key)
    return out.when(kind.isin(*V.CROSS_CUTTING_KINDS), "cross-cutting").otherwise("unknown")


def layer_or_language(known: Column, language: Column) -> Column:
    return F.coalesce(known, _lookup(F.lower(language), V.LANGUAGE_LAYERS, "unknown"))


def kind_category(kind: Column) -> Column:
    return (
        F.when(kind.isin("table", "view", "column"), "data").when(kind.isin("procedure", "function", "method", "trigger"), "code")
        .when(kind.isin("class", "interface", "module", "package"), "container").otherwise("other")
    )


def dialect_scores(text: Column) -> tuple[Column, Column]:
    """Points for T-SQL and for PostgreSQL."""
    up = F.upper(text)
    points = lambda marks: reduce(lambda a, b: a + b, (F.when(F.contains(up, F.lit(m)), 2).otherwise(0) for m in marks))
    go = F.contains(up, F.lit("\nGO\n")) | F.contains(up, F.lit("\nGO\r\n")) | F.endswith(up, F.lit("\nGO"))
    return points(V.TSQL_MARKS) + F.when(go, 10).otherwise(0), points(V.PGSQL_MARKS)


def dialect(text: Column) -> Column:
    tsql, pgsql = dialect_scores(text)
    return F.when(tsql > pgsql, "tsql").otherwise("pgsql")


def looks_like_sql(text: Column) -> Column:
    """Whether an SQL keyword stands in the text as a word of its own."""
    return F.upper(text).rlike(rf"(?<![A-Z0-9_])(?:{'|'.join(V.SQL_MARKS)})(?![A-Z0-9_])")


def table_references(text: Column, schema: str = "dbo") -> Column:
    """array of (name, qualified, reference_type): names behind FROM, JOIN, INTO, UPDATE, DELETE, MERGE and EXEC."""
    upper_words = F.lit(list(V.SQL_WORDS))

    def after(keywords, kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?i)(?:{'|'.join(keywords)})(?=[ ])[ ]\s*([^\s,;)(]+)"), F.lit(1))
        return F.transform(F.filter(found, lambda t: ~F.array_contains(upper_words, F.upper(t))), lambda t: F.struct(t.alias("name"), F.concat(F.lit(schema + "."), t).alias("qualified"), F.lit(kind).alias("reference_type")))

    calls = F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Z0-9_])(?:EXECUTE|EXEC) \s*([^\s,;)(]+)"), F.lit(1))
    called = F.transform(
        F.filter(calls, lambda t: ~F.array_contains(upper_words, F.upper(t))),
        lambda t: F.struct(t.alias("name"), F.when(F.contains(t, F.lit(".")), t).otherwise(F.concat(F.lit(schema + "."), t)).alias("qualified"), F.lit("calls").alias("reference_type")),
    )
    return F.concat(after(V.READING_WORDS, "uses_table"), after(V.WRITING_WORDS, "writes_to"), called)


def _first_phrase(question: Column, table, other: str) -> Column:
    low, out = F.lower(question), None
    for name, phrases in table:
        hit = _any(F.contains(low, F.lit(p)) for p in phrases)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def intent(question: Column) -> Column:
    return _first_phrase(question, V.INTENTS, "search")


def tool(question: Column) -> Column:
    return _first_phrase(question, V.TOOL_FALLBACK, "search")


def search_terms(question: Column, stop_words=V.STOP_WORDS) -> Column:
    """The question's words less stop words and single letters; the question itself if none is left."""
    words = F.split(F.lower(question), r"\s+")
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, r"^[?.,!\"']+|[?.,!\"']+$", ""))
    kept = F.filter(trimmed, lambda w: (F.octet_length(w) > 1) & ~F.array_contains(F.lit(list(stop_words)), w))
    return F.when(F.size(kept) == 0, question).otherwise(F.array_join(kept, " "))


def kinds_in(question: Column) -> Column:
    """Symbol kinds that the question names, sorted."""
    low = F.lower(question)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), k) for w, k in V.KIND_WORDS.items())))))


def change_type(question: Column) -> Column:
    low = F.lower(question)
    has = lambda *s: _any(F.contains(low, F.lit(x)) for x in s)
    return F.when(has("delete", "remove", "drop"), "delete").when(has("rename"), "rename").otherwise("modify")


def direction(question: Column) -> Column:
    low = F.lower(question)
    has = lambda *s: _any(F.contains(low, F.lit(x)) for x in s)
    return F.when(has("come from", "upstream", "data source"), "upstream").when(has("written to", "downstream", "populates"), "downstream").otherwise("both")


def analytics_scope(question: Column) -> Column:
    low = F.lower(question)
    has = lambda *s: _any(F.contains(low, F.lit(x)) for x in s)
    return F.when(has("layer"), "layers").when(has("language"), "languages").when(has("kind", "type"), "kinds").otherwise("summary")


def glob_to_regex(pattern: str) -> str:
    """Of a shell pattern in which ``*`` and ``?`` do not match a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def is_schema_file(path: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Migration and schema scripts, by path, and what the project's own patterns name."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    conditions = [F.contains(low, F.lit(p)) for p in V.SCHEMA_PATHS] + [F.endswith(low, F.lit(e)) for e in V.SCHEMA_ENDINGS]
    for p in patterns:
        conditions.append(low.rlike(glob_to_regex(p.lower())))
        if not re.search(r"[*?\[\\]", p):
            conditions.append(F.contains(low, F.lit(p.lower())))
    return _any(conditions)


# -- scores ----------------------------------------------------------------------------------------------------------


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length in bytes of the longest common substring; for the short names of symbols.

    Row by row over the shorter dimension with array functions: the classic table, one row held at a time.
    """
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    nx, ny = F.octet_length(a), F.octet_length(b)
    at = lambda s, i: F.substring(s, (2 * i - 1).cast("int"), F.lit(2))
    zero = F.array_repeat(F.lit(0), ny + 1)
    start = F.struct(zero.alias("row"), F.lit(0).alias("best"))

    def step(state: Column, i: Column) -> Column:
        row = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(1), ny), lambda j: F.when(at(x, i) == at(y, j), F.get(state["row"], j - 1) + 1).otherwise(0)))
        return F.struct(row.alias("row"), F.greatest(state["best"], F.array_max(row)).alias("best"))

    return F.when((nx == 0) | (ny == 0), 0).otherwise(F.aggregate(F.sequence(F.lit(1), nx), start, step, lambda s: s["best"]))


def relevance(name: Column, qualified_name: Column, query: str, common_substring: bool = True) -> Column:
    n, q, t = F.lower(name), F.lower(qualified_name), F.lit(query.lower())
    out = (
        F.when(n == t, 1.0).when(q == t, 0.95).when(F.contains(n, t), 0.8).when(F.contains(q, t), 0.6).when(F.contains(t, n), 0.5)
    )
    if not common_substring:
        return out.otherwise(0.0)
    common = longest_common_substring(n, t)
    return out.when(common > 2, common / F.greatest(F.octet_length(n), F.octet_length(t)) * 0.4).otherwise(0.0)


def centrality(pagerank: Column, in_degree: Column) -> Column:
    by_rank = F.least(F.lit(1.0), F.log1p(1000 * pagerank) / F.log(F.lit(11.0)))
    by_degree = F.least(F.lit(1.0), F.log1p(in_degree.cast("double")) / F.log(F.lit(51.0)))
    return F.when(pagerank > 0, by_rank).when(in_degree > 0, by_degree).otherwise(0.0)


def kind_priority(kind: Column) -> Column:
    return _lookup(kind, V.KIND_PRIORITY, V.OTHER_KIND_PRIORITY)


def novelty(id_: Column, seen: list[str] | None) -> Column:
    return F.lit(0.5) if seen is None else F.when(id_.isin(*seen), 0.1).otherwise(1.0) if seen else F.lit(1.0)


def focus(id_: Column, focused: list[str] | None) -> Column:
    return F.lit(0.5) if not focused else F.when(id_.isin(*focused), 1.0).otherwise(0.3)


def severity(change: str, depth: Column, edge_type: Column) -> Column:
    """Of a dependent that an upstream walk reaches."""
    first = F.when(edge_type.isin("writes_to", "reads_from", "calls"), "critical").otherwise("high") if change == "delete" else F.when(edge_type.isin("calls", "transforms_to"), "high").otherwise("medium")
    return F.when(depth == 1, first).when(depth == 2, "medium").otherwise("low")


def direct_severity(change: str, edge_type: Column) -> Column:
    """Of a direct dependency, as the impact tool grades it."""
    if change == "delete":
        return F.when(edge_type.isin("calls", "references", "inherits", "implements"), "BREAKING").otherwise("HIGH")
    if change == "rename":
        return F.when(edge_type.isin("calls", "references"), "BREAKING").otherwise("MEDIUM")
    return F.when(edge_type.isin("calls", "inherits", "implements"), "HIGH").otherwise("LOW")


def derivation_edge(derivation: Column) -> Column:
    return _lookup(derivation, {k: v[0] for k, v in V.DERIVATION_EDGES.items()}, V.OTHER_DERIVATION[0])


def derivation_confidence(derivation: Column) -> Column:
    return _lookup(derivation, {k: v[1] for k, v in V.DERIVATION_EDGES.items()}, V.OTHER_DERIVATION[1])


def combined_confidence(parser: Column, resolver: Column) -> Column:
    return F.when((parser > 0) & (resolver > 0), parser * resolver).when(resolver > 0, resolver).otherwise(parser)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector has no length."""
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return 1 - dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4)


def symbol_cost(verbosity: Column, signature: Column) -> Column:
    """Tokens of a symbol's card: 30, 60 or 120, and its signature's in the longer forms."""
    extra = F.coalesce(token_estimate(signature), F.lit(0))
    return F.when(verbosity == "summary", F.lit(30)).when(verbosity == "full", 120 + extra).otherwise(60 + extra)


def is_low_value(kind: Column, pagerank: Column) -> Column:
    return (F.coalesce(pagerank, F.lit(0.0)) < 1e-4) & (kind == "column")


def valid_slug(slug: Column) -> Column:
    return slug.rlike(r"^[a-z0-9][a-z0-9-]{1,61}[a-z0-9]$")


def embedding_text(kind: Column, qualified_name: Column, signature: Column, doc: Column) -> Column:
    """The text of a symbol that is embedded, by kind."""
    label = F.concat(F.initcap(kind), F.lit(" "), qualified_name)
    sig = F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(" "), signature)).otherwise("")
    note = F.when(F.coalesce(doc, F.lit("")) != "", F.concat(F.lit(" — "), doc)).otherwise("")
    typed = F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(" type "), signature)).otherwise("")
    return (
        F.when(kind == "table", label).when(kind.isin("procedure", "function"), F.concat(label, sig, note)).when(kind.isin("view", "class"), F.concat(label, note))
        .when(kind.isin("trigger", "method"), F.concat(label, sig)).when(kind == "column", F.concat(label, typed))
        .otherwise(F.concat(kind, F.lit(" "), qualified_name, F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit(": "), signature)).otherwise("")))
    )
