"""What a client can ask: one object over a project's symbols and edges, each question a DataFrame."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import analytics as A
from ..operators import search as S
from ..operators import traversal as T
from ..operators.access import Principal, clamp, visible

#: Tokens of an answer, and the lines that a table of an answer has at most by default.
BUDGET = 4000
PAGE, MOST = 20, 100
#: Seeds that a topic gives a subgraph.
SEEDS = 5


def tokens(text: str) -> int:
    return len(text.encode()) // 4


def to_markdown(df: DataFrame, title: str, budget: int = BUDGET, rows: int = MOST) -> str:
    """A heading and a table of the first rows, as many as the budget holds, and a note if there are more."""
    head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    used, out = len(head.encode()), [head]
    taken = df.limit(rows + 1).collect()
    for n, row in enumerate(taken):
        line = "| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |\n"
        if n == rows or used + len(line.encode()) > 4 * budget:
            out.append(f"\n_more rows left out after {n}_\n")
            break
        used += len(line.encode())
        out.append(line)
    return "".join(out)


def first_json_object(text: str) -> dict | None:
    """The first balanced JSON object in a text, as models wrap them in prose."""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        return json.loads(text[start : i + 1])
                    except ValueError:
                        break
    return None


@dataclass
class Session:
    """What a client has seen and asked, for novelty and focus."""

    seen: list[str] = field(default_factory=list)
    focused: list[str] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)

    def asked(self, query: str) -> None:
        self.queries = [*self.queries, query][-20:]

    def showed(self, ids: list[str]) -> None:
        self.seen = list(dict.fromkeys([*self.seen, *ids]))

    def focus(self, id_: str) -> None:
        self.focused = [id_, *(x for x in self.focused if x != id_)][:10]


class Project:
    """Symbols (id, name, qualified_name, kind, language, file_id, source_id) and edges of one project.

    ``embed`` turns a text column into vectors as those of ``embeddings`` were made.
    """

    def __init__(self, spark: SparkSession, symbols: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None, who: Principal | None = None, tenant_column: str | None = None, embed=S.hash_embedding):
        self.spark, self.edges, self.embeddings, self.embed = spark, edges, embeddings, embed
        self.symbols = visible(symbols, who, tenant_column) if who and tenant_column else symbols

    def ranked(self) -> DataFrame:
        """Symbols with degrees; pagerank is joined where it has been stored with them."""
        s = self.symbols.join(A.degrees(self.symbols, self.edges), "id")
        return s if "pagerank" in s.columns else s.withColumn("pagerank", F.lit(None).cast("double"))

    def search_symbols(self, query: str, kinds: list[str] | None = None, limit: int | None = None, session: Session | None = None) -> DataFrame:
        found = S.ranked_search(self.ranked(), query, kinds, None, clamp(limit, PAGE, MOST))
        return S.rank(found, query, session.seen if session else None, session.focused if session else None).orderBy(F.desc("score"), "id")

    def resolve(self, name: str) -> str | None:
        """The id of the best match of a name."""
        best = self.search_symbols(name, limit=10).select("id").first()
        return best[0] if best else None

    def semantic_search(self, vector: list[float], k: int = 10, kinds: list | None = None) -> DataFrame:
        return S.semantic_search(self.embeddings, vector, clamp(k, 10, MOST), kinds)

    def lineage(self, root: str, direction: str = "both", depth: int = 3) -> tuple[DataFrame, DataFrame]:
        found = T.lineage_edges(self.edges, root, direction, depth)
        return T.lineage_nodes(self.symbols, found), found

    def column_lineage(self, root: str, direction: str = "both", depth: int = 5, derivations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        nodes, found = T.column_lineage(self.symbols, self.edges, root, direction, depth)
        return nodes, found.where(S.is_in("edge_type", derivations))

    def impact(self, root: str, change: str = "modify", depth: int = 5) -> DataFrame:
        rank_of = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
        return T.impact(self.symbols, self.edges, root, change, depth).orderBy(rank_of, "depth", "id")

    def impact_outgoing(self, root: str, change: str = "modify", depth: int = 3) -> DataFrame:
        return T.impact_outgoing(self.symbols, self.edges, root, change, depth)

    def trace(self, root: str, direction: str = "full", depth: int = 5) -> DataFrame:
        return T.trace(self.symbols, self.edges, root, direction, depth)

    def subgraph(self, topic: str | None = None, seeds: list[str] | None = None, kinds: list[str] | None = None, depth: int = 2, most: int = 50, budget: int = BUDGET, verbosity: str = "standard") -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): seeds are the given ids, else the text search's hits, else the nearest by embedding (symbol_id), else the symbols of the kinds that are used most."""
        start = None
        if seeds:
            start = self.symbols.where(F.col("id").isin(*seeds)).select("id")
        elif topic:
            start = S.search(self.symbols, topic, kinds, limit=SEEDS).select("id")
            if start.isEmpty() and self.embeddings is not None and "symbol_id" in self.embeddings.columns:
                vector = self.spark.range(1).select(self.embed(F.lit(topic))).first()[0]
                start = S.semantic_symbols(self.symbols, self.embeddings, vector, SEEDS, kinds).where("distance is not null").select("id")
            if kinds and start.isEmpty():
                start = None
        if start is None:
            start = self.ranked().where(S.is_in("kind", kinds)).orderBy(F.desc("in_degree"), "id").limit(most).select("id")
        found = T.subgraph(self.symbols, self.edges, start, depth, most)
        signature = F.col("signature") if "signature" in self.symbols.columns else F.lit(None).cast("string")
        cost = X.symbol_cost(F.lit(verbosity), signature)
        nodes = found.join(self.symbols, "id").withColumn("cost", cost).withColumn("core", F.col("depth") == 0)
        kept = T.within_budget(nodes.withColumn("order", -F.col("rank")), budget - 100, order=("core", "order"))
        return kept, T.induced_edges(self.edges, kept)

    def analytics(self, scope: str = "summary") -> DataFrame:
        if scope == "summary":
            return A.summary_text(self.symbols, self.edges)
        if scope == "layers":
            return A.layer_counts(self.symbols)
        if scope in ("languages", "kinds"):
            return A.counts_by(self.symbols, scope[:-1]).orderBy(F.desc("cnt"), scope[:-1])
        if scope == "bridges":
            return A.bridges(self.symbols, self.edges).orderBy(F.desc("edge_count"), "source_language", "target_language", "edge_type")
        if scope == "coverage":
            return A.bridge_coverage(self.symbols, self.edges)
        raise ValueError(f"unknown scope: {scope}")

    def ask(self, question: str) -> tuple[str, DataFrame]:
        """(intent, rows) of a question in plain words."""
        q = F.lit(question)
        row = self.spark.range(1).select(X.intent(q), X.search_terms(q), X.kinds_in(q), X.change_type(q), X.direction(q), X.analytics_scope(q)).first()
        intent, terms, kinds, change, direction, scope = row
        if intent == "ranking":
            return intent, self.ranked().where(S.is_in("kind", kinds)).orderBy(F.desc("in_degree"), "id").limit(PAGE).select("id", "name", "kind", "in_degree")
        if intent == "analytics":
            return intent, self.analytics(scope)
        if intent == "overview":
            return intent, self.analytics("summary")
        if intent == "bridges":
            return intent, self.analytics("bridges")
        if intent == "relationships":
            return intent, self.subgraph(terms, kinds=["table"], depth=1, most=100)[1]
        if intent == "subgraph":
            return intent, self.subgraph(terms)[0]
        root = self.resolve(terms) if intent in ("impact", "lineage", "cross_language", "dependencies") else None
        if root is None:
            return "search", S.search(self.symbols, terms, kinds)
        if intent == "impact":
            return intent, self.impact_outgoing(root, change)
        if intent == "lineage":
            return intent, self.lineage(root, direction, 5)[1]
        if intent == "cross_language":
            return intent, self.trace(root)
        return intent, T.lineage_edges(self.edges, root, "both", 1)

    def hints(self, intent: str, root: str | None = None) -> list[str]:
        """At most three questions that follow."""
        subject = root or "a symbol of the answer"
        after = {
            "search": [f"lineage of {subject}", f"impact of a change to {subject}"], "lineage": [f"impact of a change to {subject}", f"trace {subject} across languages"],
            "impact": [f"lineage of {subject}", f"subgraph around {subject}"], "overview": ["layers", "bridges between languages", "most used symbols"],
        }
        return after.get(intent, ["overview of the project", f"search for {subject}"])[:3]
