"""SQL scripts, T-SQL and PostgreSQL: one tokenizer, statements told by their leading words.

A statement is walked clause by clause on its tokens. Definitions become symbols; inside a definition (the context) tables
that are read, joined and written and procedures that are called become references. Select items, inserted columns and
assignments become column references, classified by what their expression is made of.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .facts import Facts

_TOKEN = re.compile(
    r"(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<body>\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z))|(?P<quoted>\[[^\]]*\]|\"(?:[^\"]|\"\")*\")|(?P<string>N?'(?:[^']|'')*(?:'|\Z))"
    r"|(?P<number>\d+(?:\.\d+)?)|(?P<word>[@#:]{0,2}[A-Za-z_\u0080-￿][\w@#$]*)|(?P<sign>::|<>|<=|>=|!=|\|\||.)",
    re.S,
)
# Aggregate functions; words that end a table list or cannot be an alias; words that begin a table constraint.
_AGGREGATES = frozenset("SUM COUNT AVG MIN MAX STDEV VAR STRING_AGG ARRAY_AGG COUNT_BIG".split())
_CLAUSES = frozenset("WHERE GROUP ORDER HAVING UNION EXCEPT INTERSECT FROM JOIN INNER LEFT RIGHT FULL CROSS OUTER ON SET VALUES SELECT INTO OPTION LIMIT OFFSET FETCH RETURNING WHEN USING WITH END BEGIN GO AS INSERT UPDATE DELETE MERGE EXEC EXECUTE IF ELSE WHILE RETURN DECLARE CREATE FOR WINDOW NATURAL APPLY".split())
_CONSTRAINTS = frozenset("CONSTRAINT PRIMARY FOREIGN UNIQUE CHECK KEY INDEX EXCLUDE LIKE PERIOD".split())
_STATEMENTS = frozenset("SELECT INSERT UPDATE DELETE MERGE EXEC EXECUTE CREATE PERFORM CALL".split())


@dataclass
class Token:
    kind: str  # word, quoted, string, number, sign, body
    text: str
    up: str
    line: int


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if m["body"] is not None:
            kind = "body"
        if kind == "quoted":
            out.append(Token(kind, value[1:-1].replace('""', '"'), "", line))
        elif kind != "skip":
            out.append(Token(kind, value, value.upper() if kind in ("word", "sign") else "", line))
        line += value.count("\n")
    return out


class _Script:
    def __init__(self, facts: Facts, schema: str, dialect: str):
        self.facts, self.schema, self.dialect = facts, schema, dialect

    # -- reading -----------------------------------------------------------------------------------------------------

    def name(self, t: list[Token], i: int) -> tuple[str, int]:
        """A dotted name at ``i`` and the position behind it; empty if there is none."""
        parts = []
        while i < len(t) and t[i].kind in ("word", "quoted"):
            parts.append(t[i].text)
            if i + 1 < len(t) and t[i + 1].text == ".":
                i += 2
                while i < len(t) and t[i].text == ".":
                    i += 1
                continue
            return ".".join(parts), i + 1
        return ".".join(parts), i

    def qualified(self, name: str) -> str:
        return name if "." in name or not name or name[0] in "@#" else f"{self.schema}.{name}" if self.schema else name

    @staticmethod
    def close(t: list[Token], i: int) -> int:
        """The position behind the parenthesis that opens at ``i``."""
        depth = 0
        while i < len(t):
            depth += (t[i].text == "(") - (t[i].text == ")")
            i += 1
            if not depth:
                return i
        return i

    @classmethod
    def parts(cls, t: list[Token]) -> list[list[Token]]:
        """Tokens between commas outside parentheses."""
        out, depth = [[]], 0
        for x in t:
            depth += (x.text == "(") - (x.text == ")")
            if x.text == "," and not depth:
                out.append([])
            else:
                out[-1].append(x)
        return [p for p in out if p]

    # -- statements --------------------------------------------------------------------------------------------------

    def walk(self, t: list[Token], context: str) -> None:
        i = 0
        while i < len(t):
            up = t[i].up
            if up == "CREATE" or up == "ALTER" and not context:
                i = self.create(t, i)
            elif up == "SELECT":
                i = self.select(t, i, context, context)
            elif up == "INSERT":
                i = self.insert(t, i, context)
            elif up == "UPDATE" and i + 1 < len(t) and t[i + 1].kind in ("word", "quoted"):
                i = self.update(t, i, context)
            elif up in ("DELETE", "MERGE"):
                i = self.written(t, i, context)
            elif up in ("EXEC", "EXECUTE", "CALL", "PERFORM"):
                i = self.call(t, i, context)
            else:
                i += 1

    def create(self, t: list[Token], i: int) -> int:
        line = t[i].line
        i += 1
        while i < len(t) and t[i].up in ("OR", "ALTER", "REPLACE", "TEMP", "TEMPORARY", "UNIQUE", "MATERIALIZED", "GLOBAL", "LOCAL", "UNLOGGED", "CONSTRAINT"):
            i += 1
        if i >= len(t):
            return i
        what = t[i].up
        i += 1
        while i < len(t) and t[i].up in ("IF", "NOT", "EXISTS"):
            i += 1
        kinds = {"TABLE": "table", "VIEW": "view", "PROCEDURE": "procedure", "PROC": "procedure", "FUNCTION": "function", "TRIGGER": "trigger", "TYPE": "type"}
        if what not in kinds:
            return i
        name, i = self.name(t, i)
        if not name:
            return i
        full, kind = self.qualified(name), kinds[what]
        end = t[-1].line
        if kind == "table":
            return self.table(t, i, name, full, line)
        if kind == "type":
            self.facts.symbol(name.split(".")[-1], full, kind, line)
            return i
        if kind == "view":
            self.facts.symbol(name.split(".")[-1], full, kind, line, end)
            named = []
            if i < len(t) and t[i].text == "(":
                j = self.close(t, i)
                named = [p[0].text for p in self.parts(t[i + 1 : j - 1])]
                i = j
            while i < len(t) and t[i].up not in ("SELECT", "WITH"):
                i += 1
            while i < len(t) and t[i].up != "SELECT":
                i += 1
            for column in self.view_columns(t, i, full, named):
                self.facts.symbol(column, f"{full}.{column}", "column", line, None, "", full)
            return self.select(t, i, full, full, named)
        signature, body = "", t[i:]
        if kind in ("procedure", "function"):
            if body and body[0].text == "(":
                j = self.close(body, 0)
                signature = " ".join(x.text for x in body[:j])
                body = body[j:]
            else:
                j = next((k for k, x in enumerate(body) if x.up == "AS"), 0)
                signature = " ".join(x.text for x in body[:j])
                body = body[j:]
        self.facts.symbol(name.split(".")[-1], full, kind, line, end, signature)
        if kind == "trigger":
            on = next((k for k, x in enumerate(body) if x.up == "ON"), None)
            if on is not None:
                target, after = self.name(body, on + 1)
                self.facts.ref(full, target.split(".")[-1], "uses_table", body[on].line, self.qualified(target))
                body = body[after:]
            run = next((k for k, x in enumerate(body) if x.up == "EXECUTE" and k + 1 < len(body) and body[k + 1].up in ("FUNCTION", "PROCEDURE")), None)
            if run is not None:
                target, _ = self.name(body, run + 2)
                self.facts.ref(full, target.split(".")[-1], "calls", body[run].line, self.qualified(target))
                return len(t)
        for x in body:
            if x.kind == "body" or x.kind == "string" and self.dialect == "pgsql" and len(x.text) > 20:
                inner = re.sub(r"^\$\w*\$|\$\w*\$$", "", x.text) if x.kind == "body" else x.text.strip("'").replace("''", "'")
                own = tokens(inner)
                for y in own:
                    y.line += x.line - 1
                self.walk(own, full)
        if self.dialect == "pgsql":
            return len(t)
        self.walk(body, full)
        return len(t)

    def table(self, t: list[Token], i: int, name: str, full: str, line: int) -> int:
        while i < len(t) and t[i].text != "(":
            if t[i].up in _STATEMENTS:
                return i
            i += 1
        j = self.close(t, i) if i < len(t) else i
        self.facts.symbol(name.split(".")[-1], full, "table", line, t[min(j, len(t)) - 1].line)
        for p in self.parts(t[i + 1 : j - 1]):
            if len(p) > 1 and p[0].kind in ("word", "quoted") and p[0].up not in _CONSTRAINTS and p[1].kind in ("word", "quoted"):
                self.facts.symbol(p[0].text, f"{full}.{p[0].text}", "column", p[0].line, None, p[1].text, full)
        return j

    # -- queries -----------------------------------------------------------------------------------------------------

    def clause_end(self, t: list[Token], i: int) -> int:
        """The end of the query that begins at ``i``: a closing parenthesis, a semicolon, or a statement that is not part of it."""
        depth, first = 0, i
        while i < len(t):
            x = t[i]
            depth += (x.text == "(") - (x.text == ")")
            if depth < 0 or x.text == ";" and not depth:
                return i
            if not depth and i > first and x.up in ("INSERT", "UPDATE", "DELETE", "MERGE", "EXEC", "EXECUTE", "CREATE", "DECLARE", "RETURN", "BEGIN", "IF", "WHILE") and t[i - 1].up not in ("FOR", "AFTER"):
                return i
            if not depth and i > first and x.up == "SELECT" and t[i - 1].up not in ("UNION", "ALL", "EXCEPT", "INTERSECT"):
                return i
            if not depth and x.up == "END" and not any(y.up == "CASE" for y in t[first:i]):
                return i
            i += 1
        return i

    def split_select(self, t: list[Token], i: int) -> tuple[list[list[Token]], list[Token], int]:
        """(items, tokens from FROM on, end) of the select at ``i``."""
        end = self.clause_end(t, i)
        depth = 0
        for k in range(i + 1, end):
            depth += (t[k].text == "(") - (t[k].text == ")")
            if not depth and t[k].up in ("FROM", "INTO", "UNION", "WHERE", "ORDER", "GROUP"):
                break
        else:
            k = end
        items = t[i + 1 : k]
        while items and items[0].up in ("DISTINCT", "ALL", "TOP"):
            top = items[0].up == "TOP"
            items = items[1:]
            if top and items:
                items = items[self.close(items, 0) if items[0].text == "(" else 1 :]
        return self.parts(items), t[k:end], end

    def sources(self, rest: list[Token], context: str) -> dict[str, str]:
        """References of the tables behind FROM and JOIN, and aliases (lower case) to qualified names in order."""
        aliases: dict[str, str] = {}
        i, listing = 0, False
        depth = 0
        while i < len(rest):
            x = rest[i]
            if x.text == "(":
                if i + 1 < len(rest) and rest[i + 1].up == "SELECT":
                    j = self.close(rest, i)
                    self.select(rest[i + 1 : j - 1], 0, context, "")
                    i = j
                    continue
                depth += 1
            elif x.text == ")":
                depth -= 1
            begins = x.up in ("FROM", "JOIN", "USING") and not (x.up == "USING" and i + 1 < len(rest) and rest[i + 1].text == "(") or x.text == "," and listing and not depth
            if begins and i + 1 < len(rest) and rest[i + 1].kind in ("word", "quoted"):
                name, i = self.name(rest, i + 1)
                listing = x.up != "JOIN"
                if i < len(rest) and rest[i].text == "(":  # a function
                    i = self.close(rest, i)
                    continue
                full = self.qualified(name)
                if context and name[0] not in "@#" and name.lower() not in ("inserted", "deleted"):
                    self.facts.ref(context, name.split(".")[-1], "joins" if x.up == "JOIN" else "reads_from", x.line, full)
                if i < len(rest) and rest[i].up == "AS":
                    i += 1
                if i < len(rest) and rest[i].kind in ("word", "quoted") and rest[i].up not in _CLAUSES:
                    aliases[rest[i].text.lower()] = full
                    i += 1
                aliases.setdefault(name.split(".")[-1].lower(), full)
                aliases.setdefault(name.lower(), full)
                continue
            if x.up in ("WHERE", "GROUP", "ORDER", "HAVING", "ON"):
                listing = False
            if x.up == "SELECT" and i and rest[i - 1].up in ("UNION", "ALL", "EXCEPT", "INTERSECT"):
                aliases.update({k: v for k, v in self.sources(self.split_select(rest, i)[1], context).items() if k not in aliases})
                break
            i += 1
        return aliases

    def first_column(self, e: list[Token], aliases: dict[str, str]) -> str:
        """The first column of an expression, qualified by its table where that is known."""
        i = 0
        while i < len(e):
            if e[i].kind in ("word", "quoted") and e[i].up not in _CLAUSES | {"CASE", "THEN", "AND", "OR", "NOT", "NULL", "IS", "IN", "LIKE", "BETWEEN", "DISTINCT", "OVER", "PARTITION", "BY"} and e[i].text[0] != "@":
                name, j = self.name(e, i)
                if j < len(e) and e[j].text == "(":
                    i = j + 1
                    continue
                return self.column_name(name, aliases)
            i += 1
        return ""

    def column_name(self, name: str, aliases: dict[str, str]) -> str:
        table, _, column = name.rpartition(".")
        if table:
            return f"{aliases.get(table.lower(), table)}.{column}"
        tables = list(dict.fromkeys(aliases.values()))
        return f"{tables[0]}.{column}" if len(tables) == 1 else column

    @staticmethod
    def derivation(e: list[Token]) -> str:
        ups = [x.up for x in e]
        if "CASE" in ups:
            return "conditional"
        if any(u in _AGGREGATES and k + 1 < len(e) and e[k + 1].text == "(" for k, u in enumerate(ups)):
            return "aggregate"
        if any(x.text in ("(", "+", "-", "*", "/", "%", "||", "::") for x in e) or any(x.kind in ("string", "number") for x in e):
            return "transform"
        return "direct_copy"

    def item(self, p: list[Token]) -> tuple[list[Token], str]:
        """(expression, output name) of a select item."""
        if len(p) > 2 and p[1].text == "=" and p[0].kind in ("word", "quoted") and p[0].text[0] != "@":
            return p[2:], p[0].text
        depth, at = 0, None
        for k, x in enumerate(p):
            depth += (x.text == "(") - (x.text == ")")
            if x.up == "AS" and not depth:
                at = k
        if at is not None and at + 1 < len(p):
            return p[:at], p[at + 1].text
        if len(p) > 1 and p[-1].kind in ("word", "quoted") and p[-1].up != "END" and (p[-2].kind in ("word", "quoted", "number", "string") or p[-2].text == ")"):
            return p[:-1], p[-1].text
        return p, p[-1].text if p[-1].kind in ("word", "quoted") and p[-1].up != "END" else ""

    def view_columns(self, t: list[Token], i: int, full: str, named: list[str]) -> list[str]:
        if i >= len(t):
            return named
        items, _, _ = self.split_select(t, i)
        return named or [n for n in (self.item(p)[1] for p in items) if n and n != "*"]

    def select(self, t: list[Token], i: int, context: str, target: str, named: list[str] | None = None) -> int:
        items, rest, end = self.split_select(t, i)
        aliases = self.sources(rest, context)
        if target:
            for k, p in enumerate(items):
                e, name = self.item(p)
                name = named[k] if named and k < len(named) else name
                self.column(e, aliases, f"{target}.{name}" if name and name != "*" else "", context)
        for p in items:
            for k, x in enumerate(p):
                if x.text == "(" and k + 1 < len(p) and p[k + 1].up == "SELECT":
                    self.select(p[k + 1 : self.close(p, k) - 1], 0, context, "")
        for k, x in enumerate(rest):
            if x.up in ("WHERE", "HAVING", "ON"):
                for m in range(k, len(rest)):
                    if rest[m].text == "(" and m + 1 < len(rest) and rest[m + 1].up == "SELECT":
                        self.select(rest[m + 1 : self.close(rest, m) - 1], 0, context, "")
                break
        return max(end, i + 1)

    def column(self, e: list[Token], aliases: dict[str, str], target: str, context: str) -> None:
        source = self.first_column(e, aliases)
        if source and target and not source.endswith(".*"):
            text = " ".join(x.text for x in e)
            kind = self.derivation(e)
            self.facts.column(source, target, kind, "" if kind == "direct_copy" else text, context, e[0].line)

    def insert(self, t: list[Token], i: int, context: str) -> int:
        line = t[i].line
        i += 1
        if i < len(t) and t[i].up == "INTO":
            i += 1
        name, i = self.name(t, i)
        if not name:
            return i
        full = self.qualified(name)
        if context and name[0] not in "@#":
            self.facts.ref(context, name.split(".")[-1], "writes_to", line, full)
        columns: list[str] = []
        if i < len(t) and t[i].text == "(" and not (i + 1 < len(t) and t[i + 1].up == "SELECT"):
            j = self.close(t, i)
            columns = [p[-1].text for p in self.parts(t[i + 1 : j - 1])]
            i = j
        if i < len(t) and t[i].text == "(":
            i += 1
        if i < len(t) and t[i].up == "SELECT":
            items, rest, end = self.split_select(t, i)
            aliases = self.sources(rest, context)
            for column, p in zip(columns, items, strict=False):
                self.column(self.item(p)[0], aliases, f"{full}.{column}", context or full)
            return max(end, i + 1)
        if i < len(t) and t[i].up in ("EXEC", "EXECUTE"):
            return self.call(t, i, context)
        return i

    def update(self, t: list[Token], i: int, context: str) -> int:
        line = t[i].line
        name, i = self.name(t, i + 1)
        end = self.clause_end(t, i)
        at = next((k for k in range(i, end) if t[k].up == "SET"), None)
        if at is None:
            return i
        stop, depth = end, 0
        for k in range(at + 1, end):
            depth += (t[k].text == "(") - (t[k].text == ")")
            if not depth and t[k].up in ("FROM", "WHERE"):
                stop = k
                break
        aliases = self.sources(t[stop:end], context)
        full = aliases.get(name.lower(), self.qualified(name))
        if context:
            self.facts.ref(context, full.split(".")[-1], "writes_to", line, full)
        aliases.setdefault(full.split(".")[-1].lower(), full)
        for p in self.parts(t[at + 1 : stop]):
            eq = next((k for k, x in enumerate(p) if x.text == "="), None)
            if eq and p[eq + 1 :]:
                self.column(p[eq + 1 :], aliases, f"{full}.{p[eq - 1].text}", context or full)
        return max(end, i)

    def written(self, t: list[Token], i: int, context: str) -> int:
        """DELETE and MERGE."""
        line, word = t[i].line, t[i].up
        i += 1
        while i < len(t) and t[i].up in ("FROM", "INTO", "TOP"):
            i += 1
        name, j = self.name(t, i)
        if name and t[i].up not in _CLAUSES and name[0] not in "@#":
            if context:
                self.facts.ref(context, name.split(".")[-1], "writes_to", line, self.qualified(name))
            if word == "MERGE":
                using = next((k for k in range(j, len(t)) if t[k].up == "USING"), None)
                if using is not None:
                    self.sources(t[using : using + 4], context)
        return max(j, i)

    def call(self, t: list[Token], i: int, context: str) -> int:
        line = t[i].line
        i += 1
        if i + 1 < len(t) and t[i].text.startswith("@") and t[i + 1].text == "=":
            i += 2
        name, j = self.name(t, i)
        if name and context and name[0] not in "@#" and t[i].kind in ("word", "quoted"):
            self.facts.ref(context, name.split(".")[-1], "calls", line, self.qualified(name))
        return max(j, i)


def parse(path: str, text: str, dialect: str = "tsql") -> Facts:
    facts = Facts()
    text = text.replace("{databaseOwner}", "dbo.").replace("{objectQualifier}", "")
    script = _Script(facts, "dbo" if dialect == "tsql" else "", dialect)
    batch: list[Token] = []
    lines = text.split("\n")
    for t in tokens(text):
        ends = t.up == "GO" and lines[t.line - 1].strip().upper() == "GO" if dialect == "tsql" else t.text == ";"
        if ends:
            script.walk(batch, "")
            batch = []
        else:
            batch.append(t)
    script.walk(batch, "")
    return facts
