"""Program sources: Java, C#, JavaScript and TypeScript, classic ASP, Delphi.

Each extractor blanks comments, finds declarations by pattern, gives every reference the innermost declaration around it,
and looks for SQL in string literals where the language's data access libraries take it.
"""

from __future__ import annotations

import re

from .facts import Facts, Lines, looks_like_sql

_STRING = r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)"


def _blank(text: str, pattern: str) -> str:
    """Comments turned into spaces, so that offsets stay."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:1] not in "\"'`@$" else m[0], text, flags=re.S)


_C_COMMENTS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|/\*.*?\*/"


def _block_end(text: str, at: int) -> int:
    """Behind the brace block that opens at or after ``at``; the line's end if none opens before a semicolon."""
    depth = 0
    for m in re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[{};]").finditer(text, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif c == ";" and not depth:
            return m.end()
    return len(text)


class _Scopes:
    """Declared ranges; the innermost around an offset names what a reference comes from."""

    def __init__(self):
        self.ranges: list[tuple[int, int, str]] = []

    def add(self, start: int, end: int, name: str) -> None:
        self.ranges.append((start, end, name))

    def at(self, offset: int, but: str = "") -> str:
        inside = [(e - s, n) for s, e, n in self.ranges if s <= offset < e and n != but]
        return min(inside)[1] if inside else ""


def _text_of(m: re.Match, group: int) -> str:
    return next((x for x in m.groups()[group - 1 : group + 2] if x is not None), "")


def _types(base: str) -> list[str]:
    """Names in a list of base types, type arguments left out."""
    return [x.strip().split(".")[-1] for x in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", base)).split(",") if x.strip()]


def _marks(src: str, bare: str, at: int) -> str:
    """What stands between the last declaration and ``at``; ``bare`` is ``src`` without strings, what is in parentheses ends nothing."""
    begin, depth = at, 0
    while begin and (depth or bare[begin - 1] not in ";{}"):
        begin -= 1
        depth = max(0, depth + (bare[begin] == ")") - (bare[begin] == "("))
    return src[begin:at]


def _mappings(f: Facts, src: str, bare: str, at: int, source: str, line: Lines) -> None:
    """References of the declaration at ``at`` to what its mapping annotations name: the first literal of each, unless empty."""
    for m in re.compile(r"@[\w.]*Mapping\w*\s*\(").finditer(bare, at - len(_marks(src, bare, at)), at):
        end, depth = m.end(), 1
        while end < at and depth:
            depth += (bare[end] == "(") - (bare[end] == ")")
            end += 1
        path = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"").search(src, m.end(), end)
        if path and path[1]:
            f.ref(source, path[1], "references", line(m.start()))


def java(path: str, text: str) -> Facts:
    f, line, scopes = Facts(), Lines(text), _Scopes()
    src = _blank(text, _C_COMMENTS)
    bare = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda x: " " * len(x[0]), src)
    package = (re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", src) or [None, ""])[1]
    if package:
        f.symbol(package.split(".")[-1], package, "package", 1)
    for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", src):
        f.ref(package, m[1].split(".")[-1], "imports", line(m.start(1)), m[1])
    for m in re.finditer(r"\b(class|interface|enum|record)\s+(\w+)(?:\s*<[^{]*?>)?([^{;]*)\{", src):
        outer = scopes.at(m.start())
        full = ".".join(x for x in (outer or package, m[2]) if x)
        end = _block_end(src, m.end() - 1)
        kind = {"record": "class"}.get(m[1], m[1])
        f.symbol(m[2], full, kind, line(m.start()), line(end), parent=outer)
        scopes.add(m.start(), end, full)
        for word, kind_ in (("extends", "inherits"), ("implements", "implements")):
            found = re.search(rf"\b{word}\s+(.*?)(?=\bimplements\b|\bextends\b|$)", m[3], re.S)
            for name in _types(found[1]) if found else []:
                f.ref(full, name, kind_, line(m.start()))
        repository = re.search(r"\b(?:Jpa|Crud|PagingAndSorting|Mongo)Repository\s*<\s*(\w+)", m[3])
        marks = _marks(src, bare, m.start())
        table = re.search(r"@Table\s*\([^)]*?name\s*=\s*\"([^\"]+)\"", marks)
        if table or "@Entity" in marks:
            f.ref(full, table[1] if table else m[2], "uses_table", line(m.start()), confidence=0.95 if table else 0.85)
        for q in re.finditer(r"@Named(?:Native)?Query\s*\([^)]*?query\s*=\s*\"([^\"]*)\"", marks):
            f.sql(q[1], line(m.start()), full, "")
        _mappings(f, src, bare, m.start(), full, line)
        if repository:
            f.ref(full, repository[1], "uses_table", line(m.start()), confidence=0.85)
            for d in re.finditer(r"\b(?:find|get|read|count|exists|delete|query)\w*By\w*\s*\(", src[m.end() : end]):
                f.ref(full, repository[1], "uses_table", line(m.end() + d.start()), confidence=0.8)
    for m in re.finditer(r"(?m)(?:^|(?<=[{};]))[ \t]*((?:@\w+(?:\([^)\n]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]+>\s+)?([\w.<>\[\], ?]+?)\s+(\w+)\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:throws\s+[\w., ]+)?\s*([{;])", src):
        owner = scopes.at(m.start(3))
        if not owner or m[2].split()[-1] in ("return", "new", "throw", "else", "case") or m[3] in ("if", "for", "while", "switch", "catch"):
            continue
        end = _block_end(src, m.end() - 1) if m[5] == "{" else m.end()
        full = f"{owner}.{m[3]}"
        f.symbol(m[3], full, "method", line(m.start(3)), line(end), f"{m[2].strip()} {m[3]}({' '.join(m[4].split())})", owner)
        scopes.add(m.start(), end, full)
        _mappings(f, src, bare, m.start(3), full, line)
    for m in re.finditer(r"(?m)(?:^|(?<=[{};]))[ \t]*(?:private|protected|public)\s+(?:static\s+|final\s+)*([\w.<>\[\], ?]+?)\s+(\w+)\s*(?:=[^;]*)?;", src):
        owner = scopes.at(m.start())
        if owner:
            f.symbol(m[2], f"{owner}.{m[2]}", "field", line(m.start(2)), None, m[1], owner)
    for m in re.finditer(rf"@Query\s*\(\s*(?:value\s*=\s*)?{_STRING}", src):
        f.sql(_text_of(m, 1), line(m.start()), scopes.at(m.start()), "")
    for m in re.finditer(rf"\b(prepareStatement|prepareCall|createNativeQuery|createQuery|executeQuery|executeUpdate|execute|query|update|queryForObject|queryForList)\s*\(\s*{_STRING}", src):
        if looks_like_sql(_text_of(m, 2)):
            f.sql(re.sub(r"^\{?\s*(?:\?\s*=\s*)?call\s+", "EXEC ", _text_of(m, 2), flags=re.I), line(m.start()), scopes.at(m.start()), "dbo")
    return f


def csharp(path: str, text: str) -> Facts:
    f, line, scopes = Facts(), Lines(text), _Scopes()
    src = _blank(text, r"@?\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|//[^\n]*|/\*.*?\*/")
    bare = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda x: " " * len(x[0]), src)
    file_space = ""
    for m in re.finditer(r"(?m)^\s*namespace\s+([\w.]+)\s*([{;]?)", src):
        f.symbol(m[1].split(".")[-1], m[1], "module", line(m.start(1)))
        if m[2] == ";":
            file_space = m[1]
        else:
            scopes.add(m.start(), _block_end(src, m.end() - 1), m[1])
    for m in re.finditer(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", src):
        f.ref(file_space, m[1].split(".")[-1], "imports", line(m.start(1)), m[1])
    for m in re.finditer(r"\b(class|interface|struct|enum|record)\s+(\w+)(?:<[^>{]*>)?\s*(?:\([^)]*\))?\s*(?::\s*([^{;]+?))?\s*(?:where[^{]*)?\{", src):
        outer = scopes.at(m.start()) or file_space
        full = f"{outer}.{m[2]}" if outer else m[2]
        end = _block_end(src, m.end() - 1)
        kind = {"struct": "class", "record": "class"}.get(m[1], m[1])
        f.symbol(m[2], full, kind, line(m.start()), line(end), parent=outer)
        scopes.add(m.start(), end, full)
        for base in _types(m[3] or "") if kind != "enum" else []:
            f.ref(full, base, "implements" if re.match(r"I[A-Z]", base) else "inherits", line(m.start()))
        marks = _marks(src, bare, m.start())
        table = re.search(r"\[Table\s*\(\s*\"([^\"]+)\"", marks)
        if table:
            f.ref(full, table[1], "uses_table", line(m.start()), confidence=0.95)
    for m in re.finditer(r"(?m)(?:^|(?<=[{};\]]))[ \t]*((?:(?:public|protected|private|internal|static|virtual|override|abstract|sealed|async|partial|readonly|extern|new)\s+)+)([\w.<>\[\],? ]+?)\s+(\w+)\s*(\(([^)]*)\)|\{|=>|[;=])", src):
        owner = scopes.at(m.start(3))
        if not owner or m[2].split()[0] in ("class", "interface", "struct", "enum", "record", "namespace", "delegate", "event"):
            continue
        full = f"{owner}.{m[3]}"
        if m[4].startswith("("):
            end = _block_end(src, m.end())
            f.symbol(m[3], full, "method", line(m.start(3)), line(end), f"{m[2].strip()} {m[3]}({' '.join((m[5] or '').split())})", owner)
            scopes.add(m.start(), end, full)
        else:
            f.symbol(m[3], full, "property" if m[4] in ("{", "=>") else "field", line(m.start(3)), None, m[2].strip(), owner)
            entity = re.match(r"(?:DbSet|IDbSet)\s*<\s*(\w+)", m[2])
            if entity:
                f.ref(owner, entity[1], "uses_table", line(m.start()), confidence=0.9)
            elif "virtual" in m[1] and m[4] == "{":
                target = re.match(r"(?:(?:ICollection|IList|List|IEnumerable|HashSet)\s*<\s*)?([A-Z]\w+)", m[2])
                if target and target[1] not in ("String", "DateTime", "Guid", "Decimal"):
                    f.ref(owner, target[1], "references", line(m.start()), confidence=0.85)
    literal = r"@?\$?\"((?:[^\"\\]|\\.|\"\")*)\""
    for m in re.finditer(rf"\b(\w*(?:SqlRaw|SqlInterpolated|SqlQuery|SqlCommand|Query\w*|Execute\w*|CommandText|Sql))\s*(?:<[^>()]*>)?\s*(?:\(|=)\s*(?:\w+\s*,\s*)?{literal}", src):
        value = m[2].strip()
        source = scopes.at(m.start())
        if looks_like_sql(value):
            f.sql(value, line(m.start()), source, "dbo")
        elif re.fullmatch(r"[\[\]\w.]+", value):
            name = value.replace("[", "").replace("]", "")
            f.ref(source, name, "calls", line(m.start()), name if "." in name else f"dbo.{name}", 0.85)
    for m in re.finditer(r"\.(?:Then)?Include\s*\(\s*(?:\w+\s*=>\s*\w+\.(\w+)|\"(\w+)\")", src):
        f.ref(scopes.at(m.start()), m[1] or m[2], "references", line(m.start()), confidence=0.8)
    return f


def javascript(path: str, text: str) -> Facts:
    f, line, scopes = Facts(), Lines(text), _Scopes()
    src = _blank(text, _C_COMMENTS)
    module = re.sub(r"\.\w+$", "", re.split(r"[/\\]", path)[-1])
    for m in re.finditer(r"(?:import\s+(?:[\w*{}\s,$]+\s+from\s+)?|export\s+[\w*{}\s,$]+\s+from\s+|require\s*\(\s*)['\"]([^'\"]+)['\"]", src):
        f.ref(module, m[1], "imports", line(m.start()), m[1])

    def declare(m: re.Match, name: str, kind: str, signature: str = "") -> str:
        outer = scopes.at(m.start())
        full = f"{outer}.{name}" if outer else f"{module}.{name}"
        end = _block_end(src, m.end() - 1)
        f.symbol(name, full, kind, line(m.start()), line(end), signature, outer)
        scopes.add(m.start(), end, full)
        return full

    for m in re.finditer(r"(?:@(\w+)\s*\(([^)]*)\)\s*)*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?\bclass\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+([^{]+))?\s*\{", src):
        full = declare(m, m[3], "class")
        if m[4]:
            f.ref(full, m[4], "inherits", line(m.start()))
        for name in _types(m[5] or ""):
            f.ref(full, name, "implements", line(m.start()))
        if m[1] in ("Entity", "Table"):
            named = re.search(r"['\"]([^'\"]+)['\"]", m[2] or "")
            f.ref(full, named[1] if named else m[3].lower(), "uses_table", line(m.start()), confidence=0.95)
    for m in re.finditer(r"(?:export\s+)?\binterface\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([^{]+))?\s*\{", src):
        full = declare(m, m[1], "interface")
        for name in _types(m[2] or ""):
            f.ref(full, name, "inherits", line(m.start()))
    for m in re.finditer(r"(?:export\s+)?(?:const\s+)?\benum\s+(\w+)\s*\{", src):
        declare(m, m[1], "enum")
    for m in re.finditer(r"(?:export\s+)?\btype\s+(\w+)(?:<[^=]*>)?\s*=", src):
        f.symbol(m[1], f"{module}.{m[1]}", "type", line(m.start()))
    for m in re.finditer(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?\bfunction\s*\*?\s*(\w+)\s*(?:<[^(]*>)?\(([^)]*)\)[^{;]*\{", src):
        declare(m, m[1], "function", f"({' '.join(m[2].split())})")
    for m in re.finditer(r"(?:export\s+)?\b(?:const|let|var)\s+(\w+)(?:\s*:[^=]+)?\s*=\s*(?:async\s*)?(?:function\b[^({]*\(([^)]*)\)\s*\{|(?:\(([^)]*)\)|\w+)\s*(?::[^=]+)?=>)", src):
        declare(m, m[1], "function", f"({' '.join((m[2] or m[3] or '').split())})")
    for m in re.finditer(r"(?m)(?:^|(?<=[{};]))[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(\w+)\s*\(([^)]*)\)\s*(?::\s*[\w<>\[\]|., ]+)?\s*\{", src):
        owner = scopes.at(m.start())
        if m[1] in ("if", "for", "while", "switch", "catch", "function", "return") or not any(s["qualified_name"] == owner and s["kind"] == "class" for s in f.symbols):
            continue
        declare(m, m[1], "method", f"({' '.join(m[2].split())})")
    f.symbol(module, module, "module", 1, line(len(text)))
    source = lambda at: scopes.at(at) or module
    for m in re.finditer(r"\.define\s*\(\s*['\"](\w+)['\"]", src):
        f.ref(source(m.start()), m[1], "uses_table", line(m.start()), confidence=0.95)
    for m in re.finditer(rf"\.(query|execute|raw|\$queryRaw|\$executeRaw|exec|run|all|prepare)\s*(?:<[^>(]*>)?\s*\(?\s*{_STRING}", src):
        if looks_like_sql(_text_of(m, 2)):
            f.sql(_text_of(m, 2), line(m.start()), source(m.start()), "", 0.85 if "aw" in m[1] else 0.9)
    for m in re.finditer(r"\bprisma\.(\w+)\.(?:find|create|update|delete|upsert|count|aggregate|group)\w*\s*\(", src):
        f.ref(source(m.start()), m[1], "uses_table", line(m.start()), confidence=0.8)
    for m in re.finditer(r"\b(?:knex|db)\s*(?:\.(?:from|into|table)\s*)?\(\s*['\"](\w+)['\"]", src):
        f.ref(source(m.start()), m[1], "uses_table", line(m.start()), confidence=0.9)
    return f


def asp(path: str, text: str) -> Facts:
    f, line, scopes = Facts(), Lines(text), _Scopes()
    page = re.split(r"[/\\]", path)[-1]
    for m in re.finditer(r"<!--\s*#include\s+(?:file|virtual)\s*=\s*\"([^\"]+)\"", text, re.I):
        f.ref(page, m[1], "imports", line(m.start()), m[1])
    for m in re.finditer(r"<%@\s*(\w+)([^%]*)%>", text):
        attributes = {k.lower(): v for k, v in re.findall(r"(\w+)\s*=\s*\"([^\"]*)\"", m[2])}
        if m[1].lower() == "import" and "namespace" in attributes:
            f.ref(page, attributes["namespace"], "imports", line(m.start()), attributes["namespace"])
        if m[1].lower() == "register":
            target = attributes.get("src") or attributes.get("namespace") or attributes.get("assembly", "")
            f.ref(page, target, "imports", line(m.start()), target)
        if "inherits" in attributes:
            f.ref(page, attributes["inherits"].split(".")[-1], "inherits", line(m.start()), attributes["inherits"])
        for key in ("codebehind", "codefile", "masterpagefile"):
            if key in attributes:
                f.ref(page, attributes[key], "references", line(m.start()), attributes[key])
    src = re.sub(r"(?m)^([^\"'\n]*(?:\"[^\"\n]*\"[^\"'\n]*)*)'[^\n]*", lambda m: m[1] + " " * (len(m[0]) - len(m[1])), text)
    for m in re.finditer(r"(?im)^[ \t]*(?:<%\s*)?(?:(?:public|private)\s+)?(?:default\s+)?(function|sub|class|property\s+(?:get|let|set))\s+(\w+)\s*(\([^)]*\))?", src):
        word = m[1].split()[0].lower()
        end = re.compile(rf"(?i)\bend\s+{word}\b").search(src, m.end())
        stop = end.end() if end else len(src)
        kind = {"function": "function", "sub": "procedure", "class": "class", "property": "property"}[word]
        outer = scopes.at(m.start())
        full = f"{outer}.{m[2]}" if outer else m[2]
        f.symbol(m[2], full, kind, line(m.start(2)), line(stop), m[3] or "", outer)
        scopes.add(m.start(), stop, full)
    for m in re.finditer(r"(?im)^[ \t]*const\s+(\w+)\s*=", src):
        f.symbol(m[1], m[1], "constant", line(m.start()))
    for m in re.finditer(r"(?i)CreateObject\s*\(\s*\"([^\"]+)\"", src):
        f.ref(scopes.at(m.start()) or page, m[1], "references", line(m.start()), m[1])
    joined = re.sub(r"\"\s*&\s*_[ \t]*\r?\n\s*\"", "", src)
    spans = Lines(joined)
    for m in re.finditer(r"(?i)(?:\.(?:Execute|Open)\s*\(?\s*|CommandText\s*=\s*|\b\w*sql\w*\s*=\s*(?:\w+\s*&\s*)?)\"((?:[^\"]|\"\")*)\"", joined):
        if looks_like_sql(m[1]):
            f.sql(m[1], spans(m.start()), scopes.at(m.start()) or page, "dbo")
    return f


def _pascal_literal(expression: str) -> str:
    return "".join(x.replace("''", "'") for x in re.findall(r"'((?:[^'\n]|'')*)'", expression))


def delphi(path: str, text: str) -> Facts:
    f, line, scopes = Facts(), Lines(text), _Scopes()
    for m in re.finditer(r"\{\$I(?:NCLUDE)?\s+([^}\s]+)\s*\}", text, re.I):
        f.ref("", m[1], "imports", line(m.start()), m[1])
    src = re.sub(r"'(?:[^'\n]|'')*'|\{.*?\}|\(\*.*?\*\)|//[^\n]*", lambda m: m[0] if m[0][0] == "'" else re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    unit = re.search(r"(?i)\b(?:unit|program|library)\s+([\w.]+)\s*;", src)
    module = unit[1] if unit else re.sub(r"\.\w+$", "", re.split(r"[/\\]", path)[-1])
    f.symbol(module, module, "module", line(unit.start()) if unit else 1, line(len(text)))
    for r in f.refs:
        r["from_symbol"] = module
    for m in re.finditer(r"(?i)\buses\b([^;]*);", src):
        for name in re.findall(r"([\w.]+)(?:\s+in\s+'[^']*')?\s*(?:,|$)", m[1]):
            f.ref(module, name, "imports", line(m.start()), name)
    for m in re.finditer(r"(?i)\b(\w+)\s*=\s*(?:packed\s+)?(class|record|interface)\b(?!\s+of\b)(?:\s*\(([^)]*)\))?(?!\s*;)", src):
        end = re.compile(r"(?i)\bend\s*;").search(src, m.end())
        stop = end.end() if end else len(src)
        full = f"{module}.{m[1]}"
        f.symbol(m[1], full, {"record": "type"}.get(m[2].lower(), m[2].lower()), line(m.start()), line(stop), parent=module)
        scopes.add(m.start(), stop, full)
        for n, base in enumerate(_types(m[3] or "")):
            f.ref(full, base, "implements" if n and re.match(r"I[A-Z]", base) else "inherits", line(m.start()))
        for p in re.finditer(r"(?i)\bproperty\s+(\w+)\s*:\s*([\w.]+)", src[m.end() : stop]):
            f.symbol(p[1], f"{full}.{p[1]}", "property", line(m.end() + p.start()), None, p[2], full)
    implementation = re.search(r"(?i)\bimplementation\b", src)
    start = implementation.end() if implementation else 0
    found = list(re.finditer(r"(?im)^\s*(?:class\s+)?(procedure|function|constructor|destructor)\s+([\w.]+)\s*(\([^)]*\))?", src[start:]))
    for m, following in zip(found, [*found[1:], None], strict=True):
        stop = start + following.start() if following else len(src)
        full = f"{module}.{m[2]}"
        kind = "method" if "." in m[2] else "function" if m[1].lower() == "function" else "procedure"
        f.symbol(m[2].split(".")[-1], full, kind, line(start + m.start(2)), line(stop), m[3] or "", module)
        scopes.add(start + m.start(), stop, full)
    for m in re.finditer(r"(?i)\b(?:SQL\.Text|CommandText)\s*:=\s*((?:'(?:[^'\n]|'')*'|[\s+]|\w+\([^)]*\)|\w+)+?);", src):
        value = _pascal_literal(m[1])
        if looks_like_sql(value):
            f.sql(value, line(m.start()), scopes.at(m.start()) or module, "dbo", 0.9)
    added: dict[str, list[str]] = {}
    for m in re.finditer(r"(?i)\bSQL\.Add\s*\(([^;]*)\)\s*;", src):
        added.setdefault(scopes.at(m.start()) or module, []).append(_pascal_literal(m[1]))
    for source, parts in added.items():
        if looks_like_sql(" ".join(parts)):
            f.sql(" ".join(parts), 1, source, "dbo", 0.85)
    return f


def dfm(path: str, text: str) -> Facts:
    f, line = Facts(), Lines(text)
    form = re.search(r"(?im)^\s*(?:object|inherited)\s+(\w+)\s*:\s*(\w+)", text)
    owner = form[2] if form else ""
    for m in re.finditer(r"(?im)^\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*(\w+)", text):
        f.symbol(m[1], f"{owner}.{m[1]}" if owner else m[1], "variable", line(m.start()), None, m[2], owner)
    for m in re.finditer(r"(?is)\b(?:\w*SQL\.Strings\s*=\s*\((.*?)\)\s*$|CommandText\s*=\s*((?:\s*'(?:[^']|'')*'\s*\+?)+))", text, re.M):
        value = " ".join(x.replace("''", "'") for x in re.findall(r"'((?:[^'\n]|'')*)'", m[1] or m[2]))
        if looks_like_sql(value):
            f.sql(value, line(m.start()), owner, "dbo")
    return f
