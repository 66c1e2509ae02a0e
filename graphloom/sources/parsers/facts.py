"""What an extractor finds in a file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ...functions import vocabulary as V

_READ = re.compile(rf"(?i)({'|'.join(V.READING_WORDS + V.WRITING_WORDS)})[ ]\s*([^\s,;)(]+)")
_CALL = re.compile(r"(?i)(?<![A-Z0-9_])(?:EXECUTE|EXEC) \s*([^\s,;)(]+)")
_SQL = re.compile(rf"(?<![A-Z0-9_])(?:{'|'.join(V.SQL_MARKS)})(?![A-Z0-9_])")


def looks_like_sql(text: str) -> bool:
    return bool(_SQL.search(text.strip().upper()))


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    columns: list[dict] = field(default_factory=list)

    def symbol(self, name: str, qualified: str, kind: str, line: int, end: int | None = None, signature: str = "", parent: str = "") -> None:
        row = dict(name=name, qualified_name=qualified, kind=kind, start_line=line, end_line=end or line, signature=signature, parent=parent)
        if not any(s["qualified_name"] == qualified and s["kind"] == kind for s in self.symbols):
            self.symbols.append(row)

    def ref(self, source: str, name: str, kind: str, line: int, qualified: str = "", confidence: float = 0.0) -> None:
        self.refs.append(dict(from_symbol=source, to_name=name, to_qualified=qualified, reference_type=kind, confidence=confidence, line=line))

    def column(self, source: str, target: str, derivation: str, expression: str, context: str, line: int) -> None:
        self.columns.append(dict(source_column=source, target_column=target, derivation_type=derivation, expression=expression, context=context, line=line))

    def sql(self, text: str, line: int, source: str, schema: str = "dbo", confidence: float = 0.0) -> None:
        """References of an SQL fragment."""
        prefix = schema + "." if schema else ""
        for word, name in _READ.findall(text):
            if name.upper() not in V.SQL_WORDS:
                kind = "writes_to" if word.upper() in V.WRITING_WORDS else "uses_table"
                self.ref(source, name, kind, line, prefix + name if prefix else "", confidence)
        for name in _CALL.findall(text):
            if name.upper() not in V.SQL_WORDS:
                self.ref(source, name, "calls", line, prefix + name if prefix and "." not in name else name, confidence)


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, offset)
