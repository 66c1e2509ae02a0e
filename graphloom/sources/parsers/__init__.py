"""Extraction of symbols, references and column lineage from source files.

Every extractor takes (path, text) and returns ``Facts``. Files are independent, so ``parse_files`` runs them in
``mapInPandas``; a file that cannot be parsed gives no facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import code, sql
from .facts import Facts

_SYMBOL = "name string, qualified_name string, kind string, start_line int, end_line int, signature string, parent string"
_REFERENCE = "from_symbol string, to_name string, to_qualified string, reference_type string, confidence double, line int"
_COLUMN = "source_column string, target_column string, derivation_type string, expression string, context string, line int"
SCHEMA = f"path string, language string, symbols array<struct<{_SYMBOL.replace(' ', ': ').replace(',:', ',')}>>, refs array<struct<{_REFERENCE.replace(' ', ': ').replace(',:', ',')}>>, column_refs array<struct<{_COLUMN.replace(' ', ': ').replace(',:', ',')}>>"

EXTRACTORS = {
    "tsql": lambda path, text: sql.parse(path, text, "tsql"),
    "pgsql": lambda path, text: sql.parse(path, text, "pgsql"),
    "java": code.java,
    "csharp": code.csharp,
    "javascript": code.javascript,
    "typescript": code.javascript,
    "asp": code.asp,
    "delphi": code.delphi,
    "dfm": code.dfm,
}


def parse_text(path: str, language: str, text: str) -> Facts:
    return EXTRACTORS[language](path, text)


def parse_files(files: DataFrame) -> DataFrame:
    """path, language and the arrays symbols, refs and column_refs of (path, language, content) files.

    ``content`` is text or UTF-8. With a boolean column skip_column_lineage, files where it is true give no column references.
    """
    skip = F.col("skip_column_lineage") if "skip_column_lineage" in files.columns else F.lit(False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, language, content, skipped in frame.itertuples(index=False):
                if language not in EXTRACTORS or content is None:
                    continue
                text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content
                try:
                    facts = parse_text(path, language, text)
                except (IndexError, ValueError, RecursionError):
                    continue
                out.append((path, language, facts.symbols, facts.refs, [] if skipped else facts.columns))
            yield pd.DataFrame(out, columns=["path", "language", "symbols", "refs", "column_refs"])

    return files.select("path", "language", "content", F.coalesce(skip, F.lit(False)).alias("skip")).mapInPandas(run, SCHEMA)


def symbols_of(parsed: DataFrame) -> DataFrame:
    """A row for each symbol; ids are digests of path, qualified name and kind."""
    s = parsed.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")
    return s.withColumn("id", F.sha2(F.concat_ws("|", "qualified_name", "kind"), 256))


def references_of(parsed: DataFrame) -> DataFrame:
    r = parsed.select("path", "language", F.posexplode("refs").alias("n", "r")).select("path", "language", "n", "r.*")
    return r.withColumn("ref_id", F.xxhash64("path", "n"))


def columns_of(parsed: DataFrame) -> DataFrame:
    c = parsed.select("path", F.posexplode("column_refs").alias("n", "c")).select("path", "n", "c.*")
    return c.withColumn("ref_id", F.xxhash64("path", "n"))
