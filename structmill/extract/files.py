"""Extraction as a Spark job: each file is a row in, a nested row out, in the partitions where the files lie."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmill.extract import braces, python
from structmill.extract.model import SCHEMA, Extraction
from structmill.functions.text import TAGGED_LINE

_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".rs": "rust"}
_EXTRACTORS: dict[str, Callable[[str, str], Extraction]] = {"python": lambda text, _: python.extract(text), **{x: braces.extract for x in ("javascript", "typescript", "go", "java", "rust")}}
_TAGGED = re.compile(TAGGED_LINE)


def extractor_version() -> str:
    """Sixteen hex digits that change with any source of the extractors, or of the rows they fill."""
    digest = hashlib.sha256()
    for source in sorted(Path(__file__).parent.glob("*.py")):
        digest.update(source.read_bytes())
    return digest.hexdigest()[:16]


def supported_suffixes() -> list[str]:
    return sorted(_LANGUAGES)


def register(suffixes: list[str], language: str, extractor: Callable[[str, str], Extraction]) -> None:
    """Adds or replaces the extractor of some suffixes; call it in a module that the workers import too."""
    _LANGUAGES.update(dict.fromkeys(suffixes, language))
    _EXTRACTORS[language] = extractor


def extract(path: str, text: str) -> dict | None:
    """The row of one file; None for suffixes without an extractor. A failing extractor leaves an error, not a crash."""
    language = _LANGUAGES.get("." + path.rpartition(".")[2].lower())
    if language is None:
        return None
    raw = text.encode("utf-8", "replace")
    plain = text.replace("\r\n", "\n")
    try:
        found = _EXTRACTORS[language](plain, language)
    except Exception as e:  # noqa: BLE001 - one broken file must not end the job
        found = Extraction([], [], [], [], [f"Error extracting file: {type(e).__name__}"])
    rationale = []
    for n, line in enumerate(plain.split("\n"), 1):
        if m := _TAGGED.match(line):
            context = next((s.name for s in reversed(found.symbols) if s.line_start <= n <= s.line_end), None)
            rationale.append((m[1].upper(), m[2].strip(), n, context))
    lines = plain.count("\n") + (0 if plain.endswith("\n") or not plain else 1)
    return dict(
        language=language, sha256=hashlib.sha256(raw).hexdigest(), file_size_bytes=len(raw), line_count=lines, symbols=[tuple(s) for s in found.symbols], imports=[tuple(i) for i in found.imports],
        exports=[tuple(e) for e in found.exports], call_edges=[tuple(c) for c in found.calls], rationale_comments=rationale, extraction_errors=found.errors,
    )


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in re.split(r", (?=\w+ (?:bigint|string|array))", SCHEMA)]
    for batch in batches:
        out = []
        for file_id, repo, path, content in zip(batch["file_id"], batch["repo"], batch["file_path"], batch["content"]):
            row = extract(path, content or "")
            if row:
                out.append({"file_id": file_id, "repo": repo, "file_path": path, **row})
        yield pd.DataFrame(out, columns=names)


def extract_files(sources: DataFrame) -> DataFrame:
    """sources: file_id, repo, file_path, content -> one nested row per file with a supported suffix.

    Null content is an empty file; rows without file_path are left out.
    """
    rows = sources.where(F.col("file_path").isNotNull()).select("file_id", "repo", "file_path", "content")
    return rows.mapInPandas(_rows, SCHEMA)
