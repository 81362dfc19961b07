"""Whether one source text is valid in its language."""

from __future__ import annotations

from structmill.llm.lexing import effect, parses, prepared, states
from structmill.llm.vocabulary import LANGUAGES


def language_of(path: str | None) -> str | None:
    """The language that the suffix of a path stands for, None for other suffixes; TSX is a kind of its own."""
    suffix = "." + (path or "").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return "tsx" if suffix == ".tsx" else LANGUAGES.get(suffix)


def valid(text: str, language: str) -> bool:
    """The text read in one piece. Names and types need not resolve. Blank and comment-only text is valid."""
    text = prepared(text, language)
    return parses(effect(text, 0, language, states(text, language)), language)
