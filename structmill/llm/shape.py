"""What one source text looks like: banners, layout, literals, repetition, and its winnowed fingerprints."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Tokens of one shingle, and shingles of which the smallest hash is kept: a shared run of 49 tokens is always seen.
SHINGLE, WINDOW = 40, 10
#: A shorter text has one fingerprint, of all its tokens, if it has this many.
LEAST_WHOLE = 25
#: Tokens of the runs that measure how far a text repeats one shape, and the least tokens to judge.
SHAPE, LEAST_TOKENS = 12, 50

_HASH = r"""(?P<comment>\#[^\n]*)|(?P<str>[rRbBuUfF]{0,2}(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))"""
_SLASH = r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
_REST = r"|(?P<word>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<sign>[^\w\s])"
_TOKENS = {True: re.compile(_HASH + _REST, re.S), False: re.compile(_SLASH + _REST, re.S)}

_HEADER = {
    True: re.compile(r"(?:\s+|\#[^\n]*)*(?:[rR]?\"\"\".*?\"\"\")?", re.S),
    False: re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/|#![^\n]*)*", re.S),
}
#: What programs write above their output, in several languages.
_BANNER = re.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically)?[ -]?generated\b|\bcode generated\b|\bgenerated (?:by|from|with|using|on|code|file|source)\b|\bfile (?:was|is|has been) generated\b|"
    r"\bdo not (?:edit|modify) (?:this|by hand|manually)|\bdo not edit\b|\b(?:manual )?(?:changes|edits|modifications) (?:will be|are|get) (?:lost|overwritten)|"
    r"\b(?:produced|created|written|emitted) by (?:the )?[\w.-]+(?: v?[\d.]+)? (?:on|from|at)\b|\bchange the (?:template|schema|source)\b|\bmachine[ -](?:generated|written|made)\b|"
    r"\bautomatisch\b.*\b(?:erzeugt|erstellt|generiert)\b|\bnicht (?:von hand )?(?:bearbeiten|ändern)\b|\bbeim bauen überschrieben\b|"
    r"\b(?:généré|genere)\w* automatiquement\b|\bautomatiquement (?:généré|genere)|\bne pas (?:modifier|éditer)\b|\bgenerado automáticamente\b|\bautomáticamente generado\b|\bno (?:editar|modificar)\b",
    re.I,
)
_DENIAL = re.compile(r"\b(?:not|never|nicht|kein\w*|pas|jamais|no es|nunca)\b[^.;:\n]{0,20}\b(?:auto\w*[ -]?)?(?:generat|generiert|erzeugt|généré|generad)|\bhand[- ]?(?:written|edited)|\bedited by hand\b", re.I)
#: Lines that show a language or format; fixed patterns.
_SIGNS = {
    "python": re.compile(r"^\s*(?:async )?def \w+\(|^from [\w.]+ import |^import \w+(?:\.\w+)*$|^\s*class \w+.*:$", re.M),
    "script": re.compile(r"^\s*(?:import .* from [\"']|export |const \w+\s*=|(?:async )?function[ *]|(?:var|let) \w+\s*=)|=> ?\{|^!function|function\(", re.M),
    "go": re.compile(r"^package \w+$|^func |^\s*\w+ := ", re.M),
    "java": re.compile(r"^package [\w.]+;|^import [\w.]+;|^\s*(?:public|private|protected|final|static)\b.*[({;]$", re.M),
    "rust": re.compile(r"^use [\w:{}, ]+;|^\s*(?:pub(?:\(\w+\))? )?(?:fn|struct|enum|impl|static|const [A-Z_0-9]+:) ?|^\s*let (?:mut )?\w+", re.M),
    "other": re.compile(r"\A\s*<(?:!DOCTYPE|html|\?xml)|\A\s*[{\[]\s*\n?\s*\"|\A\s*\w+: .+\n\w+:|\A\s*# .+\n\n[A-Z].*\n", re.I),
}
_ACTION = frozenset("def lambda function func fn return if for while switch match yield async await".split())
_SPREAD = re.compile(r"[:\w\])>]\s*+=\s*+(?:new\s+[\w.]+\s*+(?:\[\s*+\]\s*+)*|&?\s*+(?:\[[^\[\]\n]*\]\s*+[\w.]*\s*+)|[\w.]+!?\s*+)?&?\s*+[\[{(]", re.S)


class Shape(NamedTuple):
    banner: bool
    compressed: bool
    data: bool
    runs: int
    different_runs: int
    fingerprints: np.ndarray


@lru_cache(maxsize=200_000)
def _token_hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) | 1


def _rolled(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values."""
    out = np.zeros(max(0, len(values) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + values[k : k + len(out)]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def winnowed(values: np.ndarray, shingle: int = SHINGLE, window: int = WINDOW) -> np.ndarray:
    """The smallest shingle hash of every window, once each, as signed 64-bit numbers."""
    hashes = _rolled(values, shingle)
    if len(hashes) > window:
        hashes = np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1)
    elif len(hashes):
        hashes = hashes.min(keepdims=True)
    return np.unique(hashes).view(np.int64)


def foreign(text: str, language: str) -> bool:
    """Whether a text shows signs of other languages or formats only."""
    own = "script" if language in ("javascript", "typescript", "tsx") else language
    return not _SIGNS[own].search(text) and any(p.search(text) for name, p in _SIGNS.items() if name != own)


def shape(text: str, language: str) -> Shape:
    """Empty and blank texts have no shape at all: every flag is off. They and texts of another language or format have no fingerprints."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    hashed = language == "python"
    header = _HEADER[hashed].match(text)[0]
    banner = any(_BANNER.search(line) and not _DENIAL.search(line) for line in header.split("\n"))
    hashes: list[int] = []
    kinds: list[int] = []
    literals = words = actions = bare = 0  # bare: characters of code, without those in strings
    for m in _TOKENS[hashed].finditer(text):
        kind = m.lastgroup
        if kind == "comment":
            continue
        token = m[0]
        hashes.append(_token_hash(token.lower()))
        if kind == "word":
            kinds.append(1)
            words += 1
            bare += len(token)
            actions += token in _ACTION
        elif kind == "sign":
            kinds.append(ord(token))
            bare += 1
            actions += token == ">" and len(kinds) > 1 and kinds[-2] == 61  # an arrow
        else:
            kinds.append(2)
            literals += 1
            bare += len(token) if kind == "num" else 2
    n = len(hashes)
    values, shapes = np.array(hashes, np.uint64), np.array(kinds, np.uint64)
    runs = _rolled(shapes, SHAPE) if n >= LEAST_TOKENS else shapes[:0]
    lines = sum(1 for line in text.split("\n") if line.strip()) or 1
    compressed = language in ("javascript", "typescript", "tsx") and n >= LEAST_TOKENS and bare / lines >= 100 and words > literals and actions > 0
    data = literals >= 20 and actions == 0 and words <= 0.25 * n and bool(_SPREAD.search(text))
    prints = values[:0].view(np.int64)
    if not foreign(text, language):
        prints = winnowed(values) if n >= SHINGLE else _rolled(values, n).view(np.int64) if n >= LEAST_WHOLE else prints
    return Shape(banner, compressed, data, len(runs), len(np.unique(runs)), prints)
