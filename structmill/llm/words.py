"""Words of a text, the same however it is set, encoded or laid out."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters that are not seen: soft hyphen, joiners, direction marks, fillers, variation selectors.
_UNSEEN = "[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]"
#: Tags that stand inside a word or line; any other tag parts words.
_INLINE = "a|abbr|b|big|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr"
_TAG = rf"</?(?P<inline>(?:{_INLINE})\b)?(?(inline)|[A-Za-z!?])[^<>]*>"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_ESCAPE = r"\\u(?P<hex>[0-9a-fA-F]{4})|\\[nrtbf]"
_MARKUP = re.compile(rf"{_TAG}|(?P<entity>{_ENTITY})|{_ESCAPE}|(?P<unseen>{_UNSEEN})")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")


def _plain(m: re.Match) -> str:
    if m["unseen"] or m["inline"]:
        return ""
    if m["entity"]:
        return re.sub(_UNSEEN, "", html.unescape(m["entity"]))
    if m["hex"]:
        return re.sub(_UNSEEN, "", chr(int(m["hex"], 16)))
    return " "


def words(text: str) -> list[str]:
    """Runs of letters and digits after tags, entities and escapes are resolved, folded by NFKC and case.

    An unseen character doesn't part a word; an underscore does. Text without words gives an empty list.
    """
    if text.isascii():
        if "<" in text or "&" in text or "\\" in text:
            text = _MARKUP.sub(_plain, text)
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
    else:
        text = _MARKUP.sub(_plain, text)
    return _WORD.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The words of ``words(text)``, each with the range of ``text`` it came from. Slower."""
    pieces: list[tuple[str, int, int]] = []
    at = 0

    def take(part: str, start: int) -> None:
        for m in re.finditer(r".[̀-ͯ]*", part, re.S):
            pieces.append((m[0], start + m.start(), start + m.end()))

    for m in _MARKUP.finditer(text):
        take(text[at : m.start()], at)
        if plain := _plain(m):
            pieces.append((plain, m.start(), m.end()))
        at = m.end()
    take(text[at:], at)
    out: list[tuple[str, int, int]] = []
    joined, spans = [], []
    for plain, a, b in pieces:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", plain).casefold())
        joined.append(folded)
        spans += [(a, b)] * len(folded)
    for m in _WORD.finditer("".join(joined)):
        out.append((m[0], spans[m.start()][0], spans[m.end() - 1][1]))
    return out
