"""Reading source text in pieces: what a piece does to a reader in each state it can be entered in.

A reader is in plain code ("") or inside something that may go on over line ends: a comment, a string, a template,
the text or a tag of an element. What it will return to lies on a stack: open brackets, and the strings, templates and
elements whose holes hold code again. A piece does not know that stack. Where it closes what it has not opened, its
account ends and goes on by what is found there: one account per state that the closing can lead back to. A file's
accounts are joined piece by piece; brackets that are closed become one symbol of the local grammar on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from structmill.llm.grammars import grammar
from structmill.llm.vocabulary import SIGNS, WORDS

#: Stands for tokens that no rule names.
OTHER = "\ue00f"

# What is open: round, square and curly brackets stand for themselves, the others for their states.
_HOLE_TEMPLATE, _HOLE_TEXT, _HOLE_TAG, _ELEMENT, _INNER_ELEMENT, _COMMENT, _INNER_COMMENT = "\ue100\ue101\ue102\ue103\ue104\ue105\ue106"
_FORMATTED = ["f'''", 'f"""', "f'", 'f"', "fr'''", 'fr"""', "fr'", 'fr"']
_HOLES_FORMATTED = {mode: chr(0xE110 + i) for i, mode in enumerate(_FORMATTED)}
#: Per open thing: what closes it ("x" ends an element, "y" a comment) and the state the reader is in then.
RETURNS = {
    "(": (")", ""), "[": ("]", ""), "{": ("}", ""),
    _HOLE_TEMPLATE: ("}", "`"), _HOLE_TEXT: ("}", "text"), _HOLE_TAG: ("}", "tag"),
    _ELEMENT: ("x", ""), _INNER_ELEMENT: ("x", "text"), _COMMENT: ("y", ""), _INNER_COMMENT: ("y", "/*"),
    **{symbol: ("}", mode) for mode, symbol in _HOLES_FORMATTED.items()},
}
_OPEN_THING = re.compile("([(\\[{\ue100-\ue11f])")
_LETTER = {"(": "P", "[": "A", "{": "B"}

# Plain code ---------------------------------------------------------------------------------------------------

_WORD = r"[^\W\d]\w*"
_SCRIPT_WORD = r"\#?(?:[^\W\d]|\$)(?:\w|\$)*"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?:[a-zA-Z]\w*)?"
_DOUBLE = r'"(?:[^"\\\n]|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]|\\.)*+'"
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TAG_OPENS = {"javascript": re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*)"), "tsx": re.compile(r"<(?:>|(?!const\b)[A-Za-z_$][\w$.:-]*(?!\s*(?:,|extends\b)|[\w$.:-]))")}

#: Per language: line comments, what opens a state of several lines, strings of one line, words, numbers.
_PARTS = {
    "python": (r"\#[^\n]*", r"(?P<f>[fFtT][rR]?|[rR][fFtT])(?P<q>'''|\"\"\"|'|\")|(?:[rRuUbB]|[bB][rR]|[rR][bB])?(?P<t>'''|\"\"\")", rf"(?:[rRuUbB]|[bB][rR]|[rR][bB])?(?:{_SINGLE}|{_DOUBLE})", _WORD, _NUMBER),
    "javascript": (r"//[^\n]*", r"(?P<t>/\*|`)", f"{_DOUBLE}|{_SINGLE}", _SCRIPT_WORD, _NUMBER),
    "go": (r"//[^\n]*", r"(?P<t>/\*|`)", rf"{_DOUBLE}|'(?:[^'\\\n]|\\[^\n][^'\n]*)'", _WORD, _NUMBER),
    "java": (r"//[^\n]*", r"(?P<t>/\*|\"\"\")", f"{_DOUBLE}|{_SINGLE}", _SCRIPT_WORD.removeprefix(r"\#?"), _NUMBER),
    "rust": (
        r"//[^\n]*",
        r"(?P<t>/\*)|(?:br|cr|r)(?P<raw>\#*)\"|(?:b|c)?(?P<q>\")(?!(?:[^\"\\\n]|\\.)*+\")",
        r"""(?:b|c)?"(?:[^"\\\n]|\\.)*+"|b?'(?:[^'\\\n]|\\[^\n][^'\n]*)'|'[^\W\d]\w*""",
        r"(?:r\#)?[^\W\d]\w*",
        r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?:[a-z]\w*)?",
    ),
}
_PARTS["typescript"] = _PARTS["tsx"] = _PARTS["javascript"]
_LINES = frozenset(("javascript", "typescript", "tsx", "go"))
_SCRIPTS = frozenset(("javascript", "typescript", "tsx"))

# Inside ---------------------------------------------------------------------------------------------------------

#: What ends or interrupts a state; what else is matched is skipped.
_STOPS = {
    "/*": r"\*/", "/*o": r"\*/", "nested": r"/\*|\*/", "`": r"\\.|`|\$\{", "go`": "`", "'''": r"\\.|'''", '"""': r'\\.|"""', '"': r'\\.|"', 'tag"': '"', "tag'": "'",
    "text": r"\{|</[\w$.:-]*\s*>|<>|<[A-Za-z_$][\w$.:-]*|[<>}]",
    "tag": r"\s+|//[^\n]*|[A-Za-z_$][\w$:.-]*|=|[\"'{]|/>|>|.",
    **{mode: rf"\\N\{{[^}}]*\}}|\\(?!\{{).|\{{\{{|\}}\}}|{mode.lstrip('fr')}|\{{" + ("" if len(mode) > 3 else r"|\n") for mode in _FORMATTED if "r" not in mode},
    **{mode: rf"\\(?!\{{).|\{{\{{|\}}\}}|{mode.lstrip('fr')}|\{{" + ("" if len(mode) > 4 else r"|\n") for mode in _FORMATTED if "r" in mode},
}


@lru_cache(maxsize=None)
def _stop(mode: str, language: str) -> re.Pattern:
    if mode.startswith("#"):  # a raw string with as many number signs
        return re.compile('"' + mode[1:])
    key = {("/*", "rust"): "nested", ("`", "go"): "go`"}.get((mode, language), mode)
    return re.compile(_STOPS[key], re.S)


#: Words after which an operand follows, so a slash begins a pattern and a smaller sign an element; fixed values.
_BEFORE_OPERAND = frozenset("return typeof case in of instanceof new delete void throw do else yield await default".split())


class _Code:
    """Plain code of one language: its tokens as characters of its local grammar."""

    def __init__(self, language: str):
        comment, opens, strings, word, number = _PARTS[language]
        signs = "|".join(re.escape(s) for s in sorted(SIGNS[language].split(), key=len, reverse=True) if s not in "()[]{}")
        line = r"\n[ \t]*+" if language == "python" else r"\n"
        blank = r"(?:[^\S\n]|\\\n)*+" if language == "python" else r"[^\S\n]*+"
        self.match = re.compile(rf"{blank}(?:(?P<line>{line})|(?P<comment>{comment})|(?P<open>{opens})|(?P<str>{strings})|(?P<word>{word})|(?P<bracket>[()\[\]{{}}])|(?P<num>{number})|(?P<sign>{signs})|(?P<end>\Z))", re.S).match
        self.grammar = grammar(language)
        chars = self.grammar.chars
        self.words = {w: chars.get(w, OTHER) for w in WORDS[language]}
        self.signs = {s: chars.get(s, OTHER) for s in SIGNS[language].split()}
        self.language = language
        self.template = chars.get("TPL", "s")
        self.keeps_lines = language in _LINES or language == "python"
        ends = "".join(chars.get(w, "") for w in ") ] } ++ -- return break continue fallthrough this super true false null yield debugger".split() + (sorted(WORDS[language] & _SOFT) if language in _SCRIPTS else []))
        self._no_line = re.compile(f"(?<![ins01{re.escape(ends + self.template)}])\n") if language in _LINES else None
        dots = "".join(re.escape(chars[d]) for d in (".", "?.") if d in chars)
        reserved = "".join(self.words.values())
        self._after_dot = re.compile(f"([{dots}]\n*)[{re.escape(reserved)}]") if language in _SCRIPTS else None
        self._goes_on = re.compile("\n+(?=[" + "".join(re.escape(chars[s]) for s in _CONTINUES if s in chars) + "])") if language in _SCRIPTS else None

    def tidy(self, content: str) -> str:
        """Line ends only where a statement can end, each once; words after a dot are names."""
        if self._after_dot and self._goes_on:
            content = self._goes_on.sub("", self._after_dot.sub(r"\1i", content))
        if self._no_line:
            return self._no_line.sub("", re.sub("\n+", "\n", content))
        return re.sub("[\n \t]+", "", content)

    def close(self, symbol: str, content: str) -> tuple[str, str] | None:
        """What stands for a thing that was open, and the state after it; None if its content can't be."""
        mode = RETURNS[symbol][1]
        if symbol in _LETTER:
            group = self.grammar.group(_LETTER[symbol], self.tidy(content))
            return None if group is None else (group, mode)
        if symbol in (_HOLE_TEMPLATE, _HOLE_TEXT, _HOLE_TAG):
            return ("", mode) if self.grammar.matches("hole", self.tidy(content).replace("\n", "")) else None
        return ("s" if symbol == _ELEMENT else "", mode)


#: What no statement of a script begins with: the line before goes on; fixed values.
_CONTINUES = ". ?. , ? : = == === != !== && || ?? * / % ** < <= > & | ^ => += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= << in instanceof extends implements".split()
#: Words that are names where no rule wants them.
_SOFT = frozenset("of from as async static get set let type interface namespace module declare abstract readonly public private protected keyof is satisfies override infer unique asserts".split())


@lru_cache(maxsize=None)
def code(language: str) -> _Code:
    return _Code(language)


#: An account: its tokens with what it leaves open; how it ends ("!" a clash, "=" and the state at the end of the
#: piece, or what it closes without having opened it); where it then goes on.
Account = tuple[str, str, int]
#: The accounts of a piece by where they begin and in which state; and where the piece begins.
Effect = tuple[int, dict[tuple[int, str], Account]]
_CLASH: Account = ("", "!", 0)


def states(text: str, language: str) -> frozenset[str]:
    """The states that a reader of this text can be in; what is never opened needs no account."""
    found = {""}
    if language == "python":
        found |= {q for q in ("'''", '"""') if q in text}
        for prefix, quote in set(re.findall(r"([fFtTrR]{1,2})('''|\"\"\"|'|\")", text)):
            if set(prefix.lower()) & set("ft"):
                found.add(("fr" if "r" in prefix.lower() else "f") + quote)
        return frozenset(found)
    if "/*" in text:
        found |= {"/*", "/*o"} if language in _SCRIPTS else {"/*"}
    if language in _SCRIPTS or language == "go":
        found |= {"`"} if "`" in text else set()
    if language in _TAG_OPENS and re.search(r"</|/>", text) and _TAG_OPENS[language].search(text):
        found |= {"text", "tag", 'tag"', "tag'"}
    if language == "java" and '"""' in text:
        found.add('"""')
    if language == "rust":
        found |= {'"'} | {f"#{n}" for n in re.findall(r"r(#*)\"", text)}
    return frozenset(found)


_NEXT = re.compile(r"\s*+(.?)", re.S)


def pieces(text: str, language: str, size: int) -> Iterator[tuple[int, str]]:
    """The text in parts of about ``size`` characters, each but the first begins with a line end.

    No part begins where a backslash continues a line, nor before a slash or smaller sign: what they mean depends on
    the token before them.
    """
    at = 0
    while len(text) - at > size:
        end = text.find("\n", at + size)
        while end > 0 and (text[end - 1] == "\\" or _NEXT.match(text, end)[1] in ("/", "<")):
            end = text.find("\n", end + 1)
        if end < 0:
            break
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def prepared(text: str, language: str) -> str:
    """Line ends as one sign, without byte order mark and interpreter line; Python begins with a line end."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if language in _SCRIPTS and text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    return "\n" + text if language == "python" else text


def effect(text: str, begin: int, language: str, known: frozenset[str]) -> Effect:
    """The accounts of one piece. The first piece of a file (``begin`` 0) is entered in plain code with nothing open."""
    lang = code(language)
    if "\0" in text:
        return begin, {(begin, mode): _CLASH for mode in ({""} if begin == 0 else known)}
    todo = [(begin, "")] if begin == 0 else [(begin, mode) for mode in sorted(known)]
    out: dict[tuple[int, str], Account] = {}
    while todo:
        key = todo.pop()
        if key in out:
            continue
        out[key] = account = _account(lang, text, key[0] - begin, key[1], begin)
        if account[1] in RETURNING and begin:
            todo += [(account[2], mode) for mode in RETURNING[account[1]] if mode in known]
        elif account[1] in RETURNING:
            out[key] = _CLASH
    return begin, out


#: The states that closing something can lead back to.
RETURNING = {c: sorted({mode for closer, mode in RETURNS.values() if closer == c}) for c in ")]}xy"}


def _account(lang: _Code, text: str, at: int, mode: str, begin: int) -> Account:
    language, match, words, signs = lang.language, lang.match, lang.words, lang.signs
    script, lines, tag_opens = language in _SCRIPTS, lang.keeps_lines, _TAG_OPENS.get(language)
    frames: list[list[str]] = [[]]
    open_: list[str] = []
    add = frames[-1].append
    operand = False  # whether an operand stands before, so that a slash divides

    def whole() -> str:
        return "".join(frames[0]) + "".join(s + "".join(f) for s, f in zip(open_, frames[1:]))

    while True:
        push = closer = ""
        if mode == "":
            m = match(text, at)
            if m is None:
                return _CLASH
            at = m.end()
            kind = m.lastgroup
            if kind == "word":
                word = m["word"]
                char = words.get(word)
                add("i" if char is None else char)
                operand = char is None or word not in _BEFORE_OPERAND
                continue
            if kind == "sign":
                sign = m["sign"]
                if script and not operand and sign[0] in "/<":
                    start = m.start("sign")
                    if sign[0] == "/" and (r := _REGEX.match(text, start)):
                        at, operand = r.end(), True
                        add("s")
                        continue
                    if sign[0] == "<" and tag_opens and (r := tag_opens.match(text, start)):
                        at, push, mode = r.end(), _ELEMENT, "text" if r[0] == "<>" else "tag"
                if not push:
                    add(signs[sign])
                    operand = sign in ("++", "--")
                    continue
            elif kind == "bracket":
                b = m["bracket"]
                if b in "([{":
                    push, operand = b, False
                else:
                    closer, operand = b, b != "}"
            elif kind == "line":
                if lines:
                    add(m["line"])
                continue
            elif kind == "comment":
                continue
            elif kind == "str":
                add("s")
                operand = True
                continue
            elif kind == "num":
                add("n")
                operand = True
                continue
            elif kind == "end":
                return whole(), "=", 0
            else:  # something of several lines opens
                groups = m.groupdict()
                if groups.get("f"):
                    mode = ("fr" if "r" in groups["f"].lower() else "f") + groups["q"]
                elif groups.get("raw") is not None:
                    mode = "#" + groups["raw"]
                else:
                    mode = groups.get("t") or groups["q"]
                if mode == "/*" and script and operand:
                    mode = "/*o"
                if mode == "/*" and language == "rust":
                    push = _COMMENT
        else:
            m = _stop(mode, language).search(text, at)
            if m is None:
                return whole(), "=" + mode, 0
            at, found = m.end(), m[0]
            if mode == "text":
                if found == "{":
                    push, mode = _HOLE_TEXT, ""
                elif found == "<>":
                    push = _INNER_ELEMENT
                elif found.startswith("</"):
                    closer = "x"
                elif len(found) > 1:
                    push, mode = _INNER_ELEMENT, "tag"
                else:
                    return _CLASH
            elif mode == "tag":
                if found == "{":
                    push, mode = _HOLE_TAG, ""
                elif found in ("'", '"'):
                    mode += found
                elif found == "/>":
                    closer = "x"
                elif found == ">":
                    mode = "text"
                elif len(found) == 1 and not (found.isalpha() or found.isspace() or found in "=_$"):
                    return _CLASH
            elif mode in ('tag"', "tag'"):
                mode = "tag"
            elif mode in ("/*", "/*o"):
                if found == "/*":
                    push = _INNER_COMMENT
                elif language == "rust":
                    closer = "y"
                else:
                    mode, operand = "", mode == "/*o"
            elif found == "${":
                push, mode = _HOLE_TEMPLATE, ""
            elif found == "{":
                push, mode = _HOLES_FORMATTED[mode], ""
            elif found == "\n":
                return _CLASH
            elif found == "`" or found == mode or found == mode.lstrip("fr") or mode[0] == "#":
                add(lang.template if found == "`" and script else "s")
                mode, operand = "", True
            if mode == "" and push:
                operand = False
        if push:
            open_.append(push)
            frames.append([])
            add = frames[-1].append
        elif closer:
            if not open_:
                return whole(), closer, begin + at
            symbol = open_.pop()
            content = "".join(frames.pop())
            add = frames[-1].append
            if RETURNS[symbol][0] != closer or (done := lang.close(symbol, content)) is None:
                return _CLASH
            add(done[0])
            mode = done[1]
            operand = operand if closer in ")]}" else True


def joined(a: Effect, b: Effect, language: str) -> Effect:
    """The effect of one piece after another. Associative."""
    lang = code(language)
    begin, accounts = a
    follow = b[1]
    out = {}
    for key, account in accounts.items():
        if account[1][0] != "=":
            out[key] = account
            continue
        parts = _OPEN_THING.split(account[0])
        frames, open_ = parts[::2], parts[1::2]
        here = (b[0], account[1][1:])
        while True:
            tokens, end, to = follow.get(here, _CLASH)
            if end == "!":
                out[key] = _CLASH
                break
            more = _OPEN_THING.split(tokens)
            frames[-1] += more[0]
            frames += more[2::2]
            open_ += more[1::2]
            if end[0] == "=" or not open_:
                out[key] = (frames[0] + "".join(s + f for s, f in zip(open_, frames[1:])), end, to)
                break
            symbol, content = open_.pop(), frames.pop()
            if RETURNS[symbol][0] != end or (done := lang.close(symbol, content)) is None:
                out[key] = _CLASH
                break
            frames[-1] += done[0]
            here = (to, done[1])
    if begin == 0:
        return begin, {k: v if v[1] not in RETURNING else _CLASH for k, v in out.items()}
    out |= {k: v for k, v in follow.items() if k[0] != b[0]}
    return begin, _reached(begin, out)


def _reached(begin: int, accounts: dict[tuple[int, str], Account]) -> dict[tuple[int, str], Account]:
    places: dict[int, list[tuple[int, str]]] = {}
    for key in accounts:
        places.setdefault(key[0], []).append(key)
    seen, todo = {}, [begin]
    while todo:
        for key in places.pop(todo.pop(), ()):
            seen[key] = accounts[key]
            if accounts[key][1] in RETURNING:
                todo.append(accounts[key][2])
    return seen


def _blocks(lines: list[str], lang: _Code) -> str | None:
    """Python's lines with each indented block as one symbol; None where the indentation or a block can't be."""
    stack: list[tuple[int, int, list[str]]] = [(0, 0, [])]
    for line in lines:
        rest = line.lstrip(" \t")
        if not rest:
            continue
        blank = line[: len(line) - len(rest)]
        wide, narrow = len(blank.expandtabs(8)), len(blank.expandtabs(1))
        if wide > stack[-1][0]:
            if narrow <= stack[-1][1]:
                return None
            stack.append((wide, narrow, []))
        else:
            while wide < stack[-1][0]:
                symbol = lang.grammar.group("I", "".join(stack.pop()[2]))
                if symbol is None:
                    return None
                stack[-1][2].append(symbol)
            if (wide, narrow) != stack[-1][:2]:
                return None
        stack[-1][2].append(rest + "\n")
    while len(stack) > 1:
        symbol = lang.grammar.group("I", "".join(stack.pop()[2]))
        if symbol is None:
            return None
        stack[-1][2].append(symbol)
    return "".join(stack[0][2])


def parses(whole: Effect, language: str) -> bool:
    """Whether a file with this effect leaves nothing open and its statements parse. Blank and comment-only text does."""
    tokens, end, _ = whole[1].get((0, ""), _CLASH)
    if end != "=" or _OPEN_THING.search(tokens):
        return False
    lang = code(language)
    if language == "python":
        statements = _blocks(tokens.split("\n"), lang)
        return statements is not None and lang.grammar.matches(lang.grammar.start, statements)
    tokens = lang.tidy(tokens)
    return not tokens.strip("\n") or lang.grammar.matches(lang.grammar.start, tokens)
