"""Functions of one source text with the documentation their language attaches to them.

Per language one recursive pattern captures documentation, signature and balanced body together. Strings and
comments are alternatives of the same pattern, so that nothing inside them is taken for code.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import regex


class Pair(NamedTuple):
    line: int
    name: str
    kind: str
    signature: str
    documentation: str
    code: str


_STRINGS = r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'"
_NOTES = r"//[^\n]*|/\*.*?\*/"


def _nesting(strings: str, notes: str) -> str:
    """Groups in brackets, whose content protects strings and comments."""
    one = lambda name, o, c: rf"(?P<{name}>{o}(?:[^()\[\]{{}}\"'`/#]|{strings}|{notes}|(?&round)|(?&square)|(?&curly)|[\"'`/#])*+{c})"
    return rf"(?(DEFINE){one('round', chr(92) + '(', chr(92) + ')')}{one('square', chr(92) + '[', chr(92) + ']')}{one('curly', chr(92) + '{', chr(92) + '}')}(?P<angle><(?:[^<>(){{}};]|(?&angle)|(?&round)|=>)*+>))"


_TEMPLATE = r"`(?:[^`\\]|\\.)*`"
_SCRIPT_STRINGS = rf"{_STRINGS}|{_TEMPLATE}"
_TYPE = r"(?:[^(){}\[\];=<>,/\"']|(?&round)|(?&square)|(?&angle)|(?&curly)(?=\s*[\[|&{])|=>)++"
_NOT_A_NAME = r"(?!(?:if|for|while|switch|catch|function|return|with|do|else|new|typeof|await|class|throw|case|super|import)\b)"
_ARROW_TYPE = r"(?:[^(){}\[\];=<>,/\"']|(?&round)\s*=>|(?&round)|(?&square)|(?&angle)|(?&curly)(?=\s*[\[|&=]))++"
_RESULT = rf"(?:\s*:\s*{_TYPE})?"
#: What an arrow that opens no block returns: up to the end of the statement or list item; lines go on with an operator.
_RETURNED = rf"(?:(?&round)|(?&square)|(?&curly)|{_SCRIPT_STRINGS}|=>|[^\s()\[\]{{}};,\"'`]|[^\S\n]|\n(?=\s*[.?:&|+*/=]))++"
_BODY = r"(?=(?P<body>(?&curly)))"
_ARROW_BODY = rf"(?=(?P<body>(?&curly)|(?=[^\s{{{{]){_RETURNED}))"
_ARROW = rf"(?:async\s*)?(?:(?&angle)?\s*(?&round)(?:\s*:\s*{_ARROW_TYPE})?|[\w$]+)\s*=>\s*"

SCRIPT = regex.compile(
    _nesting(_SCRIPT_STRINGS, _NOTES)
    + rf"""(?P<doc>/\*\*(?!/)(?:(?!\*/).)*+\*/)(?:\s|//[^\n]*|/\*(?!\*).*?\*/|@[\w$.]+(?&round)?)*+
    (?P<sig>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:
        (?P<function>(?:async\s+)?function\s*\*?\s*)(?P<name>[\w$]+)\s*(?&angle)?\s*(?&round){_RESULT}\s*{_BODY}
      | (?P<bound>(?:const|let|var)\s+)(?P<name>[\w$]+)(?:\s*:\s*{_TYPE})?\s*=\s*(?:(?:async\s+)?function\s*\*?\s*[\w$]*\s*(?&angle)?\s*(?&round){_RESULT}\s*{_BODY}|{_ARROW}{_ARROW_BODY})
      | (?:(?:public|private|protected|static|readonly|abstract|override|async|get|set|accessor)\s+)*+\*?\s*{_NOT_A_NAME}(?P<name>[\#\w$]+)\s*(?:
            \??(?&angle)?\s*(?&round){_RESULT}\s*{_BODY}
          | (?:[?!]?\s*:\s*{_TYPE})?\s*=\s*{_ARROW}{_ARROW_BODY}
          | \s*:\s*(?:(?:async\s+)?function\s*\*?\s*[\w$]*\s*(?&round)\s*{_BODY}|{_ARROW}{_ARROW_BODY})
      )
    ))
    | (?:@[\w.$]+\s*(?&round)?|\b(?:public|private|protected|static|abstract|async|export|default)\b)\s*/\*\*(?!/)(?:(?!\*/).)*+\*/
    | {_NOTES} | {_SCRIPT_STRINGS}""",
    regex.S | regex.X,
)

_MARK = r"@(?!interface\b)[\w.]+(?:\s*(?&round))?"
JAVA = regex.compile(
    _nesting(rf'"""(?:[^\\]|\\.)*?"""|{_STRINGS}', _NOTES)
    + rf"""(?P<doc>/\*\*(?!/)(?:(?!\*/).)*+\*/)(?:\s|//[^\n]*|/\*(?!\*).*?\*/)*+
    (?P<sig>(?:(?:{_MARK}|(?:public|private|protected|static|final|abstract|synchronized|native|strictfp|default)\b|//[^\n]*|/\*.*?\*/)\s*)*+(?:(?&angle)\s*)?
        (?:(?!(?:new|return|throw|else|class|interface|enum|record)\b)[\w.]+(?:\s*(?&angle))?(?:\.\w+)*(?:\s*(?:{_MARK}\s*)?\[\s*\])*\s+)?(?!(?:if|for|while|switch|catch|try|synchronized)\b)(?P<name>\w+)\s*(?&round)\s*
        (?:\[\s*\]\s*)*(?:throws\s+[\w.,\s<>@]+?)?\s*(?=(?P<body>(?&curly))))
    | (?:@[\w.]+\s*(?&round)?|\b(?:public|private|protected|static|final|abstract|synchronized|native|default)\b)\s*/\*\*(?!/)(?:(?!\*/).)*+\*/
    | {_NOTES} | \"\"\"(?:[^\\]|\\.)*?\"\"\" | {_STRINGS}""",
    regex.S | regex.X,
)

GO = regex.compile(
    _nesting(r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|' + r"'(?:[^'\\\n]|\\.)+'", _NOTES)
    + rf"""(?m:^)(?P<doc>(?:[ \t]*+(?://[^\n]*|/\*(?:(?!\*/).)*+\*/[ \t]*+(?://[^\n]*)?)\n)++)
    (?P<sig>func\s*(?P<recv>(?&round)\s*)?(?P<name>\w+)\s*(?:(?&square)\s*)?(?&round)\s*(?:(?&round)|[\w.*\[\]<\-\s]|(?&square)|(?:func\s*(?&round))|(?:interface|struct)\s*(?&curly))*?\s*(?=(?P<body>(?&curly))\s*?(?:\n|;|//|/\*|\Z)))
    | {_NOTES} | "(?:[^"\\\n]|\\.)*" | `[^`]*` | '(?:[^'\\\n]|\\.)+'""",
    regex.S | regex.X,
)

_RUST_STRINGS = r"""\b(?:br|cr|r)\#*(?:"(?:[^"])*"\#*)|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'"""
_RUST_ATTR = r"\#!?\s*(?&square)"
RUST = regex.compile(
    _nesting(_RUST_STRINGS, _NOTES)
    + rf"""(?P<doc>(?:(?:///(?!/)[^\n]*(?:\n|\Z)|/\*\*(?![*/])(?:(?!\*/).)*+\*/|{_RUST_ATTR}|//(?![/!])[^\n]*|////[^\n]*|/\*(?![*!]).*?\*/|/\*\*\*.*?\*/)\s*)++)?+
    (?P<sig>(?:pub\b\s*(?&round)?\s*)?(?:default\s+)?(?:(?:const|async|unsafe|extern(?:\s*"[^"]*")?)\s+)*fn\s+(?P<name>(?:r\#)?\w+)\s*(?&angle)?\s*(?&round)\s*(?:->(?:[^{{}};"\[]|(?&square)|(?&curly)(?=\s*[>\],]))+?)?(?:\bwhere\b[^{{}};]*)?\s*(?=(?P<body>(?&curly))))
    | (?P<skip>///[^\n]*|{_NOTES}|{_RUST_ATTR}) | {_RUST_STRINGS}""",
    regex.S | regex.X,
)

_PY_STRING = r"(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")"
PYTHON = regex.compile(
    rf"""(?(DEFINE)(?P<round>[(\[{{](?:[^()\[\]{{}}\"'\#]|{_PY_STRING}|\#[^\n]*|(?&round))*+[)\]}}])(?P<line>(?:[^\n\"'\#()\[\]{{}}\\]|{_PY_STRING}|\#[^\n]*|(?&round)|\\.)*+))
    (?m:^)(?P<indent>[ \t]*+)(?P<sig>(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:(?&round)[ \t]*)?(?&round)[ \t]*(?:->(?:[^:\n\"'()\[\]{{}}]|{_PY_STRING}|(?&round))+)?)
    :[ \t]*(?:\#[^\n]*)?(?:\n[ \t]*(?:\#[^\n]*)?)*+(?P<doc>(?:[rRuUbBfFtT]{{0,2}}{_PY_STRING}(?:[ \t]|\\\n)*+)++)(?=\n|;|\#|\Z)
    (?=(?P<rest>(?&line)(?:\n(?:[ \t]*+(?=\#|\n|\Z)|(?P=indent)[ \t]++)(?&line))*+))
    | \#[^\n]* | [rRuUbBfFtT]{{0,2}}{_PY_STRING}""",
    regex.S | regex.X,
)
_PY_PART = regex.compile(rf"(?P<prefix>[rRuUbBfFtT]{{0,2}}){_PY_STRING}", regex.S)


def _block(comment: str) -> str:
    """Text of a /** */ or /* */ comment without its frame."""
    inner = regex.sub(r"^/\*+!?|\*+/\s*$", "", comment)
    return "\n".join(regex.sub(r"^\s*\*+ ?", "", line) if i else line for i, line in enumerate(inner.split("\n"))).strip()


def _python(text: str) -> Iterator[Pair]:
    for m in PYTHON.finditer(text):
        if m["sig"] is None:
            continue
        parts = [p["prefix"].lower() for p in _PY_PART.finditer(m["doc"])]
        if any(set(p) & set("bft") for p in parts):
            continue
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                doc = ast.literal_eval(f"({m['doc']})")
        except (SyntaxError, ValueError):
            continue
        yield Pair(text.count("\n", 0, m.start("name")) + 1, m["name"], "method" if m["indent"] else "function", m["sig"].strip(), doc.strip(), (text[m.start("sig") : m.start("doc")].rstrip() + text[m.end("doc") : m.end("rest")]).rstrip())


def _documented(pattern: regex.Pattern, text: str) -> Iterator[Pair]:
    """JSDoc and Javadoc."""
    at = 0
    while m := pattern.search(text, at):
        at = m.end()
        if not m.captures("name"):  # documentation of something else, or after what it should stand before
            continue
        function = pattern is SCRIPT and (m["function"] is not None or m["bound"] is not None)
        name = m.captures("name")[-1]
        yield Pair(text.count("\n", 0, m.starts("name")[-1]) + 1, name, "function" if function else "method", m["sig"].strip(), _block(m["doc"]), text[m.start("sig") : m.ends("body")[-1]])


def _go(text: str) -> Iterator[Pair]:
    for m in GO.finditer(text):
        if m["sig"] is None:
            continue
        doc = []
        for c in regex.finditer(r"//([^\n]*)|/\*(.*?)\*/", m["doc"], regex.S):
            if c[1] is None:
                doc.append(c[2].strip())
            elif not regex.match(r"(?:line |[a-z0-9]+:[a-z0-9]|export |extern )", c[1]):  # a directive is no text
                doc.append(c[1].strip())
        yield Pair(text.count("\n", 0, m.start("name")) + 1, m["name"], "method" if m["recv"] else "function", m["sig"].strip(), "\n".join(doc).strip(), text[m.start("sig") : m.end("body")])


def _rust(text: str) -> Iterator[Pair]:
    implements = [(m.start(), m.end()) for m in regex.finditer(_RUST_BLOCKS, text)]
    for m in RUST.finditer(text):
        if m["sig"] is None:
            continue
        doc = []
        for c in regex.finditer(r'///(?!/)([^\n]*)|/\*\*(?![*/])(.*?)\*/|\#\s*\[\s*doc\s*=\s*"((?:[^"\\]|\\.)*)"\s*\]|//[^\n]*|/\*.*?\*/', m["doc"] or "", regex.S):
            if c[1] is not None:
                doc.append(c[1].strip())
            elif c[2] is not None:
                doc.append(_block(f"/**{c[2]}*/"))
            elif c[3] is not None:
                doc.append(c[3].strip())
        inner = regex.match(r"\{\s*((?://![^\n]*\s*|/\*!.*?\*/\s*)+)", m["body"], regex.S)
        if inner:
            doc += [(c[1] if c[1] is not None else _block(f"/*!{c[2]}*/")).strip() for c in regex.finditer(r"//!([^\n]*)|/\*!(.*?)\*/", inner[1], regex.S)]
        if not doc:
            continue
        method = any(a < m.start("sig") < b for a, b in implements)
        yield Pair(text.count("\n", 0, m.start("name")) + 1, m["name"], "method" if method else "function", m["sig"].strip(), "\n".join(doc).strip(), text[m.start("sig") : m.end("body")])


_RUST_BLOCKS = regex.compile(_nesting(_RUST_STRINGS, _NOTES) + r"(?m:^)[ \t]*(?:pub\s+)?(?:unsafe\s+)?(?:impl|trait)\b[^{};]*(?&curly)", regex.S)

_BY_LANGUAGE = {
    "python": _python,
    "javascript": lambda t: _documented(SCRIPT, t),
    "typescript": lambda t: _documented(SCRIPT, t),
    "tsx": lambda t: _documented(SCRIPT, t),
    "java": lambda t: _documented(JAVA, t),
    "go": _go,
    "rust": _rust,
}


def documented_functions(text: str, language: str) -> Iterator[Pair]:
    """Functions and methods that have a body and any documentation, trivial or not."""
    yield from _BY_LANGUAGE[language](text.replace("\r\n", "\n").replace("\r", "\n"))


# What is trivial ----------------------------------------------------------------------------------------------

#: Comments that speak to tools; fixed values.
_SWITCH = regex.compile(
    r"^\s*(?:eslint|tslint|jshint|jslint|jscs|istanbul|prettier|stylelint|biome|deno|oxlint|c8|v8|webpack|@ts-|ts-|flow|noqa|pylint|flake8|mypy|pyright|ruff|type:\s*ignore|isort|yapf|"
    r"fmt:|black:|nosec|bandit|pragma|nolint|lint:|golint|gofmt|go:|\+build|noinspection|checkstyle|nosonar|@formatter|suppress|spotbugs|pmd|rustfmt|clippy|allow\(|deny\(|cbindgen|"
    r"coverage|cspell|spell-?checker|vim:|-\*-|region\b|endregion\b|language=|sourcemappingurl)",
    regex.I,
)
_PLACEHOLDER = regex.compile(
    r"^\W*(?:to-?do|fix-?me|xxx|hack|tbd|tba|wip|n/?a|none|null|nil|nothing|undefined|undocumented|placeholder|empty|missing|lorem ipsum.*|"
    r"(?:add|write|insert|put|needs?|missing|no|document|describe|fill in|to be|not yet|todo)\b.*|(?:a |the |short |brief |function |method |class )*(?:description|docs?|docstring|documentation|summary|comment|text)(?: goes)?(?: here)?|"
    r"(?:auto-?|automatically )?generated(?: (?:method|function|constructor|javadoc))? ?(?:stub|comment|doc)?|\{?@?inheritdoc\}?|see (?:above|below)|same as above|ditto|function|method|constructor|\W*)\W*$",
    regex.I,
)
_MARKER = regex.compile(r"^\W*(?:TODO|FIXME|XXX|TBD|HACK)\b", regex.I)
_NOT_A_NEED = regex.compile(r"^\W*(?:adds?|writes?|inserts?|puts?|needs?|document|describe|no|not yet|to be|missing|fill in)\b", regex.I)
_FILLER = frozenset("a an the this that of for to and or in on is are be does do it its function method func fn constructor class helper returns return with from by".split())
_WORDS = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{L}+|\d+")


def _same_word(said: str, own: str) -> bool:
    """Equal but for an ending: maps, mapped, mapping and map; queries and query."""
    root = own[:-1] if len(own) > 3 else own
    return said.startswith(root) and len(said) - len(own) <= 3


def description(doc: str, language: str) -> str:
    """Documentation without its tag sections, switches and markup."""
    lines = []
    tags = regex.compile(r"^\s*(?:@(?!desc)\w+|\\(?:param|return)|:\w+(?:\s[^:]*)?:)", regex.I) if language != "rust" else regex.compile(r"^\s*$^")
    for line in doc.split("\n"):
        if tags.match(line):
            if language == "python":
                continue
            break
        if _SWITCH.match(line):
            continue
        lines.append(regex.sub(r"^\s*@desc\w*\s*", "", line))
    text = "\n".join(lines)
    return regex.sub(r"\{@\w+\s*([^}]*)\}|</?[a-zA-Z][^<>]*>", r" \1 ", text).strip()


def trivial(doc: str, name: str, language: str) -> bool:
    """Empty, a placeholder, only tags or tool switches, or only the words of the function's name."""
    text = description(doc, language)
    if not regex.search(r"[\p{L}\p{N}]", text):
        return True
    flat = " ".join(text.split())
    if _MARKER.match(flat) and len(flat) < 80:
        return True
    if _PLACEHOLDER.match(flat) and (len(flat.split()) <= 7 or not _NOT_A_NEED.match(flat)):
        verbs = _NOT_A_NEED.match(flat)
        about = r"\b(?:docs?|docstrings?|documentation|documented|document|descriptions?|described|describe|comments?|text|summary|todo|yet|me|this|here|filled|written|done)\b"
        if not verbs or regex.search(about, flat, regex.I) or len(flat.split()) <= 2:
            return True
    own = [w.lower() for w in _WORDS.findall(name)]
    own.append("".join(own))
    said = [w.lower() for w in _WORDS.findall(flat)]
    return all(w in _FILLER or any(_same_word(w, o) for o in own) for w in said)
