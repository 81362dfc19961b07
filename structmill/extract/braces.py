"""JavaScript, TypeScript, Go, Java and Rust: declarations by patterns over text whose strings and comments are blanked.

A table per language says what declares a symbol, an import or an export; spans end at the brace that closes them.
Comments right above a declaration are its documentation.
"""

from __future__ import annotations

import bisect
import re

from structmill.extract.model import Call, Export, Extraction, Import, Symbol

_BLANK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""", re.S)
_RUST_BLANK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'""", re.S)
_CALL = re.compile(r"(?<![\w$])((?:new\s+)?[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(")
_NO_CALL = frozenset("if for while switch catch function return func fn match when super typeof sizeof await new import require constructor else do".split())

#: kind -> pattern; the group ``name`` names the symbol. Patterns are tried at line starts.
_DECLARED: dict[str, list[tuple[str, re.Pattern]]] = {
    "script": [
        ("class", re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)", re.M)),
        ("interface", re.compile(r"^(?:export\s+)?(?:default\s+)?interface\s+(?P<name>[\w$]+)", re.M)),
        ("enum", re.compile(r"^(?:export\s+)?(?:default\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)", re.M)),
        ("type_alias", re.compile(r"^(?:export\s+)?type\s+(?P<name>[\w$]+)[^=\n]*=", re.M)),
        ("function", re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)", re.M)),
        ("function", re.compile(r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)[^=\n]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=\n]*=>|[\w$]+\s*=>)", re.M)),
        ("constant", re.compile(r"^(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]*)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:function\b|\())", re.M)),
        ("method", re.compile(r"^[ \t]+(?P<access>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*)\*?(?P<name>[#\w$]+)\s*(?:<[^>\n]*>)?\([^{};]*\)\s*(?::[^{};=\n]+)?\{", re.M)),
    ],
    "go": [
        ("method", re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?(?P<parent>\w+)[^)]*\)\s*(?P<name>\w+)", re.M)),
        ("function", re.compile(r"^func\s+(?P<name>\w+)", re.M)),
        ("struct", re.compile(r"^(?:type\s+|\t)(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b", re.M)),
        ("interface", re.compile(r"^(?:type\s+|\t)(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", re.M)),
    ],
    "java": [
        ("class", re.compile(r"^\s*(?P<access>(?:(?:public|private|protected|static|final|abstract)\s+)*)(?:class|record)\s+(?P<name>\w+)", re.M)),
        ("interface", re.compile(r"^\s*(?P<access>(?:(?:public|private|protected|static|abstract)\s+)*)interface\s+(?P<name>\w+)", re.M)),
        ("enum", re.compile(r"^\s*(?P<access>(?:(?:public|private|protected|static)\s+)*)enum\s+(?P<name>\w+)", re.M)),
        ("constant", re.compile(r"^\s*(?P<access>(?:(?:public|private|protected)\s+)?)(?:static\s+final|final\s+static)\s+[\w<>\[\], ]+?\s(?P<name>[A-Z][A-Z0-9_]*)\s*=", re.M)),
        ("method", re.compile(r"^\s+(?P<access>(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]+>\s*)?(?:[\w.]+(?:<[^()]*>)?(?:\[\])*\s+)?(?P<name>\w+)\s*\([^{};]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]", re.M)),
    ],
    "rust": [
        ("struct", re.compile(r"^[ \t]*(?P<access>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", re.M)),
        ("enum", re.compile(r"^[ \t]*(?P<access>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", re.M)),
        ("trait", re.compile(r"^[ \t]*(?P<access>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)", re.M)),
        ("type_alias", re.compile(r"^(?P<access>pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", re.M)),
        ("constant", re.compile(r"^[ \t]*(?P<access>pub(?:\([^)]*\))?\s+)?const\s+(?P<name>[A-Z]\w*)\s*:", re.M)),
        ("function", re.compile(r"^[ \t]*(?P<access>pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)", re.M)),
    ],
}
_OWNERS = {
    "script": re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", re.M),
    "java": re.compile(r"^\s*(?:\w+\s+)*(?:class|interface|enum|record)\s+(\w+)", re.M),
    "rust": re.compile(r"^[ \t]*(?:unsafe\s+)?(?:impl(?:<[^>\n]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?|(?:pub(?:\([^)]*\))?\s+)?trait\s+)(\w+)", re.M),
}


def family(language: str) -> str:
    return "script" if language in ("javascript", "typescript") else language


def blanked(text: str, language: str) -> str:
    """The text with every string and comment replaced by blanks of the same length and line ends."""
    pattern = _RUST_BLANK if language == "rust" else _BLANK
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closing(code: str, start: int) -> int:
    """Where the braces that open at or after start close again; the end of the statement if none open."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif depth == 0:
            return m.start()
    return len(code) - 1


#: What opens a function inside a function; group 1 is its brace, if it has one.
_INNER = {
    "script": re.compile(r"\bfunction\b[^{;]*?(\{)|=>\s*(\{)?"),
    "go": re.compile(r"\bfunc\s*\([^{}]*?(\{)"),
    "java": re.compile(r"->\s*(\{)?|\b(?:class|interface|enum|record)\s+\w+[^{;]*?(\{)"),
    "rust": re.compile(r"\bfn\s+\w+[^{;]*?(\{)|(?:(?<=[(,={;:])|\bmove\b|\breturn\b)\s*\|[^|\n]*\|\s*(?:->[^{;]*)?(\{)?"),
}


def _inner(code: str, start: int, end: int, kind: str) -> list[tuple[int, int]]:
    """The bodies of functions inside a function's body; an arrow's expression ends with its list item or statement."""
    out, at = [], start + 1
    while m := _INNER[kind].search(code, at, end):
        if m[m.lastindex or 0] == "{":
            stop = _closing(code, m.start(m.lastindex))
        else:
            depth, stop = 0, end
            for b in re.compile(r"[()\[\]{},;]").finditer(code, m.end(), end):
                if b[0] in "([{":
                    depth += 1
                elif depth and b[0] in ")]}":
                    depth -= 1
                elif not depth:
                    stop = b.start()
                    break
        out.append((m.start(), stop))
        at = max(stop, m.end())
    return out


def _go_constants(code: str, text: str, line_of) -> list[Symbol]:
    """Constants, grouped or not, with every name of a line."""
    found = []
    for m in re.finditer(r"^const\s*(\()?", code, re.M):
        lines = [(m.end(), code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code))]
        if m[1]:
            depth, stop = 1, len(code)
            for b in re.compile(r"[()]").finditer(code, m.end()):
                depth += 1 if b[0] == "(" else -1
                if not depth:
                    stop = b.start()
                    break
            lines = [(m.end() + x.start(), m.end() + x.end()) for x in re.finditer(r"[^\n;]+", code[m.end() : stop])]
        for a, b in lines:
            if names := re.match(r"\s*(\w+(?:\s*,\s*\w+)*)", code[a:b]):
                row = line_of(a + names.start(1))
                for name in re.findall(r"\w+", names[1]):
                    if name != "_":
                        found.append(Symbol(name, "constant", row, row, text[a:b].strip(), _visibility("go", "constant", name, "", False), None, None, [], None))
    return found


def _documentation(lines: list[str], row: int, language: str) -> str | None:
    """Comment lines right above a row (from 0); annotations and attributes in between are skipped."""
    at = row - 1
    while at >= 0 and re.match(r"\s*(?:@\w|#\[)", lines[at]):
        at -= 1
    found: list[str] = []
    if at >= 0 and lines[at].rstrip().endswith("*/"):
        end = at
        while at > 0 and "/*" not in lines[at]:
            at -= 1
        block = "\n".join(lines[at : end + 1])
        if language == "go" or block.lstrip().startswith("/**"):
            found = [re.sub(r"^\s*(?:/\*+|\*/|\*)?\s?|\*/\s*$", "", x) for x in block.split("\n")]
    elif language in ("go", "rust"):
        mark = r"\s*///(?!/)" if language == "rust" else r"//(?!go:)"
        while at >= 0 and re.match(mark, lines[at]):
            if not re.match(r"\s*//+\s*(?:WHY|NOTE|IMPORTANT|HACK|TODO|FIXME)\s*:", lines[at]):
                found.insert(0, re.sub(r"^\s*//+\s?", "", lines[at]))
            at -= 1
    return "\n".join(found).strip() or None


def _visibility(language: str, kind: str, name: str, access: str, exported: bool) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if re.match(r"pub\s*$", access.strip() or "-") else "package" if access.strip() else "private"
    if language == "java":
        return next((v for v in ("public", "private", "protected") if v in access), "package")
    for v in ("public", "private", "protected"):
        if v in access:
            return v
    if kind == "method":
        return "private" if name.startswith(("_", "#")) else "public"
    return "public" if exported else "unknown"


def _parameters(signature: str, language: str) -> list[tuple]:
    m = re.search(r"\(([^()]*)\)\s*(?:->.*|:.*|\w.*)?$", signature) if language != "go" else re.search(r"\w\s*\(([^()]*)\)", signature)
    out = []
    for part in filter(None, (p.strip() for p in (m[1] if m else "").split(","))):
        value = None
        if "=" in part and "=>" not in part:
            part, value = (x.strip() for x in part.split("=", 1))
        if language in ("rust", "typescript", "javascript"):
            name, _, kind = part.partition(":")
        elif language == "java":
            kind, _, name = part.rpartition(" ")
        else:
            name, _, kind = part.partition(" ")
        out.append((name.strip(), kind.strip() or None, value))
    return out


def _used(prefix: str, path: str) -> list[tuple[str, str, str | None]]:
    """(module, name, alias) of every leaf of a use tree."""
    head, brace, group = path.partition("{")
    if not brace:
        base, _, alias = path.partition(" as ")
        whole = prefix + base.strip()
        module, _, last = whole.rpartition("::")
        return [(module or last, last if module else "", alias.strip() or None)]
    parts, depth, start = [], 0, 0
    inner = group[: group.rindex("}")] if "}" in group else group
    for i, c in enumerate(inner + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(inner[start:i].strip())
            start = i + 1
    return [leaf for part in parts if part for leaf in _used(prefix + head.strip(), part)]


def _imports(text: str, code: str, language: str, line_of) -> list[Import]:
    out: list[Import] = []
    if family(language) == "script":
        for m in re.finditer(r"^[ \t]*(import|export)\s+(type\s+)?([^;'\"]*?)\s*(?:from\s*)?[\"']([^\"'\n]+)[\"']", text, re.M):
            if code[m.start(1)] == " " or (m[1] == "export" and "from" not in m[0]):
                continue
            kind = "import_type" if m[2] else "re_export" if m[1] == "export" else "import"
            clause, line = m[3], line_of(m.start(1))
            braces = re.search(r"\{([^}]*)\}", clause)
            outside = re.sub(r"\{[^}]*\}", "", clause).strip(" ,")
            specs = [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", s.strip())) for s in (braces[1].split(",") if braces else []) if s.strip()]
            plain = [s[0] for s in specs if len(s) == 1]
            if plain or not (specs or outside):
                out.append(Import(m[4], plain, None, line, kind))
            out += [Import(m[4], [s[0]], s[1], line, kind) for s in specs if len(s) == 2]
            for o in filter(None, (x.strip() for x in outside.split(","))):
                star = re.match(r"\*(?:\s+as\s+(\S+))?", o)
                out.append(Import(m[4], ["*"], star[1], line, kind) if star else Import(m[4], [], o, line, kind))
        for m in re.finditer(r"(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*[\"']([^\"'\n]+)[\"']\s*\)", text):
            names = [x.strip().split(":")[0].strip() for x in (m[2] or "").split(",") if x.strip()]
            out.append(Import(m[3], names, m[1], line_of(m.start()), "require"))
    elif language == "go":
        for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|([^\n]*))", text, re.M):
            for s in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", m[1] or m[2] or ""):
                out.append(Import(s[2], [], s[1], line_of((m.start(1) if m[1] is not None else m.start(2)) + s.start()), "import"))
    elif language == "java":
        for m in re.finditer(r"^import\s+(static\s+)?([\w.]+?)(?:\.(\w+|\*))?\s*;", text, re.M):
            out.append(Import(m[2], [m[3]] if m[3] else [], None, line_of(m.start()), "static_import" if m[1] else "import"))
    else:
        for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M):
            path, line = re.sub(r"\s+", " ", m[1].strip()), line_of(m.start())
            by_module: dict[str, list[str]] = {}
            for module, name, alias in _used("", path):
                if alias:
                    out.append(Import(module, [name], alias, line, "use"))
                else:
                    by_module.setdefault(module, []).append(name)
            out += [Import(module, [n for n in names if n], None, line, "use") for module, names in by_module.items()]
    return out


_LISTED, _STAR = re.compile(r"\s*\{([^}]*)\}\s*(from)?"), re.compile(r"\s*\*")


def _exports(code: str, line_of) -> list[Export]:
    out = []
    for m in re.finditer(r"^export\s+(?:(default)\s+)?(type\s+)?(?:(?:abstract|async|declare)\s+)*(?:(?:function\s*\*?|class|interface|enum|const|let|var|namespace)\s*)?([\w$]+)?", code, re.M):
        if m[1]:
            out.append(Export(m[3] or "<default>", "default", line_of(m.start())))
        elif m[3]:
            out.append(Export(m[3], "type" if m[2] else "named", line_of(m.start())))
        elif group := _LISTED.match(code, m.end()):
            for spec in filter(None, (x.strip() for x in group[1].split(","))):
                out.append(Export(re.split(r"\s+as\s+", spec)[-1], "re_export" if group[2] else "named", line_of(m.start())))
        elif _STAR.match(code, m.end()):
            out.append(Export("*", "re_export", line_of(m.start())))
    return out


def extract(text: str, language: str) -> Extraction:
    code, lines = blanked(text, language), text.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    kind_of = family(language)
    owners = []
    if kind_of in _OWNERS:
        owners = [(m.start(1), _closing(code, m.end()), m[1]) for m in _OWNERS[kind_of].finditer(code)]
    exports = _exports(code, line_of) if kind_of == "script" else []
    public = {e.name for e in exports}
    symbols, bodies = [], []
    for kind, pattern in _DECLARED[kind_of]:
        if language == "javascript" and kind in ("interface", "enum", "type_alias", "constant"):
            continue
        for m in pattern.finditer(code):
            name, at = m["name"], m.start("name")
            if name in _NO_CALL and not (kind == "method" and name == "constructor"):
                continue
            groups = m.groupdict()
            owner = groups.get("parent") or next((o for a, b, o in reversed(owners) if a < at < b), None)
            if kind == "method" and owner is None:
                continue
            what = "method" if kind_of == "rust" and kind == "function" and owner else kind
            body = m.end() - 1 if code[m.end() - 1] in "{;" else m.end()
            end = _closing(code, body)
            head_end = code.find("{", m.start("name"), end + 1)
            signature = re.sub(r"\s+", " ", text[m.start() : head_end if head_end > 0 else min(end, m.end())]).strip().rstrip("{; ")
            row = line_of(at)
            parent = owner if what in ("method", "constant") and kind_of != "go" or groups.get("parent") else None
            returned = re.search(r"(?:->|\)\s*:)\s*([^{]+)$", signature)
            symbols.append(
                Symbol(name, what, row, line_of(end), signature, _visibility(language, what, name, groups.get("access") or "", name in public), parent, _documentation(lines, line_of(m.start() + len(m[0]) - len(m[0].lstrip())) - 1, language), _parameters(signature, language) if what in ("function", "method") else [], returned[1].strip() if returned else None)
            )
            if what in ("function", "method") and head_end > 0:
                bodies.append((f"{parent}.{name}" if parent else name, head_end, end))
    if language == "go":
        symbols += _go_constants(code, text, line_of)
    symbols.sort(key=lambda s: (s.line_start, s.line_end))
    calls = []
    for caller, a, b in sorted(bodies, key=lambda x: x[1]):
        inner = _inner(code, a, b, kind_of)
        for m in _CALL.finditer(code, a, b):
            if any(x <= m.start(1) < y for x, y in inner):
                continue
            callee = re.sub(r"^(?:this|self)\.", "", re.sub(r"\s+", " ", m[1]))
            if callee.split(".")[-1] not in _NO_CALL and not callee.endswith("!"):
                calls.append(Call(caller, callee, line_of(m.start(1)), 1.0 if re.match(r"^\w+$", callee) else 0.7))
    return Extraction(symbols, _imports(text, code, language, line_of), exports, calls, [])
