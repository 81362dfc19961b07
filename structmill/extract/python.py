"""Python, by its own syntax tree. Functions, classes and methods one level deep; a decorated span starts at the decorator."""

from __future__ import annotations

import ast
import re
import warnings

from structmill.extract.model import Call, Extraction, Import, Symbol

_CONSTANT = re.compile(r"^[A-Z][A-Z0-9_]*$")


def _visibility(name: str) -> str:
    return "public" if not name.startswith("_") or (name.startswith("__") and name.endswith("__")) else "private"


def _parameters(a: ast.arguments) -> list[tuple]:
    text = lambda n: ast.unparse(n) if n is not None else None
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    out = [(p.arg, text(p.annotation), text(v)) for p, v in zip(plain, defaults)]
    if a.vararg:
        out.append((f"*{a.vararg.arg}", text(a.vararg.annotation), None))
    out += [(p.arg, text(p.annotation), text(v)) for p, v in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        out.append((f"**{a.kwarg.arg}", text(a.kwarg.annotation), None))
    return out


def _calls(node: ast.AST, caller: str) -> list[Call]:
    """Calls in a body, without those of nested functions and classes."""
    out, stack = [], list(ast.iter_child_nodes(node))[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if isinstance(n, ast.Call):
            callee = ast.unparse(n.func).removeprefix("self.")
            out.append(Call(caller, callee, n.lineno, 1.0 if "." not in callee else 0.7))
        stack.extend(list(ast.iter_child_nodes(n))[::-1])
    return out


def extract(text: str) -> Extraction:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return Extraction([], [], [], [], [f"Error at line {getattr(e, 'lineno', None) or 1}: {getattr(e, 'msg', 'cannot be parsed')}"])
    lines = text.split("\n")
    symbols, imports, calls = [], [], []

    def function(n, parent: str | None) -> None:
        first = min([n.lineno, *(x.lineno for x in n.decorator_list)])
        kind = "method" if parent else "function"
        returned = ast.unparse(n.returns) if n.returns else None
        symbols.append(Symbol(n.name, kind, first, n.end_lineno, lines[first - 1].strip().rstrip(":"), _visibility(n.name), parent, ast.get_docstring(n), _parameters(n.args), returned))
        for part in n.body:
            calls.extend(_calls(ast.Module([part], []), f"{parent}.{n.name}" if parent else n.name))

    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(n, None)
        elif isinstance(n, ast.ClassDef):
            first = min([n.lineno, *(x.lineno for x in n.decorator_list)])
            symbols.append(Symbol(n.name, "class", first, n.end_lineno, lines[first - 1].strip().rstrip(":"), _visibility(n.name), None, ast.get_docstring(n)))
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(m, n.name)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name) and _CONSTANT.match(t.id):
                    symbols.append(Symbol(t.id, "constant", n.lineno, n.end_lineno, lines[n.lineno - 1].strip(), _visibility(t.id)))
        elif isinstance(n, ast.Import):
            imports += [Import(a.name, [], a.asname, n.lineno, "import") for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            plain = [a.name for a in n.names if not a.asname]
            if plain:
                imports.append(Import(module, plain, None, n.lineno, "from_import"))
            imports += [Import(module, [a.name], a.asname, n.lineno, "from_import") for a in n.names if a.asname]
    return Extraction(symbols, imports, [], calls, [])
